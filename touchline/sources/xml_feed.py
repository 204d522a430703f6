"""The XML feed: match information, events and 25 Hz positions, one file per match.

Files pair up by the match id at the end of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import constants as K
from touchline import schemas
from touchline.functions import scalars as S
from touchline.operators import actions as E
from touchline.operators.trajectory import keep_pattern, step_distance
from touchline.session import materialise
from touchline.sources.files import Files, as_files, list_files

KINDS = {"info": "*matchinformation*.xml", "events": "*events_raw*.xml", "positions": "*positions_raw*.xml"}
#: A match without one of these files is incomplete.
REQUIRED = ("info", "events", "positions")
CORRUPT = "_corrupt_record"


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """All files of the feed with their match and kind."""
    forms = {kind: pattern.replace(".", "[.]").replace("*", "[^/]*") + "$" for kind, pattern in KINDS.items()}
    return list_files(
        spark, folder, K.SOURCE_XML, "*.xml", forms, F.regexp_extract("path", r"([^_/]+)[.]xml$", 1)
    )


def _read(spark: SparkSession, folder: str | Files, kind: str, tag: str, schema) -> DataFrame:
    """The elements ``tag`` of all files of a kind, with the text of those that do not parse."""
    files = as_files(folder)
    if tag in files.staged:
        return files.staged[tag]
    names = ["match_id", *schema.names, CORRUPT]
    fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    paths = files.of(kind, KINDS[kind])
    if not paths:
        return spark.createDataFrame([], T.StructType([T.StructField("match_id", T.StringType()), *fields.fields]))
    rows = spark.read.schema(fields).option("rowTag", tag).xml(paths)
    match_id = F.regexp_extract("_metadata.file_name", r"([^_]+)\.xml$", 1)
    return rows.select(match_id.alias("match_id"), *[F.col(f"`{c}`") for c in names[1:]])


def stage(spark: SparkSession, folder: str | Files) -> Files:
    """Parse events and positions once and write them; all readers then take the written rows."""
    files = as_files(folder)
    return files.with_staged(
        Event=materialise(_read(spark, files, "events", "Event", schemas.EVENT).withColumn("row_id", F.monotonically_increasing_id())),
        FrameSet=materialise(_read(spark, files, "positions", "FrameSet", schemas.FRAME_SET)),
    )


def incomplete(spark: SparkSession, folder: str | Files) -> DataFrame:
    """(match_id, reason) of files that do not end with the closing tag of their first element.

    The first and the last line of a file follow from the block and the place of the row in its task,
    so large files are read in parallel and never held as a whole.
    """
    files = as_files(folder)
    paths = [path for kind, pattern in KINDS.items() for path in files.of(kind, pattern)]
    if not paths:
        return spark.createDataFrame([], "match_id string, reason string")
    at = F.struct("block", "line")
    tag = F.regexp_extract("value", r"<([A-Za-z_:][^\s/>]*)", 1)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"),
    )
    ends = lines.filter("value <> ''").groupBy("file").agg(
        F.min_by(tag, F.when(tag != "", at)).alias("root"), F.max_by("value", at).alias("last")
    )
    closed = F.endswith("last", F.concat(F.lit("</"), F.col("root"), F.lit(">")))
    return ends.filter(~F.coalesce(closed, F.lit(False))).select(
        F.regexp_extract("file", r"([^_]+)\.xml$", 1).alias("match_id"),
        F.concat("file", F.lit(": does not end with its closing tag")).alias("reason"),
    )


def malformed(spark: SparkSession, staged: Files) -> DataFrame:
    """(match_id, reason) of staged elements that did not parse."""
    out = None
    for tag, rows in staged.staged.items():
        found = rows.filter(F.col(CORRUPT).isNotNull()).groupBy("match_id").agg(F.min(CORRUPT).alias("text"))
        reason = F.concat(F.lit(f"malformed {tag}: "), F.left("text", F.lit(200)))
        part = found.select("match_id", reason.alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def _score(pair: Column, side: int) -> Column:
    parts = F.split(pair, ":")
    return F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(side))).try_cast("int"))


def _both(pair: Column, side: int) -> Column:
    """One side of a score, null unless both sides are numbers."""
    return F.when(_score(pair, 0).isNotNull() & _score(pair, 1).isNotNull(), _score(pair, side))


def matches(spark: SparkSession, folder: str | Files) -> DataFrame:
    general = _read(spark, folder, "info", "General", schemas.GENERAL)
    place = _read(spark, folder, "info", "Environment", schemas.ENVIRONMENT)
    competition = S.lookup(F.col("_CompetitionId"), K.COMPETITION_XML, F.coalesce("_CompetitionId", F.lit("")))
    halves = [F.col(c) for c in ("_ResultFirstHalf", "_ResultSecondHalf")]
    out = general.select(
        "match_id",
        F.lit(K.SOURCE_XML).alias("source"),
        competition.alias("competition"),
        F.col("_CompetitionId").alias("competition_id"),
        F.col("_CompetitionName").alias("competition_name"),
        F.col("_Season").alias("season_name"),
        F.col("_SeasonId").alias("season_id"),
        F.col("_MatchDay").try_cast("int").alias("match_day"),
        S.iso_normalise(F.col("_KickoffTime")).alias("kickoff_time_utc"),
        F.col("_HomeTeamId").alias("home_team_id"),
        F.col("_GuestTeamId").alias("away_team_id"),
        _both(F.col("_Result"), 0).alias("home_score"),
        _both(F.col("_Result"), 1).alias("away_score"),
        *[
            _both(half, side).alias(f"{name}_{team}")
            for half, name in zip(halves, ("first_half", "second_half"))
            for side, team in ((0, "home"), (1, "away"))
        ],
        F.lit("in_stadium").alias("tracking_type"),
        F.lit(K.TRACKER_XML).alias("tracking_name_original"),
        F.lit(25).alias("fps_original"),
        F.lit(10).alias("fps_output"),
        F.lit("native").alias("ball_status_source"),
    )
    place = place.select(
        "match_id",
        F.coalesce("_PitchX", F.lit(K.DEFAULT_PITCH_LENGTH)).alias("pitch_length"),
        F.coalesce("_PitchY", F.lit(K.DEFAULT_PITCH_WIDTH)).alias("pitch_width"),
        F.col("_StadiumId").alias("stadium_id"),
        F.col("_StadiumName").alias("stadium_name"),
        F.col("_StadiumCapacity").try_cast("int").alias("stadium_capacity"),
    )
    return out.join(place, "match_id", "left")


def referees(spark: SparkSession, folder: str | Files) -> DataFrame:
    rows = _read(spark, folder, "info", "Referee", schemas.REFEREE)
    return rows.select(
        "match_id",
        F.coalesce("_PersonId", "_RefereeId").alias("id"),
        F.col("_FirstName").alias("first_name"),
        F.col("_LastName").alias("last_name"),
        F.col("_Shortname").alias("short_name"),
        F.col("_Role").alias("official_type"),
    ).filter(F.col("id").isNotNull())


def base_rosters(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Players of the team sheets, before anything is added from events."""
    rows = _read(spark, folder, "info", "Team", schemas.TEAM)
    team_id = F.coalesce("_TeamId", "_id")
    players = F.concat(F.coalesce("Player", F.array()), F.coalesce("Players.Player", F.array()))
    rows = rows.select(
        "match_id",
        team_id.alias("team_id"),
        F.coalesce("_TeamName", "_ShortName", "_LongName", "_Name", team_id).alias("team_name"),
        F.posexplode(players).alias("seq", "p"),
    )
    first, last = F.col("p._FirstName"), F.col("p._LastName")
    raw = F.col("p._PlayingPosition")
    labels = {c: lab for c, (lab, _) in K.POSITIONS_XML.items() if lab}
    groups = {c: g for c, (_, g) in K.POSITIONS_XML.items()}
    return rows.select(
        "match_id", "team_id", "team_name", "seq",
        F.coalesce("p._PersonId", "p._PlayerId").alias("player_id"),
        F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))).alias("player_name"),
        F.coalesce("p._Shortname", F.lit("")).alias("short_name"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.when(F.col("p._ShirtNumber").rlike("^[0-9]+$"), F.col("p._ShirtNumber").try_cast("int")).alias("shirt_number"),
        raw.alias("position_raw"),
        S.lookup(raw, labels).alias("position_label"),
        S.lookup(raw, groups).alias("position_group"),
        F.coalesce(F.lower("p._Starting") == "true", F.lit(False)).alias("starting"),
    ).filter(F.col("team_id").isNotNull() & F.col("player_id").isNotNull())


def raw_events(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Raw events with their nested children and their place in the file (``seq``, from 0).

    A file is read by one task from its beginning, so the rows' numbers follow the file.
    """
    rows = _read(spark, folder, "events", "Event", schemas.EVENT)
    if "row_id" not in rows.columns:
        rows = materialise(rows.withColumn("row_id", F.monotonically_increasing_id()))
    # A match has some thousand events.
    first = F.min("row_id").over(Window.partitionBy("match_id"))
    return rows.withColumn("seq", F.col("row_id") - first).drop("row_id", CORRUPT)


def kickoffs(events: DataFrame, matches_df: DataFrame) -> DataFrame:
    period = S.lookup(F.col("KickOff._GameSection"), K.PERIOD_BY_SECTION)
    rows = events.filter(F.col("KickOff").isNotNull()).select(
        "match_id", "seq", period.alias("period"), F.col("KickOff._TeamLeft").alias("team_left"),
        S.to_utc(F.col("_EventTime")).alias("kickoff"),
    ).filter(F.col("period").isNotNull())
    return rows.join(matches_df.select("match_id", "home_team_id"), "match_id")


def rosters(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Team sheets completed with substitution times, cards and goals from the events."""
    base = base_rosters(spark, folder)
    events = raw_events(spark, folder)
    info = matches(spark, folder).select("match_id", "kickoff_time_utc")
    subs = events.filter(F.col("Substitution").isNotNull()).join(info, "match_id").select(
        "match_id", "seq",
        S.elapsed_seconds(S.to_utc(F.col("kickoff_time_utc")), S.to_utc(F.col("_EventTime"))).alias("elapsed_s"),
        F.col("Substitution._PlayerIn").alias("player_in"),
        F.col("Substitution._PlayerOut").alias("player_out"),
        F.col("Substitution._PlayingPosition").alias("position"),
    )
    cautions = events.filter(F.col("Caution").isNotNull()).select(
        "match_id", F.col("Caution._Player").alias("player_id"), F.col("Caution._CardColor").alias("color")
    )
    shots = events.select(
        "match_id",
        F.explode(F.array_compact(F.array("ShotAtGoal", "FreeKick.ShotAtGoal", "CornerKick.ShotAtGoal", "Penalty.ShotAtGoal"))).alias("s"),
    ).select(
        "match_id", F.col("s._Player").alias("player_id"), F.col("s._Team").alias("team_id"),
        F.col("s.SuccessfulShot").isNotNull().alias("is_goal"),
    )
    keys = ["match_id", "player_id"]
    counts = E.player_stats(cautions, shots, base.select(*keys, F.col("team_id").alias("roster_team")))
    out = base.join(E.substitution_times(subs), keys, "left").join(counts, keys, "left")
    came_on = F.col("sub_in_s").isNotNull()
    unlisted = F.col("position_raw").isNull() & ~F.col("starting")
    named = unlisted & came_on & F.col("in_position").isNotNull()
    benched = unlisted & ~came_on
    labels = {c: lab for c, (lab, _) in K.POSITIONS_XML.items() if lab}
    groups = {c: g for c, (_, g) in K.POSITIONS_XML.items()}
    off = S.hms(F.col("sub_out_s"))
    return out.select(
        *keys, "team_id", "team_name", "seq", "player_name", "short_name", "first_name", "last_name", "shirt_number", "starting",
        F.when(benched, "SUB").when(named, F.col("in_position")).otherwise(F.col("position_raw")).alias("position_raw"),
        F.when(named, S.lookup(F.col("in_position"), labels)).otherwise(F.col("position_label")).alias("position_label"),
        F.when(benched, "SUB").when(named, S.lookup(F.col("in_position"), groups)).otherwise(F.col("position_group")).alias("position_group"),
        F.when(F.col("starting"), "00:00:00").when(came_on, S.hms(F.col("sub_in_s"))).alias("start_time"),
        F.when(F.col("starting") | came_on, off).alias("end_time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("yellow_cards", "red_cards", "goals", "own_goals")],
    )


def directions(spark: SparkSession, folder: str | Files) -> DataFrame:
    info = matches(spark, folder)
    out = E.play_direction(kickoffs(raw_events(spark, folder), info))
    return out.withColumn("source", F.lit(K.SOURCE_XML))


def positions(spark: SparkSession, folder: str | Files) -> DataFrame:
    """All raw position rows: players, ball and referees at 25 Hz."""
    rows = _read(spark, folder, "positions", "FrameSet", schemas.FRAME_SET)
    section = F.col("_GameSection")
    return rows.select(
        "match_id",
        F.col("_TeamId").alias("team_id"),
        F.col("_PersonId").alias("player_id"),
        S.lookup(section, K.PERIOD_BY_SECTION, F.coalesce(section, F.lit(""))).alias("period"),
        F.inline("Frame"),
    ).select(
        "match_id", "team_id", "player_id", "period",
        F.col("_N").alias("frame_id_source"), F.col("_T").alias("timestamp"),
        F.col("_X").alias("x"), F.col("_Y").alias("y"), F.col("_Z").alias("z"),
        F.col("_S").alias("speed_kmh"), F.col("_A").alias("acceleration_ms2"), F.col("_M").alias("match_minute"),
        F.col("_BallStatus").alias("ball_code"), F.col("_BallPossession").alias("poss_code"),
    ).filter(F.col("frame_id_source").isNotNull())


def is_player(team: str = "team_id") -> Column:
    return F.coalesce(~F.col(team).isin("BALL", "referee"), F.lit(False))


def tracking(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Player rows thinned to 10 Hz, with ball, roster and native kinematics."""
    raw = positions(spark, folder if "FrameSet" in as_files(folder).staged else stage(spark, folder))
    info = matches(spark, folder).select("match_id", "home_team_id", "away_team_id", "competition")
    frame = ["match_id", "period", "frame_id_source"]
    ball = F.when(F.col("team_id") == "BALL", F.struct("x", "y", F.coalesce("z", F.lit(0.0)).alias("z"), "ball_code", "poss_code"))
    clock = raw.groupBy(*frame).agg(
        F.min("timestamp").alias("timestamp"), F.min("match_minute").alias("match_minute"), F.max(ball).alias("ball")
    )
    kept = materialise(keep_pattern(clock, ["match_id", "period"], "frame_id_source"))
    players = raw.filter(
        is_player() & F.col("player_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    ).select(*frame, "player_id", "x", "y", "speed_kmh", "acceleration_ms2")
    stepped = step_distance(players.join(kept, frame), ["match_id", "player_id", "period"])
    meta = base_rosters(spark, folder).select(
        "match_id", "player_id", "player_name", "team_id", "team_name", "position_raw", "position_label", "position_group"
    )
    rows = stepped.join(meta, ["match_id", "player_id"], "left").join(info, "match_id", "left")
    r3 = lambda c: F.round(c, 3)
    return rows.select(
        *frame, "timestamp", "player_id", "player_name", "team_id", "team_name", "position_raw", "position_label", "position_group",
        r3("x").alias("x"), r3("y").alias("y"),
        r3("ball.x").alias("ball_x"), r3("ball.y").alias("ball_y"),
        r3(F.coalesce("ball.z", F.lit(0.0))).alias("ball_z"),
        (F.col("ball.ball_code") == 1).alias("ball_status"),
        S.possession_by_code(F.col("ball.poss_code"), F.col("home_team_id"), F.col("away_team_id")).alias("ball_poss_team_id"),
        r3("speed_kmh").alias("speed_kmh"), r3("acceleration_ms2").alias("acceleration_ms2"), "distance_m", "match_minute",
        F.lit(True).alias("is_visible"),
        F.coalesce(F.col("team_id") == F.col("home_team_id"), F.lit(False)).alias("is_home"),
        F.lit(K.SOURCE_XML).alias("source"), F.lit("in_stadium").alias("tracking_type"),
        F.lit("native_tracab").alias("kinematic_source"), "competition",
    )


def actions(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Normalised actions: classified, oriented, offsides marked, throw-ins re-keyed."""
    info = matches(spark, folder).select("match_id", "home_team_id", "competition_name")
    sheet = base_rosters(spark, folder).select(
        "match_id", "player_id", F.col("short_name").alias("player_name"), F.col("team_id").alias("_team"), "team_name"
    )
    events = raw_events(spark, folder)
    starts = kickoffs(events, info)
    # As for actions only: a missing first half is not inferred from the second.
    sides = E.play_direction(starts, infer_first=False)
    second = starts.filter(F.col("period") == "second_half").groupBy("match_id").agg(
        F.max_by("kickoff", "seq").alias("second_kickoff")
    )
    classed = materialise(E.classify_events(events.drop("Substitution", "Caution")))
    at = S.to_utc(F.col("_EventTime"))
    staged = (
        classed.join(info, "match_id")
        .join(second, "match_id", "left")
        .withColumn("period", E.period_by_kickoff(at, F.col("second_kickoff")))
        .join(sides, ["match_id", "period"], "left")
        .join(sheet, ["match_id", "player_id"], "left")
    )

    def axis(name: str, extent: float) -> Column:
        return S.recentre(F.col(f"`{name}`"), extent)

    length, width = K.DEFAULT_PITCH_LENGTH, K.DEFAULT_PITCH_WIDTH
    start_x = F.coalesce(axis("_X-Source-Position", length), axis("_X-Position", length))
    start_y = F.coalesce(axis("_Y-Source-Position", width), axis("_Y-Position", width))
    rows = staged.select(
        "match_id", "seq", F.col("_EventId").alias("event_id"),
        S.iso_normalise(F.col("_EventTime")).alias("timestamp"), "period", "action_type", "player_id",
        F.coalesce("player_name", F.lit("")).alias("player_name"),
        F.coalesce("_team", "raw_team_id").alias("team_id"),
        F.coalesce("team_name", F.lit("")).alias("team_name"), "receiver_id", "result",
        S.flip_if(start_x, F.coalesce("play_direction", F.lit(""))).alias("start_x"), start_y.alias("start_y"),
        S.flip_if(axis("_X-Position", length), F.coalesce("play_direction", F.lit(""))).alias("end_x"),
        axis("_Y-Position", width).alias("end_y"),
        F.lit(K.SOURCE_XML).alias("source"), F.coalesce("competition_name", F.lit("")).alias("competition"),
    )
    marked = E.mark_offside(rows, ["match_id"], "seq", span=65_536)
    return E.conform_actions(E.rekey_throw_ins(marked, ["match_id"], "seq", span=65_536))
