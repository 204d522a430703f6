"""The JSON/CSV feed: one folder per match with frames, match sheet, phases and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import constants as K
from touchline import schemas
from touchline.functions import scalars as S
from touchline.operators import actions as E
from touchline.operators.joins import in_latest_interval
from touchline.operators.trajectory import step_speed_with_reset
from touchline.session import materialise
from touchline.sources.files import Files, as_files, list_files


def _match_id() -> Column:
    return F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)


KINDS = {
    "sheet": "matches/*/*_match.json", "frames": "matches/*/*_tracking_extrapolated.jsonl",
    "phases": "matches/*/*_phases_of_play.csv", "events": "matches/*/*_dynamic_events.csv",
}
#: A match without one of these files is incomplete.
REQUIRED = ("sheet", "frames")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """All files of the feed with their match and kind."""
    forms = {kind: "/" + pattern.replace(".", "[.]").replace("*", "[^/]*") + "$" for kind, pattern in KINDS.items()}
    return list_files(
        spark, folder, K.SOURCE_JSON, "*_*", forms, F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    )


def read_csv(spark: SparkSession, folder: str | Files, kind: str, columns: Sequence[str]) -> DataFrame:
    """(match_id, columns) of CSV files, matched by the names in each file's own header.

    Files with the same header are read together; a column that a header lacks is null. The header
    is the first line of a file's first block; one row per file reaches the driver, as it does when
    files are listed.
    """
    fields = ", ".join(f"`{name}` string" for name in ("match_id", *columns))
    paths = as_files(folder).of(kind, KINDS[kind])
    if not paths:
        return spark.createDataFrame([], fields)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(paths).select(
        path.alias("path"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    head = F.regexp_replace("value", "^\ufeff|\r$", "")
    found = lines.filter("block = 0").groupBy("path").agg(F.min_by(head, "line").alias("head")).collect()
    out: DataFrame | None = None
    for header in sorted({row["head"] for row in found}):
        rows = spark.read.option("header", True).csv([row["path"] for row in found if row["head"] == header])
        named = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
        part = rows.select(_match_id().alias("match_id"), *named)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], fields) if out is None else out


def _read_json(spark: SparkSession, folder: str | Files, kind: str, schema, **options) -> DataFrame:
    paths = as_files(folder).of(kind, KINDS[kind])
    if not paths:
        return spark.createDataFrame([], T.StructType([T.StructField("match_id", T.StringType()), *schema.fields]))
    rows = spark.read.schema(schema).options(**options).json(paths)
    return rows.select(_match_id().alias("match_id"), *schema.names)


def sheets(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Match sheets, one row per match, as delivered."""
    return _read_json(spark, folder, "sheet", schemas.MATCH_JSON, multiLine=True)


def incomplete(spark: SparkSession, folder: str | Files) -> DataFrame:
    """(match_id, reason) of match sheets that are not JSON, or name no team."""
    schema = T.StructType([*schemas.MATCH_JSON.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = _read_json(spark, folder, "sheet", schema, multiLine=True)
    broken = F.when(F.col("_corrupt_record").isNotNull(), "match sheet is not JSON").when(
        F.col("home_team.id").isNull() | F.col("away_team.id").isNull(), "match sheet names no teams"
    )
    return rows.select("match_id", broken.alias("reason")).filter("reason is not null")


def stage(spark: SparkSession, folder: str | Files) -> Files:
    """Frames are parsed once and written; all readers then take the written rows."""
    files = as_files(folder)
    return files.with_staged(frames=materialise(frames(spark, files)))


def malformed(spark: SparkSession, staged: Files) -> DataFrame:
    """Single frames that do not parse are dropped, so only files without any frame are left to report."""
    listed = [(path.split("/")[-2],) for path in staged.of("frames", KINDS["frames"])]
    known = spark.createDataFrame(listed, "match_id string")
    missing = known.join(staged.staged["frames"].select("match_id").distinct(), "match_id", "left_anti")
    return missing.select("match_id", F.lit("no frame of the tracking file parses").alias("reason"))


def kickoff_index(spark: SparkSession, folder: str | Files) -> DataFrame:
    rows = spark.read.schema(schemas.MATCH_INDEX).option("multiLine", True).json(f"{as_files(folder).root}/matches.json")
    return rows.select(F.col("id").cast("string").alias("match_id"), F.col("date_time").alias("kickoff_raw")).dropDuplicates(["match_id"])


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def _first_half_seconds(default: float) -> Column:
    first = F.filter("match_periods", lambda p: p["period"] == 1)
    return F.coalesce(F.get(first, F.lit(0))["duration_minutes"] * 60.0, F.lit(default))


def second_half_offset(default_minutes: float = 45.0) -> Column:
    """Seconds from kick-off to the second half: first half plus the assumed break."""
    return _first_half_seconds(default_minutes * 60.0) + K.HALF_TIME_BREAK_SECONDS


def matches(spark: SparkSession, folder: str | Files) -> DataFrame:
    rows = sheets(spark, folder).join(kickoff_index(spark, folder), "match_id", "left")
    return rows.select(
        "match_id",
        F.lit(K.SOURCE_JSON).alias("source"),
        F.lit(K.COMPETITION_JSON).alias("competition"),
        _text("competition_edition.competition.id").alias("competition_id"),
        F.col("competition_edition.competition.name").alias("competition_name"),
        F.col("competition_edition.season.name").alias("season_name"),
        _text("competition_edition.season.id").alias("season_id"),
        F.col("competition_round.round_number").alias("match_day"),
        S.iso_normalise(F.col("kickoff_raw")).alias("kickoff_time_utc"),
        _text("home_team.id").alias("home_team_id"),
        _text("away_team.id").alias("away_team_id"),
        F.col("home_team_score").alias("home_score"),
        F.col("away_team_score").alias("away_score"),
        *[
            F.lit(None).cast("int").alias(f"{half}_{team}")
            for half in ("first_half", "second_half")
            for team in ("home", "away")
        ],
        F.lit("broadcast").alias("tracking_type"),
        F.lit(K.TRACKER_JSON).alias("tracking_name_original"),
        F.lit(10).alias("fps_original"),
        F.lit(10).alias("fps_output"),
        F.lit("phases_approx").alias("ball_status_source"),
        F.coalesce("pitch_length", F.lit(K.DEFAULT_PITCH_LENGTH)).alias("pitch_length"),
        F.coalesce("pitch_width", F.lit(K.DEFAULT_PITCH_WIDTH)).alias("pitch_width"),
        _text("stadium.id").alias("stadium_id"),
        F.col("stadium.name").alias("stadium_name"),
        F.col("stadium.capacity").alias("stadium_capacity"),
    )


def referees(spark: SparkSession, folder: str | Files) -> DataFrame:
    rows = sheets(spark, folder).select("match_id", F.explode("referees").alias("r"))
    return rows.filter(F.col("r.id").isNotNull()).select(
        "match_id", _text("r.id").alias("id"), "r.first_name", "r.last_name", "r.short_name",
        F.coalesce("r.type", "r.role").alias("official_type"),
    )


def rosters(spark: SparkSession, folder: str | Files) -> DataFrame:
    rows = sheets(spark, folder).select("match_id", "home_team", "away_team", F.posexplode("players").alias("seq", "p"))
    raw = F.col("p.player_role.acronym")
    labels = {c: lab for c, (lab, _) in K.POSITIONS_JSON.items() if lab}
    groups = {c: g for c, (_, g) in K.POSITIONS_JSON.items()}
    home = F.col("p.team_id") == F.col("home_team.id")
    return rows.select(
        "match_id", _text("p.id").alias("player_id"), _text("p.team_id").alias("team_id"),
        F.when(home, F.col("home_team.short_name")).otherwise(F.col("away_team.short_name")).alias("team_name"),
        "seq", F.col("p.short_name").alias("player_name"), F.col("p.short_name").alias("short_name"),
        "p.first_name", "p.last_name", F.col("p.number").alias("shirt_number"),
        F.coalesce(F.col("p.start_time") == "00:00:00", F.lit(False)).alias("starting"),
        raw.alias("position_raw"), S.lookup(raw, labels).alias("position_label"), S.lookup(raw, groups).alias("position_group"),
        "p.start_time", "p.end_time",
        *[
            F.coalesce(f"p.{c}", F.lit(0)).cast("long").alias(name)
            for c, name in (("yellow_card", "yellow_cards"), ("red_card", "red_cards"), ("goal", "goals"), ("own_goal", "own_goals"))
        ],
    )


def directions(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Entries are plain text or objects with an ``attacking_side``."""
    rows = sheets(spark, folder).select("match_id", F.posexplode(F.slice("home_team_side", 1, 2)).alias("i", "side"))
    inner = F.coalesce(F.get_json_object("side", "$.attacking_side"), F.col("side"))
    period = F.when(F.col("i") == 0, "first_half").otherwise("second_half")
    return rows.select(
        "match_id", period.alias("period"), S.lookup(inner, K.DIRECTION_BY_TEXT, inner).alias("play_direction"),
        F.lit(K.SOURCE_JSON).alias("source"),
    )


def frames(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Frames with nested players; lines that do not parse are dropped."""
    files = as_files(folder)
    if "frames" in files.staged:
        return files.staged["frames"]
    named = _read_json(spark, files, "frames", schemas.FRAME_JSON, mode="PERMISSIVE")
    good = F.col("_corrupt_record").isNull() & F.col("frame").isNotNull() & F.col("period").isNotNull()
    return named.filter(good).drop("_corrupt_record")


def phases(spark: SparkSession, folder: str | Files) -> DataFrame:
    return read_csv(spark, folder, "phases", ("frame_start", "frame_end")).select(
        "match_id",
        F.col("frame_start").try_cast("double").cast("long").alias("frame_start"),
        F.col("frame_end").try_cast("double").cast("long").alias("frame_end"),
    )


def tracking(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Player rows at native 10 Hz with clock, ball, possession and step kinematics."""
    shots = frames(spark, folder)
    offset = sheets(spark, folder).select(
        "match_id", _text("home_team.id").alias("home_team_id"), _text("away_team.id").alias("away_team_id"),
        (_first_half_seconds(0.0) + K.HALF_TIME_BREAK_SECONDS).alias("_second"),
    ).join(kickoff_index(spark, folder), "match_id", "left")
    roster = rosters(spark, folder).select(
        "match_id", "player_id", "player_name", "team_id", "team_name", "position_raw", "position_label", "position_group"
    )
    in_play = in_latest_interval(
        shots.select("match_id", "frame").distinct(), phases(spark, folder), keys=["match_id"], point="frame",
        start="frame_start", end="frame_end", name="ball_status",
    )
    owner = roster.select("match_id", F.col("player_id").alias("_owner"), F.col("team_id").alias("_owner_team"))
    clock = S.clock_seconds(F.col("timestamp"), two_part=False)
    framed = (
        shots.withColumn("_owner", _text("possession.player_id"))
        .join(owner, ["match_id", "_owner"], "left")
        .join(in_play, ["match_id", "frame"], "left")
        .join(offset, "match_id", "left")
    )
    start = F.when(F.col("period") == 2, F.col("_second")).otherwise(0.0)
    has_clock = F.coalesce("timestamp", F.lit("")) != ""
    utc = S.iso_text(S.shift_seconds(S.to_utc(F.col("kickoff_raw")), start + clock))
    flat = framed.select(
        "match_id", F.col("frame").alias("frame_id_source"), F.col("period").alias("_period"),
        F.when(F.col("period") == 1, "first_half").otherwise("second_half").alias("period"),
        F.when(has_clock, utc).alias("timestamp"),
        F.when(has_clock, S.match_minute(clock, F.col("period"))).alias("match_minute"),
        *[F.round(f"ball_data.{c}", 3).alias(f"ball_{c}") for c in ("x", "y", "z")],
        "ball_status",
        S.possession_by_group(F.col("_owner_team"), F.col("possession.group"), F.col("home_team_id"), F.col("away_team_id")).alias("ball_poss_team_id"),
        "home_team_id", F.explode("player_data").alias("p"),
    ).filter(F.col("p.player_id").isNotNull())
    seen = F.coalesce("p.is_detected", F.lit(False))
    flat = flat.select(
        *[c for c in flat.columns if c != "p"],
        _text("p.player_id").alias("player_id"), seen.alias("is_visible"),
        F.when(seen, F.round("p.x", 3)).alias("x"), F.when(seen, F.round("p.y", 3)).alias("y"),
    )
    moved = step_speed_with_reset(flat, ["match_id", "player_id", "_period"], "frame_id_source").drop("_period")
    rows = moved.join(roster, ["match_id", "player_id"], "left")
    return rows.withColumns(
        {
            "acceleration_ms2": F.lit(None).cast("double"),
            "is_home": F.coalesce(F.col("team_id") == F.col("home_team_id"), F.lit(False)),
            "source": F.lit(K.SOURCE_JSON),
            "tracking_type": F.lit("broadcast"),
            "kinematic_source": F.lit("finite_diff_native"),
            "competition": F.lit(K.COMPETITION_JSON),
        }
    ).drop("home_team_id")


def raw_events(spark: SparkSession, folder: str | Files) -> DataFrame:
    return read_csv(spark, folder, "events", schemas.EVENTS_CSV_COLUMNS)


def actions(spark: SparkSession, folder: str | Files) -> DataFrame:
    """Actions at the end of player possessions, oriented and on the UTC clock."""
    info = sheets(spark, folder).select(
        "match_id",
        F.coalesce("competition.name", "competition_edition.competition.name", F.lit(K.COMPETITION_JSON)).alias("competition"),
        S.to_utc(F.col("date_time")).alias("_kickoff"),
        second_half_offset().alias("_second"),
    )
    sides = directions(spark, folder).drop("source")
    number = F.col("period").try_cast("double").cast("int")
    rows = raw_events(spark, folder).filter(F.col("event_type") == "player_possession").withColumn("_n", number)

    def utc(clock: str) -> Column:
        start = F.when(F.col("_n") == 2, F.col("_second")).otherwise(0.0)
        return S.iso_text(S.shift_seconds(F.col("_kickoff"), start + S.clock_seconds(F.col(clock))))

    staged = (
        rows.withColumn("period", S.lookup(F.col("_n"), K.PERIOD_BY_NUMBER))
        .join(info, "match_id", "left")
        .join(sides, ["match_id", "period"], "left")
    )
    side = F.coalesce("play_direction", F.lit(""))

    def point(x: str, y: str) -> tuple[Column, Column]:
        px, py = F.col(x).try_cast("double"), F.col(y).try_cast("double")
        whole = px.isNotNull() & py.isNotNull()
        return F.when(whole, S.flip_if(px, side)), F.when(whole, py)

    start, end = point("x_start", "y_start"), point("x_end", "y_end")
    shaped = staged.select(
        "match_id", "period", utc("time_start").alias("timestamp"), utc("time_end").alias("time_end_utc"),
        start[0].alias("start_x"), start[1].alias("start_y"), end[0].alias("end_x"), end[1].alias("end_y"),
        F.coalesce(S.clean_id(F.col("player_id")), F.lit("")).alias("player_id"), "player_name",
        F.coalesce(S.clean_id(F.col("team_id")), F.lit("")).alias("team_id"), F.col("team_shortname").alias("team_name"),
        F.lit(K.SOURCE_JSON).alias("source"), "competition",
        "event_id", "start_type", "end_type", "pass_outcome", "game_interruption_before", "lead_to_goal", "player_targeted_id",
    )
    return E.conform_actions(E.possession_actions(shaped))
