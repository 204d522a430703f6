"""Action normalisation: classification of raw events, repairs, unions, match sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators.series import DEFAULT_ROWS, DEFAULT_SPAN, open_series

# Child elements of a raw event, in the order in which they decide its class.
EVENT_CHILDREN = (
    "Play", "ShotAtGoal", "FreeKick", "CornerKick", "Penalty", "KickOff", "Foul",
    "OtherBallAction", "GoalKick", "ThrowIn", "Offside",
)


def _shot_result(shot: Column) -> Column:
    """Outcome of a shot from the name of its outcome child; 'fail' without one."""
    chain = None
    for tag, result in K.SHOT_OUTCOMES.items():
        hit = shot[tag].isNotNull()
        chain = F.when(hit, result) if chain is None else chain.when(hit, result)
    return chain.otherwise("fail")


def _pass_result(play: Column) -> Column:
    return F.when(play["_Evaluation"] == "successfullyCompleted", "success").otherwise("fail")


def classify_events(events: DataFrame) -> DataFrame:
    """Class, acting player, team, receiver and result of raw events with nested children.

    The first child present (in ``EVENT_CHILDREN`` order) decides. Events without an
    action are dropped; offside markers stay, as action 'offside', for
    :func:`mark_offside`.
    """
    col = F.col
    play, shot = col("Play"), col("ShotAtGoal")
    fk, ck, pen = col("FreeKick"), col("CornerKick"), col("Penalty")
    gk, ti, foul, oba = col("GoalKick"), col("ThrowIn"), col("Foul"), col("OtherBallAction")

    def action(kind, player, team, result, receiver=None, team_fallback=None):
        text = F.lit(kind) if isinstance(kind, str) else kind
        outcome = F.lit(result) if isinstance(result, str) else result
        return F.struct(
            text.alias("action_type"),
            F.coalesce(player, F.lit("")).alias("player_id"),
            F.coalesce(team, F.lit("")).alias("raw_team_id"),
            outcome.alias("result"),
            (F.lit(None).cast("string") if receiver is None else receiver).alias("receiver_id"),
        )

    def passed(kind: Column, p: Column):
        won = _pass_result(p)
        return action(kind, p["_Player"], p["_Team"], won, F.when(won == "success", p["_Recipient"]))

    def crossed(p: Column, yes: str, no: str) -> Column:
        return F.when(p["Cross"].isNotNull(), yes).otherwise(no)

    def shot_at(kind, s: Column):
        return action(kind, s["_Player"], s["_Team"], _shot_result(s))

    open_shot = (
        F.when(shot["_TakerSetup"] == "penalty", "shot_penalty")
        .when((shot["_TakerSetup"] == "freeKick") & (shot["_BuildUp"] == "freeKick"), "shot_freekick")
        .otherwise("shot")
    )
    none = F.lit(None)
    made = (
        F.when(play.isNotNull(), passed(crossed(play, "cross", "pass"), play))
        .when(shot.isNotNull(), shot_at(open_shot, shot))
        .when(
            fk.isNotNull(),
            F.when(
                fk["Play"].isNotNull(),
                passed(crossed(fk["Play"], "freekick_cross", "freekick_short"), fk["Play"]),
            ).when(fk["ShotAtGoal"].isNotNull(), shot_at("shot_freekick", fk["ShotAtGoal"])),
        )
        .when(
            ck.isNotNull(),
            F.when(
                ck["Play"].isNotNull(),
                passed(crossed(ck["Play"], "corner_cross", "corner_short"), ck["Play"]),
            ),
        )
        .when(
            pen.isNotNull(),
            F.when(pen["ShotAtGoal"].isNotNull(), shot_at("shot_penalty", pen["ShotAtGoal"])),
        )
        .when(col("KickOff").isNotNull(), none)
        .when(foul.isNotNull(), action("foul", foul["_Fouled"], foul["_TeamFouled"], "fail"))
        .when(
            oba.isNotNull(),
            F.when(
                oba["_DefensiveClearance"] == "true",
                action("clearance", oba["_Player"], oba["_Team"], "success"),
            ),
        )
        .when(gk.isNotNull(), action("goalkick", gk["Play"]["_Player"], gk["_Team"], "success"))
        .when(ti.isNotNull(), action("throw_in", ti["Play"]["_Player"], ti["_Team"], "success"))
        .when(
            col("Offside").isNotNull(),
            action("offside", F.lit(""), F.lit(""), "marker"),
        )
    )
    kept = [c for c in events.columns if c not in EVENT_CHILDREN]
    # Generating the struct keeps the chain from being evaluated once per field.
    staged = events.withColumn("_a", F.explode(F.array_compact(F.array(made))))
    return staged.select(
        *kept, *[F.col(f"_a.{n}").alias(n) for n in ("action_type", "player_id", "raw_team_id", "result", "receiver_id")]
    )


def mark_offside(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    marker: str = "offside",
    eligible: Sequence[str] = K.OFFSIDE_ELIGIBLE,
    lookback: int = K.OFFSIDE_LOOKBACK,
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Give result 'offside' to the failed pass each marker belongs to; drop the markers.

    A marker takes the latest failed eligible action not yet taken among the last
    ``lookback`` emitted actions. Markers and eligible actions therefore pair up like
    brackets, newest first, and whether an action is taken depends only on what follows
    it: count +1 for each eligible action and -1 for each marker behind it; the action is
    taken when that balance first reaches -1 while fewer than ``lookback`` actions were
    emitted in between. At most ``lookback - 1`` later actions and ``lookback`` markers
    can matter, so a fixed look-ahead is exact.
    """
    ahead = 2 * lookback - 1
    is_marker = F.col("action_type") == marker
    candidate = F.col("action_type").isin(*eligible) & (F.col("result") == "fail")
    staged = df.withColumns(
        {
            "_step": F.when(is_marker, -1).when(candidate, 1).otherwise(0),
            "_emits": F.when(is_marker, 0).otherwise(1),
        }
    )
    chunks = open_series(staged, keys, order, after=ahead, span=span, rows=rows)
    w = chunks.window()
    taken = F.lit(False)
    for k in range(1, ahead + 1):
        frame = w.rowsBetween(1, k)
        taken = taken | F.coalesce(
            (F.sum("_step").over(frame) == -1) & (F.sum("_emits").over(frame) < lookback), F.lit(False)
        )
    out = chunks.with_df(chunks.df.withColumn("_taken", taken)).close()
    return (
        out.filter(F.col("_emits") == 1)
        .withColumn("result", F.when((F.col("_step") == 1) & F.col("_taken"), "offside").otherwise(F.col("result")))
        .drop("_step", "_emits", "_taken")
    )


def rekey_throw_ins(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Move throw-ins to the receiving player: the next action, if by the same team."""
    chunks = open_series(df, keys, order, after=1, span=span, rows=rows)
    w = chunks.window()
    named = "player_name" in df.columns

    def nxt(name: str) -> Column:
        return F.lead(name).over(w)

    follows = (
        (F.col("action_type") == "throw_in")
        & (F.coalesce(nxt("player_id"), F.lit("")) != "")
        & nxt("team_id").eqNullSafe(F.col("team_id"))
    )
    placed = follows & nxt("start_x").isNotNull()
    changes = {
        "player_id": F.when(follows, nxt("player_id")).otherwise(F.col("player_id")),
        "start_x": F.when(placed, nxt("start_x")).otherwise(F.col("start_x")),
        "start_y": F.when(placed, nxt("start_y")).otherwise(F.col("start_y")),
    }
    if named:
        changes["player_name"] = F.when(follows, nxt("player_name")).otherwise(F.col("player_name"))
    return chunks.with_df(chunks.df.withColumns(changes)).close()


def possession_actions(df: DataFrame) -> DataFrame:
    """Actions at the end of possessions, plus a throw-in where a possession began with one.

    Columns used: event_id, start_type, end_type, pass_outcome, game_interruption_before,
    lead_to_goal, player_targeted_id, time_end_utc. Other columns pass through.
    """

    def text(name: str) -> Column:
        return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))

    end, start, outcome = text("end_type"), text("start_type"), text("pass_outcome")
    kind = (
        F.when(end == "pass", "pass")
        .when(
            end == "shot",
            F.when(text("game_interruption_before") == "free_kick_for", "shot_freekick").otherwise("shot"),
        )
        .when(end == "clearance", "clearance")
        .when(end == "foul_suffered", "foul")
        .when(end == "possession_loss", "bad_touch")
        .otherwise("non_action")
    )
    result = (
        F.when(
            end == "pass",
            F.when(outcome == "successful", "success").when(outcome == "offside", "offside").otherwise("fail"),
        )
        .when(end == "shot", F.when(text("lead_to_goal") == "true", "success").otherwise("fail"))
        .when(end == "clearance", "success")
        .otherwise("fail")
    )
    received = (end == "pass") & (outcome == "successful")
    event_id = F.coalesce(S.clean_id(F.col("event_id").cast("string")), F.lit(""))

    def emitted(eid, action_type, res, receiver, receiver_time):
        return F.struct(
            eid.alias("event_id"),
            action_type.alias("action_type"),
            res.alias("result"),
            receiver.alias("receiver_id"),
            receiver_time.alias("receiver_time"),
        )

    nothing = F.lit(None).cast("string")
    throw_in = F.when(
        start == "throw_in_reception",
        emitted(F.concat(event_id, F.lit("_ti")), F.lit("throw_in"), F.lit("success"), nothing, nothing),
    )
    main = emitted(
        event_id,
        kind,
        result,
        F.when(received, S.clean_id(F.col("player_targeted_id").cast("string"))),
        F.when(received, F.col("time_end_utc")),
    )
    used = (
        "event_id", "start_type", "end_type", "pass_outcome", "game_interruption_before",
        "lead_to_goal", "player_targeted_id", "time_end_utc",
    )
    kept = [c for c in df.columns if c not in used]
    return df.withColumn("_e", F.explode(F.array_compact(F.array(throw_in, main)))).select(
        *kept,
        *[F.col(f"_e.{n}").alias(n) for n in ("event_id", "action_type", "result", "receiver_id", "receiver_time")],
    )


def period_by_kickoff(event_time: Column, second_kickoff: Column) -> Column:
    """Second half from its kick-off on, else first half; null without an event time."""
    return F.when(
        event_time.isNotNull(),
        F.when(event_time >= second_kickoff, "second_half").otherwise("first_half"),
    )


def play_direction(
    kickoffs: DataFrame,
    *,
    match: str = "match_id",
    period: str = "period",
    team_left: str = "team_left",
    home: str = "home_team_id",
    order: str = "seq",
    infer_first: bool = True,
) -> DataFrame:
    """Home side's direction per match and period; a missing half is the opposite one.

    The last kick-off of a period counts.
    """
    direction = F.when(F.col(team_left) == F.col(home), "left_right").otherwise("right_left")
    halves = kickoffs.withColumn("_dir", direction).groupBy(match).agg(
        *[
            F.max_by("_dir", F.when(F.col(period) == name, F.col(order))).alias(name)
            for name in ("first_half", "second_half")
        ]
    )
    first = F.coalesce("first_half", S.opposite(F.col("second_half"))) if infer_first else F.col("first_half")
    filled = halves.select(
        match, first.alias("first_half"), F.coalesce("second_half", S.opposite(F.col("first_half"))).alias("second_half")
    )
    return filled.select(
        match,
        F.explode(F.create_map(F.lit("first_half"), F.col("first_half"), F.lit("second_half"), F.col("second_half"))).alias(
            "period", "play_direction"
        ),
    ).filter(F.col("play_direction").isNotNull())


def conform_actions(*parts: DataFrame) -> DataFrame:
    """Union of action tables in the fixed column order, rounded, with the comparable flag."""
    out: DataFrame | None = None
    for part in parts:
        missing = {
            c: F.lit(None).cast("string")
            for c in K.ACTION_COLUMNS
            if c not in part.columns and c != "cross_dataset_comparable"
        }
        part = part.withColumns(missing) if missing else part
        part = part.withColumn("cross_dataset_comparable", S.comparable(F.col("action_type")))
        part = part.withColumns(
            {c: F.round(F.col(c).cast("double"), 3) for c in ("start_x", "start_y", "end_x", "end_y")}
        ).withColumns({c: F.col(c).cast("string") for c in ("event_id", "player_id", "team_id", "match_id")})
        part = part.select(*K.ACTION_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def action_counts(actions: DataFrame) -> DataFrame:
    """Row counts by source, type, result and competition, in one pass."""
    dims = ("source", "action_type", "result", "competition")
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims if d in actions.columns]
    )
    return (
        actions.select(F.explode(pairs).alias("p"))
        .groupBy("p.dimension", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def comparable_pivot(actions: DataFrame, action_types: Sequence[str] = K.COMPARABLE_ACTIONS) -> DataFrame:
    """Source by action type counts of comparable actions, 0 where none."""
    return (
        actions.filter(S.comparable(F.col("action_type")))
        .groupBy("source")
        .pivot("action_type", list(action_types))
        .count()
        .na.fill(0)
    )


def player_stats(cautions: DataFrame, shots: DataFrame, player_team: DataFrame) -> DataFrame:
    """Cards, goals and own goals per player of a match.

    ``cautions``: match_id, player_id, color. ``shots``: match_id, player_id, team_id,
    is_goal. ``player_team``: match_id, player_id, roster_team.
    """
    cards = cautions.filter(F.col("player_id").isNotNull() & F.col("color").isNotNull()).select(
        "match_id", "player_id",
        (F.col("color") == "yellow").cast("long").alias("yellow_cards"),
        F.col("color").isin("red", "yellowRed").cast("long").alias("red_cards"),
        F.lit(0).cast("long").alias("goals"),
        F.lit(0).cast("long").alias("own_goals"),
    )
    scored = shots.filter(F.col("is_goal") & F.col("player_id").isNotNull()).join(
        player_team, ["match_id", "player_id"], "left"
    )
    own = F.coalesce(F.col("team_id") != F.col("roster_team"), F.lit(False))
    goals = scored.select(
        "match_id", "player_id",
        F.lit(0).cast("long").alias("yellow_cards"),
        F.lit(0).cast("long").alias("red_cards"),
        (~own).cast("long").alias("goals"),
        own.cast("long").alias("own_goals"),
    )
    names = ("yellow_cards", "red_cards", "goals", "own_goals")
    return (
        cards.unionByName(goals).groupBy("match_id", "player_id").agg(*[F.sum(n).alias(n) for n in names])
    )


def substitution_times(subs: DataFrame) -> DataFrame:
    """Seconds a player came on and went off, and the position taken.

    ``subs``: match_id, seq, elapsed_s, player_in, player_out, position. The last entry
    of a player counts; negative times are ignored.
    """
    ok = subs.filter(F.col("elapsed_s") >= 0)
    entries = ok.select(
        "match_id", "seq",
        F.explode(
            F.array(
                F.struct(F.col("player_in").alias("player_id"), F.col("elapsed_s").alias("in_s"),
                         F.lit(None).cast("double").alias("out_s"), F.col("position").alias("position")),
                F.struct(F.col("player_out").alias("player_id"), F.lit(None).cast("double").alias("in_s"),
                         F.col("elapsed_s").alias("out_s"), F.lit(None).cast("string").alias("position")),
            )
        ).alias("e"),
    ).select("match_id", "seq", "e.*").filter(F.coalesce("player_id", F.lit("")) != "")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq")))

    return entries.groupBy("match_id", "player_id").agg(
        last("in_s").alias("sub_in_s"), last("out_s").alias("sub_out_s"), last("position").alias("in_position")
    )


def expand_counts(rosters: DataFrame, *, block: int = 1_000) -> DataFrame:
    """One row per goal and card of the match sheet; own goals count for the opponent.

    ``rosters``: match_id, team_id, opponent_id, player_id and the four counts.
    """
    kinds = (
        ("goals", "goal", "team_id"),
        ("own_goals", "own_goal", "opponent_id"),
        ("yellow_cards", "yellow_card", "team_id"),
        ("red_cards", "red_card", "team_id"),
    )
    counted = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(team).alias("team_id"),
                F.coalesce(F.col(count), F.lit(0)).cast("long").alias("n"),
            )
            for count, kind, team in kinds
        ]
    )
    rows = rosters.select("match_id", "player_id", F.explode(counted).alias("e")).select(
        "match_id", "player_id", "e.*"
    ).filter(F.col("n") > 0)
    # Two levels of sequences, so a large count never becomes one large array.
    blocks = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("long"))))
    inside = F.sequence(F.lit(1), F.least(F.lit(block), F.col("n") - F.col("_b") * block).cast("int"))
    return blocks.withColumn("_i", F.explode(inside)).select(
        "match_id", "player_id", "kind", "team_id", (F.col("_b") * block + F.col("_i")).cast("int").alias("copy_no")
    )


def pair_substitutions(rosters: DataFrame) -> DataFrame:
    """Pair players who came on with players who went off, per match and team.

    Equal times pair first, in roster order; what is left pairs in order (on: roster
    order, off: earliest end). ``rosters``: match_id, team_id, player_id, seq, starting,
    start_time, end_time.
    """
    team = ["match_id", "team_id"]
    on = rosters.filter(
        F.col("start_time").isNotNull() & ~F.col("start_time").isin("", "00:00:00")
    ).select(*team, F.col("player_id").alias("in_player_id"), F.col("start_time").alias("in_time"), F.col("seq").alias("in_seq"))
    off = rosters.filter(F.col("starting") & (F.coalesce("end_time", F.lit("")) != "")).select(
        *team, F.col("player_id").alias("out_player_id"), F.col("end_time").alias("out_time"), F.col("seq").alias("out_seq")
    )
    on = on.withColumn("_k", F.row_number().over(Window.partitionBy(*team, "in_time").orderBy("in_seq")))
    off = off.withColumn("_k", F.row_number().over(Window.partitionBy(*team, "out_time").orderBy("out_seq")))
    same = on.join(off.withColumn("in_time", F.col("out_time")), [*team, "in_time", "_k"])
    matched = same.select(*team, "in_player_id", "in_time", "out_player_id", "out_time")
    late_on = on.join(matched.select(*team, "in_player_id"), [*team, "in_player_id"], "left_anti").withColumn(
        "_r", F.row_number().over(Window.partitionBy(*team).orderBy("in_seq"))
    )
    late_off = off.join(matched.select(*team, "out_player_id"), [*team, "out_player_id"], "left_anti").withColumn(
        "_r", F.row_number().over(Window.partitionBy(*team).orderBy("out_time", "out_seq"))
    )
    rest = late_on.drop("_k").join(late_off.drop("_k"), [*team, "_r"], "left")
    return matched.unionByName(rest.select(*matched.columns))


def period_bounds(tracking: DataFrame, *, time: str = "timestamp") -> DataFrame:
    """First and last frame and time of each match period."""
    return tracking.groupBy("match_id", "period").agg(
        F.min("frame_id").alias("frame_id_start"),
        F.max("frame_id").alias("frame_id_end"),
        F.min_by(time, "frame_id").alias("time_start"),
        F.max_by(time, "frame_id").alias("time_end"),
    )


def whistles(bounds: DataFrame) -> DataFrame:
    """Start and end whistle of every period that has the time."""
    pair = F.array(
        F.struct(F.lit("start").alias("sub_type"), F.col("time_start").alias("time")),
        F.struct(F.lit("end").alias("sub_type"), F.col("time_end").alias("time")),
    )
    return (
        bounds.select("match_id", F.col("period").alias("type"), F.explode(pair).alias("w"))
        .select("match_id", "type", "w.sub_type", "w.time")
        .filter(F.col("time").isNotNull())
    )
