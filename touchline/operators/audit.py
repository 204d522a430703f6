"""Data-quality checks on the harmonised tables; each check is one aggregate query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators.quantiles import aggregate_with_quantiles
from touchline.operators.series import DEFAULT_ROWS, DEFAULT_SPAN, open_series
from touchline.operators.trajectory import TRACK_KEYS, time_steps


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; unknown counts as not holding."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def coordinate_bounds(
    df: DataFrame, *, length: Column | None = None, width: Column | None = None
) -> DataFrame:
    """Extreme quantiles of in-play positions and the share outside the pitch."""
    half_l = (F.lit(K.DEFAULT_PITCH_LENGTH) if length is None else length) / 2
    half_w = (F.lit(K.DEFAULT_PITCH_WIDTH) if width is None else width) / 2
    rows = df.filter(F.col("is_visible") & F.col("ball_status")).withColumns(
        {"_ox": F.abs("x") > half_l, "_oy": F.abs("y") > half_w}
    )
    return aggregate_with_quantiles(
        rows,
        ["source", "match_id"],
        {
            "frac_x_outside": share(F.col("_ox")),
            "frac_y_outside": share(F.col("_oy")),
        },
        {"x_p001": ("x", 0.001), "x_p999": ("x", 0.999), "y_p001": ("y", 0.001), "y_p999": ("y", 0.999)},
    )


def frame_ids(df: DataFrame) -> DataFrame:
    """Frame ids start at 0 and leave no gap."""
    out = df.groupBy("match_id").agg(
        F.min("frame_id").alias("min_frame_id"),
        F.max("frame_id").alias("max_frame_id"),
        F.count_distinct("frame_id").alias("n_frames"),
    )
    return out.withColumns(
        {
            "starts_at_zero": F.col("min_frame_id") == 0,
            "gap_free": F.col("max_frame_id") - F.col("min_frame_id") + 1 == F.col("n_frames"),
        }
    )


def enum_values(df: DataFrame, column: str, allowed: Sequence[str], *, skip_null: bool = True) -> DataFrame:
    """Counts of every value with a flag whether it belongs to the enumeration."""
    rows = df.filter(F.col(column).isNotNull()) if skip_null else df
    return (
        rows.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("compliant", F.coalesce(F.col("value").isin(*allowed), F.lit(False)))
    )


def precision(df: DataFrame, columns: Sequence[str] = ("x", "y", "ball_z"), *, digits: int = 3) -> DataFrame:
    """Values with more decimals than allowed, per match and column."""
    def off(c: str) -> Column:
        return F.count_if(F.abs(F.col(c) - F.round(c, digits)) > 1e-9)

    wide = df.groupBy("source", "match_id").agg(*[off(c).alias(c) for c in columns])
    return wide.unpivot(["source", "match_id"], list(columns), "column", "n_offending")


def visibility(df: DataFrame) -> DataFrame:
    """Hidden rows must have no position and kinematics, visible rows must have a position."""
    hidden, seen = ~F.col("is_visible"), F.col("is_visible")

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    out = df.groupBy("source", "match_id").agg(
        n(hidden).alias("n_invisible"),
        n(hidden & F.col("x").isNotNull()).alias("hidden_with_x"),
        n(hidden & F.col("speed_kmh_filtered").isNotNull()).alias("hidden_with_speed"),
        n(hidden & F.col("acceleration_ms2_filtered").isNotNull()).alias("hidden_with_accel"),
        n(seen & F.col("x").isNull()).alias("visible_without_x"),
        n(seen & F.col("y").isNull()).alias("visible_without_y"),
    )
    leaks = sum(
        F.col(c)
        for c in ("hidden_with_x", "hidden_with_speed", "hidden_with_accel", "visible_without_x", "visible_without_y")
    )
    return out.withColumn("compliant", leaks == 0)


def id_overlap(df: DataFrame, source_a: str, source_b: str) -> DataFrame:
    """Player and team ids used by both sources, and matches present in several sources."""
    kinds = F.array(
        F.struct(F.lit("player_id").alias("kind"), F.col("player_id").alias("id")),
        F.struct(F.lit("team_id").alias("kind"), F.col("team_id").alias("id")),
    )
    ids = df.select("source", F.explode(kinds).alias("k")).select("source", "k.*").filter(F.col("id").isNotNull())
    shared = (
        ids.groupBy("kind", "id")
        .agg(F.count_if(F.col("source") == source_a).alias("_a"), F.count_if(F.col("source") == source_b).alias("_b"))
        .filter((F.col("_a") > 0) & (F.col("_b") > 0))
        .select("kind", "id")
    )
    twice = (
        df.groupBy(F.col("match_id").alias("id"))
        .agg(F.count_distinct("source").alias("_n"))
        .filter(F.col("_n") > 1)
        .select(F.lit("match_id").alias("kind"), "id")
    )
    return shared.unionByName(twice)


def direction_prior(directions: DataFrame) -> DataFrame:
    """Share of first halves in which the home side attacked each way, per source."""
    first = directions.filter(F.col("period") == "first_half").withColumn(
        "_d", S.lookup(F.col("play_direction"), K.DIRECTION_BY_TEXT, F.col("play_direction"))
    ).filter(F.col("_d").isin(*K.DIRECTIONS))
    return first.groupBy("source").agg(
        *[share(F.col("_d") == d).alias(f"frac_{d}") for d in K.DIRECTIONS], F.count(F.lit(1)).alias("n_matches")
    )


def home_keeper_side(df: DataFrame) -> DataFrame:
    """After orientation the home goalkeeper stands at negative x on average."""
    keeper = F.coalesce(F.col("position_group") == "GK", F.lit(False))
    if "position_raw" in df.columns:
        keeper = keeper | F.coalesce(F.col("position_raw").isin("TW", "GK"), F.lit(False))
    return (
        df.filter(F.col("is_home") & keeper & F.col("is_visible"))
        .groupBy("source", "match_id", "period")
        .agg(F.avg("x").alias("home_gk_mean_x"))
        .withColumn("compliant", F.col("home_gk_mean_x") < 0)
    )


def coverage(df: DataFrame) -> DataFrame:
    """Tracked minutes per match and half."""
    def minutes(condition: Column | None = None) -> Column:
        frame = F.col("frame_id") if condition is None else F.when(condition, F.col("frame_id"))
        return F.round(F.count_distinct(frame) / F.lit(float(K.FRAMES_PER_MINUTE)), 2)

    return df.groupBy("source", "match_id").agg(
        F.count_distinct("frame_id").alias("n_frames"),
        minutes().alias("duration_min"),
        minutes(F.col("period") == "first_half").alias("first_half_min"),
        minutes(F.col("period") == "second_half").alias("second_half_min"),
    )


def coverage_by_source(per_match: DataFrame) -> DataFrame:
    return aggregate_with_quantiles(
        per_match,
        ["source"],
        {
            "matches": F.count(F.lit(1)),
            "mean_duration_min": F.avg("duration_min"),
            "min_duration_min": F.min("duration_min"),
            "max_duration_min": F.max("duration_min"),
        },
        {"median_duration_min": ("duration_min", 0.5)},
    )


def ball_status(df: DataFrame) -> DataFrame:
    """Shares of in play, out of play and unknown frames per match."""
    return df.groupBy("source", "match_id").agg(
        share(F.col("ball_status")).alias("frac_true"),
        share(~F.col("ball_status")).alias("frac_false"),
        share(F.col("ball_status").isNull()).alias("frac_null"),
    )


def ball_status_by_source(per_match: DataFrame) -> DataFrame:
    return per_match.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.avg("frac_true").alias("mean_true"),
        F.min("frac_true").alias("min_true"),
        F.max("frac_true").alias("max_true"),
    )


def null_rate(df: DataFrame, column: str = "ball_poss_team_id") -> DataFrame:
    return df.groupBy("source", "match_id").agg(share(F.col(column).isNull()).alias("null_rate"))


def _distribution(df: DataFrame, column: str, extra: dict[str, Column]) -> DataFrame:
    return aggregate_with_quantiles(
        df.filter(F.col(column).isNotNull()),
        ["source"],
        {
            "n": F.count(F.lit(1)),
            "min": F.min(column),
            "mean": F.avg(column),
            "max": F.max(column),
            **extra,
        },
        {"p01": (column, 0.01), "median": (column, 0.5), "p99": (column, 0.99)},
    )


def ball_height(df: DataFrame) -> DataFrame:
    return _distribution(df, "ball_z", {"frac_negative": share(F.col("ball_z") < 0)})


def cadence(
    df: DataFrame,
    *,
    keys: Sequence[str] = TRACK_KEYS,
    order: str = "frame_id",
    seconds: str = "t_s",
    near: tuple[float, float] = (0.079, 0.121),
    name: str = "frac_in_0_08_to_0_12",
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Distribution of the time between consecutive rows of a player, per source.

    ``name`` is the share of steps within ``near``.
    """
    steps = time_steps(df, keys, order, seconds=seconds, span=span, rows=rows)
    ok = steps.filter((F.col("dt_s") > 0) & (F.col("dt_s") < 5.0)).select("source", "dt_s")
    return _distribution(ok, "dt_s", {name: share(F.col("dt_s").between(*near))})


def _diffs(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], span: int, rows: int) -> DataFrame:
    chunks = open_series(df, keys, order, before=1, span=span, rows=rows)
    w = chunks.window()
    return chunks.with_df(
        chunks.df.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})
    ).close()


def distance_agreement(
    df: DataFrame, *, keys: Sequence[str] = TRACK_KEYS, order: str = "frame_id",
    span: int = DEFAULT_SPAN, rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Stored distance against the distance between consecutive positions."""
    moved = _diffs(df, keys, order, ("x", "y"), span, rows).withColumn(
        "_diff",
        F.abs(F.col("distance_m") - F.sqrt(F.col("_d_x") * F.col("_d_x") + F.col("_d_y") * F.col("_d_y"))),
    )
    return moved.filter(F.col("_diff").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.avg("_diff").alias("mean_abs_diff_m"),
        F.max("_diff").alias("max_abs_diff_m"),
        share(F.col("_diff") > 1e-3).alias("frac_above_1mm"),
    )


def speed_agreement(df: DataFrame, *, dt: float = 0.1) -> DataFrame:
    """Stored speed against stored distance over the nominal time step."""
    rows = df.withColumn(
        "_diff", F.abs(F.col("speed_kmh") - F.col("distance_m") / F.lit(dt) * 3.6)
    ).filter(F.col("_diff").isNotNull())
    return aggregate_with_quantiles(
        rows,
        ["source"],
        {"n_compared": F.count(F.lit(1)), "mean_abs_diff_kmh": F.avg("_diff")},
        {"p95_abs_diff_kmh": ("_diff", 0.95), "p99_abs_diff_kmh": ("_diff", 0.99)},
    )


def acceleration_agreement(
    df: DataFrame, *, dt: float = 0.1, keys: Sequence[str] = TRACK_KEYS, order: str = "frame_id",
    span: int = DEFAULT_SPAN, rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Stored acceleration against the change of filtered speed."""
    moved = _diffs(
        df.withColumn("_v", F.col("speed_kmh_filtered") / 3.6), keys, order, ("_v",), span, rows
    ).withColumn("_diff", F.abs(F.col("acceleration_ms2") - F.col("_d__v") / F.lit(dt)))
    return aggregate_with_quantiles(
        moved.filter(F.col("_diff").isNotNull()),
        ["source"],
        {"n_compared": F.count(F.lit(1)), "mean_abs_diff_ms2": F.avg("_diff"), "max_abs_diff_ms2": F.max("_diff")},
        {"p99_abs_diff_ms2": ("_diff", 0.99)},
    )


def kinematic_summary(df: DataFrame) -> DataFrame:
    rows = df.withColumn("_abs_a", F.abs("acceleration_ms2_filtered"))
    v = "speed_kmh_filtered"
    negative = F.avg(F.when(F.col(v).isNotNull(), (F.col(v) < 0).cast("int")))
    return aggregate_with_quantiles(
        rows,
        ["source"],
        {
            "n_rows": F.count(F.lit(1)),
            "n_visible": F.count_if(F.col("is_visible")),
            "speed_mean_kmh": F.avg(v),
            "speed_max_kmh": F.max(v),
            "speed_negative_frac": negative,
            "accel_mean_ms2": F.avg("acceleration_ms2_filtered"),
            "accel_max_abs_ms2": F.max("_abs_a"),
        },
        {"speed_median_kmh": (v, 0.5), "speed_p99_kmh": (v, 0.99), "accel_p99_abs_ms2": ("_abs_a", 0.99)},
    )


def speed_bands(df: DataFrame, *, column: str = "speed_kmh_filtered") -> DataFrame:
    """Share of player time in each speed band, per source."""
    v = F.col(column)
    aggregates = [F.count(v).alias("n_visible_kinematic")]
    for name, low, high in K.SPEED_BANDS:
        inside = v >= low if high is None else (v >= low) & (v < high)
        aggregates.append(F.avg(F.when(v.isNotNull(), inside.cast("int"))).alias(name))
    return df.groupBy("source").agg(*aggregates)


def native_kinematics(frames: DataFrame) -> DataFrame:
    """How many raw player frames carry a non-zero native speed and acceleration."""
    return frames.filter(~F.col("team_id").isin("BALL", "referee")).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("frames_checked"),
        F.count_if(F.col("speed_kmh") != 0).alias("nonzero_speed"),
        F.count_if(F.col("acceleration_ms2") != 0).alias("nonzero_accel"),
    )


def label_summary(roster: DataFrame) -> DataFrame:
    """Roster label coverage per source."""
    return roster.groupBy("source").agg(
        F.count("player_id").alias("roster_players"),
        F.count("position_raw").alias("players_with_position_raw"),
        F.count("position_group").alias("players_with_position_group"),
        F.count_if(F.col("starting")).alias("starters"),
        F.count("start_time").alias("used_players"),
        (F.count("position_group") / F.count("player_id")).alias("position_group_rate"),
    )


def label_counts(roster: DataFrame, column: str) -> DataFrame:
    return roster.groupBy("source", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def label_coverage(df: DataFrame) -> DataFrame:
    """Players tracked, players seen and share of labelled rows per match."""
    return df.groupBy("source", "match_id").agg(
        F.count_distinct("player_id").alias("tracking_players"),
        F.count_distinct(F.when(F.col("is_visible"), F.col("player_id"))).alias("visible_players"),
        share(F.col("position_group").isNotNull()).alias("labelled_rate"),
    )


# Checks on nested match sheets ----------------------------------------------------------


def match_sheet_shape(sheets: DataFrame) -> DataFrame:
    """Presence and size of the required parts of each match sheet."""
    match = "match"
    return sheets.select(
        "match_id",
        F.col(f"{match}.result.final").isNotNull().alias("has_result_final"),
        F.col(f"{match}.result.first_half").isNotNull().alias("has_result_first_half"),
        F.col(f"{match}.result.second_half").isNotNull().alias("has_result_second_half"),
        F.col(f"{match}.status.is_neutral").isNotNull().alias("has_status_is_neutral"),
        F.col(f"{match}.events.goals").isNotNull().alias("has_events_goals"),
        F.col(f"{match}.events.cards").isNotNull().alias("has_events_cards"),
        F.col(f"{match}.events.substitutions").isNotNull().alias("has_events_substitutions"),
        F.size(F.coalesce(F.col(f"{match}.events.goals"), F.array())).alias("n_goals"),
        F.size(F.coalesce(F.col(f"{match}.events.cards"), F.array())).alias("n_cards"),
        F.size(F.coalesce(F.col(f"{match}.events.substitutions"), F.array())).alias("n_substitutions"),
    )


def referees_present(sheets: DataFrame) -> DataFrame:
    ids = F.col("referees.id")
    n = F.size(F.coalesce(ids, F.array()))
    return sheets.select(
        "match_id",
        n.alias("n_referees"),
        F.when(n > 0, F.forall(ids, lambda i: i.isNotNull())).otherwise(False).alias("ids_set"),
    )


def meta_naming(sheets: DataFrame) -> DataFrame:
    tracking = "meta.tracking"
    out = sheets.select(
        "match_id",
        F.col(f"{tracking}.name").isNotNull().alias("tracking_has_name"),
        F.col(f"{tracking}.fps").isNotNull().alias("tracking_has_fps"),
        F.col(f"{tracking}.version").isNotNull().alias("tracking_has_version"),
        F.col(f"{tracking}.collection_timing").isNotNull().alias("tracking_has_collection_timing"),
        F.col("meta.event.name").isNotNull().alias("event_has_name"),
        F.col("meta.format.version").alias("format_version"),
    )
    return out.withColumn(
        "compliant",
        F.col("tracking_has_name") & F.col("tracking_has_fps") & F.col("tracking_has_collection_timing"),
    )


def long_form(df: DataFrame, check: str, keys: Sequence[str], compliant: Column | None = None) -> DataFrame:
    """(check, subject, metric, value, compliant) rows of a check's numeric columns."""
    numeric = [
        f.name
        for f in df.schema.fields
        if f.name not in keys and f.dataType.typeName() in ("double", "long", "integer", "boolean")
        and f.name != "compliant"
    ]
    verdict = F.col("compliant") if "compliant" in df.columns else F.lit(None).cast("boolean")
    subject = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    values = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("int").cast("double").alias("value"))
            if df.schema[n].dataType.typeName() == "boolean"
            else F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
            for n in numeric
        ]
    )
    return df.select(
        F.lit(check).alias("check"),
        subject.alias("subject"),
        (verdict if compliant is None else compliant).alias("compliant"),
        F.explode(values).alias("m"),
    ).select("check", "subject", "m.metric", "m.value", "compliant")


def run_audit(
    tracking: DataFrame,
    directions: DataFrame,
    *,
    sources: tuple[str, str] = (K.SOURCE_XML, K.SOURCE_JSON),
    seconds: str = "t_s",
) -> DataFrame:
    """All tracking checks as one report table."""
    match = ["source", "match_id"]
    zero = (F.col("starts_at_zero") & F.col("gap_free"))
    parts = [
        long_form(coordinate_bounds(tracking), "coordinate_bounds", match),
        long_form(frame_ids(tracking), "frame_ids", ["match_id"], zero),
        long_form(enum_values(tracking, "period", K.PERIODS), "period_enum", ["value"]),
        long_form(enum_values(directions, "play_direction", K.DIRECTIONS), "direction_enum", ["value"]),
        long_form(enum_values(tracking, "position_group", K.POSITION_GROUPS), "position_groups", ["value"]),
        long_form(precision(tracking), "precision", [*match, "column"], F.col("n_offending") == 0),
        long_form(visibility(tracking), "visibility", match),
        long_form(id_overlap(tracking, *sources).groupBy("kind").agg(F.count(F.lit(1)).alias("n_shared")), "id_overlap", ["kind"], F.lit(False)),
        long_form(direction_prior(directions), "direction_prior", ["source"]),
        long_form(home_keeper_side(tracking), "home_keeper_side", [*match, "period"]),
        long_form(coverage(tracking), "coverage", match),
        long_form(ball_status(tracking), "ball_status", match),
        long_form(null_rate(tracking), "possession_nulls", match),
        long_form(ball_height(tracking), "ball_height", ["source"]),
        long_form(cadence(tracking, seconds=seconds), "cadence", ["source"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
