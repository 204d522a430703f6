"""Frame, team, player and action feature views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators import joins as J
from touchline.operators.quantiles import aggregate_with_quantiles
from touchline.operators.sampling import sample_frames, sample_per_group
from touchline.operators.trajectory import onsets, visible_segments
from touchline.session import materialise

SPEED, ACCEL, DIST = "speed_kmh_filtered", "acceleration_ms2_filtered", "distance_m"
PROFILE_KEYS = ["source", "match_id", "player_id", "position_group"]


def shown(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_visible"))


def frame_state(df: DataFrame, *, frames_per_match: int | None = None, seed: int = K.SEED) -> DataFrame:
    """One row per frame: ball, visible players and their spread; label ``ball_in_play``.

    Frames whose ball status is unknown are dropped.
    """
    rows = shown(sample_frames(df, frames_per_match, seed=seed))

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("player_id")))

    view = rows.groupBy("source", "match_id", "frame_id", "period").agg(
        first("ball_status").alias("_status"),
        *[first(c).alias(c) for c in ("ball_x", "ball_y", "ball_z")],
        F.count(F.lit(1)).alias("n_visible"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        F.stddev_samp("x").alias("spread_x"),
        F.stddev_samp("y").alias("spread_y"),
        F.avg(SPEED).alias("mean_speed"),
        F.stddev_samp(SPEED).alias("std_speed"),
        F.avg(ACCEL).alias("mean_accel"),
    )
    return (
        view.filter(F.col("_status").isNotNull())
        .withColumn("ball_in_play", F.col("_status").cast("int"))
        .withColumn("period_second_half", S.second_half(F.col("period")))
        .drop("_status", "period")
    )


def with_role(
    df: DataFrame, roster_roles: DataFrame | None, *, roles: Mapping[str, str] | None = None
) -> DataFrame:
    """Tactical role from the row's label, else from the roster; rows without one and
    goalkeepers are dropped. ``roster_roles``: match_id, player_id, roster_role."""
    roles = K.ROLE_BY_LABEL if roles is None else roles
    role = S.lookup(F.col("position_label"), roles)
    if roster_roles is not None:
        df = df.join(roster_roles, ["match_id", "player_id"], "left")
        role = F.coalesce(role, F.col("roster_role"))
    out = df.withColumn("position_group", role).filter(
        F.col("position_group").isNotNull() & (F.col("position_group") != "GK")
    )
    return out.drop("roster_role")


def roster_roles(roster: DataFrame, *, roles: Mapping[str, str] | None = None) -> DataFrame:
    """Role per (match, player): from the roster label, or its coarse group without a label."""
    roles = K.ROLE_BY_LABEL if roles is None else roles
    role = F.when(
        F.col("position_label").isNotNull(), S.lookup(F.col("position_label"), roles)
    ).otherwise(F.col("position_group"))
    return (
        roster.select("match_id", "player_id", role.alias("roster_role"))
        .filter(F.col("roster_role").isNotNull())
        .groupBy("match_id", "player_id")
        .agg(F.max("roster_role").alias("roster_role"))
    )


def _player_rows(
    df: DataFrame,
    roster: DataFrame | None,
    roles: Mapping[str, str] | None,
    max_frames: int | None,
    seed: int,
) -> DataFrame:
    """Sampled rows with role, team-relative position and distance to the ball."""
    rows = with_role(df.filter(F.col("team_id").isNotNull()), roster, roles=roles)
    rows = sample_per_group(
        rows, ["match_id", "player_id"], max_frames, ["match_id", "player_id", "frame_id"], seed=seed
    )
    rows = J.with_centroid(rows)
    rows = rows.withColumns(
        {
            "dist_to_ball": S.distance(F.col("ball_x"), F.col("ball_y"), F.col("x"), F.col("y")),
            "period_second_half": S.second_half(F.col("period")),
            "is_home": F.col("is_home").cast("int"),
        }
    )
    used = [*PROFILE_KEYS, "frame_id", "x", "y", "rel_x", "rel_y", SPEED, DIST, "dist_to_ball", "is_home", "period_second_half"]
    return materialise(rows.select(*used, *[c for c in (ACCEL,) if c in rows.columns]))


def player_profile(
    df: DataFrame,
    roster: DataFrame | None = None,
    *,
    roles: Mapping[str, str] | None = None,
    max_frames: int | None = None,
    min_frames: int = 200,
    seed: int = K.SEED,
) -> DataFrame:
    """Where and how a player moved in a match; one row per player-match and role."""
    rows = _player_rows(shown(df), roster, roles, max_frames, seed)
    aggregates = {
        "n_frames": F.count_distinct("frame_id"),
        "x_mean": F.avg("x"),
        "y_mean": F.avg("y"),
        "x_std": F.stddev_samp("x"),
        "y_std": F.stddev_samp("y"),
        "rel_x_std": F.stddev_samp("rel_x"),
        "rel_y_std": F.stddev_samp("rel_y"),
        "speed_mean": F.avg(SPEED),
        "speed_std": F.stddev_samp(SPEED),
        "accel_mean": F.avg(ACCEL),
        "accel_std": F.stddev_samp(ACCEL),
        "distance_sum": F.coalesce(F.sum(DIST), F.lit(0.0)),
        "dist_to_ball_mean": F.avg("dist_to_ball"),
        "is_home": F.min_by("is_home", "frame_id"),
        "second_half_share": F.avg("period_second_half"),
    }
    quantiles = {
        "x_median": ("x", 0.5), "y_median": ("y", 0.5),
        "_x10": ("x", 0.1), "_x90": ("x", 0.9), "_y10": ("y", 0.1), "_y90": ("y", 0.9),
        "rel_x_median": ("rel_x", 0.5), "rel_y_median": ("rel_y", 0.5),
        "speed_median": (SPEED, 0.5), "speed_q90": (SPEED, 0.9),
        "dist_to_ball_median": ("dist_to_ball", 0.5),
    }
    out = aggregate_with_quantiles(rows, PROFILE_KEYS, aggregates, quantiles)
    return (
        out.filter(F.col("n_frames") >= min_frames)
        .withColumns(
            {"x_range": F.col("_x90") - F.col("_x10"), "y_range": F.col("_y90") - F.col("_y10")}
        )
        .drop("_x10", "_x90", "_y10", "_y90")
    )


def without_kinematics(profile: DataFrame) -> DataFrame:
    """The profile without speed, acceleration and distance columns."""
    dropped = [
        c for c in profile.columns if c.startswith(("speed_", "accel_")) or c == "distance_sum"
    ]
    return profile.drop(*dropped)


def intensity_rates(
    df: DataFrame,
    roster: DataFrame | None = None,
    *,
    roles: Mapping[str, str] | None = None,
    max_frames: int | None = None,
    min_frames: int = 200,
    continuous_frames: int | None = None,
    high_speed: float = K.HIGH_SPEED_KMH,
    sprint: float = K.SPRINT_KMH,
    seed: int = K.SEED,
) -> DataFrame:
    """Running intensity per observed minute with role and location features.

    With ``continuous_frames`` only rows of unbroken visible stretches of that length
    count. Rows without a target value are dropped.
    """
    if continuous_frames is None:
        base = shown(df)
    else:
        labelled = with_role(df.filter(F.col("team_id").isNotNull()), roster, roles=roles)
        base = visible_segments(
            labelled.drop("position_group"), ["match_id", "player_id"], "frame_id", min_rows=continuous_frames
        )
    rows = _player_rows(base, roster, roles, max_frames, seed)
    rows = rows.withColumn(
        "_hsr", F.when(F.col(SPEED) >= high_speed, F.col(DIST)).otherwise(0.0)
    )
    rows = onsets(
        rows, ["match_id", "player_id"], "frame_id", F.col(SPEED) >= sprint, name="_sprint"
    )
    aggregates = {
        "n_frames": F.count_distinct("frame_id"),
        "x_std": F.stddev_samp("x"),
        "y_std": F.stddev_samp("y"),
        "rel_x_std": F.stddev_samp("rel_x"),
        "rel_y_std": F.stddev_samp("rel_y"),
        "dist_to_ball_std": F.stddev_samp("dist_to_ball"),
        "is_home": F.min_by("is_home", "frame_id"),
        "second_half_share": F.avg("period_second_half"),
        "total_distance_m": F.coalesce(F.sum(DIST), F.lit(0.0)),
        "hsr_distance_m": F.coalesce(F.sum("_hsr"), F.lit(0.0)),
        "sprint_count": F.sum("_sprint"),
        "vmax_kmh": F.max(SPEED),
        "mean_speed_kmh": F.avg(SPEED),
    }
    quantiles = {
        "x_median": ("x", 0.5), "y_median": ("y", 0.5),
        "rel_x_median": ("rel_x", 0.5), "rel_y_median": ("rel_y", 0.5),
        "dist_to_ball_median": ("dist_to_ball", 0.5),
    }
    out = aggregate_with_quantiles(rows, PROFILE_KEYS, aggregates, quantiles)
    minutes = F.col("n_frames") / F.lit(float(K.FRAMES_PER_MINUTE))
    return (
        out.filter(F.col("n_frames") >= min_frames)
        .withColumns(
            {
                "distance_per_minute_m": F.col("total_distance_m") / minutes,
                "hsr_per_minute_m": F.col("hsr_distance_m") / minutes,
            }
        )
        .dropna(subset=["distance_per_minute_m", "hsr_per_minute_m", "mean_speed_kmh"])
    )


def team_shape(
    df: DataFrame,
    *,
    frames_per_match: int | None = None,
    min_visible: int | None = 8,
    min_outfield: int | None = None,
    seed: int = K.SEED,
) -> DataFrame:
    """Centroid, width, depth, spread and speed of each visible team per frame."""
    rows = sample_frames(
        shown(df).filter(F.col("team_id").isNotNull()), frames_per_match, seed=seed
    )
    outfield = (~F.col("position_label").eqNullSafe("GK")).cast("int")
    view = rows.groupBy("source", "match_id", "team_id", "frame_id", "period", "is_home").agg(
        F.count(F.lit(1)).alias("n_visible"),
        F.sum(outfield).alias("n_outfield_visible"),
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        (F.max("y") - F.min("y")).alias("width_y"),
        (F.max("x") - F.min("x")).alias("depth_x"),
        F.stddev_samp("x").alias("spread_x"),
        F.stddev_samp("y").alias("spread_y"),
        F.avg(SPEED).alias("mean_speed"),
        F.stddev_samp(SPEED).alias("std_speed"),
    )
    if min_visible is not None:
        view = view.filter(F.col("n_visible") >= min_visible)
    if min_outfield is not None:
        view = view.filter(F.col("n_outfield_visible") >= min_outfield)
    return view.withColumn("period_second_half", S.second_half(F.col("period"))).withColumn(
        "is_home", F.col("is_home").cast("int")
    )


TEAM_SHAPE_CORE = [
    "source", "match_id", "centroid_x", "centroid_y", "width_y", "depth_x", "spread_x",
    "spread_y", "mean_speed", "std_speed",
]
TEAM_SHAPE_STRICT = ["source", "match_id", "centroid_x", "centroid_y", "mean_speed", "std_speed"]
PLAYER_CORE = ["source", "match_id", "x", "y", SPEED, ACCEL, DIST]


def oriented(df: DataFrame, directions: DataFrame, *, normalised: str | None = None) -> DataFrame:
    """Mirror x where the home side attacked right to left.

    ``directions``: match_id, period, play_direction, and optionally a ``normalised``
    flag; rows of matches that are already normalised keep their x.
    """
    extra = [normalised] if normalised else []
    out = df.join(
        directions.select("match_id", "period", "play_direction", *extra), ["match_id", "period"], "left"
    )
    direction = F.col("play_direction")
    if normalised:
        direction = F.when(~F.coalesce(F.col(normalised), F.lit(False)), direction)
    return out.withColumn("x", S.flip_if(F.col("x"), direction)).drop("play_direction", *extra)


def player_view(
    df: DataFrame,
    *,
    rows_per_match: int | None = None,
    min_outfield: int | None = None,
    seed: int = K.SEED,
) -> DataFrame:
    """Visible player rows, optionally only of well-covered team-frames, sampled per match."""
    rows = shown(df)
    if min_outfield is not None:
        rows = J.covered_team_frames(rows.filter(F.col("team_id").isNotNull()), minimum=min_outfield)
    rows = sample_per_group(
        rows, ["match_id"], rows_per_match, ["match_id", "player_id", "frame_id"], seed=seed
    )
    return rows.withColumns(
        {
            "period_second_half": S.second_half(F.col("period")),
            "is_home": F.col("is_home").cast("int"),
            "ball_status": F.col("ball_status").cast("int"),
        }
    )


def event_view(
    actions: DataFrame,
    action_types: Sequence[str],
    results: Sequence[str],
    *,
    comparable_only: bool = False,
) -> DataFrame:
    """Displacement and one-hot columns of actions; categories are given, so the schema is fixed."""
    rows = actions
    if comparable_only:
        rows = rows.filter(S.comparable(F.col("action_type")))
    geometry = S.pass_geometry()
    return rows.select(
        "source", "match_id", "event_id", "start_x", "start_y", "end_x", "end_y",
        geometry["pass_dx"].alias("dx"),
        geometry["pass_dy"].alias("dy"),
        geometry["pass_length_m"].alias("distance"),
        S.comparable(F.col("action_type")).cast("int").alias("cross_dataset_comparable"),
        *S.one_hot("action_type", action_types),
        *S.one_hot("result", results),
    )


def pass_view(actions: DataFrame) -> DataFrame:
    """Passes with complete coordinates, their geometry and success label."""
    rows = actions.filter(F.col("action_type") == "pass").dropna(
        subset=["start_x", "start_y", "end_x", "end_y"]
    )
    return rows.withColumns(
        {
            "pass_success": F.coalesce((F.col("result") == "success").cast("int"), F.lit(0)),
            **S.pass_geometry(),
            "second_half": S.second_half(F.col("period")),
        }
    )


def shot_view(actions: DataFrame, *, away: Column | None = None) -> DataFrame:
    rows = actions.filter(F.col("action_type").isin(*K.SHOT_ACTIONS)).dropna(
        subset=["start_x", "start_y"]
    )
    won = F.col("result").isin("success", "successful")
    return rows.withColumns(
        {
            "shot_success": F.coalesce(won.cast("int"), F.lit(0)),
            "second_half": S.second_half(F.col("period")),
            **S.shot_geometry(away=away),
            "is_set_piece": (F.col("action_type") != "shot").cast("int"),
        }
    )


def pass_context(
    passes: DataFrame,
    tracking: DataFrame,
    *,
    event_id: Sequence[str] = ("event_id",),
    event_time: str = "t_ms",
    frame_time: str = "t_ms",
    tolerance: int = 200,
) -> DataFrame:
    """Players around the start and end of each pass in its nearest frame.

    Passes without a frame within the tolerance, or without visible players, are dropped.
    """
    seen = shown(tracking).filter(F.col(frame_time).isNotNull())
    frames = seen.groupBy("match_id", "frame_id").agg(F.min(frame_time).alias("_ft"))
    matched = J.nearest_within(
        passes, frames, keys=["match_id"], event_id=list(event_id), event_time=event_time,
        frame_time="_ft", tolerance=tolerance, carry=["frame_id"],
    )
    players = seen.select(
        "match_id", "frame_id", F.col("team_id").alias("_team"), F.col("x").alias("_x"), F.col("y").alias("_y")
    )
    met = matched.join(players, ["match_id", "frame_id"])
    to_start = S.distance(F.col("_x"), F.col("_y"), F.col("start_x"), F.col("start_y"))
    to_end = S.distance(F.col("_x"), F.col("_y"), F.col("end_x"), F.col("end_y"))
    mate = F.coalesce(F.col("_team") == F.col("team_id"), F.lit(False))
    met = met.withColumns({"_s": to_start, "_e": to_end, "_mate": mate})

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    context = met.groupBy("match_id", *event_id).agg(
        F.count(F.lit(1)).alias("n_visible_frame"),
        F.count_if(mate).alias("_n_mates"),
        n(mate & (F.col("_s") <= 10)).alias("teammates_within_10m_start"),
        n(~mate & (F.col("_s") <= 10)).alias("opponents_within_10m_start"),
        n(~mate & (F.col("_s") <= 3)).alias("opponents_within_3m_start"),
        n(~mate & (F.col("_e") <= 5)).alias("opponents_within_5m_end"),
        F.min(F.when(~mate, F.col("_s"))).alias("min_dist_opponent_to_start"),
        F.min(F.when(mate, F.col("_e"))).alias("min_dist_teammate_to_end"),
    )
    rivals = F.col("n_visible_frame") - F.col("_n_mates")
    context = context.withColumns(
        {
            "teammates_within_10m_start": F.when(
                F.col("_n_mates") > 0, F.col("teammates_within_10m_start")
            ),
            **{
                c: F.when(rivals > 0, F.col(c))
                for c in (
                    "opponents_within_10m_start",
                    "opponents_within_3m_start",
                    "opponents_within_5m_end",
                )
            },
        }
    ).drop("_n_mates")
    return passes.join(context, ["match_id", *event_id])


def player_context(
    df: DataFrame, *, max_frames: int | None = None, seed: int = K.SEED
) -> DataFrame:
    """Mean crowding and median minimum distances of each player in a match."""
    rows = sample_per_group(
        shown(df), ["match_id", "player_id"], max_frames, ["match_id", "player_id", "frame_id"], seed=seed
    )
    near = materialise(J.neighbours_in_frame(rows))
    keys = ["match_id", "player_id"]
    return aggregate_with_quantiles(
        near,
        keys,
        {
            "ctx_opponents_5m_mean": F.avg("opponents_within_5m"),
            "ctx_opponents_10m_mean": F.avg("opponents_within_10m"),
            "ctx_teammates_5m_mean": F.avg("teammates_within_5m"),
        },
        {
            "ctx_min_dist_opponent_median": ("min_dist_opponent", 0.5),
            "ctx_min_dist_teammate_median": ("min_dist_teammate", 0.5),
        },
    )


def mean_pool(df: DataFrame, groups: Sequence[str], vector: str, size: int, prefix: str = "emb") -> DataFrame:
    """Component-wise mean of an array column per group, as one column per component."""
    return df.groupBy(*groups).agg(
        *[F.avg(F.get(F.col(vector), F.lit(i))).alias(f"{prefix}_{i:03d}") for i in range(size)]
    )


def match_stats(df: DataFrame, *, visibility_source: str = K.SOURCE_JSON) -> DataFrame:
    visible = F.when(F.col("source") == visibility_source, F.col("is_visible").cast("int"))
    return df.groupBy("source", "match_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("player_id").alias("players"),
        F.count_distinct("frame_id").alias("frames"),
        (F.avg(visible) * 100).alias("visible_pct"),
    )
