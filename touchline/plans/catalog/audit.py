"""Audit queries over the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.operators import audit as D
from touchline.plans.registry import query, rounded
from touchline.plans.standin import Tables
from touchline.session import materialise

KEYS = ["match_id", "player_id", "period"]


def _floats(df: DataFrame) -> DataFrame:
    return rounded(df, [c for c, kind in df.dtypes if kind == "double"])


def _r(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) as {n}" for n in names)


def tracking(t: Tables) -> DataFrame:
    """Harmonised-looking rows with the columns the checks read."""
    return t.view("harm_v").withColumns(
        {
            "position_group": F.when(F.col("position_label") == "GK", "GK").when(F.col("position_label").isNotNull(), "MID"),
            "t_s": F.col("t_ms") / 1000.0,
            "speed_kmh": F.col("speed_kmh_filtered"),
            "acceleration_ms2": F.col("acceleration_ms2_filtered"),
        }
    )


_T = """
tr as (select *, case when position_label = 'GK' then 'GK' when position_label is not null then 'MID' end as position_group,
  t_ms / 1000.0 as t_s from harm_v)
"""


@query(
    "audit_bounds",
    "harm_v",
    f"""
with b as (select source, match_id, avg(cast(abs(x) > 35 as int)) as frac_x_outside, avg(cast(abs(y) > 4 as int)) as frac_y_outside,
  quantile_cont(x, 0.001) as x_p001, quantile_cont(x, 0.999) as x_p999, quantile_cont(y, 0.001) as y_p001, quantile_cont(y, 0.999) as y_p999
  from harm_v where is_visible and ball_status group by 1, 2)
select source, match_id, {_r("frac_x_outside", "frac_y_outside", "x_p001", "x_p999", "y_p001", "y_p999")} from b
""",
)
def audit_bounds(t: Tables) -> DataFrame:
    return _floats(D.coordinate_bounds(tracking(t), length=F.lit(70.0), width=F.lit(8.0)))


@query(
    "audit_frames",
    "harm_v",
    """
select match_id, min(frame_id) as min_frame_id, max(frame_id) as max_frame_id, count(distinct frame_id) as n_frames,
  min(frame_id) = 0 as starts_at_zero, max(frame_id) - min(frame_id) + 1 = count(distinct frame_id) as gap_free
from harm_v group by 1
""",
)
def audit_frames(t: Tables) -> DataFrame:
    return D.frame_ids(tracking(t))


@query(
    "audit_enum",
    "harm_v directions_v",
    f"""
with {_T.strip()}
select 'period' as field, period as value, count(*) as n, true as compliant from tr group by 2
union all select 'position_group', position_group, count(*), position_group = 'GK' from tr where position_group is not null group by 2
union all select 'play_direction', play_direction, count(*), true from directions_v group by 2
""",
)
def audit_enum(t: Tables) -> DataFrame:
    df = tracking(t)
    parts = [
        D.enum_values(df, "period", K.PERIODS).withColumn("field", F.lit("period")),
        D.enum_values(df, "position_group", K.POSITION_GROUPS).withColumn("field", F.lit("position_group")),
        D.enum_values(t.view("directions_v"), "play_direction", K.DIRECTIONS).withColumn("field", F.lit("play_direction")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "audit_precision",
    "harm_v",
    """
select source, match_id, 'x' as "column", count(*) filter (abs(x / 7 - round(x / 7, 3)) > 1e-9) as n_offending from harm_v group by 1, 2
union all select source, match_id, 'y', count(*) filter (abs(y - round(y, 3)) > 1e-9) from harm_v group by 1, 2
union all select source, match_id, 'ball_z', count(*) filter (abs(ball_z - round(ball_z, 3)) > 1e-9) from harm_v group by 1, 2
""",
)
def audit_precision(t: Tables) -> DataFrame:
    return D.precision(tracking(t).withColumn("x", F.col("x") / 7))


@query(
    "audit_visibility",
    "harm_v",
    """
select source, match_id, count(*) filter (not is_visible) as n_invisible, count(*) filter (not is_visible and x is not null) as hidden_with_x,
  count(*) filter (not is_visible and speed_kmh_filtered is not null) as hidden_with_speed,
  count(*) filter (not is_visible and acceleration_ms2_filtered is not null) as hidden_with_accel,
  count(*) filter (is_visible and x is null) as visible_without_x, count(*) filter (is_visible and y is null) as visible_without_y,
  count(*) filter (not is_visible and (x is not null or speed_kmh_filtered is not null or acceleration_ms2_filtered is not null)
    or is_visible and (x is null or y is null)) = 0 as compliant
from harm_v group by 1, 2
""",
)
def audit_visibility(t: Tables) -> DataFrame:
    return D.visibility(tracking(t))


@query(
    "id_overlap",
    "harm_v",
    """
select 'player_id' as kind, player_id as id from harm_v group by 2 having count(distinct source) > 1
union all select 'team_id', team_id from harm_v group by 2 having count(distinct source) > 1
union all select 'match_id', match_id from harm_v group by 2 having count(distinct source) > 1
""",
)
def id_overlap(t: Tables) -> DataFrame:
    return D.id_overlap(tracking(t), "A", "B")


@query(
    "audit_orientation",
    "directions_v",
    f"""
with d as (select source, avg(cast(play_direction = 'left_right' as int)) as frac_left_right,
  avg(cast(play_direction = 'right_left' as int)) as frac_right_left, count(*) as n_matches
  from directions_v where period = 'first_half' group by 1)
select source, n_matches, {_r("frac_left_right", "frac_right_left")} from d
""",
)
def audit_orientation(t: Tables) -> DataFrame:
    return _floats(D.direction_prior(t.view("directions_v")))


@query(
    "audit_gk",
    "harm_v",
    f"""
with {_T.strip()}, g as (select source, match_id, period, avg(x) as home_gk_mean_x from tr
  where is_home and position_group = 'GK' and is_visible group by 1, 2, 3)
select source, match_id, period, {_r("home_gk_mean_x")}, home_gk_mean_x < 0 as compliant from g
""",
)
def audit_gk(t: Tables) -> DataFrame:
    return _floats(D.home_keeper_side(tracking(t)))


_COVERAGE = """
cov as (select source, match_id, count(distinct frame_id) as n_frames,
  round(count(distinct frame_id) / 600.0 + 1e-9, 2) as duration_min,
  round(count(distinct case when period = 'first_half' then frame_id end) / 600.0 + 1e-9, 2) as first_half_min,
  round(count(distinct case when period = 'second_half' then frame_id end) / 600.0 + 1e-9, 2) as second_half_min
  from harm_v group by 1, 2)
"""


@query("audit_coverage", "harm_v", f"with {_COVERAGE.strip()} select * from cov")
def audit_coverage(t: Tables) -> DataFrame:
    return D.coverage(tracking(t))


@query(
    "audit_coverage_source",
    "harm_v",
    f"""
with {_COVERAGE.strip()}, s as (select source, count(*) as matches, avg(duration_min) as mean_duration_min, min(duration_min) as min_duration_min,
  max(duration_min) as max_duration_min, quantile_cont(duration_min, 0.5) as median_duration_min from cov group by 1)
select source, matches, {_r("mean_duration_min", "min_duration_min", "max_duration_min", "median_duration_min")} from s
""",
)
def audit_coverage_source(t: Tables) -> DataFrame:
    return _floats(D.coverage_by_source(D.coverage(tracking(t))))


_STATUS = """
st as (select source, match_id, avg(cast(coalesce(ball_status, false) as int)) as frac_true,
  avg(cast(coalesce(not ball_status, false) as int)) as frac_false, avg(cast(ball_status is null as int)) as frac_null
  from harm_v group by 1, 2)
"""


@query("audit_status", "harm_v", f"with {_STATUS.strip()} select source, match_id, {_r('frac_true', 'frac_false', 'frac_null')} from st")
def audit_status(t: Tables) -> DataFrame:
    return _floats(D.ball_status(tracking(t)))


@query(
    "audit_status_source",
    "harm_v",
    f"""
with {_STATUS.strip()}, s as (select source, count(*) as n_matches, avg(frac_true) as mean_true, min(frac_true) as min_true, max(frac_true) as max_true from st group by 1)
select source, n_matches, {_r("mean_true", "min_true", "max_true")} from s
""",
)
def audit_status_source(t: Tables) -> DataFrame:
    return _floats(D.ball_status_by_source(D.ball_status(tracking(t))))


@query(
    "audit_nulls",
    "harm_v",
    "select source, match_id, round(avg(cast(ball_poss_team_id is null as int)) + 1e-9, 6) as null_rate from harm_v group by 1, 2",
)
def audit_nulls(t: Tables) -> DataFrame:
    return _floats(D.null_rate(tracking(t)))


def _dist_sql(source: str, col: str, extra: str, name: str) -> str:
    return f"""
dist as (select source, count(*) as n, min({col}) as mn, avg({col}) as av, max({col}) as mx, {extra} as {name},
  quantile_cont({col}, 0.01) as p01, quantile_cont({col}, 0.5) as median, quantile_cont({col}, 0.99) as p99 from {source} group by 1)
select source, n, round(mn + 1e-9, 6) as "min", round(av + 1e-9, 6) as "mean", round(mx + 1e-9, 6) as "max", {_r(name, "p01", "median", "p99")} from dist
"""


@query(
    "audit_height",
    "harm_v",
    f"with {_dist_sql('harm_v', 'ball_z', 'avg(cast(ball_z < 0 as int))', 'frac_negative').strip()}",
)
def audit_height(t: Tables) -> DataFrame:
    return _floats(D.ball_height(tracking(t)))


_LAG = "over (partition by match_id, player_id, period order by fi)"


@query(
    "cadence",
    "tracking_v",
    f"""
with s as (select source, t_kin_ms / 1000.0 - lag(t_kin_ms / 1000.0) {_LAG} as dt from tracking_v),
ok as (select * from s where dt > 0 and dt < 5),
{_dist_sql("ok", "dt", "avg(cast(dt >= 0.779 and dt <= 0.821 as int))", "frac_near").strip()}
""",
)
def cadence(t: Tables) -> DataFrame:
    df = t.tracking().withColumn("t_s", F.col("t_kin_ms") / 1000.0)
    return _floats(D.cadence(df, keys=KEYS, order="fi", near=(0.779, 0.821), name="frac_near"))


@query(
    "val_distance",
    "harm_v",
    f"""
with d as (select source, abs(distance_m - sqrt((x - lag(x) {_LAG}) * (x - lag(x) {_LAG}) + (y - lag(y) {_LAG}) * (y - lag(y) {_LAG}))) as df from harm_v),
s as (select source, count(*) as n_compared, avg(df) as mean_abs_diff_m, max(df) as max_abs_diff_m, avg(cast(df > 0.001 as int)) as frac_above_1mm
  from d where df is not null group by 1)
select source, n_compared, {_r("mean_abs_diff_m", "max_abs_diff_m", "frac_above_1mm")} from s
""",
)
def val_distance(t: Tables) -> DataFrame:
    return _floats(D.distance_agreement(tracking(t), keys=KEYS, order="fi"))


@query(
    "val_speed",
    "harm_v",
    f"""
with d as (select source, abs(speed_kmh_filtered - distance_m / 0.1 * 3.6) as df from harm_v),
s as (select source, count(*) as n_compared, avg(df) as mean_abs_diff_kmh, quantile_cont(df, 0.95) as p95_abs_diff_kmh,
  quantile_cont(df, 0.99) as p99_abs_diff_kmh from d where df is not null group by 1)
select source, n_compared, {_r("mean_abs_diff_kmh", "p95_abs_diff_kmh", "p99_abs_diff_kmh")} from s
""",
)
def val_speed(t: Tables) -> DataFrame:
    return _floats(D.speed_agreement(tracking(t)))


@query(
    "val_accel",
    "harm_v",
    f"""
with v as (select *, speed_kmh_filtered / 3.6 as v from harm_v),
d as (select source, abs(acceleration_ms2_filtered - (v - lag(v) {_LAG}) / 0.1) as df from v),
s as (select source, count(*) as n_compared, avg(df) as mean_abs_diff_ms2, max(df) as max_abs_diff_ms2, quantile_cont(df, 0.99) as p99_abs_diff_ms2
  from d where df is not null group by 1)
select source, n_compared, {_r("mean_abs_diff_ms2", "max_abs_diff_ms2", "p99_abs_diff_ms2")} from s
""",
)
def val_accel(t: Tables) -> DataFrame:
    return _floats(D.acceleration_agreement(tracking(t), keys=KEYS, order="fi"))


@query(
    "kin_summary",
    "harm_v",
    f"""
with s as (select source, count(*) as n_rows, count(*) filter (is_visible) as n_visible, avg(speed_kmh_filtered) as speed_mean_kmh,
  max(speed_kmh_filtered) as speed_max_kmh, avg(cast(speed_kmh_filtered < 0 as int)) as speed_negative_frac,
  avg(acceleration_ms2_filtered) as accel_mean_ms2, max(abs(acceleration_ms2_filtered)) as accel_max_abs_ms2,
  quantile_cont(speed_kmh_filtered, 0.5) as speed_median_kmh, quantile_cont(speed_kmh_filtered, 0.99) as speed_p99_kmh,
  quantile_cont(abs(acceleration_ms2_filtered), 0.99) as accel_p99_abs_ms2 from harm_v group by 1)
select source, n_rows, n_visible, {_r("speed_mean_kmh", "speed_max_kmh", "speed_negative_frac", "accel_mean_ms2",
 "accel_max_abs_ms2", "speed_median_kmh", "speed_p99_kmh", "accel_p99_abs_ms2")} from s
""",
)
def kin_summary(t: Tables) -> DataFrame:
    return _floats(D.kinematic_summary(tracking(t)))


@query(
    "speed_bands",
    "harm_v",
    f"""
with s as (select source, count(v) as n_visible_kinematic, avg(cast(v >= 0 and v < 6 as int)) as standing, avg(cast(v >= 6 and v < 11 as int)) as jogging,
  avg(cast(v >= 11 and v < 19.8 as int)) as running, avg(cast(v >= 19.8 and v < 25.2 as int)) as high_speed, avg(cast(v >= 25.2 as int)) as sprint
  from (select source, speed_kmh_filtered as v from harm_v) q group by 1)
select source, n_visible_kinematic, {_r("standing", "jogging", "running", "high_speed", "sprint")} from s
""",
)
def speed_bands(t: Tables) -> DataFrame:
    return _floats(D.speed_bands(tracking(t)))


@query(
    "label_audit",
    "harm_v",
    f"""
with {_T.strip()}, s as (select source, match_id, count(distinct player_id) as tracking_players,
  count(distinct case when is_visible then player_id end) as visible_players, avg(cast(position_group is not null as int)) as labelled_rate from tr group by 1, 2)
select source, match_id, tracking_players, visible_players, {_r("labelled_rate")} from s
""",
)
def label_audit(t: Tables) -> DataFrame:
    return _floats(D.label_coverage(tracking(t)))


def _roster(t: Tables) -> DataFrame:
    per = tracking(t).groupBy("source", "match_id", "player_id").agg(
        F.max("position_label").alias("position_raw"), F.max("position_group").alias("position_group"),
        F.min("frame_id").alias("_first"),
    )
    return per.withColumns(
        {
            "starting": F.col("_first") < 40,
            "start_time": F.when(F.col("_first") % 3 != 0, F.col("_first").cast("string")),
        }
    )


_ROSTER = """
ro as (select source, match_id, player_id, max(position_label) as position_raw, max(position_group) as position_group, min(frame_id) < 40 as starting,
  case when min(frame_id) % 3 <> 0 then cast(min(frame_id) as varchar) end as start_time from tr group by 1, 2, 3)
"""


@query(
    "label_summary",
    "harm_v",
    f"""
with {_T.strip()}, {_ROSTER.strip()}
select source, count(player_id) as roster_players, count(position_raw) as players_with_position_raw, count(position_group) as players_with_position_group,
  count(*) filter (starting) as starters, count(start_time) as used_players, round(count(position_group) / count(player_id) + 1e-9, 6) as position_group_rate
from ro group by 1
""",
)
def label_summary(t: Tables) -> DataFrame:
    return _floats(D.label_summary(_roster(t)))


@query(
    "label_counts",
    "harm_v",
    f"with {_T.strip()}, {_ROSTER.strip()} select source, position_group as value, count(*) as n from ro group by 1, 2",
)
def label_counts(t: Tables) -> DataFrame:
    return D.label_counts(_roster(t), "position_group")


@query(
    "audit_all",
    "harm_v",
    f"""
with st as (select source, match_id, avg(cast(coalesce(ball_status, false) as int)) as a, avg(cast(coalesce(not ball_status, false) as int)) as b,
  avg(cast(ball_status is null as int)) as c, avg(cast(ball_poss_team_id is null as int)) as d from harm_v group by 1, 2)
select 'ball_status' as "check", concat(source, '/', match_id) as subject, 'frac_true' as metric, round(a + 1e-9, 6) as value, cast(null as boolean) as compliant from st
union all select 'ball_status', concat(source, '/', match_id), 'frac_false', round(b + 1e-9, 6), null from st
union all select 'ball_status', concat(source, '/', match_id), 'frac_null', round(c + 1e-9, 6), null from st
union all select 'possession_nulls', concat(source, '/', match_id), 'null_rate', round(d + 1e-9, 6), null from st
""",
)
def audit_all(t: Tables) -> DataFrame:
    df = tracking(t)
    parts = D.long_form(D.ball_status(df), "ball_status", ["source", "match_id"]).unionByName(
        D.long_form(D.null_rate(df), "possession_nulls", ["source", "match_id"])
    )
    return _floats(parts)


@query("audit_report")
def audit_report(t: Tables) -> DataFrame:
    return D.run_audit(materialise(tracking(t)), t.view("directions_v"), sources=("A", "B"))
