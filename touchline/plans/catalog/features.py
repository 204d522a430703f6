"""Feature views, joins, samples and splits over the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import features as A
from touchline.operators import joins as J
from touchline.operators import sampling as O
from touchline.plans.registry import query, r6, rounded
from touchline.plans.standin import Tables

ROLES = {"GK": "GK", "L0": "FB", "L1": "CB", "L2": "DM", "L3": "WG"}
_ROLE_SQL = """case position_label when 'GK' then 'GK' when 'L0' then 'FB' when 'L1' then 'CB'
  when 'L2' then 'DM' when 'L3' then 'WG' when 'L4' then case when player_id = 'p5' then 'FW' end
  else case when player_id = 'p5' then 'FW' end end"""


def _roster(t: Tables) -> DataFrame:
    """Roster roles: only player p5 has one, so other unlabelled rows stay without."""
    return (
        t.view("rosters_v")
        .filter("player_id = 'p5'")
        .select("match_id", "player_id", F.lit("FW").alias("roster_role"))
        .distinct()
    )


def _floats(df: DataFrame) -> DataFrame:
    return rounded(df, [c for c, kind in df.dtypes if kind == "double"])


def _round_sql(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) as {n}" for n in names)


# Joins ---------------------------------------------------------------------------------


@query(
    "roster_join",
    "tracking_v",
    """
with roster as (select distinct match_id, player_id, team_id as roster_team from tracking_v where event_id % 3 = 0)
select t.event_id, t.match_id, t.player_id, r.roster_team
from tracking_v t left join roster r on t.match_id = r.match_id and t.player_id = r.player_id
""",
)
def roster_join(t: Tables) -> DataFrame:
    df = t.tracking()
    roster = (
        df.filter("event_id % 3 = 0")
        .select("match_id", "player_id", F.col("team_id").alias("roster_team"))
        .distinct()
    )
    out = J.with_roster(df, roster, ["match_id", "player_id"])
    return out.select("event_id", "match_id", "player_id", "roster_team")


@query(
    "frame_join",
    "tracking_v",
    """
with ball as (select match_id, frame_id_source, avg(x) as bx, avg(y) as b_y from tracking_v group by 1, 2)
select t.event_id, round(bx + 1e-9, 6) as ball_x, round(b_y + 1e-9, 6) as ball_y
from tracking_v t left join ball b on t.match_id = b.match_id and t.frame_id_source = b.frame_id_source
""",
)
def frame_join(t: Tables) -> DataFrame:
    df = t.tracking().drop("ball_x", "ball_y")
    keys = ["match_id", "frame_id_source"]
    ball = df.groupBy(*keys).agg(F.avg("x").alias("ball_x"), F.avg("y").alias("ball_y"))
    out = J.with_roster(df, ball, keys)
    return rounded(out.select("event_id", "ball_x", "ball_y"), ["ball_x", "ball_y"])


@query(
    "asof_interval",
    "frames_v phases_v",
    """
select f.match_id, f.frame_id_source,
  case when f.match_id in (select match_id from phases_v) then coalesce(p.frame_end >= f.frame_id_source, false) end as in_play
from frames_v f asof left join phases_v p on f.match_id = p.match_id and f.frame_id_source >= p.frame_start
""",
)
def asof_interval(t: Tables) -> DataFrame:
    out = J.in_latest_interval(
        t.view("frames_v"), t.view("phases_v"), keys=["match_id"], point="frame_id_source",
        start="frame_start", end="frame_end", name="in_play",
    )
    return out.select("match_id", "frame_id_source", "in_play")


@query(
    "asof_nearest",
    "actions_v frames_v",
    """
with pairs as (
  select e.match_id, e.event_id, f.frame_id_source,
         row_number() over (partition by e.event_id order by abs(f.t_ms - e.t_ms), f.t_ms) as rn
  from actions_v e join frames_v f on e.match_id = f.match_id and f.t_ms between e.t_ms - 200 and e.t_ms + 200)
select match_id, event_id, frame_id_source from pairs where rn = 1
""",
)
def asof_nearest(t: Tables) -> DataFrame:
    out = J.nearest_within(
        t.actions(), t.view("frames_v").select("match_id", "frame_id_source", "t_ms"),
        keys=["match_id"], event_id=["event_id"], event_time="t_ms", frame_time="t_ms",
        tolerance=200, carry=["frame_id_source"],
    )
    return out.select("match_id", "event_id", "frame_id_source")


_PAIRS_SQL = """
seen as (select * from harm_v where is_visible),
pairs as (
  select a.match_id, a.frame_id, a.player_id, a.team_id = b.team_id as mate,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d
  from seen a left join seen b on a.match_id = b.match_id and a.frame_id = b.frame_id and a.player_id <> b.player_id),
near as (
  select match_id, frame_id, player_id,
    count(*) filter (not mate and d <= 5) as opponents_within_5m,
    count(*) filter (not mate and d <= 10) as opponents_within_10m,
    count(*) filter (mate and d <= 5) as teammates_within_5m,
    min(d) filter (not mate) as min_dist_opponent,
    min(d) filter (mate) as min_dist_teammate
  from pairs group by 1, 2, 3)
"""


@query(
    "pairwise_ctx",
    "harm_v",
    f"""
with {_PAIRS_SQL.strip()}
select match_id, frame_id, player_id, opponents_within_5m, opponents_within_10m, teammates_within_5m,
  {_round_sql("min_dist_opponent", "min_dist_teammate")} from near
""",
)
def pairwise_ctx(t: Tables) -> DataFrame:
    return _floats(J.neighbours_in_frame(A.shown(t.view("harm_v"))))


@query(
    "centroid_rel",
    "harm_v",
    """
select event_id,
  round(x - avg(x) over (partition by match_id, team_id, frame_id) + 1e-9, 6) as rel_x,
  round(y - avg(y) over (partition by match_id, team_id, frame_id) + 1e-9, 6) as rel_y
from harm_v where is_visible
""",
)
def centroid_rel(t: Tables) -> DataFrame:
    return _floats(J.with_centroid(A.shown(t.view("harm_v"))).select("event_id", "rel_x", "rel_y"))


_COVER_SQL = """
cover as (
  select match_id, team_id, frame_id from harm_v
  where is_visible and position_label is distinct from 'GK' group by 1, 2, 3 having count(*) >= 9)
"""


@query(
    "coverage_semi",
    "harm_v",
    f"""
with {_COVER_SQL.strip()}
select h.event_id from harm_v h semi join cover c
  on h.match_id = c.match_id and h.team_id = c.team_id and h.frame_id = c.frame_id where h.is_visible
""",
)
def coverage_semi(t: Tables) -> DataFrame:
    return J.covered_team_frames(A.shown(t.view("harm_v"))).select("event_id")


# Feature views -------------------------------------------------------------------------


@query(
    "frame_state",
    "harm_v",
    f"""
with v as (
  select source, match_id, frame_id, period, min_by(ball_status, player_id) as st,
    min_by(ball_x, player_id) as ball_x, min_by(ball_y, player_id) as ball_y, min_by(ball_z, player_id) as ball_z,
    count(*) as n_visible, avg(x) as mean_x, avg(y) as mean_y, stddev_samp(x) as spread_x, stddev_samp(y) as spread_y,
    avg(speed_kmh_filtered) as mean_speed, stddev_samp(speed_kmh_filtered) as std_speed,
    avg(acceleration_ms2_filtered) as mean_accel
  from harm_v where is_visible group by 1, 2, 3, 4)
select source, match_id, frame_id, n_visible, cast(st as int) as ball_in_play,
  cast(period = 'second_half' as int) as period_second_half,
  {_round_sql("ball_x", "ball_y", "ball_z", "mean_x", "mean_y", "spread_x", "spread_y", "mean_speed", "std_speed", "mean_accel")}
from v where st is not null
""",
)
def frame_state(t: Tables) -> DataFrame:
    return _floats(A.frame_state(t.view("harm_v"), frames_per_match=None))


_PLAYER_SQL = f"""
roled as (select *, {_ROLE_SQL} as position_group from harm_v),
rowsv as (select * from roled where is_visible and position_group is not null and position_group <> 'GK'),
ctr as (select *, x - avg(x) over (partition by match_id, team_id, frame_id) as rel_x,
  y - avg(y) over (partition by match_id, team_id, frame_id) as rel_y,
  sqrt((ball_x - x) * (ball_x - x) + (ball_y - y) * (ball_y - y)) as dist_to_ball,
  cast(period = 'second_half' as int) as sh, cast(is_home as int) as ih from rowsv)
"""
_PROFILE_SQL = """
prof as (
select source, match_id, player_id, position_group, count(distinct frame_id) as n_frames,
  avg(x) as x_mean, avg(y) as y_mean, stddev_samp(x) as x_std, stddev_samp(y) as y_std,
  stddev_samp(rel_x) as rel_x_std, stddev_samp(rel_y) as rel_y_std,
  avg(speed_kmh_filtered) as speed_mean, stddev_samp(speed_kmh_filtered) as speed_std,
  avg(acceleration_ms2_filtered) as accel_mean, stddev_samp(acceleration_ms2_filtered) as accel_std,
  sum(distance_m) as distance_sum, avg(dist_to_ball) as dist_to_ball_mean, min(ih) as is_home,
  avg(sh) as second_half_share, quantile_cont(x, 0.5) as x_median, quantile_cont(y, 0.5) as y_median,
  quantile_cont(x, 0.9) - quantile_cont(x, 0.1) as x_range,
  quantile_cont(y, 0.9) - quantile_cont(y, 0.1) as y_range,
  quantile_cont(rel_x, 0.5) as rel_x_median, quantile_cont(rel_y, 0.5) as rel_y_median,
  quantile_cont(speed_kmh_filtered, 0.5) as speed_median, quantile_cont(speed_kmh_filtered, 0.9) as speed_q90,
  quantile_cont(dist_to_ball, 0.5) as dist_to_ball_median
from ctr group by 1, 2, 3, 4 having count(distinct frame_id) >= 20)
"""
_PROFILE_FLOATS = (
    "x_mean", "y_mean", "x_std", "y_std", "rel_x_std", "rel_y_std", "dist_to_ball_mean",
    "second_half_share", "x_median", "y_median", "x_range", "y_range", "rel_x_median",
    "rel_y_median", "dist_to_ball_median",
)
_PROFILE_KINEMATIC = (
    "speed_mean", "speed_std", "speed_median", "speed_q90", "accel_mean", "accel_std", "distance_sum",
)


def profile(t: Tables) -> DataFrame:
    return A.player_profile(
        t.view("harm_v"), _roster(t), roles=ROLES, max_frames=None, min_frames=20
    )


@query(
    "player_profile",
    "harm_v",
    f"""
with {_PLAYER_SQL.strip()}, {_PROFILE_SQL.strip()}
select source, match_id, player_id, position_group, n_frames, is_home,
  {_round_sql(*_PROFILE_FLOATS, *_PROFILE_KINEMATIC)} from prof
""",
)
def player_profile(t: Tables) -> DataFrame:
    return _floats(profile(t))


@query(
    "player_profile_no_kinematic",
    "harm_v",
    f"""
with {_PLAYER_SQL.strip()}, {_PROFILE_SQL.strip()}
select source, match_id, player_id, position_group, n_frames, is_home, {_round_sql(*_PROFILE_FLOATS)} from prof
""",
)
def player_profile_no_kinematic(t: Tables) -> DataFrame:
    return _floats(A.without_kinematics(profile(t)))


def _rates_sql(minimum: int) -> str:
    return f"""
sp as (select *, cast(coalesce(speed_kmh_filtered >= 25.2, false) and not coalesce(lag(speed_kmh_filtered >= 25.2)
         over (partition by match_id, player_id order by frame_id), false) as int) as sprint,
       case when speed_kmh_filtered >= 19.8 then distance_m else 0.0 end as hsr from ctr),
agg as (
  select source, match_id, player_id, position_group, count(distinct frame_id) as n_frames,
    stddev_samp(x) as x_std, stddev_samp(y) as y_std, stddev_samp(rel_x) as rel_x_std, stddev_samp(rel_y) as rel_y_std,
    stddev_samp(dist_to_ball) as dist_to_ball_std, min(ih) as is_home, avg(sh) as second_half_share,
    sum(distance_m) as total_distance_m, sum(hsr) as hsr_distance_m, sum(sprint) as sprint_count,
    max(speed_kmh_filtered) as vmax_kmh, avg(speed_kmh_filtered) as mean_speed_kmh,
    quantile_cont(x, 0.5) as x_median, quantile_cont(y, 0.5) as y_median,
    quantile_cont(rel_x, 0.5) as rel_x_median, quantile_cont(rel_y, 0.5) as rel_y_median,
    quantile_cont(dist_to_ball, 0.5) as dist_to_ball_median
  from sp group by 1, 2, 3, 4 having count(distinct frame_id) >= {minimum}),
rates as (select *, total_distance_m / (n_frames / 600.0) as distance_per_minute_m,
  hsr_distance_m / (n_frames / 600.0) as hsr_per_minute_m from agg)
select source, match_id, player_id, position_group, n_frames, is_home, sprint_count,
  {_round_sql("x_std", "y_std", "rel_x_std", "rel_y_std", "dist_to_ball_std", "second_half_share",
   "total_distance_m", "hsr_distance_m", "vmax_kmh", "mean_speed_kmh", "x_median", "y_median",
   "rel_x_median", "rel_y_median", "dist_to_ball_median", "distance_per_minute_m", "hsr_per_minute_m")}
from rates
"""


@query("intensity_rates", "harm_v", f"with {_PLAYER_SQL.strip()},{_rates_sql(20)}")
def intensity_rates(t: Tables) -> DataFrame:
    out = A.intensity_rates(
        t.view("harm_v"), _roster(t), roles=ROLES, max_frames=None, min_frames=20
    )
    return _floats(out)


_VISIBLE_PLAYER_SQL = _PLAYER_SQL.replace(
    "rowsv as (select * from roled where is_visible and position_group is not null and position_group <> 'GK')",
    """lab as (select * from roled where position_group is not null and position_group <> 'GK'),
vis as (select *, lag(is_visible) over (partition by match_id, player_id order by frame_id) as pv from lab),
seg as (select *, sum(case when is_visible <> coalesce(pv, false) then 1 else 0 end)
        over (partition by match_id, player_id order by frame_id) as sg from vis),
long as (select *, count(*) over (partition by match_id, player_id, sg) as seg_n from seg where is_visible),
rowsv as (select * from long where seg_n >= 30)""",
)


@query("intensity_rates_vis", "harm_v", f"with {_VISIBLE_PLAYER_SQL.strip()},{_rates_sql(15)}")
def intensity_rates_vis(t: Tables) -> DataFrame:
    out = A.intensity_rates(
        t.view("harm_v"), _roster(t), roles=ROLES, max_frames=None, min_frames=15,
        continuous_frames=30,
    )
    return _floats(out)


_SHAPE_FLOATS = (
    "centroid_x", "centroid_y", "width_y", "depth_x", "spread_x", "spread_y", "mean_speed", "std_speed",
)


def _shape_sql(source: str, having: str) -> str:
    return f"""
shape as (
  select source, match_id, team_id, frame_id, period, is_home, count(*) as n_visible,
    sum(case when position_label is distinct from 'GK' then 1 else 0 end) as n_outfield_visible,
    avg(x) as centroid_x, avg(y) as centroid_y, max(y) - min(y) as width_y, max(x) - min(x) as depth_x,
    stddev_samp(x) as spread_x, stddev_samp(y) as spread_y, avg(speed_kmh_filtered) as mean_speed,
    stddev_samp(speed_kmh_filtered) as std_speed
  from {source} where is_visible group by 1, 2, 3, 4, 5, 6 having {having})
"""


@query(
    "team_shape",
    "harm_v",
    f"""
with {_shape_sql("harm_v", "count(*) >= 8").strip()}
select source, match_id, team_id, frame_id, period, cast(is_home as int) as is_home, n_visible,
  cast(n_outfield_visible as bigint) as n_outfield_visible, cast(period = 'second_half' as int) as period_second_half,
  {_round_sql(*_SHAPE_FLOATS)} from shape
""",
)
def team_shape(t: Tables) -> DataFrame:
    return _floats(A.team_shape(t.view("harm_v"), frames_per_match=None))


@query(
    "team_shape_core",
    "harm_v",
    f"""
with {_shape_sql("harm_v", "count(*) >= 8").strip()}
select source, match_id, {_round_sql(*_SHAPE_FLOATS)} from shape
""",
)
def team_shape_core(t: Tables) -> DataFrame:
    out = A.team_shape(t.view("harm_v"), frames_per_match=None)
    return _floats(out.select(*A.TEAM_SHAPE_CORE))


@query(
    "team_shape_strict",
    "harm_v",
    f"""
with {_shape_sql("harm_v", "count(*) >= 8").strip()}
select source, match_id, {_round_sql("centroid_x", "centroid_y", "mean_speed", "std_speed")}
from shape where n_outfield_visible >= 9
""",
)
def team_shape_strict(t: Tables) -> DataFrame:
    out = A.team_shape(t.view("harm_v"), frames_per_match=None, min_outfield=9)
    return _floats(out.select(*A.TEAM_SHAPE_STRICT))


_ORIENTED_SQL = """
orient as (
  select h.* exclude (x), case when play_direction = 'right_left' then -x else x end as x
  from harm_v h left join directions_v d on h.match_id = d.match_id and h.period = d.period and h.source = d.source)
"""


@query(
    "team_shape_oriented",
    "harm_v directions_v",
    f"""
with {_ORIENTED_SQL.strip()}, {_shape_sql("orient", "sum(case when position_label is distinct from 'GK' then 1 else 0 end) >= 9").strip()}
select source, match_id, {_round_sql("centroid_x", "centroid_y", "mean_speed", "std_speed")} from shape
""",
)
def team_shape_oriented(t: Tables) -> DataFrame:
    df = A.oriented(t.view("harm_v"), _directions(t))
    out = A.team_shape(df, frames_per_match=None, min_visible=None, min_outfield=9)
    return _floats(out.select(*A.TEAM_SHAPE_STRICT))


def _directions(t: Tables) -> DataFrame:
    return t.view("directions_v").select("match_id", "period", "play_direction").distinct()


_VIEW_FLOATS = ("x", "y", "speed_kmh_filtered", "acceleration_ms2_filtered", "distance_m")
_SAMPLED = """
ranked as (select *, row_number() over (partition by match_id
   order by md5(concat_ws(':', '42', match_id, player_id, cast(frame_id as varchar)))) as rn from {src})
"""


@query(
    "player_view",
    "harm_v",
    f"""
with seen as (select * from harm_v where is_visible), {_SAMPLED.format(src="seen").strip()}
select event_id, source, match_id, {_round_sql(*_VIEW_FLOATS, "ball_x", "ball_y", "ball_z")},
  cast(is_home as int) as is_home, cast(ball_status as int) as ball_status,
  cast(period = 'second_half' as int) as period_second_half
from ranked
""",
)
def player_view(t: Tables) -> DataFrame:
    out = A.player_view(t.view("harm_v"))
    return _floats(
        out.select(
            "event_id", "source", "match_id", *_VIEW_FLOATS, "ball_x", "ball_y", "ball_z",
            "is_home", "ball_status", "period_second_half",
        )
    )


@query(
    "player_view_core",
    "harm_v",
    f"""
with seen as (select * from harm_v where is_visible), {_SAMPLED.format(src="seen").strip()}
select event_id, source, match_id, {_round_sql(*_VIEW_FLOATS)} from ranked
""",
)
def player_view_core(t: Tables) -> DataFrame:
    out = A.player_view(t.view("harm_v"))
    return _floats(out.select("event_id", *A.PLAYER_CORE))


_STRICT_ROWS = """
strict as (select h.* from {src} h semi join cover c
  on h.match_id = c.match_id and h.team_id = c.team_id and h.frame_id = c.frame_id where h.is_visible)
"""


@query(
    "player_view_strict",
    "harm_v",
    f"""
with {_COVER_SQL.strip()}, {_STRICT_ROWS.format(src="harm_v").strip()}, {_SAMPLED.format(src="strict").strip()}
select event_id, source, match_id, {_round_sql(*_VIEW_FLOATS)} from ranked
""",
)
def player_view_strict(t: Tables) -> DataFrame:
    out = A.player_view(t.view("harm_v"), min_outfield=9)
    return _floats(out.select("event_id", *A.PLAYER_CORE))


@query(
    "player_view_oriented",
    "harm_v directions_v",
    f"""
with {_COVER_SQL.strip()}, {_ORIENTED_SQL.strip()}, {_STRICT_ROWS.format(src="orient").strip()},
{_SAMPLED.format(src="strict").strip()}
select event_id, source, match_id, {_round_sql(*_VIEW_FLOATS)} from ranked
""",
)
def player_view_oriented(t: Tables) -> DataFrame:
    df = A.oriented(t.view("harm_v"), _directions(t))
    out = A.player_view(df, min_outfield=9)
    return _floats(out.select("event_id", *A.PLAYER_CORE))


_TYPES = ("foul", "offside", "pass", "shot", "throw_in")
_RESULTS = ("fail", "success")
_ONE_HOT_SQL = ", ".join(
    [f"cast(action_type = '{v}' as int) as action_type_{v}" for v in _TYPES]
    + [f"cast(result = '{v}' as int) as result_{v}" for v in _RESULTS]
)
_EVENT_SQL = f"""
select source, match_id, event_id, start_x, start_y, end_x, end_y,
  round(end_x - start_x + 1e-9, 6) as dx, round(end_y - start_y + 1e-9, 6) as dy,
  round(sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y)) + 1e-9, 6) as distance,
  cast(action_type in ('pass', 'shot', 'shot_freekick', 'throw_in') as int) as cross_dataset_comparable,
  {_ONE_HOT_SQL}
from actions_v
"""


@query("event_view", "actions_v", _EVENT_SQL)
def event_view(t: Tables) -> DataFrame:
    return rounded(A.event_view(t.actions(), _TYPES, _RESULTS), ["dx", "dy", "distance"])


@query(
    "event_view_comparable",
    "actions_v",
    f"select * exclude (cross_dataset_comparable) from ({_EVENT_SQL}) where cross_dataset_comparable = 1",
)
def event_view_comparable(t: Tables) -> DataFrame:
    out = A.event_view(t.actions(), _TYPES, _RESULTS, comparable_only=True)
    return rounded(out.drop("cross_dataset_comparable"), ["dx", "dy", "distance"])


@query(
    "pass_view",
    "actions_v",
    """
select source, match_id, event_id, cast(result = 'success' as int) as pass_success,
  round(sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y)) + 1e-9, 6) as pass_length_m,
  round(atan2(end_y - start_y, end_x - start_x) + 1e-9, 6) as pass_angle_rad,
  round(end_x - start_x + 1e-9, 6) as forward_progress_m,
  cast(period = 'second_half' as int) as second_half
from actions_v where action_type = 'pass' and start_x is not null and end_x is not null
""",
)
def pass_view(t: Tables) -> DataFrame:
    names = ["pass_length_m", "pass_angle_rad", "forward_progress_m"]
    out = A.pass_view(t.actions())
    return rounded(
        out.select("source", "match_id", "event_id", "pass_success", *names, "second_half"), names
    )


@query(
    "shot_view",
    "actions_v",
    """
select source, match_id, event_id, cast(result = 'success' as int) as shot_success,
  abs(start_y) as abs_y,
  round(sqrt((52.5 - start_x) * (52.5 - start_x) + start_y * start_y) + 1e-9, 6) as dist_to_goal_m,
  round(atan2(abs(start_y), greatest(52.5 - start_x, 0.1)) + 1e-9, 6) as angle_to_goal,
  cast(period = 'second_half' as int) as second_half, cast(action_type <> 'shot' as int) as is_set_piece
from actions_v where action_type in ('shot', 'shot_freekick', 'shot_penalty')
""",
)
def shot_view(t: Tables) -> DataFrame:
    out = A.shot_view(t.actions())
    return rounded(
        out.select(
            "source", "match_id", "event_id", "shot_success", "abs_y", "dist_to_goal_m",
            "angle_to_goal", "second_half", "is_set_piece",
        ),
        ["dist_to_goal_m", "angle_to_goal"],
    )


@query(
    "pass_context",
    "actions_v harm_v",
    f"""
with seen as (select * from harm_v where is_visible),
fr as (select match_id, frame_id, min(t_ms) as ft from seen group by 1, 2),
pairs as (
  select e.*, f.frame_id, row_number() over (partition by e.event_id order by abs(f.ft - e.t_ms), f.ft) as rn
  from actions_v e join fr f on e.match_id = f.match_id and f.ft between e.t_ms - 200 and e.t_ms + 200
  where action_type = 'pass'),
met as (
  select p.match_id, p.event_id, s.team_id = p.team_id as mate,
    sqrt((s.x - p.start_x) * (s.x - p.start_x) + (s.y - p.start_y) * (s.y - p.start_y)) as ds,
    sqrt((s.x - p.end_x) * (s.x - p.end_x) + (s.y - p.end_y) * (s.y - p.end_y)) as de
  from pairs p join seen s on p.match_id = s.match_id and p.frame_id = s.frame_id where rn = 1),
ctx as (
  select match_id, event_id, count(*) as n_visible_frame, count(*) filter (mate) as nm,
    count(*) filter (not mate) as nr,
    count(*) filter (mate and ds <= 10) as t10, count(*) filter (not mate and ds <= 10) as o10,
    count(*) filter (not mate and ds <= 3) as o3, count(*) filter (not mate and de <= 5) as o5,
    min(ds) filter (not mate) as min_dist_opponent_to_start, min(de) filter (mate) as min_dist_teammate_to_end
  from met group by 1, 2)
select match_id, event_id, n_visible_frame, case when nm > 0 then t10 end as teammates_within_10m_start,
  case when nr > 0 then o10 end as opponents_within_10m_start, case when nr > 0 then o3 end as opponents_within_3m_start,
  case when nr > 0 then o5 end as opponents_within_5m_end,
  {_round_sql("min_dist_opponent_to_start", "min_dist_teammate_to_end")} from ctx
""",
)
def pass_context(t: Tables) -> DataFrame:
    out = A.pass_context(A.pass_view(t.actions()), t.view("harm_v"))
    floats = ["min_dist_opponent_to_start", "min_dist_teammate_to_end"]
    return rounded(
        out.select(
            "match_id", "event_id", "n_visible_frame", "teammates_within_10m_start",
            "opponents_within_10m_start", "opponents_within_3m_start", "opponents_within_5m_end", *floats,
        ),
        floats,
    )


_CTX_NAMES = (
    "ctx_opponents_5m_mean", "ctx_opponents_10m_mean", "ctx_teammates_5m_mean",
    "ctx_min_dist_opponent_median", "ctx_min_dist_teammate_median",
)
_CTX_SQL = """
ctx as (
  select match_id, player_id, avg(opponents_within_5m) as ctx_opponents_5m_mean,
    avg(opponents_within_10m) as ctx_opponents_10m_mean, avg(teammates_within_5m) as ctx_teammates_5m_mean,
    quantile_cont(min_dist_opponent, 0.5) as ctx_min_dist_opponent_median,
    quantile_cont(min_dist_teammate, 0.5) as ctx_min_dist_teammate_median
  from near group by 1, 2)
"""


@query(
    "player_context",
    "harm_v",
    f"with {_PAIRS_SQL.strip()}, {_CTX_SQL.strip()} select match_id, player_id, {_round_sql(*_CTX_NAMES)} from ctx",
)
def player_context(t: Tables) -> DataFrame:
    return _floats(A.player_context(t.view("harm_v"), max_frames=None))


@query(
    "profile_with_context",
    "harm_v",
    f"""
with {_PLAYER_SQL.strip()}, {_PROFILE_SQL.strip()}, {_PAIRS_SQL.strip()}, {_CTX_SQL.strip()}
select p.source, p.match_id, p.player_id, p.position_group, p.n_frames, {_round_sql("x_median", *_CTX_NAMES)}
from prof p left join ctx c on p.match_id = c.match_id and p.player_id = c.player_id
""",
)
def profile_with_context(t: Tables) -> DataFrame:
    context = A.player_context(t.view("harm_v"), max_frames=None)
    out = profile(t).join(context, ["match_id", "player_id"], "left")
    return _floats(
        out.select("source", "match_id", "player_id", "position_group", "n_frames", "x_median", *_CTX_NAMES)
    )


@query(
    "embed_pool",
    "",
    "select label, "
    + ", ".join(f"round(avg(embedding[{i + 1}]::double) + 1e-9, 6) as emb_{i:03d}" for i in range(64))
    + " from embeddings group by label",
)
def embed_pool(t: Tables) -> DataFrame:
    out = A.mean_pool(
        t.table("embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")),
        ["label"], "embedding", 64,
    )
    return _floats(out)


@query(
    "match_stats",
    "harm_v",
    """
select source, match_id, count(*) as rows, count(distinct player_id) as players, count(distinct frame_id) as frames,
  round(avg(case when source = 'B' then cast(is_visible as int) end) * 100 + 1e-9, 6) as visible_pct
from harm_v group by 1, 2
""",
)
def match_stats(t: Tables) -> DataFrame:
    return _floats(A.match_stats(t.view("harm_v"), visibility_source="B"))


# Samples, splits, sets -----------------------------------------------------------------


@query(
    "sample_per_group",
    "harm_v",
    """
select match_id, player_id, frame_id from (
  select *, row_number() over (partition by match_id, player_id
    order by md5(concat_ws(':', '42', match_id, player_id, cast(frame_id as varchar)))) as rn from harm_v) q
where rn <= 40
""",
)
def sample_per_group(t: Tables) -> DataFrame:
    keys = ["match_id", "player_id", "frame_id"]
    return O.sample_per_group(t.view("harm_v"), keys[:2], 40, keys).select(*keys)


@query(
    "balanced_sample",
    "drift_v",
    """
select source, l_orderkey, l_linenumber, l_partkey, l_suppkey from (
  select *, row_number() over (partition by source order by
    md5(concat_ws(':', '42', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar),
        cast(l_suppkey as varchar))), l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from drift_v) q
where rn <= 20000
""",
)
def balanced_sample(t: Tables) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return O.balanced_sample(t.view("drift_v"), per_source=20_000, key=key).select("source", *key)


@query(
    "reservoir",
    "actions_v",
    """
select event_id from actions_v order by md5(concat_ws(':', '42', cast(event_id as varchar))) limit 1000
""",
)
def reservoir(t: Tables) -> DataFrame:
    return O.reservoir_sample(t.actions(), 1000, ["event_id"]).select("event_id")


_SPLIT_SQL = """
g as (select source, match_id, row_number() over (partition by source
        order by md5(concat_ws(':', '42', match_id)), match_id) - 1 as rk,
      count(*) over (partition by source) as n from (select distinct source, match_id from drift_v) d)
"""


@query(
    "group_split",
    "drift_v",
    f"""
with {_SPLIT_SQL.strip()}
select d.source, d.match_id, rk < ceil(n * 0.3) as is_test, count(*) as n_rows
from drift_v d join g on d.source = g.source and d.match_id = g.match_id group by 1, 2, 3
""",
)
def group_split(t: Tables) -> DataFrame:
    out = O.group_shuffle_split(t.view("drift_v"), strata=["source"])
    return out.groupBy("source", "match_id", "is_test").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "group_folds",
    "drift_v",
    f"""
with {_SPLIT_SQL.strip()}
select d.source, d.match_id, cast(rk % 5 as int) as fold, count(*) as n_rows
from drift_v d join g on d.source = g.source and d.match_id = g.match_id group by 1, 2, 3
""",
)
def group_folds(t: Tables) -> DataFrame:
    out = O.group_folds(t.view("drift_v"))
    return out.groupBy("source", "match_id", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "leave_one_out",
    "drift_v",
    """
select concat('lomo:', match_id) as fold_id,
  (select count(*) from drift_v) - count(*) as n_train, count(*) as n_test
from drift_v group by match_id
""",
)
def leave_one_out(t: Tables) -> DataFrame:
    df = t.view("drift_v")
    sizes = df.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_test"))
    total = df.count()
    folds = O.leave_one_group_out(df)
    return folds.join(sizes, "match_id").select(
        "fold_id", (F.lit(total) - F.col("n_test")).alias("n_train"), "n_test"
    )


@query(
    "regime_sample",
    "drift_v",
    """
with pools as (
  select source, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    row_number() over (partition by source order by md5(concat_ws(':', case source when 'F' then '42' else '142' end,
      cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar))),
      l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn
  from drift_v)
select source, l_orderkey, l_linenumber, l_partkey, l_suppkey from pools where rn <= 500
""",
)
def regime_sample(t: Tables) -> DataFrame:
    df = t.view("drift_v")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = O.sample_target_regime(
        df.filter("source = 'F'"), df.filter("source = 'O'"), "merged_same_n", 1000, key=key
    )
    return out.select("source", *key)


@query(
    "topk",
    "harm_v",
    """
select match_id, player_id, round(sum(distance_m) + 1e-9, 6) as total from harm_v
group by 1, 2 order by total desc, match_id, player_id limit 15
""",
)
def topk(t: Tables) -> DataFrame:
    totals = t.view("harm_v").groupBy("match_id", "player_id").agg(r6(F.sum("distance_m")).alias("total"))
    return totals.orderBy(F.desc("total"), "match_id", "player_id").limit(15)


@query(
    "one_hot",
    "actions_v",
    f"select event_id, {_ONE_HOT_SQL} from actions_v",
)
def one_hot(t: Tables) -> DataFrame:
    return t.actions().select(
        "event_id", *S.one_hot("action_type", _TYPES), *S.one_hot("result", _RESULTS)
    )
