"""Trajectory queries over the stand-in tracking view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import trajectory as T
from touchline.operators.smoothing import fit_matrix
from touchline.plans.registry import query, r6, rounded
from touchline.plans.standin import Tables

KEYS = ["match_id", "player_id", "period"]
_K = "partition by match_id, player_id, period"
_WINDOW_B = {"B": 13}


def _matrix_sql(width: int, degree: int) -> str:
    rows = [
        "[" + ", ".join(repr(float(v)) for v in row) + "]" for row in fit_matrix(width, degree)
    ]
    return "[" + ", ".join(rows) + "]::double[][]"


def _savgol_sql(source: str, key: str, order: str, value: str, out: str, width: int, stem: str) -> str:
    """CTEs that smooth ``value`` over runs of non-null values; rows keep their columns."""
    half = width // 2
    return f"""
{stem}_a as (select *, row_number() over ({key} order by {order}) as {stem}_rn from {source}),
{stem}_b as (select *, sum(case when {value} is null then 1 else 0 end)
             over ({key} order by {order}) as {stem}_g from {stem}_a),
{stem}_c as (select *, row_number() over ({key}, {stem}_g, {value} is null order by {order}) - 1 as {stem}_p,
             count(*) over ({key}, {stem}_g, {value} is null) as {stem}_n,
             list({value}) over ({key}, {stem}_g, {value} is null order by {order}
                  rows between {width - 1} preceding and {width - 1} following) as {stem}_v
             from {stem}_b),
{stem} as (select *, case when {value} is null or {stem}_n < {width} then {value} else
             list_dot_product(
               list_slice({stem}_v,
                 greatest(0, least({stem}_p - {half}, {stem}_n - {width})) - greatest({stem}_p - {width - 1}, 0) + 1,
                 greatest(0, least({stem}_p - {half}, {stem}_n - {width})) - greatest({stem}_p - {width - 1}, 0) + {width}),
               ({_matrix_sql(width, 2)})[{stem}_p - greatest(0, least({stem}_p - {half}, {stem}_n - {width})) + 1])
             end as {out} from {stem}_c)"""


@query(
    "decimate",
    "tracking_v",
    """
with ranked as (
  select match_id, period, frame_id_source,
         row_number() over (partition by match_id, period order by frame_id_source) - 1 as rk
  from (select distinct match_id, period, frame_id_source from tracking_v) d)
select t.match_id, t.period, t.frame_id_source, t.player_id,
       cast(floor(rk / 5) * 2 + case when rk % 5 = 2 then 1 else 0 end as bigint) as kept_idx
from tracking_v t join ranked r
  on t.match_id = r.match_id and t.period = r.period and t.frame_id_source = r.frame_id_source
where rk % 5 in (0, 2)
""",
)
def decimate(t: Tables) -> DataFrame:
    kept = T.keep_pattern(t.tracking(), ["match_id", "period"], "frame_id_source")
    return kept.select("match_id", "period", "frame_id_source", "player_id", "kept_idx")


@query(
    "step_distance",
    "tracking_v",
    f"""
with seen as (select * from tracking_v where x is not null),
stepped as (
  select *, lag(fi) over w as p_fi, lag(x) over w as px, lag(y) over w as py
  from seen window w as ({_K} order by fi))
select match_id, player_id, period, fi,
       case when fi - p_fi = 1 then round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 3) end as distance_m
from stepped
""",
)
def step_distance(t: Tables) -> DataFrame:
    seen = t.tracking().filter("x is not null")
    return T.step_distance(seen, KEYS, index="fi").select(*KEYS, "fi", "distance_m")


@query(
    "step_speed_reset",
    "tracking_v",
    f"""
with v as (select *, case when event_id % 29 = 0 then null else x end as xx from tracking_v),
marked as (
  select *, case when is_visible and xx is not null then 1 when not is_visible then 0 end as mark,
         case when is_visible and xx is not null then fi when not is_visible then fi end as anchor from v),
prev as (
  select *, max(anchor) over ({_K} order by fi rows between unbounded preceding and 1 preceding) as pa from marked),
pairs as (
  select a.*, b.mark as pm, b.xx as px, b.y as py from prev a left join marked b
  on a.match_id = b.match_id and a.player_id = b.player_id and a.period = b.period and a.pa = b.fi),
dist as (select *, case when mark = 1 and pm = 1
         then sqrt((xx - px) * (xx - px) + (y - py) * (y - py)) end as d from pairs)
select match_id, player_id, period, fi, round(d + 1e-9, 6) as distance_m,
       round(d / 0.1 * 3.6 + 1e-9, 6) as speed_kmh from dist
""",
)
def step_speed_reset(t: Tables) -> DataFrame:
    holes = t.tracking().withColumn("x", F.when(F.col("event_id") % 29 != 0, F.col("x")))
    out = T.step_speed_with_reset(holes.drop("distance_m", "speed_kmh"), KEYS, "fi", round_to=None)
    names = ["distance_m", "speed_kmh"]
    return rounded(out.select(*KEYS, "fi", *names), names)


@query(
    "dense_frame_id",
    "tracking_v",
    """
select match_id, period, player_id, frame_id_source,
       dense_rank() over (partition by match_id
         order by case period when 'first_half' then 0 else 1 end, frame_id_source) - 1 as frame_id
from tracking_v
""",
)
def dense_frame_id(t: Tables) -> DataFrame:
    return T.dense_frame_id(t.tracking()).select(
        "match_id", "period", "player_id", "frame_id_source", "frame_id"
    )


@query(
    "segments",
    "tracking_v",
    f"""
with a as (select *, lag(x is not null) over ({_K} order by fi) as ph from tracking_v),
b as (select *, sum(case when x is not null and not coalesce(ph, false) then 1 else 0 end)
      over ({_K} order by fi) as run from a)
select match_id, player_id, period, fi, case when x is not null then cast(run as bigint) end as run_id from b
""",
)
def segments(t: Tables) -> DataFrame:
    return T.runs(t.tracking(), KEYS, "fi", value="x").select(*KEYS, "fi", "run_id")


@query(
    "savgol",
    "tracking_v",
    f"""
with {_savgol_sql("tracking_v", _K, "fi", "x", "fit", 5, "s").strip()}
select match_id, player_id, period, fi, round(fit + 1e-9, 6) as x_filtered from s
""",
)
def savgol(t: Tables) -> DataFrame:
    out = T.savgol(t.tracking(), KEYS, "fi", "x", width=5)
    return out.select(*KEYS, "fi", r6("x_filtered").alias("x_filtered"))


_SMOOTH_CTES = f"""
pre as (
  select *, count(*) over ({_K}) as n_rows,
         sum(case when not (abs(speed_kmh) > 40) and x is not null then 1 else 0 end) over ({_K}) as n_ok
  from tracking_v),
clean as (
  select *, (source = 'B' and n_rows >= 13 and n_ok > 0) as active,
         case when source = 'B' and n_rows >= 13 and n_ok > 0 and not (abs(speed_kmh) > 40) then x end as cx,
         case when source = 'B' and n_rows >= 13 and n_ok > 0 and not (abs(speed_kmh) > 40) then y end as cy
  from pre),
{_savgol_sql("clean", _K, "fi", "cx", "fx", 13, "sx").strip()},
{_savgol_sql("sx", _K, "fi", "cy", "fy", 13, "sy").strip()},
smoothed as (
  select *, case when active then fx else x end as x_smooth, case when active then fy else y end as y_smooth
  from sy)"""


@query(
    "smooth_xy",
    "tracking_v",
    f"""
with {_SMOOTH_CTES.strip()}
select match_id, player_id, period, fi, round(x_smooth + 1e-9, 6) as x_smooth,
       round(y_smooth + 1e-9, 6) as y_smooth from smoothed
""",
)
def smooth_xy(t: Tables) -> DataFrame:
    out = T.smooth_positions(
        t.tracking(), KEYS, "fi", windows=_WINDOW_B, exclude=F.abs("speed_kmh") > 40
    )
    return rounded(out.select(*KEYS, "fi", "x_smooth", "y_smooth"), ["x_smooth", "y_smooth"])


_SPEED_CTES = f"""
speeds as (
  select *, sqrt((x_smooth - lag(x_smooth) over w) * (x_smooth - lag(x_smooth) over w)
               + (y_smooth - lag(y_smooth) over w) * (y_smooth - lag(y_smooth) over w))
            / (t_kin_ms / 1000.0 - lag(t_kin_ms / 1000.0) over w) * 3.6 as v
  from {{src}} window w as ({_K} order by fi))"""


@query(
    "speed",
    "tracking_v",
    f"""
with raw as (select *, x as x_smooth, y as y_smooth from tracking_v),
{_SPEED_CTES.format(src="raw").strip()}
select match_id, player_id, period, fi, round(v + 1e-9, 6) as speed_kmh_filtered from speeds
""",
)
def speed(t: Tables) -> DataFrame:
    df = t.tracking().withColumn("t_s", F.col("t_kin_ms") / 1000.0)
    out = T.derive_speed(df, KEYS, "fi", x="x", y="y")
    return out.select(*KEYS, "fi", r6("speed_kmh_filtered").alias("speed_kmh_filtered"))


_ACCEL_CTES = f"""
accels as (
  select *, (v - lag(v) over w) / 3.6
            / ((t_kin_ms / 1000.0 - lag(t_kin_ms / 1000.0, 2) over w) / 2) as acc
  from speeds window w as ({_K} order by fi)),
{_savgol_sql("accels", _K, "fi", "acc", "acc_fit", 7, "sa").strip()}"""


@query(
    "acceleration",
    "tracking_v",
    f"""
with speeds as (select *, speed_kmh as v from tracking_v),
{_ACCEL_CTES.strip()}
select match_id, player_id, period, fi, round(acc + 1e-9, 6) as acceleration_ms2,
       round(acc_fit + 1e-9, 6) as acceleration_ms2_filtered from sa
""",
)
def acceleration(t: Tables) -> DataFrame:
    df = t.tracking().withColumn("t_s", F.col("t_kin_ms") / 1000.0)
    out = T.derive_acceleration(df, KEYS, "fi", speed="speed_kmh")
    names = ["acceleration_ms2", "acceleration_ms2_filtered"]
    return rounded(out.select(*KEYS, "fi", *names), names)


def kinematics(t: Tables) -> DataFrame:
    """The harmonised tracking table of the stand-in view."""
    df = t.tracking()
    left_first = F.col("match_id").isin("m0", "m1") == (F.col("period") == "first_half")
    staged = df.withColumns(
        {
            "t_s": F.col("t_kin_ms") / 1000.0,
            "play_direction": F.when(left_first, "left_right").otherwise("right_left"),
        }
    )
    moved = T.kinematics_qc(
        staged, keys=KEYS, order="fi", windows=_WINDOW_B, masked_sources=("B",), round_to=None
    )
    return T.dense_frame_id(moved, frames=df)


@query(
    "kinematics_qc",
    "tracking_v",
    f"""
with {_SMOOTH_CTES.strip()},
{_SPEED_CTES.format(src="smoothed").strip()},
{_ACCEL_CTES.strip()},
picked as (
  select *,
    dense_rank() over (partition by match_id
      order by case period when 'first_half' then 0 else 1 end, frame_id_source) - 1 as frame_id,
    case when abs(speed_kmh) <= 40 then speed_kmh end as s0,
    case when source = 'B' then v when abs(speed_kmh) <= 40 then speed_kmh end as s1,
    case when source = 'B' then acc when abs(acceleration_ms2) <= 12 then acceleration_ms2 end as a0,
    case when source = 'B' then acc_fit when abs(acceleration_ms2) <= 12 then acceleration_ms2 end as a1,
    source = 'B' and not is_visible as hid
  from sa),
capped as (
  select *, case when not hid and abs(s1) <= 40 then s1 end as s2,
    case when not hid then s0 end as s00 from picked)
select match_id, frame_id, player_id,
  round((case when (match_id in ('m0', 'm1')) = (period = 'first_half') then x else -x end) + 1e-9, 6) as x,
  round(s00 + 1e-9, 6) as speed_kmh,
  round(s2 + 1e-9, 6) as speed_kmh_filtered,
  round((case when s2 is not null and not hid and abs(a0) <= 12 then a0 end) + 1e-9, 6) as acceleration_ms2,
  round((case when s2 is not null and not hid and abs(a1) <= 12 then a1 end) + 1e-9, 6) as acceleration_ms2_filtered
from capped
""",
)
def kinematics_qc(t: Tables) -> DataFrame:
    names = ["x", "speed_kmh", "speed_kmh_filtered", "acceleration_ms2", "acceleration_ms2_filtered"]
    return rounded(kinematics(t).select("match_id", "frame_id", "player_id", *names), names)


_PLAIN = """
steps as (
  select *, t_kin_ms / 1000.0 - lag(t_kin_ms / 1000.0) over w as dt,
    sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as d
  from kept window w as (partition by match_id, player_id, period, era order by fi)),
ms as (select *, d / dt as ms from steps),
acc as (select *, (ms - lag(ms) over (partition by match_id, player_id, period, era order by fi)) / dt as a from ms)
select match_id, player_id, period, fi, round(d + 1e-9, 6) as distance_m,
       round(ms * 3.6 + 1e-9, 6) as speed_kmh, round(a + 1e-9, 6) as acceleration_ms2 from acc
"""


def _raw_columns(df: DataFrame) -> DataFrame:
    names = ["distance_m", "speed_kmh", "acceleration_ms2"]
    return rounded(df.select(*KEYS, "fi", *names), names)


def _bare(t: Tables) -> DataFrame:
    df = t.tracking().withColumn("t_s", F.col("t_kin_ms") / 1000.0)
    return df.drop("distance_m", "speed_kmh", "acceleration_ms2")


@query(
    "raw_view_a",
    "tracking_v",
    f"""
with own as (select *, row_number() over ({_K} order by fi) - 1 as rn from tracking_v),
kept as (select *, 0 as era from own where rn % 5 in (0, 2) and x is not null),
{_PLAIN.strip()}
""",
)
def raw_view_a(t: Tables) -> DataFrame:
    return _raw_columns(T.raw_view_decimated(_bare(t), KEYS, "fi"))


@query(
    "raw_view_b",
    "tracking_v",
    f"""
with eras as (select *, sum(case when is_visible then 0 else 1 end) over ({_K} order by fi) as era from tracking_v),
kept as (select * from eras where is_visible and x is not null),
{_PLAIN.strip()}
""",
)
def raw_view_b(t: Tables) -> DataFrame:
    return _raw_columns(T.raw_view_with_resets(_bare(t), KEYS, "fi"))


@query(
    "visible_segments",
    "tracking_v",
    f"""
with a as (select *, lag(is_visible) over ({_K} order by fi) as pv from tracking_v),
b as (select *, sum(case when is_visible <> coalesce(pv, false) then 1 else 0 end) over ({_K} order by fi) as seg from a),
c as (select *, count(*) over ({_K}, seg) as n from b where is_visible)
select match_id, player_id, period, fi from c where n >= 25
""",
)
def visible_segments(t: Tables) -> DataFrame:
    return T.visible_segments(t.tracking(), KEYS, "fi", min_rows=25).select(*KEYS, "fi")


@query(
    "sprint_starts",
    "tracking_v",
    f"""
select match_id, player_id, period, fi,
  cast(coalesce(speed_kmh >= 25.2, false) and not coalesce(lag(speed_kmh >= 25.2) over ({_K} order by fi), false) as int)
  as sprint_start
from tracking_v
""",
)
def sprint_starts(t: Tables) -> DataFrame:
    out = T.onsets(t.tracking(), KEYS, "fi", F.col("speed_kmh") >= 25.2, name="sprint_start")
    return out.select(*KEYS, "fi", "sprint_start")


@query(
    "snippets",
    "tracking_v",
    f"""
with ok as (select * from tracking_v where x is not null),
a as (select *, case when fi - lag(fi) over ({_K} order by fi) = 1 then 0 else 1 end as brk from ok),
b as (select *, sum(brk) over ({_K} order by fi) as seg from a),
c as (select *, row_number() over ({_K}, seg order by fi) - 1 as p, count(*) over ({_K}, seg) as n,
      sum(x) over ({_K}, seg order by fi rows between current row and 9 following) as sx,
      sum(speed_kmh) over ({_K}, seg order by fi rows between current row and 9 following) as sv
      from b)
select match_id, player_id, period, fi as start_frame, cast(10 as int) as n_points,
       round(sx + 1e-9, 4) as sum_x, round(sv + 1e-9, 4) as sum_speed
from c where p % 5 = 0 and p + 10 <= n and n >= 12
""",
)
def snippets(t: Tables) -> DataFrame:
    out = T.snippets(
        t.tracking(), KEYS, "fi", ["x", "y", "speed_kmh"], length=10, min_segment=12, stride=5
    )

    def total(field: str) -> F.Column:
        return F.aggregate("snippet", F.lit(0.0), lambda acc, p: acc + p[field])

    return out.select(
        *KEYS,
        "start_frame",
        F.size("snippet").alias("n_points"),
        F.round(total("x") + 1e-9, 4).alias("sum_x"),
        F.round(total("speed_kmh") + 1e-9, 4).alias("sum_speed"),
    )


@query(
    "duplicate_number",
    "actions_v",
    """
select match_id, player_id, event_id,
       row_number() over (partition by match_id, player_id order by event_id) - 1 as copy_no
from actions_v
""",
)
def duplicate_number(t: Tables) -> DataFrame:
    out = T.duplicate_number(t.actions(), ["match_id", "player_id"], "event_id")
    return out.select("match_id", "player_id", "event_id", "copy_no")
