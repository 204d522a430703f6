"""The view graph over the stand-in tables: source shift of all eleven views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import shift as X
from touchline.plans import experiments as G
from touchline.plans import views as V
from touchline.plans.catalog.features import _COVER_SQL, _EVENT_SQL, _ORIENTED_SQL, _RESULTS, _STRICT_ROWS, _TYPES, _shape_sql
from touchline.plans.catalog.evaluation import _UNIFORM
from touchline.plans.registry import query, rounded
from touchline.plans.standin import Tables

COMPONENTS = 8
_OUTFIELD = "sum(case when position_label is distinct from 'GK' then 1 else 0 end) >= 9"
_SIDE_SQL = "cast(is_home as int) as is_home, cast(period = 'second_half' as int) as period_second_half"
_STEPS_SQL = """
{n}_s as (select *, t_kin_ms / 1000.0 - lag(t_kin_ms / 1000.0) over w as dt,
  sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as d
  from {n}_k window w as (partition by match_id, player_id, period, era order by frame_id_source)),
{n}_m as (select *, d / dt as ms from {n}_s),
{n}_v as (select source, x, y, ms * 3.6 as speed_kmh, d as distance_m,
  (ms - lag(ms) over (partition by match_id, player_id, period, era order by frame_id_source)) / dt as acceleration_ms2 from {n}_m)
"""
_RAW_SQL = f"""
dense_p as (select * exclude (distance_m, speed_kmh, acceleration_ms2), 0 as era,
  row_number() over (partition by match_id, player_id, period order by frame_id_source) - 1 as own from tracking_v where source = 'A'),
dense_k as (select * from dense_p where own % 5 in (0, 2) and x is not null and y is not null),
{_STEPS_SQL.format(n="dense").strip()},
gapped_p as (select * exclude (distance_m, speed_kmh, acceleration_ms2),
  sum(case when is_visible then 0 else 1 end) over (partition by match_id, player_id, period order by frame_id_source) as era
  from tracking_v where source = 'B'),
gapped_k as (select * from gapped_p where is_visible and x is not null and y is not null),
{_STEPS_SQL.format(n="gapped").strip()}
"""
# Rows of each view, with its features among the columns.
_ROWS_SQL = {
    "raw_tracking_common": "select * from dense_v union all by name select * from gapped_v",
    "player_tracking": f"select * replace (cast(ball_status as int) as ball_status, cast(is_home as int) as is_home), "
    "cast(period = 'second_half' as int) as period_second_half from harm_v where is_visible",
    "player_tracking_core": "select * from harm_v where is_visible",
    "player_tracking_strict": "select * from strict",
    "player_tracking_strict_oriented": "select * from strict_o",
    "team_shape": f"select * exclude (is_home), {_SIDE_SQL} from shape",
    "team_shape_core": "select * from shape",
    "team_shape_strict": "select * from shape where n_outfield_visible >= 9",
    "team_shape_strict_oriented": "select * from shape_o",
    "event_spadl": "select * from ev",
    "event_spadl_comparable": "select * from ev where cross_dataset_comparable = 1",
}
_EVENT = (
    "start_x", "start_y", "end_x", "end_y", "dx", "dy", "distance",
    *[f"action_type_{v}" for v in _TYPES], *[f"result_{v}" for v in _RESULTS],
)


def _features(name: str) -> tuple[str, ...]:
    """In the order of the view's columns, by which the frequencies of the kernel are drawn."""
    if name == "event_spadl":
        return (*_EVENT[:7], "cross_dataset_comparable", *_EVENT[7:])
    return _EVENT if name == "event_spadl_comparable" else V.GRAPH[name].features


def _view_sql(number: int, name: str) -> str:
    """Common table expressions that end in one row of measures, ``r<number>``."""
    features = _features(name)
    p, size = f"v{number}", len(features)
    typed = ", ".join(f"cast({c} as double) as c{i}" for i, c in enumerate(features))
    filled = ", ".join(f"coalesce(c{i}, (select quantile_cont(c{i}, 0.5) from {p})) as c{i}" for i in range(size))
    z = ", ".join(f"coalesce((c{i} - avg(c{i}) over ()) / nullif(stddev_pop(c{i}) over (), 0), 0) as z{i}" for i in range(size))
    moving = " + ".join(f"cast(stddev_pop(c{i}) > 0 as int)" for i in range(size))
    wave = ", ".join(
        f"sqrt(-2 * ln({_UNIFORM.format(i=i, part='r')})) * cos(2 * pi() * {_UNIFORM.format(i=i, part='a')}) / w as f{i}"
        for i in range(size)
    )
    phase = " + ".join(f"z{i} * f{i}" for i in range(size))
    columns = ", ".join(f"c{i}" for i in range(size))
    return f"""
{p} as materialized (select source, {typed} from ({_ROWS_SQL[name]}) q),
{p}_i as materialized (select source, {filled} from {p}),
{p}_z as materialized (select source, {z} from {p}_i),
{p}_n as (select count(*) filter (source = 'A') as n, count(*) filter (source = 'B') as m,
  sqrt(2.0 * greatest({moving}, 1) * count(*) / (count(*) - 1)) as w from {p}_i),
{p}_f as (select k, {wave} from range({COMPONENTS}) as r(k), {p}_n),
{p}_p as (select k, source, sum(cos({phase})) as c, sum(sin({phase})) as s from {p}_z, {p}_f group by 1, 2),
{p}_k as (select a.k, (a.c * a.c + a.s * a.s - n) / (n * (n - 1.0)) + (b.c * b.c + b.s * b.s - m) / (m * (m - 1.0))
  - 2 * (a.c * b.c + a.s * b.s) / (n * m::double) as v
  from {p}_p a join {p}_p b on a.k = b.k and a.source = 'A' and b.source = 'B', {p}_n),
{p}_l as (select source, feature, value from {p}_i unpivot (value for feature in ({columns}))),
{p}_c as (select feature, value, count(*) filter (source = 'A') as a, count(*) filter (source = 'B') as b from {p}_l group by 1, 2),
{p}_r as (select feature, sum(a) over (partition by feature order by value) as ca, sum(b) over (partition by feature order by value) as cb,
  sum(a) over (partition by feature) as na, sum(b) over (partition by feature) as nb from {p}_c),
{p}_d as (select feature, max(abs(ca / na - cb / nb)) as d, max(na)::double * max(nb) / (max(na) + max(nb)) as scale from {p}_r group by 1),
{p}_q as (select d, case when scale * d * d < 0.04 then 1.0 else least(greatest(list_sum(list_transform(range(1, 101),
  lambda j: case when j % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * j * j * scale * d * d))), 0.0), 1.0) end as p from {p}_d),
{p}_g as (select abs(avg(value) filter (source = 'B') - avg(value) filter (source = 'A')) / stddev_samp(value) as g
  from {p}_l group by feature having stddev_samp(value) > 1e-12),
r{number} as (select '{name}' as name, (select avg(v) from {p}_k) as mmd_sq, (select avg(d) from {p}_q) as ks_mean,
  (select count(*) from {p}_q where least(p * {size}, 1.0) < 0.05) as n_ks_significant, (select avg(g) from {p}_g) as shift_mean)
"""


def _pairs_sql() -> str:
    floats = ("mmd_sq", "ks_mean", "shift_mean")
    both = ", ".join(
        [f"round({side[0]}.{m} + 1e-9, 6) as {m}_{side}" for m in floats for side in ("before", "after")]
        + [f"round(b.{m} - a.{m} + 1e-9, 6) as {m}_drop" for m in floats]
        + ["b.n_ks_significant as n_ks_significant_before", "a.n_ks_significant as n_ks_significant_after"]
        + ["b.n_ks_significant - a.n_ks_significant as n_ks_significant_drop"]
    )
    pairs = ", ".join(f"('{before}', '{after}')" for before, after in X.ABLATION_PAIRS)
    return (
        f"select b.name as before, a.name as after, {both} from (values {pairs}) p(x, y) "
        "join summary b on b.name = x join summary a on a.name = y"
    )


_SHIFT_SQL = ",\n".join(
    part.strip()
    for part in (
        "with " + _RAW_SQL.strip(), _COVER_SQL, _ORIENTED_SQL, _STRICT_ROWS.format(src="harm_v"),
        _STRICT_ROWS.format(src="orient").replace("strict as", "strict_o as"), _shape_sql("harm_v", "count(*) >= 8"),
        _shape_sql("orient", _OUTFIELD).replace("shape as", "shape_o as"), f"ev as ({_EVENT_SQL})",
        *[_view_sql(number, name) for number, name in enumerate(V.SHIFT_VIEWS)],
        "summary as (" + " union all ".join(f"select * from r{number}" for number in range(len(V.SHIFT_VIEWS))) + ")",
    )
) + "\n" + _pairs_sql()


def graph_tables(t: Tables) -> dict[str, DataFrame]:
    raw = t.tracking().withColumn("t_s", F.col("t_kin_ms") / 1000.0).drop("distance_m", "speed_kmh", "acceleration_ms2")
    return {
        "tracking": t.view("harm_v"),
        "actions": t.actions(),
        "roster": t.view("rosters_v").withColumn("position_group", F.lit(None).cast("string")),
        "directions": t.view("directions_v").select("match_id", "period", "play_direction").distinct(),
        "raw_dense": raw.filter("source = 'A'"),
        "raw_gapped": raw.filter("source = 'B'"),
    }


@query("shift_ablation", "tracking_v harm_v directions_v actions_v", _SHIFT_SQL)
def shift_ablation(t: Tables) -> DataFrame:
    views = V.build(graph_tables(t), V.SHIFT_VIEWS, V.Settings(action_types=_TYPES, results=_RESULTS))
    sections = G.shift_report(
        views, described=V.GRAPH, sources=("A", "B"), permutations=0, components=COMPONENTS, classifier=False
    )
    changes = sections["changes"]
    return rounded(changes, [c for c, kind in changes.dtypes if kind == "double"])
