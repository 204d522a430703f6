"""Tracking- and action-shaped views over generic tables.

The views let every operator run on any warehouse that has an ``events``-like stream.
Each view is one SQL text valid in Spark and in ANSI engines; only the string type and
the JSON access differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STREAM = """
select event_id, ts, user_id, event_type, value,
       cast(floor(event_id / 22) as bigint) as f,
       cast({json_k} as double) as k
from events
"""

_VIEWS = {
    "stream_v": _STREAM,
    "tracking_v": """
select concat('m', cast(f % 4 as {str})) as match_id,
       case when f % 2 = 0 then 'A' else 'B' end as source,
       f as frame_id_source, f * 100 as t_ms,
       cast(floor(f / 8) as bigint) as fi,
       f * 100 + (f % 3) * 20 as t_kin_ms,
       case when f % 8 < 4 then 'first_half' else 'second_half' end as period,
       concat('p', cast(event_id % 22 as {str})) as player_id,
       case when event_id % 22 < 11 then 'home' else 'away' end as team_id,
       event_id % 22 < 11 as is_home,
       case when event_id % 22 in (0, 11) then 'GK' when event_id % 22 = 5 then null
            else concat('L', cast(event_id % 5 as {str})) end as position_label,
       case when event_id % 41 = 0 then null else value / 10.0 - 5.0 end as x,
       case when event_id % 41 = 0 then null else k / 10.0 - 5.0 end as y,
       event_id % 41 <> 0 as is_visible,
       case when f % 10 < 7 then true when f % 10 < 9 then false else null end as ball_status,
       case when f % 3 = 0 then null when f % 2 = 0 then 'home' else 'away' end as ball_poss_team_id,
       cast(f % 61 as double) / 2.0 - 15.0 as ball_x,
       cast(f % 37 as double) / 2.0 - 9.0 as ball_y,
       cast(f % 11 as double) / 10.0 - 0.1 as ball_z,
       value as speed_kmh, k / 10.0 - 5.0 as acceleration_ms2,
       k / 100.0 as distance_m, event_id
from stream_v
""",
    "harm_v": """
select match_id, source, period, frame_id_source as frame_id, fi, t_ms, player_id, team_id, is_home,
       position_label, x, y, ball_x, ball_y, ball_z, is_visible, ball_status, ball_poss_team_id,
       speed_kmh as speed_kmh_filtered, acceleration_ms2 as acceleration_ms2_filtered, distance_m, event_id
from tracking_v
""",
    "actions_v": """
select concat('m', cast(f % 4 as {str})) as match_id, event_id, event_id as seq,
       case when f % 2 = 0 then 'A' else 'B' end as source,
       case when f % 8 < 4 then 'first_half' else 'second_half' end as period,
       f * 100 + (event_id % 9) * 50 - 200 as t_ms,
       case event_type when 'view' then 'pass' when 'click' then 'throw_in' when 'purchase' then 'shot'
                       when 'signup' then 'offside' else 'foul' end as action_type,
       case when value > 50 then 'success' else 'fail' end as result,
       case when user_id % 2 = 0 then 'home' else 'away' end as team_id,
       cast(user_id as {str}) as player_id, value / 10.0 - 5.0 as start_x,
       cast((event_id % 68) - 34 as double) as start_y,
       k / 2.0 - 20.0 as end_x, cast((event_id % 61) - 30 as double) as end_y
from stream_v
""",
    "frames_v": """
select distinct match_id, source, period, frame_id_source, t_ms from tracking_v
""",
    "phases_v": """
select distinct match_id, cast(floor(frame_id_source / 40) as bigint) * 40 as frame_start,
       cast(floor(frame_id_source / 40) as bigint) * 40 + 27 as frame_end
from tracking_v where match_id <> 'm3'
""",
    "rosters_v": """
select distinct match_id, player_id, team_id, position_label from tracking_v
""",
    "directions_v": """
select distinct match_id, source, period,
       case when (match_id in ('m0', 'm1')) = (period = 'first_half') then 'left_right'
            else 'right_left' end as play_direction
from tracking_v
""",
    "drift_v": """
select l_linestatus as source, concat('s', cast(l_suppkey % 17 as {str})) as match_id,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_discount, l_tax
from lineitem
""",
    "preds_v": """
select l_linenumber as cell_id, l_returnflag as y_true,
       case when l_orderkey % 5 = 0 then 'A' else l_returnflag end as y_pred,
       l_extendedprice as y, l_quantity * 1500 as yhat
from lineitem
""",
    "measurements_v": """
select o_custkey % 20 as fold_id, c_mktsegment as target_source,
       case c_nationkey % 4 when 0 then 'target_only' when 1 then 'other_only'
                            when 2 then 'merged_same_n' else 'target_plus_other_2n' end as regime,
       100 as train_size,
       round(avg(o_totalprice), 4) as macro_f1,
       round(avg(c_acctbal), 4) as balanced_accuracy
from orders join customer on o_custkey = c_custkey
group by 1, 2, 3
""",
}
_NEEDS = {
    "tracking_v": ("stream_v",),
    "actions_v": ("stream_v",),
    "harm_v": ("tracking_v",),
    "frames_v": ("tracking_v",),
    "phases_v": ("tracking_v",),
    "rosters_v": ("tracking_v",),
    "directions_v": ("tracking_v",),
}
_SPARK = {"str": "string", "json_k": "get_json_object(props, '$.k')"}
_ANSI = {"str": "varchar", "json_k": "json_extract_string(props, '$.k')"}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in _NEEDS.get(name, ()):
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def view_sql(names: tuple[str, ...], query: str, dialect: dict[str, str]) -> str:
    """``query`` preceded by the named views as common table expressions."""
    parts = [f"{name} as ({_VIEWS[name].strip().format(**dialect)})" for name in _closure(names)]
    query = query.strip()
    if not parts:
        return query
    head = "with " + ",\n".join(parts)
    if query.lower().startswith("with "):
        return head + ",\n" + query[5:]
    return head + "\n" + query


def ansi(names: str, query: str) -> str:
    """Oracle text: ``names`` is a space-separated list of the views the query reads."""
    return view_sql(tuple(names.split()), query, _ANSI)


class Tables:
    """The tables of one data folder and the stand-in views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, views: str, query: str, *tables: str) -> DataFrame:
        """Run Spark SQL over the named views; base tables are bound by argument."""
        names = tables or ("events", "lineitem", "orders", "customer")
        text = view_sql(tuple(views.split()), query, _SPARK)
        bound = {name: self.table(name) for name in names if name in text}
        for name in bound:
            text = text.replace(f"from {name}\n", f"from {{{name}}}\n")
            text = text.replace(f"from {name} join", f"from {{{name}}} join")
            text = text.replace(f"join {name} on", f"join {{{name}}} on")
            text = text.replace(f"from {name})", f"from {{{name}}})")
        return self.spark.sql(text, **bound)

    def view(self, name: str) -> DataFrame:
        return self.sql(name, f"select * from {name}")

    def tracking(self) -> DataFrame:
        return self.view("tracking_v")

    def actions(self) -> DataFrame:
        return self.view("actions_v")
