"""Feature views over harmonised tables, as a graph.

Each node names the tables and nodes that it is built from. ``build`` resolves the wanted views and
writes every node that more than one of them reads, so that shared work is done once; inside
``session.scratch_tables`` those copies go when the block ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators import features as A
from touchline.operators import trajectory as T
from touchline.operators.sampling import sample_per_group
from touchline.operators.shift import numeric_features
from touchline.plans import harmonise
from touchline.session import materialise
from touchline.sources import json_feed, xml_feed
from touchline.sources.files import Files


@dataclass(frozen=True)
class Settings:
    """Parameters of the views. ``None`` takes all rows, frames or categories that there are."""

    rows_per_match: int | None = None
    frames_per_match: int | None = None
    frames_per_player: int | None = None
    min_frames: int = 200
    min_outfield: int = 9
    continuous_frames: int = 50
    tolerance_ms: int = 200
    roles: Mapping[str, str] | None = None
    action_types: tuple[str, ...] | None = None
    results: tuple[str, ...] | None = None
    seed: int = K.SEED


@dataclass(frozen=True)
class View:
    """A node: what it needs, how it is built, the key of its rows, and its features.

    Without named features all numeric columns are features but for the key and ``hidden``.
    """

    needs: tuple[str, ...]
    build: Callable[[Mapping[str, DataFrame], Settings], DataFrame]
    key: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()

    def features_of(self, df: DataFrame) -> list[str]:
        if self.features:
            return list(self.features)
        return numeric_features(df, ("source", "match_id", *self.key, *self.hidden))


#: Tables that a graph starts from; ``raw_dense`` and ``raw_gapped`` may be left out, one or both.
TABLES = ("tracking", "actions", "roster", "directions", "raw_dense", "raw_gapped")
_OPTIONAL = ("raw_dense", "raw_gapped")
#: Actions have a fixed vocabulary; a column with more values is not a category.
MOST_CATEGORIES = 200

_ROW = ("player_id", "frame_id")
_TEAM_FRAME = ("team_id", "frame_id", "period")
_PLAYER = ("player_id", "position_group")
_RAW_SERIES = ["match_id", "player_id", "period"]
_RAW = ["source", *_RAW_SERIES, "frame_id_source", "x", "y", "speed_kmh", "acceleration_ms2", "distance_m"]
_TARGETS = ("distance_per_minute_m", "hsr_per_minute_m", "mean_speed_kmh")
_EXPLORED = ("total_distance_m", "hsr_distance_m", "sprint_count", "vmax_kmh", "n_frames")
_PASS = ("start_x", "start_y", "end_x", "end_y", "pass_length_m", "pass_angle_rad", "forward_progress_m", "second_half")
_CONTEXT = (
    "n_visible_frame", "teammates_within_10m_start", "opponents_within_10m_start", "opponents_within_3m_start",
    "opponents_within_5m_end", "min_dist_opponent_to_start", "min_dist_teammate_to_end",
)
_CORE = ("x", "y", A.SPEED, A.ACCEL, A.DIST)


def _raw_common(t: Mapping[str, DataFrame], s: Settings) -> DataFrame:
    """Plain kinematics of both raw feeds: the dense one thinned by position, the gapped one reset at gaps."""
    parts = []
    if "raw_dense" in t:
        parts.append(T.raw_view_decimated(t["raw_dense"], _RAW_SERIES, "frame_id_source"))
    if "raw_gapped" in t:
        parts.append(T.raw_view_with_resets(t["raw_gapped"], _RAW_SERIES, "frame_id_source"))
    if not parts:
        raise ValueError("the view of raw rows needs raw_dense or raw_gapped")
    both = parts[0].select(*_RAW)
    for part in parts[1:]:
        both = both.unionByName(part.select(*_RAW))
    return sample_per_group(both, ["match_id"], s.rows_per_match, ["match_id", "player_id", "period", "frame_id_source"], seed=s.seed)


def _oriented(t: Mapping[str, DataFrame], s: Settings) -> DataFrame:
    sides = t["directions"]
    flag = "normalised" if "normalised" in sides.columns else None
    return A.oriented(t["tracking"], sides, normalised=flag)


def _player_rows(source: str, strict: bool):
    def build(t: Mapping[str, DataFrame], s: Settings) -> DataFrame:
        return A.player_view(t[source], rows_per_match=s.rows_per_match, min_outfield=s.min_outfield if strict else None, seed=s.seed)

    return build


def _team_frames(source: str, **fixed):
    def build(t: Mapping[str, DataFrame], s: Settings) -> DataFrame:
        shape = {name: s.min_outfield if value is ... else value for name, value in fixed.items()}
        return A.team_shape(t[source], frames_per_match=s.frames_per_match, seed=s.seed, **shape)

    return build


def _same(source: str):
    """Another choice of features over the same rows."""
    return lambda t, s: t[source]


def categories(df: DataFrame, column: str) -> tuple[str, ...]:
    """The distinct values of a column of a bounded vocabulary, sorted; refused beyond ``MOST_CATEGORIES``."""
    rows = df.select(column).dropna().distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} values")
    return tuple(sorted(row[0] for row in rows))


def _events(t: Mapping[str, DataFrame], s: Settings) -> DataFrame:
    rows = t["actions"]
    return A.event_view(
        rows,
        categories(rows, "action_type") if s.action_types is None else s.action_types,
        categories(rows, "result") if s.results is None else s.results,
    )


def _profile(t: Mapping[str, DataFrame], s: Settings) -> DataFrame:
    return A.player_profile(
        t["tracking"], t["roster_roles"], roles=s.roles, max_frames=s.frames_per_player, min_frames=s.min_frames, seed=s.seed
    )


def _rates(visible: bool):
    def build(t: Mapping[str, DataFrame], s: Settings) -> DataFrame:
        return A.intensity_rates(
            t["tracking"], t["roster_roles"], roles=s.roles, max_frames=s.frames_per_player, min_frames=s.min_frames,
            continuous_frames=s.continuous_frames if visible else None, seed=s.seed,
        )

    return build


GRAPH: dict[str, View] = {
    # Ancestors only.
    "oriented": View(("tracking", "directions"), _oriented),
    "roster_roles": View(("roster",), lambda t, s: A.roster_roles(t["roster"], roles=s.roles)),
    "player_context": View(
        ("tracking",), lambda t, s: A.player_context(t["tracking"], max_frames=s.frames_per_player, seed=s.seed), ("player_id",)
    ),
    # Views of the source-shift evaluation.
    "raw_tracking_common": View(
        _OPTIONAL, _raw_common, ("player_id", "period", "frame_id_source"), ("x", "y", "speed_kmh", "acceleration_ms2", "distance_m")
    ),
    "player_tracking": View(
        ("tracking",), _player_rows("tracking", False), _ROW,
        ("x", "y", "ball_x", "ball_y", "ball_z", A.SPEED, A.ACCEL, A.DIST, "is_home", "ball_status", "period_second_half"),
    ),
    "player_tracking_core": View(("player_tracking",), _same("player_tracking"), _ROW, _CORE),
    "player_tracking_strict": View(("tracking",), _player_rows("tracking", True), _ROW, _CORE),
    "player_tracking_strict_oriented": View(("oriented",), _player_rows("oriented", True), _ROW, _CORE),
    "team_shape": View(
        ("tracking",), _team_frames("tracking"), _TEAM_FRAME,
        ("n_visible", *A.TEAM_SHAPE_CORE[2:], "is_home", "period_second_half"),
    ),
    "team_shape_core": View(("team_shape",), _same("team_shape"), _TEAM_FRAME, tuple(A.TEAM_SHAPE_CORE[2:])),
    "team_shape_strict": View(
        ("team_shape",), lambda t, s: t["team_shape"].filter(F.col("n_outfield_visible") >= s.min_outfield), _TEAM_FRAME,
        tuple(A.TEAM_SHAPE_STRICT[2:]),
    ),
    "team_shape_strict_oriented": View(
        ("oriented",), _team_frames("oriented", min_visible=None, min_outfield=...), _TEAM_FRAME, tuple(A.TEAM_SHAPE_STRICT[2:])
    ),
    "event_spadl": View(("actions",), _events, ("event_id",)),
    "event_spadl_comparable": View(
        ("event_spadl",), lambda t, s: t["event_spadl"].filter("cross_dataset_comparable = 1"), ("event_id",),
        hidden=("cross_dataset_comparable",),
    ),
    # Views of the learning tasks.
    "frame_state": View(
        ("tracking",), lambda t, s: A.frame_state(t["tracking"], frames_per_match=s.frames_per_match, seed=s.seed), ("frame_id",),
        hidden=("ball_in_play",),
    ),
    "player_profile": View(("tracking", "roster_roles"), _profile, _PLAYER),
    "player_profile_no_kinematic": View(("player_profile",), lambda t, s: A.without_kinematics(t["player_profile"]), _PLAYER),
    "profile_with_context": View(
        ("player_profile", "player_context"),
        lambda t, s: t["player_profile"].join(t["player_context"], ["match_id", "player_id"], "left"), _PLAYER,
    ),
    "intensity_rates": View(("tracking", "roster_roles"), _rates(False), _PLAYER, hidden=(*_TARGETS, *_EXPLORED)),
    "intensity_rates_vis": View(("tracking", "roster_roles"), _rates(True), _PLAYER, hidden=(*_TARGETS, *_EXPLORED)),
    "pass_view": View(("actions",), lambda t, s: A.pass_view(t["actions"]), ("event_id",), _PASS),
    "pass_context": View(
        ("pass_view", "tracking"), lambda t, s: A.pass_context(t["pass_view"], t["tracking"], tolerance=s.tolerance_ms),
        ("event_id",), (*_PASS, *_CONTEXT),
    ),
    "shot_view": View(
        ("actions",), lambda t, s: A.shot_view(t["actions"]), ("event_id",),
        ("start_x", "start_y", "abs_y", "dist_to_goal_m", "angle_to_goal", "second_half", "is_set_piece"),
    ),
}
SHIFT_VIEWS = (
    "raw_tracking_common", "player_tracking", "player_tracking_core", "player_tracking_strict",
    "player_tracking_strict_oriented", "team_shape", "team_shape_core", "team_shape_strict",
    "team_shape_strict_oriented", "event_spadl", "event_spadl_comparable",
)


def order(names: Iterable[str]) -> list[str]:
    """The wanted nodes and all they need, ancestors first."""
    placed: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in placed:
            return
        for need in GRAPH[name].needs:
            visit(need)
        placed.append(name)

    for name in names:
        visit(name)
    return placed


def build(tables: Mapping[str, DataFrame], names: Iterable[str], settings: Settings | None = None) -> dict[str, DataFrame]:
    """The wanted views; nodes that several others read, or that are wanted and read, are written once."""
    names = list(dict.fromkeys(names))
    nodes = order(names)
    missing = {n for node in nodes for n in GRAPH[node].needs if n in TABLES and n not in tables} - set(_OPTIONAL)
    if missing:
        raise ValueError(f"tables missing for {', '.join(names)}: {', '.join(sorted(missing))}")
    readers = Counter(need for node in nodes for need in GRAPH[node].needs)
    readers.update(names)
    held = dict(tables)
    for node in nodes:
        df = GRAPH[node].build(held, settings or Settings())
        # Views with the rows of another one are that one's written copy already.
        shared = readers[node] > 1 and not any(df is other for other in held.values())
        held[node] = materialise(df) if shared else df
    return {name: held[name] for name in names}


# Tables of a harmonised run ----------------------------------------------------------------

_SQUAD = "players array<struct<id: string, position: string, position_group: string>>"
_SHEET = (
    "batch string, source string, match_id string, coordinates_normalised boolean, "
    "periods array<struct<type: string, play_direction: string>>, "
    f"match struct<teams: struct<home: struct<{_SQUAD}>, away: struct<{_SQUAD}>>>"
).replace("players array", "players: array")


def _milliseconds(df: DataFrame) -> DataFrame:
    return df.withColumn("t_ms", F.unix_millis(S.to_utc(F.col("timestamp"))))


def harmonised_tables(spark: SparkSession, out: str, feeds: harmonise.Feeds | None = None) -> dict[str, DataFrame]:
    """The tables of a finished run below ``out``; with ``feeds`` also the raw rows of its matches.

    Only matches that the manifest names as ok are read. Raw rows are keyed by player and period and
    carry their time in seconds; those of the dense feed come at its own rate.
    """
    sheets = harmonise.read(spark, out, "sheets", schema=_SHEET)
    squads = F.concat(*[F.coalesce(f"match.teams.{side}.players", F.array()) for side in ("home", "away")])
    roster = sheets.select("match_id", F.explode(squads).alias("p")).select(
        "match_id", F.col("p.id").alias("player_id"), F.col("p.position").alias("position_label"), "p.position_group"
    )
    directions = sheets.select("match_id", F.col("coordinates_normalised").alias("normalised"), F.explode("periods").alias("p")).select(
        "match_id", F.col("p.type").alias("period"), "p.play_direction", "normalised"
    )
    tables = {
        "tracking": _milliseconds(harmonise.read(spark, out, "tracking")),
        "actions": _milliseconds(harmonise.read(spark, out, "actions")),
        "roster": roster,
        "directions": directions,
    }
    if feeds is None:
        return tables
    ok = harmonise.manifest(spark, out).filter("status = 'ok'").select("match_id", "source")
    common = ["source", *_RAW_SERIES, "frame_id_source", "x", "y", "t_s"]
    if feeds.xml:
        rows = xml_feed.positions(spark, _listed(spark, xml_feed, feeds.xml, ok))
        players = rows.filter(xml_feed.is_player() & F.col("player_id").isNotNull())
        seconds = F.unix_micros(S.to_utc(F.col("timestamp"))) / F.lit(1e6)
        dense = players.select(F.lit(K.SOURCE_XML).alias("source"), "*", seconds.alias("t_s")).select(*common)
        tables["raw_dense"] = materialise(dense)
    if feeds.json:
        frames = json_feed.frames(spark, _listed(spark, json_feed, feeds.json, ok))
        rows = frames.select(
            "match_id", F.when(F.col("period") == 1, "first_half").otherwise("second_half").alias("period"),
            F.col("frame").alias("frame_id_source"), (F.col("frame") / 10.0).alias("t_s"), F.explode("player_data").alias("p"),
        ).select(
            F.lit(K.SOURCE_JSON).alias("source"), "match_id", "period", "frame_id_source", "t_s",
            F.col("p.player_id").cast("string").alias("player_id"), "p.x", "p.y",
            F.coalesce("p.is_detected", F.lit(False)).alias("is_visible"),
        )
        tables["raw_gapped"] = materialise(rows.filter("player_id is not null").select(*common, "is_visible"))
    return tables


def _listed(spark: SparkSession, module, root, matches: DataFrame) -> Files:
    """The files of the given matches, listed by path."""
    found = module.inventory(spark, root).join(matches, ["source", "match_id"], "left_semi")
    paths: dict[str, list[str]] = {}
    for row in found.select("kind", "path").collect():
        paths.setdefault(row["kind"], []).append(row["path"])
    return Files(root, paths)
