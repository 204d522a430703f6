"""The view graph, presets on it, and the evaluation of a harmonised run."""

import json
from pathlib import Path

import pytest
from feeds import json_feed, xml_feed
from pyspark.sql import functions as F
from test_feeds import add_match, add_xml_match

from touchline.operators import shift as X
from touchline.plans import evaluation
from touchline.plans import experiments as G
from touchline.plans import harmonise
from touchline.plans import views as V
from touchline.plans.catalog.views import graph_tables
from touchline.plans.standin import Tables
from touchline.session import ensure_checkpoint_dir

FOLDER = "/root/testdata/sf0.001"


def test_order_is_ancestors_first_and_names_every_need():
    nodes = V.order(["profile_with_context", "player_tracking_strict_oriented"])
    assert nodes.index("roster_roles") < nodes.index("player_profile") < nodes.index("profile_with_context")
    assert nodes.index("oriented") < nodes.index("player_tracking_strict_oriented")
    for view in V.GRAPH.values():
        assert all(need in V.GRAPH or need in V.TABLES for need in view.needs)
    with pytest.raises(ValueError, match="directions, tracking"):
        V.build({}, ["player_tracking_strict_oriented"])


def test_shared_ancestors_are_written_once(spark, monkeypatch):
    written = []
    plain = V.materialise
    monkeypatch.setattr(V, "materialise", lambda df: written.append(df.columns) or plain(df))
    rows = spark.createDataFrame(
        [("A", "m", 1, "pass", "success", 0.0, 0.0, 3.0, 4.0), ("B", "n", 2, "foul", None, None, 1.0, 2.0, 2.0)],
        "source string, match_id string, event_id int, action_type string, result string, start_x double, start_y double, end_x double, end_y double",
    )
    views = V.build({"actions": rows}, ["event_spadl", "event_spadl_comparable"])
    assert len(written) == 1
    assert [r.distance for r in views["event_spadl_comparable"].collect()] == [5.0]
    names = V.GRAPH["event_spadl_comparable"].features_of(views["event_spadl_comparable"])
    assert names[-3:] == ["action_type_foul", "action_type_pass", "result_success"] and "cross_dataset_comparable" not in names
    V.build({"actions": rows}, ["event_spadl_comparable"])
    assert len(written) == 1  # one reader only: nothing is written


def test_categories_are_bounded(spark):
    few = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "kind string")
    assert V.categories(few, "kind") == ("a", "b")
    many = spark.range(V.MOST_CATEGORIES + 1).select(F.col("id").cast("string").alias("kind"))
    with pytest.raises(ValueError, match="more than"):
        V.categories(many, "kind")


def test_every_preset_resolves_its_view_and_label(spark):
    tables = graph_tables(Tables(spark, FOLDER))
    settings = V.Settings(min_frames=1, continuous_frames=2, roles={"L0": "FB", "L1": "CB"})
    views = V.build(tables, {preset["view"] for preset in G.PRESETS.values()}, settings)
    for name, preset in G.PRESETS.items():
        task = G.preset_task(name, views, V.GRAPH)
        labels = {task.label, *task.more_labels}
        assert {*labels, *task.features, *task.key, "source"} <= set(task.df.columns), name
        assert task.features and not labels & set(task.features), name
        assert set(preset["runs"]) <= set(G.RUNS), name
    assert {p["runs"]["augmentation"].get("correction") for n, p in G.PRESETS.items() if n.startswith("intensity")} == {
        None, "ls", "ls_permuted", "combat_p", "combat_p_permuted",
    }


def test_a_finished_run_is_evaluated_from_its_tables(spark, tmp_path):
    xml, js = xml_feed(tmp_path / "xml"), json_feed(tmp_path / "json")
    for name in ("X2", "X3"):
        add_xml_match(xml, name)
    for name in ("502", "503"):
        add_match(js, name)
    (js / "matches.json").write_text(json.dumps([{"id": i, "date_time": "2025-02-01T10:00:00Z"} for i in (501, 502, 503)]))
    feeds, out = harmonise.Feeds(str(xml), str(js)), str(tmp_path / "out")
    assert {r.status for r in harmonise.run(spark, feeds, out).collect()} == {"ok"}
    shared = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    wanted = ("raw_tracking_common", "player_tracking", "player_tracking_core", "team_shape", "event_spadl", "event_spadl_comparable")
    sections = evaluation.evaluate(
        spark, out, str(tmp_path / "report"), feeds=feeds, shift=wanted, presets=("intensity_ls",),
        settings=V.Settings(min_frames=5), shift_settings={"permutations": 5, "folds": 2, "numTrees": 2},
        task_settings={"params": {"numTrees": 2, "maxDepth": 2}},
        grid_settings={"grids": {"augmentation": {"train_sizes": (2, 900), "correction": "ls"}}, "seeds": (42,), "regimes": ("merged_same_n",)},
    )
    assert set(shared.iterdir()) == before  # nothing that was written on the way stays
    summary = {r.name: r for r in sections["summary"].collect()}
    # No team-frame of the small feeds has eight players: that view is named, and fails no other.
    assert set(summary) == set(wanted) - {"team_shape"}
    assert [tuple(r) for r in sections["skipped"].collect()] == [("team_shape", 0, 0)]
    # 60 raw frames of three players, one missing, thinned by position: 24 + 24 + 24 a match.
    assert summary["raw_tracking_common"].n_source == 3 * 72
    # 40 frames of three players; one row is hidden and one has no place.
    assert summary["raw_tracking_common"].n_target == 3 * 118
    assert summary["player_tracking_core"].n_features == 5 and 0 <= summary["player_tracking"].accuracy_mean <= 1
    assert {(r.before, r.after) for r in sections["ablation"].collect()} == {
        ("player_tracking", "player_tracking_core"), ("event_spadl", "event_spadl_comparable"),
    }
    scores = sections["intensity_ls_augmentation"].collect()
    assert {r.target for r in scores} == {"distance_per_minute_m", "hsr_per_minute_m", "mean_speed_kmh"}
    assert {r.train_size for r in scores} == {2} and len({r.target_source for r in scores}) == 2


def test_views_of_the_same_rows_measure_their_features_once(spark, monkeypatch):
    df = spark.range(400).select(
        "id", F.concat(F.lit("m"), F.col("id") % 3).alias("match_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("source"),
        (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 23 + F.col("id") % 2).cast("double").alias("y"),
    )
    described = {name: V.View((), None, ("id",), own) for name, own in (("player_tracking", ("x", "y")), ("player_tracking_core", ("y",)))}
    measured, explode = [], X._long
    monkeypatch.setattr(X, "_long", lambda rows, features, carry: measured.append(tuple(features)) or explode(rows, features, carry))
    settings = {"sources": ("A", "B"), "permutations": 0, "components": 4, "classifier": False}
    both = G.shift_report({name: df for name in described}, described=described, **settings)
    # Once for the tests, once for the shifts.
    assert measured == [("x", "y")] * 2
    alone = G.evaluate_view("player_tracking_core", df, key=("id",), features=("y",), **settings)
    for section in ("ks", "location_scale", "summary"):
        shared = both[section].filter("name = 'player_tracking_core'")
        (got,), (want,) = shared.collect(), alone[section].select(*shared.columns).collect()
        assert tuple(got) == pytest.approx(tuple(want), nan_ok=True)
