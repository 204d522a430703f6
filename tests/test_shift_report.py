import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import shift as X
from touchline.plans import experiments as G
from touchline.plans import views as V
from touchline.plans.catalog import learning

VIEWS = {"player_tracking": ("x", "y"), "player_tracking_core": ("y",)}


def rows(spark):
    return spark.range(600).select(
        "id", F.concat(F.lit("m"), F.col("id") % 4).alias("match_id"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("source"),
        (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 23 + F.col("id") % 3).cast("double").alias("y"),
    )


def test_cosines_and_sines_equal_those_of_numpy():
    phase = np.random.default_rng(2).normal(size=(300, 7)) * np.logspace(-6, 2, 7)
    want = np.concatenate([np.cos(phase), np.sin(phase)], axis=1)
    assert np.abs(X.cosines_and_sines(phase) - want).max() < 1e-13


def test_kernel_tests_of_views_equal_those_made_alone(spark):
    settings = {"key": ["id"], "components": 16, "permutations": 7}
    together = {r.name: r for r in X.kernel_tests(rows(spark), VIEWS, "A", "B", **settings).collect()}
    assert set(together) == set(VIEWS)
    for name, features in VIEWS.items():
        (alone,) = X.mmd(rows(spark), features, "A", "B", **settings).collect()
        assert tuple(together[name])[1:] == pytest.approx(tuple(alone), rel=1e-9)
    assert together["player_tracking"].n_source == 200 and together["player_tracking"].bandwidth > together["player_tracking_core"].bandwidth


def test_views_of_the_same_rows_draw_their_permutations_once(spark, monkeypatch):
    drawn, cut = [], X.permutation_cuts
    monkeypatch.setattr(X, "permutation_cuts", lambda *args, **settings: drawn.append(1) or cut(*args, **settings))
    described = {name: V.View((), None, ("id",), own) for name, own in VIEWS.items()}
    df = rows(spark)
    sections = G.shift_report(
        dict.fromkeys(VIEWS, df), described=described, sources=("A", "B"), permutations=5, components=4, folds=2, numTrees=2, maxDepth=2
    )
    assert drawn == [1]
    got = {r.name: r for r in sections["summary"].collect()}
    assert {name: r.n_features for name, r in got.items()} == {"player_tracking": 2, "player_tracking_core": 1}
    assert all(r.n_source == 200 and r.n_permutations == 5 and 0 <= r.accuracy_mean <= 1 for r in got.values())


def test_medians_are_taken_of_features_with_gaps_only(spark, monkeypatch):
    asked, quantiles = [], X.exact_quantiles
    monkeypatch.setattr(X, "exact_quantiles", lambda df, groups, wanted: asked.append(sorted(c for c, _ in wanted.values())) or quantiles(df, groups, wanted))
    df = rows(spark).withColumn("y", F.when(F.col("id") > 0, F.col("y")))
    filled = X.impute_median(df, ["x", "y"])
    assert asked == [["y"]] and filled.filter("y is null").count() == 0
    assert X.impute_median(filled, ["x", "y"]).count() == 600 and asked == [["y"]]


def test_query_takes_both_views_from_the_same_rows_with_whole_classifiers(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(learning, "_rows", lambda t: rows(spark).withColumn("size_class", F.lit("")))
    monkeypatch.setattr(G, "shift_report", lambda views, **settings: asked.update(views=views, **settings) or {"summary": "table"})
    assert learning.shift_report(None) == "table"
    assert len({id(df) for df in asked["views"].values()}) == 1
    assert not {"folds", "numTrees", "maxDepth"} & set(asked)
