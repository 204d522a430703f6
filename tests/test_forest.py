import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import forest as T
from touchline.operators import models as ML
from touchline.plans.catalog import learning

FEATURES = ["x", "y", "z"]


def drifting(spark, rows=12_000):
    """Two sources that x and z tell apart a little; y is noise, and z has gaps."""
    odd = F.col("id") % 2
    return spark.range(rows).select(
        F.concat(F.lit("m"), F.col("id") % 20).alias("match_id"), F.when(odd == 0, "A").otherwise("B").alias("source"),
        (F.hash("id", F.lit(1)) % 8 + F.when(odd == 0, F.abs(F.hash("id", F.lit(2))) % 4).otherwise(0)).cast("double").alias("x"),
        (F.hash("id", F.lit(3)) % 5).cast("double").alias("y"),
        F.when(F.col("id") % 11 > 0, F.abs(F.hash("id", F.lit(4))) % 6 + odd).cast("double").alias("z"),
    )


def test_forests_on_counts_agree_with_forests_on_rows(spark, monkeypatch):
    df = drifting(spark)
    by_rows, fit = [], ML.fit_classifier
    monkeypatch.setattr(ML, "fit_classifier", lambda *args, **settings: by_rows.append(1) or fit(*args, **settings))
    got = [ML.domain_classifier(df, FEATURES, folds=2, numTrees=20, maxDepth=4)]
    assert not by_rows
    monkeypatch.setattr(ML, "FEW_CELLS", 0)
    monkeypatch.setattr(ML, "ROWS_PER_CELL", 10**9)
    got.append(ML.domain_classifier(df, FEATURES, folds=2, numTrees=20, maxDepth=4))
    assert len(by_rows) == 2
    scores, importances = zip(*[
        ({r.fold: r for r in folds.collect()}, {r.feature: r.importance for r in table.collect()}) for folds, table in got
    ])
    for fold in (0, 1):
        assert scores[0][fold].n_test == scores[1][fold].n_test
        assert scores[0][fold].accuracy == pytest.approx(scores[1][fold].accuracy, abs=0.02) and scores[0][fold].accuracy > 0.6
    assert importances[0] == pytest.approx(importances[1], abs=0.15) and sum(importances[0].values()) == pytest.approx(1)


def test_trees_do_not_depend_on_partitions(spark, monkeypatch):
    df = drifting(spark, 6_000).withColumn("fold", F.col("match_id").isin("m1", "m2", "m3", "m4").cast("int"))
    borders, holes = T.bin_borders(df, FEATURES)
    assert holes == [False, False, True] and [len(b) + 1 for b in borders] == [18, 9, 7]
    missing = np.array([[0, 0, 2]] * 2, np.int16)
    cells = T.count_cells(df, FEATURES, "source", "fold", [0, 1], ["A", "B"], borders, missing)
    assert cells.totals.sum() == 6_000
    monkeypatch.setattr(T, "BLOCK", 100)
    one = T.grow(cells, seed=3, numTrees=4, maxDepth=5)
    monkeypatch.setattr(T, "HELD", 10_000)
    two = T.grow(cells, seed=3, numTrees=4, maxDepth=5)
    assert all(np.array_equal(getattr(one, name), getattr(two, name)) for name in ("feature", "cut", "share", "gained"))
    assert (one.feature >= 0).any(axis=2).all()
    held_out = {r.fold: r.n for r in T.confusion(cells, one).groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    assert held_out == {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}


def test_best_split_equals_a_plain_search():
    rng = np.random.default_rng(1)
    counts, weight = rng.integers(0, 6, (7, 2, 5, 3)), np.array([1.0, 0.5, 2.0])
    counts[:, 1] = rng.permuted(counts[:, 0], axis=1)
    candidate, border, gained, below, above = T._best(counts, weight, 4)

    def impure(w):
        return w.sum() * (1 - ((w / w.sum()) ** 2).sum()) if w.sum() else 0.0

    for node in range(7):
        found = {}
        for j in range(2):
            for cut in range(5):
                sides = counts[node, j, : cut + 1].sum(axis=0), counts[node, j, cut + 1:].sum(axis=0)
                if min(side.sum() for side in sides) >= 4:
                    found[j, cut] = impure((sides[0] + sides[1]) * weight) - sum(impure(side * weight) for side in sides)
        assert gained[node] == pytest.approx(max(found.values())) == pytest.approx(found[candidate[node], border[node]])
        assert below[node] == pytest.approx(counts[node, candidate[node], : border[node] + 1].sum(axis=0) * weight)
        assert above[node] == pytest.approx(counts[node, candidate[node], border[node] + 1:].sum(axis=0) * weight)


@pytest.mark.parametrize("name", ["domain_clf", "domain_importances"])
def test_queries_fit_the_whole_classifier(monkeypatch, name):
    asked = []
    monkeypatch.setattr(learning, "_rows", lambda t: "rows")
    monkeypatch.setattr(ML, "domain_classifier", lambda rows, features, **settings: asked.append(settings) or ("scores", "table"))
    getattr(learning, name)(None)
    assert asked == [{}]
