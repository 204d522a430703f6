import hashlib

import pytest
from pyspark.sql import functions as F

from touchline.operators import metrics as M
from touchline.operators import sampling as O
from touchline.plans import design as D
from touchline.plans import experiments as G
from touchline.plans.catalog import learning
from touchline.plans.standin import Tables

KEY = ("id",)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1200).select(
        "id", F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("source"), (F.col("id") % 12).cast("string").alias("match_id"),
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"),
        (F.col("id") % 7 * 2.0).alias("y1"), (F.col("id") % 5 * -1.0).alias("y2"),
    )
    return df.unionByName(df.limit(0)).cache()


def task(rows, **extra):
    settings = {"features": ("x", "z"), "label": "y1", "kind": "regression", "params": {"numTrees": 3, "maxDepth": 4}, **extra}
    return G.Task(df=rows, key=KEY, sources=("A", "B"), **settings)


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def test_ranks_equal_the_order_of_draws(spark, rows):
    ranked = O.nested_ranks(rows, ["source"], 50, KEY, seed=9)
    got = {s: [r["id"] for r in ranked.filter(F.col("source") == s).orderBy("rank").collect()] for s in ("A", "B")}
    for source in ("A", "B"):
        drawn = rows.filter(F.col("source") == source).withColumn("d", O.draw(9, "id")).orderBy("d", "id").limit(50).collect()
        assert got[source] == [r["id"] for r in drawn]
    assert O.nested_ranks(rows, ["source"], 10**6, KEY).count() == 1200
    assert O.nested_ranks(rows.limit(0), ["source"], 5, KEY).count() == 0


def test_sets_are_nested_and_apart_from_the_test(spark, rows):
    design = G.augmentation_design(task(rows), (20, 60, 900), seeds=(1, 2))
    by = {(c.seed, c.target_source, c.regime, c.train_size): c for c in design.cells}
    assert len(by) == len(design.cells) == 2 * 2 * 3 * 4
    for seed in (1, 2):
        for target in ("A", "B"):
            small, large = by[seed, target, "target_only", 20], by[seed, target, "target_only", 60]
            assert len(ids(design.train(small))) == 20 and ids(design.train(small)) < ids(design.train(large))
            held = {r["match_id"] for r in design.test(small).select("match_id").distinct().collect()}
            assert held and not held & {r["match_id"] for r in design.train(large).select("match_id").collect()}
            mixed = design.train(by[seed, target, "merged_same_n", 20]).groupBy("source").count().collect()
            assert {r["source"]: r["count"] for r in mixed} == {"A": 10, "B": 10}
    status = {(r.target_source, r.regime, r.train_size): r for r in design.table(spark).filter("seed = 1").collect()}
    assert status["A", "target_only", 900].status == "skipped" and status["A", "target_only", 60].status == "ok"
    assert {p.role: p.found for p in status["A", "target_plus_other_2n", 900].parts} == {"target": 200, "other": 800}


def test_leave_one_match_out(spark, rows):
    design = G.augmentation_design(task(rows), (10,), seeds=(5,), scheme="lomo", regimes=("target_only",))
    assert len(design.cells) == 12 and all(design.runs(c) for c in design.cells)
    one = next(c for c in design.cells if c.fold_id == "lomo:4")
    assert {r["match_id"] for r in design.test(one).collect()} == {"4"}


def test_the_design_costs_the_same_whatever_the_cells(spark, rows):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()

    def jobs(sizes):
        before = scheduler.numTotalJobs()
        G.augmentation_design(task(rows), sizes, seeds=(1,))
        return scheduler.numTotalJobs() - before

    assert jobs(tuple(range(5, 105, 5))) <= jobs((5, 100)) + 2  # adaptive execution may split a query differently


def test_every_target_of_a_grid_is_scored(spark, rows):
    measured = G.augmentation(task(rows, more_labels=("y2",)), (60, 10**6), seeds=(1,), regimes=("target_only",)).collect()
    assert {(r.target_source, r.target, r.train_size) for r in measured} == {(s, t, 60) for s in ("A", "B") for t in ("y1", "y2")}
    with pytest.raises(ValueError):
        G.augmentation(task(rows), (10**6,), seeds=(1,))


def test_transfer_skips_small_budgets(spark, rows):
    few = rows.filter("source = 'B' or id < 90")
    design = G.transfer_design(task(few), seeds=(1,))
    assert design.cells and not any(design.runs(c) for c in design.cells)
    full = G.transfer_design(task(rows), seeds=(1,), max_budget=80)
    assert {c.train_size for c in full.cells} == {80} and all(full.runs(c) for c in full.cells)


def test_parallel_results_keep_their_order():
    assert D.in_parallel(lambda c: c.seed, [D.Cell(seed=n) for n in range(20)], at_once=3) == list(range(20))


def test_gains_of_merging_have_the_sign_of_an_improvement(spark):
    rows = [(1, "A", 10.0, 0.5), (1, "B", 8.0, 0.7), (1, "merged", 7.0, 0.75), (2, "A", 4.0, 0.1), (2, "merged", 5.0, None), (3, "merged", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "seed int, regime string, mae double, r2 double")
    got = {(r.seed, r.source_regime): (r.delta_mae, r.delta_r2) for r in M.merged_deltas(df, ["seed"], ["mae", "r2"], ("A", "B"), lower_is_better=("mae",)).collect()}
    assert got[1, "A"] == (3.0, 0.25) and got[1, "B"] == (1.0, pytest.approx(0.05)) and got[2, "A"] == (-1.0, None) and len(got) == 3
    summary = {r.source_regime: r for r in M.merged_summary(df, ["seed"], [], ["mae"], ("A", "B"), lower_is_better=("mae",)).collect()}
    assert summary["A"].delta_mae_mean == 1.0 and summary["A"].n_pairs == 2 and summary["B"].delta_mae_ci95 == 0.0


def test_digests_of_training_sets_are_read_in_order(spark):
    names = ("cell", "n")
    rows = [(f"c{i % 3}", i % 2, f"{i * 7919 % 1009}:é") for i in range(1000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.cell, r.n): r.rows_md5 for r in learning._digests(spark.createDataFrame(rows, "cell string, n int, k string"), names).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    cells = {row[:2] for row in rows}
    assert got == {c: hashlib.md5(",".join(sorted(k for *cell, k in rows if tuple(cell) == c)).encode()).hexdigest() for c in cells}
    plan = learning.grid_design(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "collect_list" not in plan
