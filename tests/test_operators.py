import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import actions as E
from touchline.operators import correction as C
from touchline.operators import metrics as M
from touchline.operators import models as ML
from touchline.operators import shift as X
from touchline.operators import trajectory as T
from touchline.operators.sampling import group_folds


def walk(spark, step):
    rows = [("m", "p", "first_half", i, f"2025-01-01T12:00:{i * step:09.6f}+00:00", float(i * step), 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "match_id string, player_id string, period string, frame_id long, timestamp string, x double, y double")
    return df.withColumn("t_s", F.unix_micros(S.to_utc(F.col("timestamp"))) / 1e6)


@pytest.mark.parametrize("step", [0.1, 1.0])
def test_walk_speed_and_acceleration(spark, step):
    df = T.derive_speed(walk(spark, step), T.TRACK_KEYS, "frame_id", x="x", y="y")
    df = T.derive_acceleration(df, T.TRACK_KEYS, "frame_id")
    rows = df.orderBy("frame_id").collect()
    assert rows[0].speed_kmh_filtered is None
    assert np.allclose([r.speed_kmh_filtered for r in rows[1:]], 3.6, atol=1e-4)
    assert [r.acceleration_ms2 for r in rows[:2]] == [None, None]
    assert np.allclose([r.acceleration_ms2 for r in rows[2:]], 0.0, atol=1e-3)


def test_native_kinematics_are_copied(spark):
    speeds = [10.0, 12.0, 25.0, 14.0, 30.0, 16.0, 22.0, 18.0]
    accels = [0.0, 0.5, 4.0, -2.0, 3.0, 1.0, -1.0, 2.0]
    rows = [("m", "p", "first_half", i, "S", True, 1.0 * i, 0.0, s, a, 0.1, i / 10) for i, (s, a) in enumerate(zip(speeds, accels))]
    df = spark.createDataFrame(rows, "match_id string, player_id string, period string, frame_id_source long, source string, is_visible boolean, x double, y double, speed_kmh double, acceleration_ms2 double, distance_m double, t_s double")
    out = T.kinematics_qc(df, windows={"other": 13}).orderBy("frame_id_source").collect()
    assert [r.speed_kmh_filtered for r in out] == speeds
    assert [r.acceleration_ms2_filtered for r in out] == accels


def test_decimation_pattern(spark):
    df = spark.range(23).select(F.lit("m").alias("m"), (F.col("id") * 3).alias("f"))
    kept = T.keep_pattern(df, ["m"], "f", span=10).orderBy("f").collect()
    assert [r.f // 3 for r in kept] == [i for i in range(23) if i % 5 in (0, 2)]
    assert [r.kept_idx for r in kept] == list(range(len(kept)))


def brute_offside(rows):
    out = []
    for action, result in rows:
        if action == "offside":
            for i in range(len(out) - 1, max(len(out) - 5, -1), -1):
                if out[i][0] in ("pass", "throw_in") and out[i][1] == "fail":
                    out[i][1] = "offside"
                    break
        else:
            out.append([action, result])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed,cut", [(0, 5), (1, 64), (2, 1 << 16), (3, 3)])
def test_offside_equals_sequential_loop(spark, seed, cut):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(["pass", "throw_in", "shot", "offside", "offside"])), str(rng.choice(["fail", "fail", "success"]))) for _ in range(400)]
    df = spark.createDataFrame([("m", i, a, r) for i, (a, r) in enumerate(rows)], "match_id string, seq long, action_type string, result string")
    got = E.mark_offside(df, ["match_id"], "seq", span=cut, rows=cut).orderBy("seq").collect()
    assert [(r.action_type, r.result) for r in got] == brute_offside(rows)


def test_direction_inference_and_whistles(spark):
    kicks = spark.createDataFrame([("m", "second_half", 1, "T1", "T1")], "match_id string, period string, seq long, team_left string, home_team_id string")
    got = {r.period: r.play_direction for r in E.play_direction(kicks).collect()}
    assert got == {"second_half": "left_right", "first_half": "right_left"}
    assert {r.period for r in E.play_direction(kicks, infer_first=False).collect()} == {"second_half"}


def brute_combat(x, batch):
    names = sorted(set(batch))
    batch = np.array(batch)
    n, _ = x.shape
    means = np.array([x[batch == b].mean(0) for b in names])
    sizes = np.array([(batch == b).sum() for b in names])
    grand = sizes @ means / n
    fitted = np.array([means[names.index(b)] for b in batch])
    pooled = np.sqrt(((x - fitted) ** 2).mean(0))
    z = (x - grand) / pooled
    params = {}
    for b in names:
        zb = z[batch == b]
        g_hat, d_hat = zb.mean(0), zb.var(0, ddof=1)
        g_bar, t2 = g_hat.mean(), g_hat.var(ddof=1)
        m, v = d_hat.mean(), d_hat.var(ddof=1)
        a, bb = (2 * v + m**2) / v, (m * v + m**3) / v
        g, d = g_hat.copy(), d_hat.copy()
        for _ in range(100):
            g2 = (t2 * len(zb) * g_hat + d * g_bar) / (t2 * len(zb) + d)
            d2 = (0.5 * ((zb - g2) ** 2).sum(0) + bb) / (0.5 * len(zb) + a - 1)
            change = max((abs(g2 - g) / abs(g)).max(), (abs(d2 - d) / d).max())
            g, d = g2, d2
            if change < 1e-4:
                break
        params[b] = (g, d)
    return {b: (grand, pooled, *params[b]) for b in names}


def test_combat_matches_direct_equations(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(0, 1, (50, 6)), rng.normal(2, 1.5, (80, 6))]) + np.arange(6)
    batch = ["a"] * 50 + ["b"] * 80
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(b, i, *map(float, r)) for i, (b, r) in enumerate(zip(batch, x))], "source string, i long, " + ", ".join(f"{c} double" for c in names))
    out = C.correct(df, df, names, method="combat_p")
    assert out.applied and out.method == "combat_p"
    got = np.array([[r[c] for c in names] for r in out.test.orderBy("i").collect()])
    params = brute_combat(x, batch)
    want = np.array([((r - params[b][0]) / params[b][1] - params[b][2]) / np.sqrt(params[b][3]) * params[b][1] + params[b][0] for r, b in zip(x, batch)])
    assert np.allclose(got, want, atol=1e-6)


def test_correction_is_skipped_for_one_batch(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "source string, x double")
    test = spark.createDataFrame([("b", 3.0)], "source string, x double")
    for method in ("ls", "combat_p"):
        out = C.correct(train, test, ["x"], method=method)
        assert not out.applied and out.reason == "single_train_batch" and out.test.first().x == 3.0


def test_permuted_labels_keep_counts(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 120, "a").otherwise("b").alias("source"))
    out = C.permute_labels(df, "source", ["id"])
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {"a": 120, "b": 380}
    assert out.filter("id < 120 and source = 'b'").count() > 50


def test_bca_interval_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    groups = {"skewed": rng.exponential(1.0, 25), "pair": np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("flat", 2.0)] * 6 + [("one", 1.0), ("skewed", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    found = {r.g: r for r in M.bootstrap_ci(df, ["g"], "v", resamples=400, method="bca").collect()}
    assert set(found) == {"skewed", "pair", "flat"} and found["flat"].ci_low is None

    normal = NormalDist()
    for name in ("skewed", "pair"):
        values = np.sort(groups[name])
        n = len(values)
        picks = [[int(hashlib.md5(f"0:{b}:{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)] for b in range(400)]
        means = np.array([values[p].mean() for p in picks])
        equal = np.isclose(means, values.mean(), rtol=1e-12, atol=0)
        bias = normal.inv_cdf(np.where(equal, 0.5, means < values.mean()).mean())
        left_out = np.array([np.delete(values, i).mean() for i in range(n)])
        gaps = left_out.mean() - left_out
        speed = (gaps**3).sum() / (6 * (gaps**2).sum() ** 1.5)
        for q, got in ((0.025, found[name].ci_low), (0.975, found[name].ci_high)):
            end = bias + normal.inv_cdf(q)
            assert got == pytest.approx(np.quantile(means, normal.cdf(bias + end / (1 - speed * end))))


def test_permutations_are_cut_at_the_exact_size(spark):
    rng = np.random.default_rng(5)
    # Many rows, then equal draws only, which no digit tells apart.
    for draws in (rng.integers(0, 2**60, 20_000), np.repeat(rng.integers(0, 2**60, 3), 100)):
        table = spark.createDataFrame(pd.DataFrame({"draw": draws})).repartition(3)
        mixed = np.sort(X._mixed(draws.astype(np.uint64), 7, 42), axis=0)
        for n in (1, 150, len(draws)):
            assert (X.permutation_cuts(table, n, 7, 42) == mixed[n - 1]).all()


def test_mmd_matches_direct_kernel_sums(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (40, 2)), rng.normal(0.8, 1, (55, 2))
    data = [("a", i, *map(float, r)) for i, r in enumerate(a)] + [("b", 100 + i, *map(float, r)) for i, r in enumerate(b)]
    df = spark.createDataFrame(data, "source string, i long, x double, y double")
    row = X.mmd(df, ["x", "y"], "a", "b", key=["i"], components=512, permutations=30).first()
    pooled = np.vstack([a, b])
    z = (pooled - pooled.mean(0)) / pooled.std(0)
    gaps = z[:, None] - z[None]
    n, m = 40, 55
    width = np.sqrt((gaps**2).sum(2).sum() / ((n + m) * (n + m - 1)))

    def statistic(k):
        return (k[:n, :n].sum() - n) / (n * (n - 1)) + (k[n:, n:].sum() - m) / (m * (m - 1)) - 2 * k[:n, n:].mean()

    waves = X.fourier_frequencies(2, 512, width, 42)
    want = statistic(np.cos(gaps @ waves.T).mean(axis=2))
    assert row.bandwidth == pytest.approx(width) and row.mmd_sq == pytest.approx(want)
    assert row.mmd_sq == pytest.approx(statistic(np.exp(-(gaps**2).sum(2) / (2 * width**2))), abs=0.03)
    assert row.p_value == pytest.approx(1 / 31) and abs(row.permutation_mean) < 0.02


@pytest.mark.parametrize("chunks", [2, 7, 128])
def test_ks_statistic(spark, chunks):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0, 1, 200), 1), np.round(rng.normal(0.4, 1, 150), 1)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "source string, x double")
    row = X.ks_per_feature(df, ["x"], "a", "b", chunks=chunks).first()
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert row.ks_stat == pytest.approx(want) and 0 < row.p_value < 0.05


def test_wilcoxon_small_exact_and_ties(spark):
    rows = [("g", float(v)) for v in (1, 2, 3, 4, 5)] + [("t", float(v)) for v in (1, 1, -1, 2, 0)] + [("o", 1.0)]
    out = {r.g: r for r in M.wilcoxon(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    assert out["g"].w_plus == 15 and out["g"].p_value == pytest.approx(0.0625)
    assert out["t"].n == 4 and out["t"].w_plus == 8
    assert out["o"].p_value is None
    normal = {r.g: r.p_value for r in M.wilcoxon(spark.createDataFrame(rows, "g string, d double"), ["g"], "d", method="normal").collect()}
    assert normal["g"] == pytest.approx(math.erfc(abs(out["g"].z) / math.sqrt(2)), rel=1e-6)


def test_normal_tail_far_out(spark):
    df = spark.createDataFrame([(float(z),) for z in (0, 1, -2.5, 6, 12, 30)], "z double")
    got = df.select("z", M.normal_two_sided(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-6) for r in got)


def test_metrics_by_hand(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")]
    df = spark.createDataFrame([(1, *r) for r in rows], "c int, y_true string, y_pred string")
    r = M.classification_metrics(df, ["c"]).first()
    assert (r.accuracy, r.balanced_accuracy) == (0.5, 0.5)
    assert r.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0.0) / 3)


def test_iso_and_ids(spark):
    df = spark.createDataFrame([("2025-01-01T12:00:00.1Z", "51649.0"), ("2025-01-01T12:00:00", "abc"), ("x", None), ("", "7")], "a string, b string")
    rows = df.select(S.iso_normalise(F.col("a")).alias("a"), S.clean_id(F.col("b")).alias("b")).collect()
    assert [r.a for r in rows] == ["2025-01-01T12:00:00.100000+00:00", "2025-01-01T12:00:00+00:00", "x", None]
    assert [r.b for r in rows] == ["51649", "abc", None, "7"]


def test_iso_ignores_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2025-01-01T12:00:00",), ("2025-01-01T12:00:00.5+02:00",)], "a string")
        got = [r.a for r in df.select(S.iso_normalise(F.col("a")).alias("a")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2025-01-01T12:00:00+00:00", "2025-01-01T10:00:00.500000+00:00"]


def test_perceptron_kind_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    data = [(float(a), float(b), "in" if a + b > 0 else "out") for a, b in x]
    df = spark.createDataFrame(data, "a double, b double, side string")
    out = ML.fit_classifier(df, ["a", "b"], "side", kind="mlp", maxIter=60, hidden=(6,)).predict(df)
    assert out.filter("side = y_pred").count() > 280


def test_class_weights_and_folds_are_joined_without_moving_rows(spark):
    df = spark.range(4000).select(
        (F.col("id") % 2).alias("source"), (F.col("id") % 14).alias("match_id"), F.col("id").cast("double").alias("x")
    )
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    # Rows of any number would do: what is small is marked, not guessed from sizes.
    spark.conf.set(threshold, "-1")
    try:
        weighted, classes = ML.balanced_weights(df, "source")
        dealt = group_folds(df, folds=2)
        for joined in (weighted, dealt):
            assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert classes == (0, 1) and weighted.agg(F.sum("_weight")).first()[0] == pytest.approx(4000)
    assert dealt.count() == 4000 and dealt.groupBy("match_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_ks_borders_are_written_before_values_are_placed(spark):
    df = spark.range(600).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("id").cast("double").alias("x"))
    plan = X.ks_per_feature(df, ["x"], "a", "b")._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan
