"""Results must not depend on where series are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from touchline.operators import joins as J
from touchline.operators import trajectory as T
from touchline.operators.quantiles import exact_quantiles
from touchline.operators.sampling import nested_ranks, sample_per_group
from touchline.operators.series import last_seen, row_positions, running_totals
from touchline.operators.smoothing import fit_matrix

KEYS = ["k"]
CUTS = [(3, 4), (40, 13)]


def rows_of(spark, n=90, seed=5):
    rng = np.random.default_rng(seed)
    out, at = [], 0
    for i in range(n):
        at += int(rng.choice([1, 1, 1, 2, 40]))
        for k in ("a", "b"):
            gap = rng.random() < 0.12
            x = None if gap else float(np.round(rng.normal() + 0.3 * i, 3))
            out.append((k, at, x, float(i), not gap, float(at) / 10))
    return spark.createDataFrame(out, "k string, f long, x double, y double, vis boolean, t_s double")


def table(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy("k", "f").collect()]


@pytest.mark.parametrize("span,rows", CUTS)
def test_running_totals_match_plain_windows(spark, span, rows):
    df = rows_of(spark)
    w = Window.partitionBy("k").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    want = table(df.withColumn("s", F.sum("y").over(w)), "k", "f", "s")
    got = running_totals(df, KEYS, "f", {"s": F.col("y")}, group_totals={"n": F.lit(1)}, span=span)
    assert table(got, "k", "f", "s") == want
    assert {r.n for r in got.collect()} == {90}
    pos = table(row_positions(df, KEYS, "f", span=span), "k", "f", "_pos")
    assert [p for _, _, p in pos] == list(range(90)) * 2


@pytest.mark.parametrize("span,rows", CUTS)
def test_last_seen_matches_plain_window(spark, span, rows):
    df = rows_of(spark)
    w = Window.partitionBy("k").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    want = table(df.withColumn("p", F.last("x", True).over(w)), "k", "f", "p")
    assert table(last_seen(df, KEYS, "f", F.col("x"), "p", inclusive=False, span=span), "k", "f", "p") == want


def brute_savgol(values, width, degree=2):
    out = list(values)
    i, n = 0, len(values)
    while i < n:
        if values[i] is None:
            i += 1
            continue
        j = i
        while j < n and values[j] is not None:
            j += 1
        run = np.array(values[i:j], float)
        if len(run) >= width:
            for p in range(len(run)):
                s = min(max(p - width // 2, 0), len(run) - width)
                at = np.arange(width)
                out[i + p] = float(np.polyval(np.polyfit(at, run[s : s + width], degree), p - s))
        i = j
    return out


@pytest.mark.parametrize("span,rows", CUTS)
@pytest.mark.parametrize("width", [5, 7])
def test_savgol_matches_least_squares(spark, span, rows, width):
    df = rows_of(spark)
    got = table(T.savgol(df, KEYS, "f", "x", width=width, span=span, rows=rows), "k", "f", "x_filtered")
    for k in ("a", "b"):
        given = [x for kk, _, x in table(df, "k", "f", "x") if kk == k]
        want = brute_savgol(given, width)
        mine = [x for kk, _, x in got if kk == k]
        assert [v is None for v in mine] == [v is None for v in want]
        assert np.allclose([v for v in mine if v is not None], [v for v in want if v is not None], atol=1e-9)


def test_fit_matrix_reproduces_polynomials():
    at = np.arange(7.0)
    assert np.allclose(fit_matrix(7, 2) @ (2 + 3 * at - at**2), 2 + 3 * at - at**2)


@pytest.mark.parametrize("span,rows", CUTS)
def test_chunked_operators_agree(spark, span, rows):
    df = rows_of(spark)
    cut = {"span": span, "rows": rows}
    plain = {"span": 1 << 40, "rows": 1 << 20}
    for make in (
        lambda c: table(T.runs(df, KEYS, "f", value="x", **c), "k", "f", "run_id"),
        lambda c: table(T.visible_segments(df, KEYS, "f", visible="vis", min_rows=6, **c), "k", "f"),
        lambda c: table(T.derive_speed(df, KEYS, "f", x="x", y="y", **c), "k", "f", "speed_kmh_filtered"),
        lambda c: table(T.derive_acceleration(df, KEYS, "f", speed="y", **c), "k", "f", "acceleration_ms2", "acceleration_ms2_filtered"),
        lambda c: table(T.onsets(df, KEYS, "f", F.col("x") > 10, **c), "k", "f", "starts"),
        lambda c: table(T.smooth_positions(df.withColumn("source", F.lit("S")), KEYS, "f", windows={"S": 7}, exclude=F.col("x") > 25, **c), "k", "f", "x_smooth", "y_smooth"),
        lambda c: table(T.raw_view_with_resets(df, KEYS, "f", visible="vis", **c), "k", "f", "distance_m", "acceleration_ms2"),
        lambda c: sorted(map(str, T.snippets(df, KEYS, "f", ["x", "y"], length=4, min_segment=5, stride=2, **c).collect())),
    ):
        assert make(cut) == make(plain)


@pytest.mark.parametrize("parts", [1, 7])
def test_results_ignore_partitioning(spark, parts):
    df = rows_of(spark)
    want = table(T.savgol(df, KEYS, "f", "x", width=5), "k", "f", "x_filtered")
    assert table(T.savgol(df.repartition(parts), KEYS, "f", "x", width=5), "k", "f", "x_filtered") == want


def test_interval_uses_only_the_latest_start(spark):
    points = spark.createDataFrame([("m", f) for f in range(12)] + [("n", 1)], "m string, f long")
    spans = spark.createDataFrame([("m", 2, 9), ("m", 4, 5), ("m", 8, 8)], "m string, s long, e long")
    out = J.in_latest_interval(points, spans, keys=["m"], point="f", start="s", end="e", span=3)
    got = {(r.m, r.f): r.inside for r in out.collect()}
    assert [f for f in range(12) if got["m", f]] == [2, 3, 4, 5, 8]
    assert got["n", 1] is None and got["m", 0] is False


def test_crowded_frames_are_exact(spark):
    rng = np.random.default_rng(3)
    pts = [("m", 1, f"p{i}", "h" if i % 2 else "a", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 40, (60, 2)))]
    df = spark.createDataFrame(pts, "match_id string, frame_id long, player_id string, team_id string, x double, y double")
    small = sorted(map(str, J.neighbours_in_frame(df, block_rows=7).collect()))
    assert small == sorted(map(str, J.neighbours_in_frame(df).collect()))
    first = J.neighbours_in_frame(df, block_rows=7).filter("player_id = 'p0'").first()
    d = [np.hypot(p[4] - pts[0][4], p[5] - pts[0][5]) for p in pts[1:] if p[3] != "a"]
    assert first.opponents_within_10m == sum(v <= 10 for v in d) and first.min_dist_opponent == pytest.approx(min(d))


@pytest.mark.parametrize("whole_below", [0, 400, 10_000])
def test_exact_quantiles_match_numpy(spark, whole_below):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g in "ab" for v in np.concatenate([rng.normal(size=300), np.zeros(200), [1e6]])]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], {"lo": ("v", 0.1), "mid": ("v", 0.5), "hi": ("v", 0.99)}, whole_below=whole_below).collect()}
    for g in "ab":
        vals = [v for gg, v in data if gg == g]
        assert np.allclose([got[g].lo, got[g].mid, got[g].hi], np.quantile(vals, [0.1, 0.5, 0.99]))


def test_speed_memory_survives_repeated_times(spark):
    times = [0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 4.0, 4.0, 5.0]
    rows = [("a", i, t, float(i * i), 0.0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, f long, t_s double, x double, y double").withColumn("vis", F.lit(True))
    want, last_speed = [None], None
    for i in range(1, len(times)):
        dt = times[i] - times[i - 1]
        gained = None
        if dt > 0:
            speed = (i * i - (i - 1) ** 2) / dt
            gained = None if last_speed is None else (speed - last_speed) / dt
            last_speed = speed
        want.append(gained)
    for cut in ({}, {"span": 3, "rows": 2}):
        got = T.raw_view_with_resets(df, ["k"], "f", visible="vis", **cut).orderBy("f").collect()
        assert [r.acceleration_ms2 for r in got] == pytest.approx(want)


def test_quantile_brackets_are_evaluated_once(spark):
    # Approximate quantiles depend on the order in which partial results arrive: a plan that holds them
    # can tell the rows below by one bracket and those inside by another.
    df = spark.createDataFrame([(i % 3, float(i * 31 % 997)) for i in range(4500)], "g int, v double")
    found = exact_quantiles(df, ["g"], {"lo": ("v", 0.1), "mid": ("v", 0.5)})
    assert "percentile_approx" not in found._jdf.queryExecution().toString()


def test_exact_quantiles_of_many_columns_with_outliers_and_nulls(spark):
    rng = np.random.default_rng(4)
    n = 3000
    a, b = rng.normal(size=n), np.round(rng.exponential(size=n), 1)
    a[7] = 1e12
    data = [(float(x), None if i % 9 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(data, "a double, b double")
    wanted = {f"{c}{p}": (c, p) for c in "ab" for p in (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)}
    row = exact_quantiles(df, [], wanted).first()
    kept = {"a": a, "b": [y for i, y in enumerate(b) if i % 9]}
    for name, (c, p) in wanted.items():
        assert row[name] == pytest.approx(np.quantile(kept[c], p))


def test_sample_is_exact_and_stable(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 1500, "big").otherwise("small"))
    picked = sample_per_group(df, ["g"], 700, ["id"])
    sizes = {r.g: r["count"] for r in picked.groupBy("g").count().collect()}
    assert sizes == {"big": 700, "small": 500}
    again = sample_per_group(df.repartition(5), ["g"], 700, ["id"])
    assert {r.id for r in picked.collect()} == {r.id for r in again.collect()}


def _moved_whole(df):
    return "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_samples_move_only_the_rows_up_to_the_cut(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("g"))
    picked = sample_per_group(df, ["g"], 300, ["id"])
    assert not _moved_whole(picked) and not _moved_whole(nested_ranks(df, ["g"], 300, ["id"]))
    # Null is a group as any other.
    assert {r.g: r["count"] for r in picked.groupBy("g").count().collect()} == {None: 300, 0: 300, 1: 300}
