"""Two-sample measures of how far two sources differ."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline import constants as K
from touchline.operators.quantiles import exact_quantiles
from touchline.operators.sampling import balanced_sample, draw
from touchline.operators.series import running_totals
from touchline.session import joinable, materialise


def numeric_features(df: DataFrame, exclude: Sequence[str] = ("source", "match_id")) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, kind in df.dtypes if c not in exclude and kind in kinds]


def impute_median(df: DataFrame, features: Sequence[str], *, fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the exact pooled median of each feature; features without any are left alone."""
    typed = [F.col(c).cast("double") for c in features]
    gaps = df.agg(*[F.count_if(v.isNull() | F.isnan(v)).alias(f"g{i}") for i, v in enumerate(typed)]).first() if features else ()
    wanted = [c for c, n in zip(features, gaps) if n]
    fill = {}
    if wanted:
        medians = exact_quantiles(
            df if fit_on is None else fit_on, [], {f"m{i}": (c, 0.5) for i, c in enumerate(wanted)}
        ).first()
        fill = {c: medians[f"m{i}"] for i, c in enumerate(wanted) if medians and medians[f"m{i}"] is not None}
    out = df.withColumns(dict(zip(features, typed)))
    return out.na.fill(fill) if fill else out


def prepare(
    df: DataFrame, features: Sequence[str], *, key: Sequence[str], per_source: int | None = None, seed: int = K.SEED
) -> DataFrame:
    """All rows, or a source-balanced sample, with nulls and infinities replaced by pooled medians."""
    sampled = balanced_sample(df, per_source=per_source, key=key, seed=seed)
    clean = sampled.withColumns(
        {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")) for c in features}
    )
    return impute_median(materialise(clean), features)


def _long(df: DataFrame, features: Sequence[str], carry: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    )
    finite = F.abs(F.col("value")) < float("inf")
    return df.select(*carry, F.explode(pairs).alias("p")).select(*carry, "p.*").filter(finite)


def kolmogorov_p(stat: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value: the Kolmogorov series at sqrt(nm/(n+m)) * stat."""
    lam2 = n * m / (n + m) * stat * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(F.pmod(k, F.lit(2)) == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2),
    )
    return F.when(lam2 < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_per_feature(
    df: DataFrame, features: Sequence[str], source_a: str, source_b: str, *, source: str = "source", chunks: int = 128
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-values per feature.

    Equal values are counted before the shuffle and the counts are written, as the borders, the sums of
    chunks and the sums inside them all read them; the cumulative counts then run over
    chunks with about equally many distinct values each, whatever the values' spread.
    """
    is_a, is_b = F.col(source) == source_a, F.col(source) == source_b
    counts = materialise(
        _long(df.filter(is_a | is_b), features, [source])
        .groupBy("feature", "value")
        .agg(F.count_if(is_a).alias("a"), F.count_if(is_b).alias("b"))
    )
    shares = F.array(*[F.lit(k / chunks) for k in range(1, chunks)])
    borders = counts.groupBy("feature").agg(F.percentile_approx("value", shares, 20 * chunks).alias("_borders"))
    # Borders up to the value, by halving.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(chunks.bit_length()))])
    place = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get("_borders", at + step - 1) <= F.col("value"), at + step).otherwise(at)
    ).cast("long")
    placed = counts.join(joinable(borders), "feature").withColumn("_bucket", place).drop("_borders")
    run = running_totals(
        placed, ["feature"], "value", {"ca": F.col("a"), "cb": F.col("b")},
        group_totals={"na": F.col("a"), "nb": F.col("b")}, chunk=F.col("_bucket"),
    )
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    out = run.filter((F.col("na") > 0) & (F.col("nb") > 0)).groupBy("feature").agg(
        F.max(gap).alias("ks_stat"), F.max("na").alias("n_a"), F.max("nb").alias("n_b")
    )
    p = kolmogorov_p(F.col("ks_stat"), F.col("n_a"), F.col("n_b"))
    return bonferroni(out.withColumn("p_value", p), len(features))


def bonferroni(df: DataFrame, tests: int) -> DataFrame:
    return df.withColumn("p_value_bonferroni", F.least(F.col("p_value") * tests, F.lit(1.0)))


def location_scale(
    df: DataFrame, features: Sequence[str], source_a: str, source_b: str, *, source: str = "source"
) -> DataFrame:
    """Mean shift (b minus a) and variance ratios per feature."""
    a = F.when(F.col(source) == source_a, F.col("value"))
    b = F.when(F.col(source) == source_b, F.col("value"))
    rows = _long(df.filter(F.col(source).isin(source_a, source_b)), features, [source])
    eps = 1e-12
    out = rows.groupBy("feature").agg(
        F.count(a).alias("n_a"),
        F.count(b).alias("n_b"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("pooled_std"),
        F.coalesce(F.var_samp(a), F.lit(0.0)).alias("variance_a"),
        F.coalesce(F.var_samp(b), F.lit(0.0)).alias("variance_b"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("pooled_variance"),
    )
    shift = F.col("mean_b") - F.col("mean_a")

    def over(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > eps, F.col(top) / F.col(bottom))

    return out.withColumns(
        {
            "gamma": shift,
            "gamma_pooled_sd": F.when(F.col("pooled_std") > eps, shift / F.col("pooled_std")),
            "delta2_a": over("variance_a", "pooled_variance"),
            "delta2_b": over("variance_b", "pooled_variance"),
            "variance_ratio": over("variance_b", "variance_a"),
        }
    )


# Kernel two-sample test ------------------------------------------------------------------


def _uniform(*parts: object) -> float:
    """Reproducible number in (0, 1) from the md5 of the parts."""
    text = hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    return (int(text[:8], 16) + 0.5) / 2**32


def fourier_frequencies(size: int, components: int, bandwidth: float, seed: int) -> np.ndarray:
    """Normal frequencies (components x size) of the RBF kernel exp(-d^2 / (2 bandwidth^2))."""
    out = np.empty((components, size))
    for k in range(components):
        for i in range(size):
            radius = math.sqrt(-2 * math.log(_uniform(seed, k, i, "r")))
            out[k, i] = radius * math.cos(2 * math.pi * _uniform(seed, k, i, "a")) / bandwidth
    return out


def _mixed(draws: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """Rows x permutations: 64 mixed bits of each row's draw, other ones for each permutation."""
    with np.errstate(over="ignore"):
        salts = (np.arange(1, permutations + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = draws[:, None] ^ salts[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed


def _pieces(rows: int, width: int) -> Iterator[slice]:
    """Rows that an array of so many columns holds in 64 kB at a time: larger ones are mapped anew for every step."""
    step = max(1, 8192 // max(width, 1))
    return (slice(begin, begin + step) for begin in range(0, rows, step))


_DIGIT_BITS = 12
#: So few values around a cut are looked at themselves, instead of by a further digit.
_AT_CUT = 64


def permutation_cuts(table: DataFrame, n: int, permutations: int, seed: int, *, draw_column: str = "draw") -> np.ndarray:
    """The ``n``-th smallest mixed draw of each permutation.

    All permutations are cut together, digit by digit: a pass counts the rows by the next digit of those
    that share the digits found, and a row per permutation comes back. Once only few rows share them,
    their values are compared.
    """
    draws = table.select(F.col(draw_column).alias("draw"))
    found = np.zeros(permutations, np.uint64)
    below = np.zeros(permutations, np.int64)
    left = 64
    while left:
        known, step = 64 - left, min(_DIGIT_BITS, left)
        left -= step

        def count(batches: Iterator[pd.DataFrame], known=known, step=step, left=left, found=found) -> Iterator[pd.DataFrame]:
            held = np.zeros(permutations << step, np.int64)
            for pdf in batches:
                values = pdf["draw"].to_numpy(np.uint64)
                for part in _pieces(len(values), permutations):
                    mixed = _mixed(values[part], permutations, seed)
                    cells = ((mixed >> np.uint64(left)) & np.uint64((1 << step) - 1)).astype(np.int64)
                    cells += np.arange(permutations, dtype=np.int64) << step
                    inside = cells if not known else cells[(mixed >> np.uint64(64 - known)) == found]
                    np.add.at(held, inside.ravel(), 1)
            used = np.flatnonzero(held)
            yield pd.DataFrame({"perm": (used >> step).astype("int32"), "digit": used & ((1 << step) - 1), "n": held[used]})

        counted = draws.mapInPandas(count, "perm int, digit long, n long").groupBy("perm", "digit").agg(F.sum("n").alias("n"))
        wanted = F.get(F.array(*[F.lit(int(n - b)) for b in below]), F.col("perm"))
        upto = F.sum("n").over(Window.partitionBy("perm").orderBy("digit"))
        cuts = (
            counted.withColumn("upto", upto).filter(F.col("upto") >= wanted)
            .groupBy("perm").agg(F.min(F.struct("digit", "upto", "n")).alias("c")).select("perm", "c.*").toPandas().sort_values("perm")
        )
        found = (found << np.uint64(step)) | cuts["digit"].to_numpy(np.uint64)
        below = below + (cuts["upto"] - cuts["n"]).to_numpy(np.int64)
        if left and cuts["n"].max() <= _AT_CUT:
            break
    else:
        return found

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = pdf["draw"].to_numpy(np.uint64)
            for part in _pieces(len(drawn), permutations):
                mixed = _mixed(drawn[part], permutations, seed)
                row, perm = np.nonzero((mixed >> np.uint64(left)) == found)
                if len(row):
                    yield pd.DataFrame({"perm": perm.astype("int32"), "value": mixed[row, perm].view(np.int64)})

    near = draws.mapInPandas(values, "perm int, value long").toPandas()
    out = np.empty(permutations, np.uint64)
    for perm, part in near.groupby("perm"):
        out[perm] = np.sort(part["value"].to_numpy(np.int64).view(np.uint64))[n - below[perm] - 1]
    return out


_TABLE = 4096
_AROUND = np.arange(_TABLE) * (2 * math.pi / _TABLE)
_COSINES, _SINES = np.cos(_AROUND), np.sin(_AROUND)


def cosines_and_sines(phase: np.ndarray) -> np.ndarray:
    """Cosines and sines side by side, exact to rounding: a table's nearest angle, and the series for the rest.

    The rest is at most pi / 4096, so the terms left out are below 1e-17.
    """
    steps = phase * (_TABLE / (2 * math.pi))
    near = np.rint(steps)
    rest = (steps - near) * (2 * math.pi / _TABLE)
    at = near.astype(np.int64) & (_TABLE - 1)
    cosine, sine, square = _COSINES[at], _SINES[at], rest * rest
    small_cosine, small_sine = 1 - square * (0.5 - square / 24), rest * (1 - square / 6)
    out = np.empty((len(phase), 2 * phase.shape[1]))
    out[:, : phase.shape[1]] = cosine * small_cosine - sine * small_sine
    out[:, phase.shape[1] :] = sine * small_cosine + cosine * small_sine
    return out


def mmd(
    df: DataFrame,
    features: Sequence[str],
    source_a: str,
    source_b: str,
    *,
    key: Sequence[str],
    components: int = 128,
    permutations: int = 100,
    bandwidth: float | None = None,
    seed: int = K.SEED,
    source: str = "source",
) -> DataFrame:
    """Unbiased squared MMD with an RBF kernel over all rows, and a permutation p-value.

    Features are standardised by their pooled moments; nulls and infinities count as the
    mean. The kernel is written as the mean of ``components`` random cosines of pair
    differences, so the sums over all pairs follow from one sum of cosines and sines per
    source, and the work is linear in the rows. ``bandwidth`` is the root mean square
    distance of pairs by default. A permutation's first sample are the rows of smallest draw, by a
    hash of ``key`` and the permutation, as many as the first source has; rows of one key stay together.
    """
    return kernel_tests(
        df, {"": features}, source_a, source_b, key=key, components=components, permutations=permutations,
        bandwidth=bandwidth, seed=seed, source=source,
    ).drop("name")


def kernel_tests(
    df: DataFrame,
    views: Mapping[str, Sequence[str]],
    source_a: str,
    source_b: str,
    *,
    key: Sequence[str],
    components: int = 128,
    permutations: int = 100,
    bandwidth: float | None = None,
    seed: int = K.SEED,
    source: str = "source",
) -> DataFrame:
    """``mmd`` of several sets of features of the same rows, a row per name: permutations are drawn and rows are read once."""
    features = list(dict.fromkeys(c for own in views.values() for c in own))
    rows = df.filter(F.col(source).isin(source_a, source_b))
    clean = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")) for c in features}
    moments = rows.agg(
        F.count_if(F.col(source) == source_a).alias("n"), F.count_if(F.col(source) == source_b).alias("m"),
        *[F.avg(clean[c]).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(clean[c]).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    n, m = int(moments["n"]), int(moments["m"])
    if n < 2 or m < 2:
        raise ValueError("both sources need at least two rows")
    total = n + m
    places, widths, waves = [], [], []
    for own in views.values():
        places.append([features.index(c) for c in own])
        moving = sum(1 for i in places[-1] if moments[f"s{i}"])
        widths.append(bandwidth or math.sqrt(2.0 * max(moving, 1) * total / (total - 1)))
        waves.append(fourier_frequencies(len(own), components, widths[-1], seed))
    z = [
        F.coalesce((clean[c] - F.lit(moments[f"m{i}"])) / F.lit(moments[f"s{i}"] or 1.0), F.lit(0.0))
        for i, c in enumerate(features)
    ]
    number = F.conv(F.substring(draw(seed + 1, *key), 1, 15), 16, 10).cast("long")
    names = [f"z{i}" for i in range(len(z))]
    table = rows.select(
        (F.col(source) == source_a).alias("is_a"), (number if permutations else F.lit(0).cast("long")).alias("draw"),
        *[value.alias(name) for name, value in zip(names, z)],
    )
    if permutations:
        table = materialise(table)
    cuts = permutation_cuts(table, n, permutations, seed) if permutations else np.zeros(0, np.uint64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(waves), permutations + 1, 4, components))
        counts = np.zeros((permutations + 1, 2), np.int64)
        for pdf in batches:
            values, draws, is_a = pdf[names].to_numpy(), pdf["draw"].to_numpy(np.uint64), pdf["is_a"].to_numpy(bool)
            for part in _pieces(len(pdf), components // 2):
                drawn = _mixed(draws[part], permutations, seed) <= cuts
                labels = np.concatenate([is_a[part, None], drawn], axis=1).astype(float)
                for view, (place, own) in enumerate(zip(places, waves)):
                    waved = cosines_and_sines(values[part][:, place] @ own.T)
                    both = waved.sum(axis=0)
                    mine = labels.T @ waved
                    held[view, :, :2] += mine.reshape(-1, 2, components)
                    held[view, :, 2:] += (both - mine).reshape(-1, 2, components)
                counts[:, 0] += labels.sum(axis=0).astype(np.int64)
                counts[:, 1] += len(labels)
        cells = permutations + 1
        for view, own in enumerate(held):
            yield pd.DataFrame(
                {
                    "view": np.int32(view),
                    "perm": np.repeat(np.arange(cells, dtype="int32"), components),
                    "k": np.tile(np.arange(components, dtype="int32"), cells),
                    **{name: own[:, i].ravel() for i, name in enumerate(("ca", "sa", "cb", "sb"))},
                    "a": np.repeat(counts[:, 0], components),
                    "all": np.repeat(counts[:, 1], components),
                }
            )

    summed = (
        table.mapInPandas(sums, "view int, perm int, k int, ca double, sa double, cb double, sb double, a long, all long")
        .groupBy("view", "perm", "k")
        .agg(*[F.sum(c).alias(c) for c in ("ca", "sa", "cb", "sb", "a", "all")])
        .withColumn("b", F.col("all") - F.col("a"))
    )
    square = lambda c, s: F.col(c) * F.col(c) + F.col(s) * F.col(s)
    value = (
        (square("ca", "sa") - F.col("a")) / (F.col("a") * (F.col("a") - 1.0))
        + (square("cb", "sb") - F.col("b")) / (F.col("b") * (F.col("b") - 1.0))
        - 2 * (F.col("ca") * F.col("cb") + F.col("sa") * F.col("sb")) / (F.col("a").cast("double") * F.col("b"))
    )
    stats = summed.groupBy("view", "perm").agg(F.avg(value).alias("v"))
    observed = F.max(F.when(F.col("perm") == 0, F.col("v")))
    others = F.when(F.col("perm") > 0, F.col("v"))
    wide = stats.groupBy("view").agg(
        observed.alias("mmd_sq"),
        F.collect_list(others).alias("_null"),
        F.avg(others).alias("permutation_mean"),
        F.stddev_pop(others).alias("permutation_std"),
    )
    at_least = F.size(F.filter("_null", lambda v: v >= F.col("mmd_sq")))
    return wide.select(
        F.get(F.array(*map(F.lit, views)), F.col("view")).alias("name"),
        "mmd_sq",
        ((at_least + 1) / F.lit(permutations + 1.0)).alias("p_value"),
        F.get(F.array(*map(F.lit, widths)), F.col("view")).alias("bandwidth"),
        F.lit(n).cast("long").alias("n_source"),
        F.lit(m).cast("long").alias("n_target"),
        F.lit(permutations).alias("n_permutations"),
        "permutation_mean",
        "permutation_std",
    )


def accuracy_drop(table: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Change of classifier accuracy and MMD between related views.

    ``table``: name, accuracy_mean, mmd_sq; one row per view.
    """
    spark = table.sparkSession
    wanted = spark.createDataFrame(list(pairs), "before string, after string")
    for side in ("before", "after"):
        named = table.select(
            F.col("name").alias(side),
            F.col("accuracy_mean").alias(f"source_accuracy_{side}"),
            F.col("mmd_sq").alias(f"mmd_{side}"),
        )
        wanted = wanted.join(named, side)
    return wanted.withColumns(
        {
            "source_accuracy_drop": F.col("source_accuracy_before") - F.col("source_accuracy_after"),
            "mmd_drop": F.col("mmd_before") - F.col("mmd_after"),
        }
    )


def measure_changes(table: DataFrame, pairs: Sequence[tuple[str, str]], measures: Sequence[str]) -> DataFrame:
    """Each measure before and after, and its drop, for related views. ``table``: name and measures, a row per view."""
    out = table.sparkSession.createDataFrame(list(pairs), "before string, after string")
    for side in ("before", "after"):
        named = table.select(F.col("name").alias(side), *[F.col(m).alias(f"{m}_{side}") for m in measures])
        out = out.join(named, side)
    drops = {f"{m}_drop": F.col(f"{m}_before") - F.col(f"{m}_after") for m in measures}
    return out.withColumns(drops)


ABLATION_PAIRS = (
    ("raw_tracking_common", "player_tracking_strict"),
    ("player_tracking", "player_tracking_core"),
    ("player_tracking", "player_tracking_strict"),
    ("player_tracking_strict", "player_tracking_strict_oriented"),
    ("team_shape", "team_shape_core"),
    ("team_shape", "team_shape_strict"),
    ("team_shape_strict", "team_shape_strict_oriented"),
    ("event_spadl", "event_spadl_comparable"),
)
