"""Prediction metrics, measurement summaries and paired statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from touchline.operators.quantiles import exact_quantiles


def classification_metrics(
    preds: DataFrame, cells: Sequence[str], *, truth: str = "y_true", guess: str = "y_pred", rows: str | None = None
) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 per cell, from confusion counts.

    Balanced accuracy averages recall over the true classes; macro F1 averages over true
    and predicted classes, with 0 for an undefined F1. ``rows`` names the number of rows that a row stands for.
    """
    confusion = preds.groupBy(*cells, truth, guess).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n"))
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hits")),
        F.struct(F.col(guess).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits")),
    )
    per_class = (
        confusion.select(*cells, F.explode(sides).alias("s"))
        .groupBy(*cells, "s.label")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "guessed", "hits")])
    )
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("guessed"))
    return per_class.groupBy(*cells).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.sum("support").alias("n_test"),
    )


def positive_rates(
    preds: DataFrame, cells: Sequence[str], *, truth: str = "y_true", guess: str = "y_pred"
) -> DataFrame:
    """Mean of numeric labels and of guesses per cell; null unless a cell has two true labels."""
    binary = F.count_distinct(truth) == 2
    return preds.groupBy(*cells).agg(
        F.when(binary, F.avg(truth)).alias("positive_rate_true"),
        F.when(binary, F.avg(guess)).alias("positive_rate_pred"),
    )


def regression_metrics(
    preds: DataFrame, cells: Sequence[str], *, truth: str = "y", guess: str = "yhat"
) -> DataFrame:
    error = F.col(truth) - F.col(guess)
    total = F.var_pop(truth)
    return preds.groupBy(*cells).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(total > 0, 1 - F.avg(error * error) / total).alias("r2"),
        F.avg(truth).alias("target_mean"),
        F.stddev_pop(truth).alias("target_std"),
        F.count(F.lit(1)).alias("n_test"),
    )


def ci95(column: str) -> Column:
    """Half width of the normal 95% interval of a mean; 0 for fewer than two values."""
    n = F.count(column)
    return F.when(n > 1, 1.96 * F.stddev_samp(column) / F.sqrt(n)).otherwise(F.lit(0.0))


def summarise(measurements: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, standard deviation, interval and number of runs per group."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), ci95(m).alias(f"{m}_ci95")]
    return measurements.groupBy(*groups).agg(*out, F.count(metrics[0]).alias("n_runs"))


def paired_deltas(
    measurements: DataFrame,
    pair_keys: Sequence[str],
    metrics: Sequence[str],
    *,
    baseline: str = "target_only",
    compare: Sequence[str] = ("merged_same_n", "target_plus_other_2n", "other_only"),
    regime: str = "regime",
    lower_is_better: Sequence[str] = (),
) -> DataFrame:
    """Difference to the baseline regime on equal keys; positive means the other is better."""
    base = measurements.filter(F.col(regime) == baseline).select(
        *pair_keys, *[F.col(m).alias(f"_base_{m}") for m in metrics]
    )
    other = measurements.filter(F.col(regime).isin(*compare))
    deltas = [
        (
            F.col(f"_base_{m}") - F.col(m) if m in lower_is_better else F.col(m) - F.col(f"_base_{m}")
        ).alias(f"delta_{m}")
        for m in metrics
    ]
    return other.join(base, list(pair_keys)).select(
        *pair_keys, F.col(regime).alias("compare_regime"), *deltas
    )


def merged_deltas(
    measurements: DataFrame,
    pair_keys: Sequence[str],
    metrics: Sequence[str],
    sources: Sequence[str],
    *,
    merged: str = "merged",
    regime: str = "regime",
    lower_is_better: Sequence[str] = (),
) -> DataFrame:
    """Gain of training on both sources over each source alone, at equal keys.

    Here the merged regime is what is compared, each single source a baseline: merged minus single,
    or single minus merged where lower is better, so that positive always means merging helped. Keys that
    lack either side have no row; a metric that is null on either side has a null delta.
    """
    both = measurements.filter(F.col(regime) == merged).select(*pair_keys, *[F.col(m).alias(f"_merged_{m}") for m in metrics])
    single = measurements.filter(F.col(regime).isin(*sources))
    gain = {m: F.col(f"_merged_{m}") - F.col(m) for m in metrics}
    return single.join(both, list(pair_keys)).select(
        *pair_keys, F.col(regime).alias("source_regime"),
        *[(-delta if m in lower_is_better else delta).alias(f"delta_{m}") for m, delta in gain.items()],
    )


def merged_summary(
    measurements: DataFrame, pair_keys: Sequence[str], groups: Sequence[str], metrics: Sequence[str], sources: Sequence[str], **settings
) -> DataFrame:
    """Mean, standard deviation and interval of ``merged_deltas`` per group and source, with the number of pairs."""
    deltas = merged_deltas(measurements, pair_keys, metrics, sources, **settings)
    out = []
    for m in metrics:
        name = f"delta_{m}"
        out += [F.avg(name).alias(f"{name}_mean"), F.stddev_samp(name).alias(f"{name}_std"), ci95(name).alias(f"{name}_ci95")]
    return deltas.groupBy(*groups, "source_regime").agg(*out, F.count(F.lit(1)).alias("n_pairs"))


def _resample_index(size: Column, *parts: Column) -> Column:
    text = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), size)


def bootstrap_ci(
    df: DataFrame,
    groups: Sequence[str],
    column: str,
    *,
    resamples: int = 5_000,
    alpha: float = 0.05,
    seed: int = 0,
    method: str = "percentile",
) -> DataFrame:
    """Bootstrap interval of the mean per group; null for fewer than two values.

    ``method`` is "percentile", or "bca" for levels that are corrected for bias and acceleration; the
    latter has no interval where all values, and so all replicates, are equal. Every draw is a row: replicate b takes, for each j below n, the value at a position
    given by the md5 of (seed, b, j). Replicate means then come from one aggregation.
    """
    if method not in ("percentile", "bca"):
        raise ValueError(f"unknown method {method}")
    values = df.filter(F.col(column).isNotNull())
    w = Window.partitionBy(*groups)
    placed = values.select(
        *groups,
        F.col(column).alias("_v"),
        (F.row_number().over(w.orderBy(column)) - 1).cast("long").alias("_j"),
        F.count(F.lit(1)).over(w).alias("_n"),
    ).filter(F.col("_n") > 1)
    draws = placed.select(
        *groups, "_n", "_j", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b")
    ).select(
        *groups, "_b", _resample_index(F.col("_n"), F.lit(seed), F.col("_b"), F.col("_j")).alias("_j")
    )
    means = (
        draws.join(placed.select(*groups, "_j", "_v"), [*groups, "_j"])
        .groupBy(*groups, "_b")
        .agg(F.avg("_v").alias("_mean"))
    )
    if method == "bca":
        return _bca(values, means, groups, column, resamples, alpha)
    return exact_quantiles(
        means, groups, {"ci_low": ("_mean", alpha / 2), "ci_high": ("_mean", 1 - alpha / 2)}
    )


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def _bca_levels(share: pd.Series, skewness: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Levels of the interval's ends, from the share of replicates below the mean and the skewness.

    The acceleration is that of the jackknife, which for a mean is skewness / (6 sqrt n).
    """
    normal = NormalDist()
    out = []
    for below, skew, size, level in zip(share, skewness, n, alpha):
        if not 0 < below < 1 or not math.isfinite(skew):
            out.append((None, None))
            continue
        bias, speed = normal.inv_cdf(below), skew / (6 * math.sqrt(size))
        ends = [bias + normal.inv_cdf(q) for q in (level / 2, 1 - level / 2)]
        out.append(tuple(normal.cdf(bias + end / (1 - speed * end)) for end in ends))
    return pd.DataFrame(out, columns=["low", "high"], dtype=float)


def _bca(values: DataFrame, means: DataFrame, groups: Sequence[str], column: str, resamples: int, alpha: float) -> DataFrame:
    """Quantiles of the replicate means at each group's own levels; a group has ``resamples`` of them."""
    per_group = Window.partitionBy(*groups)
    observed = values.groupBy(*groups).agg(
        F.avg(column).alias("_at"), F.skewness(column).alias("_skew"), F.count(F.lit(1)).alias("_n")
    )
    same = [F.col(f"m.{g}").eqNullSafe(F.col(f"o.{g}")) for g in groups]
    both = means.alias("m").join(observed.alias("o"), same or F.lit(True)).select("m.*", "_at", "_skew", "_n")
    # Replicates of equal draws differ from the mean by rounding only; they count half.
    close = F.abs(F.col("_mean") - F.col("_at")) <= 1e-12 * F.greatest(F.abs("_at"), F.lit(1e-300))
    below = F.when(close, 0.5).when(F.col("_mean") < F.col("_at"), 1.0).otherwise(0.0)
    ranked = both.withColumns(
        {"_share": F.avg(below).over(per_group), "_rank": F.row_number().over(per_group.orderBy("_mean")) - 1}
    )
    levels = _bca_levels("_share", "_skew", F.col("_n").cast("double"), F.lit(float(alpha)))
    shares = ranked.groupBy(*groups).agg(F.max("_share").alias("_share"), F.max("_skew").alias("_skew"), F.max("_n").alias("_n"))
    placed = shares.select(*groups, levels.alias("_levels"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"p.{g}")) for g in groups]
    joined = ranked.alias("r").join(placed.alias("p"), same or F.lit(True)).select("r.*", "p._levels")

    def quantile(level: str) -> Column:
        place = F.col(f"_levels.{level}") * (resamples - 1)
        low = F.floor(place)
        weight = F.when(F.col("_rank") == low, 1 - (place - low)).when(F.col("_rank") == low + 1, place - low)
        return F.sum(weight * F.col("_mean"))

    return joined.groupBy(*groups).agg(quantile("low").alias("ci_low"), quantile("high").alias("ci_high"))


@F.pandas_udf(DoubleType())
def _exact_signed_rank_p(w_plus: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of the signed-rank statistic without ties."""
    out = []
    for w, size in zip(w_plus, n):
        ways = np.ones(1)
        for rank in range(1, int(size) + 1):
            grown = np.zeros(len(ways) + rank)
            grown[: len(ways)] += ways
            grown[rank:] += ways
            ways = grown / 2.0
        below = ways[: int(w) + 1].sum()
        above = ways[int(w):].sum()
        out.append(min(1.0, 2.0 * min(below, above)))
    return pd.Series(out, dtype=float)


#: Coefficients of the Chebyshev fit of erfc (relative error below 1.2e-7 everywhere), highest power first.
ERFC_FIT = (
    0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368,
    -1.26551223,
)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail, erfc(|z| / sqrt 2); its relative error is bounded far into the tail."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    power = F.lit(ERFC_FIT[0])
    for coefficient in ERFC_FIT[1:]:
        power = power * t + coefficient
    return t * F.exp(power - x * x)


def wilcoxon(df: DataFrame, groups: Sequence[str], column: str, *, method: str = "exact") -> DataFrame:
    """Signed-rank test against zero per group: zeros dropped, ties share their mean rank.

    Output: ``w_plus``, ``n``, the tie-corrected normal ``z`` and the p-value, null for fewer
    than two values. ``method`` is "exact" or "normal". The exact distribution exists without
    ties only, so groups with ties get the normal p-value; its cost grows with the cube of a
    group's size, so take "normal" for groups of many thousands.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method}")
    sizes = (
        df.filter(F.col(column) != 0)
        .withColumn("_abs", F.abs(column))
        .groupBy(*groups, "_abs")
        .agg(
            F.count(F.lit(1)).alias("_t"),
            F.count_if(F.col(column) > 0).alias("_pos"),
        )
    )
    before = Window.partitionBy(*groups).orderBy("_abs").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn(
        "_rank", F.coalesce(F.sum("_t").over(before), F.lit(0)) + (F.col("_t") + 1) / 2
    )
    stats = ranked.groupBy(*groups).agg(
        F.sum(F.col("_rank") * F.col("_pos")).alias("w_plus"),
        F.sum("_t").alias("n"),
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"),
    )
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    out = stats.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance))
    p = normal_two_sided(F.col("z"))
    if method == "exact":
        untied = F.col("_ties") == 0
        p = F.when(untied, _exact_signed_rank_p(F.col("w_plus"), F.when(untied, n).otherwise(F.lit(0)))).otherwise(p)
    return out.withColumn("p_value", F.when(n >= 2, p)).drop("_ties")


def paired_summary(
    deltas: DataFrame, groups: Sequence[str], column: str, *, resamples: int = 5_000, method: str = "exact"
) -> DataFrame:
    """Mean, spread, intervals and signed-rank p (see ``wilcoxon``) of paired differences per group."""
    plain = deltas.groupBy(*groups).agg(
        F.avg(column).alias("mean"),
        F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"),
        ci95(column).alias("ci95"),
        F.count(column).alias("n_pairs"),
    )
    ranks = wilcoxon(deltas, groups, column, method=method).select(*groups, "p_value")
    interval = bootstrap_ci(deltas, groups, column, resamples=resamples)
    return plain.join(interval, list(groups), "left").join(ranks, list(groups), "left")


def forest_table(
    summaries: DataFrame, *, compare: str = "merged_same_n", order: Sequence[str] = ("task", "target_source", "train_size")
) -> DataFrame:
    """Rows of one comparison with interval bounds defaulting to the mean, and significance."""
    return (
        summaries.filter(F.col("compare_regime") == compare)
        .withColumns(
            {
                "lo": F.coalesce("ci_low", "mean"),
                "hi": F.coalesce("ci_high", "mean"),
                "significant": F.coalesce(F.col("p_value") < 0.05, F.lit(False)),
            }
        )
        .orderBy(*order)
    )
