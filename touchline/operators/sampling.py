"""Deterministic samples, group splits and training regimes.

A row's place in a sample is decided by the md5 of seed and key, so a sample does not
depend on partitioning and any SQL engine can reproduce it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline import constants as K
from touchline.operators.series import row_positions
from touchline.session import joinable


def draw(seed: int | Column, *keys: str) -> Column:
    """Reproducible pseudo-random text of a row."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first, *[F.col(k).cast("string") for k in keys]))


def nested_ranks(
    df: DataFrame, groups: Sequence[str], most: int, key: Sequence[str], *, seed: int | Column = K.SEED, name: str = "rank"
) -> DataFrame:
    """The ``most`` rows of smallest draw of each group with their rank from 1.

    Samples of any size up to ``most`` are then filters on the rank, each inside the next. Ranks
    are counted per digit of the draw and shifted by a histogram, so no group is sorted as a whole.
    """
    staged, digits = _up_to_digit(df, groups, most, key, seed)
    place = F.row_number().over(Window.partitionBy(*groups, "_digit").orderBy("_draw", *key))
    ranked = staged.join(digits, [*groups, "_digit"]).withColumn(name, (F.col("_before") + place).cast("long"))
    return ranked.filter(F.col(name) <= most).select(*df.columns, name)


def _up_to_digit(
    df: DataFrame, groups: Sequence[str], most: int, key: Sequence[str], seed: int | Column
) -> tuple[DataFrame, DataFrame]:
    """Rows with their draw and first digits, and the digits of each group that hold its ``most`` first rows.

    The digits are written, so that few of them are broadcast and only the rows that they keep are moved.
    """
    staged = df.withColumn("_draw", draw(seed, *key)).withColumn(
        "_digit", F.conv(F.substring("_draw", 1, 4), 16, 10).cast("int")
    )
    before = Window.partitionBy(*groups).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = (
        staged.groupBy(*groups, "_digit").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_before") < most).drop("_n")
    )
    return staged, joinable(digits)


def sample_per_group(
    df: DataFrame,
    groups: Sequence[str],
    n: int | None,
    key: Sequence[str],
    *,
    seed: int = K.SEED,
) -> DataFrame:
    """Exactly the ``n`` rows of smallest draw per group (all rows when there are fewer).

    A histogram over the first four hex digits gives the digit at which each group
    reaches ``n``. Rows up to that digit are ranked per digit, so no group is sorted as a whole
    or moved into one task. Null is a group as any other.
    """
    if n is None:
        return df
    staged, digits = _up_to_digit(df, groups, n, key, seed)
    names = [*groups, "_digit"]
    wanted = digits.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(names)], "_before")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & staged[c].eqNullSafe(wanted[f"_of{i}"])
    place = F.row_number().over(Window.partitionBy(*names).orderBy("_draw", *key))
    kept = staged.join(wanted, same).withColumn("_place", F.col("_before") + place)
    return kept.filter(F.col("_place") <= n).select(*df.columns)


def balanced_sample(
    df: DataFrame,
    *,
    source: str = "source",
    per_source: int | None,
    key: Sequence[str],
    seed: int = K.SEED,
) -> DataFrame:
    return sample_per_group(df, [source], per_source, key, seed=seed)


def reservoir_sample(df: DataFrame, n: int, key: Sequence[str], *, seed: int = K.SEED) -> DataFrame:
    """Uniform sample of ``n`` rows of the whole table."""
    marked = df.withColumn("_all", F.lit(1))
    return sample_per_group(marked, ["_all"], n, key, seed=seed).drop("_all")


def sample_frames(
    df: DataFrame,
    n: int | None,
    *,
    match: str = "match_id",
    frame: str = "frame_id",
    seed: int = K.SEED,
) -> DataFrame:
    """Keep the rows of ``n`` sampled frames per match."""
    if n is None:
        return df
    frames = sample_per_group(
        df.select(match, frame).distinct(), [match], n, [match, frame], seed=seed
    )
    return df.join(frames, [match, frame], "left_semi")


def ranked_groups(df: DataFrame, strata: Sequence[str], group: str, seed: int) -> DataFrame:
    """Distinct groups with their shuffled rank (0-based) and the number of groups."""
    groups = df.select(*strata, group).distinct().withColumn("_draw", draw(seed, group))
    by = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(1))
    return groups.select(
        *strata,
        group,
        (F.row_number().over(by.orderBy("_draw", group)) - 1).alias("group_rank"),
        F.count(F.lit(1)).over(by).alias("n_groups"),
    )


def group_shuffle_split(
    df: DataFrame,
    *,
    group: str = "match_id",
    strata: Sequence[str] = (),
    test_size: float = 0.30,
    seed: int = K.SEED,
) -> DataFrame:
    """Add ``is_test``: whole groups go to the test side, ceil(test_size * groups) of them."""
    ranks = ranked_groups(df, strata, group, seed)
    test = ranks.select(
        *strata, group, (F.col("group_rank") < F.ceil(F.col("n_groups") * test_size)).alias("is_test")
    )
    return df.join(joinable(test), [*strata, group])


def group_folds(
    df: DataFrame,
    *,
    group: str = "match_id",
    strata: Sequence[str] = ("source",),
    folds: int = 5,
    allow_fewer: bool = True,
    seed: int = K.SEED,
) -> DataFrame:
    """Add ``fold``: per stratum the shuffled groups are dealt into equal folds.

    Every fold needs a group of each stratum: with ``allow_fewer`` there are only as many
    folds as the smallest stratum has groups, else that is an error, as a single fold is.
    """
    ranks = ranked_groups(df, strata, group, seed)
    smallest = ranks.agg(F.min("n_groups").alias("m")).first()["m"] or 0
    k = min(folds, smallest)
    if k < 2 or (k < folds and not allow_fewer):
        raise ValueError(f"{folds} folds need as many groups in each stratum; the smallest has {smallest}")
    dealt = ranks.select(*strata, group, F.pmod("group_rank", F.lit(k)).alias("fold"))
    return df.join(joinable(dealt), [*strata, group])


def leave_one_group_out(df: DataFrame, *, group: str = "match_id") -> DataFrame:
    """One fold per group, as (fold_id, group) pairs marking the held-out group."""
    return df.select(group).distinct().select(
        F.concat(F.lit("lomo:"), F.col(group)).alias("fold_id"), group
    )


def regime_quota(regime: str, n: int) -> dict[str, int]:
    """Rows to draw from the target pool and the other pool."""
    quotas = {
        "target_only": {"target": n, "other": 0},
        "other_only": {"target": 0, "other": n},
        "merged_same_n": {"target": n // 2, "other": n - n // 2},
        "target_plus_other_2n": {"target": n, "other": n},
    }
    if regime not in quotas:
        raise ValueError(f"unknown regime {regime}")
    return quotas[regime]


def sample_target_regime(
    target_pool: DataFrame,
    other_pool: DataFrame,
    regime: str,
    n: int,
    *,
    key: Sequence[str],
    seed: int = K.SEED,
    pool_sizes: tuple[int, int] | None = None,
) -> DataFrame | None:
    """Training rows of one regime, or None when a pool is too small."""
    quota = regime_quota(regime, n)
    sizes = pool_sizes or (target_pool.count(), other_pool.count())
    if sizes[0] < quota["target"] or sizes[1] < quota["other"]:
        return None
    parts = []
    for pool, take, shift in (
        (target_pool, quota["target"], 0),
        (other_pool, quota["other"], 100 if quota["target"] else 0),
    ):
        if take:
            parts.append(reservoir_sample(pool, take, key, seed=seed + shift))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_source_regime(
    df: DataFrame,
    regime: str,
    n: int,
    *,
    key: Sequence[str],
    seed: int = K.SEED,
    source: str = "source",
) -> DataFrame | None:
    """Training rows of a single source, or of all sources for ``merged``."""
    pool = df if regime == "merged" else df.filter(F.lower(source) == regime.lower())
    if pool.count() < n:
        return None
    return reservoir_sample(pool, n, key, seed=seed)
