"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import WORD, free_name, joinable

ROWS_PER_BUCKET = 2_000
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add weight and target to a table with one row (source, source_size, ...) for each source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the total size.
    No target exceeds ``max_epochs`` times its source; what is cut off goes to the others by
    weight. A source is full exactly if its bound per weight lies below the level that the
    fuller sources leave, so one running sum over the sources in the order of that ratio
    finds the level. The windows hold one row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1)
    bound = max_epochs * F.col("source_size")
    ratio = bound / F.col("weight")
    order = (ratio.asc(), F.col("source").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(before), F.lit(0)))
        / F.sum("weight").over(after),
    ).withColumn("full", ratio <= F.col("level"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), bound.cast("double")).otherwise(F.col("weight") * open_level)
    return levels.withColumn("target", target).drop("level", "full")


def mix(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    size: Column | None = None,
    seed: str = "mix",
    max_epochs: int = MAX_EPOCHS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add size, source_size, target, taken and copies to every row.

    Each row gets the key md5(seed, id). Per source the rows in key order are taken until
    the target is used up to the word (rounded down): whole epochs first, then a cut.
    ``taken`` counts words with repeats, so the last row of a source can be taken in part;
    ``copies`` is the number of times that the row is used at all, ``max_epochs`` at most.

    The key space of each source is cut into ranges of about ``rows_per_bucket`` rows, as many
    as its rows need. Sums per range give each range its offset, so that a source holding
    most of the rows is sorted and summed by many tasks.

    A null id has a key of its own kind, a null source is a source, a null text has no words.
    Rows that tie in id and size are interchangeable: they may swap their results only if
    their ids and sizes are equal. An empty table gives an empty result. Columns of the
    added names are replaced; the default size is the number of words of ``text``.
    """
    size = word_count(F.col("text")) if size is None else size
    added = ("size", "source_size", "target", "taken", "copies")
    inner, draw, bucket, named, total, goal, buckets, ranged, range_, offset, before = (
        free_name(docs, f"mix_{name}")
        for name in ("source", "draw", "bucket", "named", "total", "goal", "buckets", "ranged", "range", "offset", "before")
    )
    df = docs.withColumn("size", size).drop(*(name for name in added if name != "size" and name not in (source, key)))
    df = df.withColumn(inner, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))).withColumn(
        draw, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("-"))).cast("binary"))
    )
    totals = df.groupBy(inner).agg(
        F.first(source).alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    plan = joinable(
        source_targets(totals, max_epochs).select(
            F.col(inner).alias(named),
            F.col("source_size").alias(total),
            F.col("target").alias(goal),
            F.ceil(F.col("source_rows") / rows_per_bucket).alias(buckets),
        )
    )
    planned = df.join(plan, F.col(inner) == F.col(named)).withColumn(
        bucket,
        F.floor(F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") * F.col(buckets) / F.lit(2**32)),
    )
    by_range = Window.partitionBy(ranged).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    ranges = joinable(
        planned.groupBy(F.col(inner).alias(ranged), F.col(bucket).alias(range_))
        .agg(F.sum("size").alias("range_size"))
        .withColumn(offset, F.coalesce(F.sum("range_size").over(by_range), F.lit(0)))
        .drop("range_size")
    )
    in_range = (
        Window.partitionBy(inner, bucket)
        .orderBy(draw, F.col(key).asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = planned.join(
        ranges, (F.col(inner) == F.col(ranged)) & (F.col(bucket) == F.col(range_))
    ).withColumn(before, F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    budget = F.floor(F.col(goal))
    epochs = F.when(F.col(total) > 0, F.floor(budget / F.col(total))).otherwise(0)
    left = budget - epochs * F.col(total) - F.col(offset) - F.col(before)
    part = F.least(F.col("size"), F.greatest(left, F.lit(0)))
    return placed.select(
        *(F.col(f"`{name}`") for name in df.columns if name not in (inner, draw, "size")),
        "size",
        F.col(total).alias("source_size"),
        F.col(goal).alias("target"),
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        F.when(F.col("size") > 0, epochs + F.when(part > 0, 1).otherwise(0)).otherwise(0).cast("int").alias("copies"),
    )
