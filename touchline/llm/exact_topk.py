"""Exact top-k inner products by norm buckets.

Vectors are grouped by length (norm), buckets of near lengths are cut into blocks of bounded size,
and the longest blocks are searched first. What they find bounds each query's k-th score from
below; divided by the query's length and a bucket's greatest length it is the least cosine that
a candidate of that bucket needs. Above 1 the whole bucket is out; a high one prunes
candidates by their range on the query's largest coordinates, a low one by their length.
The products of what is left are computed in full.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialise

BLOCK_ROWS = 8192
QUERY_ROWS = 4096
RATIO = 1.1
#: Local cosine threshold from which the coordinates prune, below it the lengths do.
COORDINATE_FROM = 0.5
COORDINATES = 2
_EXACT = float(2**53)
_LONG = (-(2**63), 2**63 - 1)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as doubles; null for vectors that take no part."""
    usable = ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    return F.when(
        F.coalesce(vector.isNotNull() & usable, F.lit(False)),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")),
    )


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products; doubles while every partial sum is an exact integer, else Python integers."""
    bound = np.sqrt((queries**2).sum(axis=1).max(initial=0)) * np.sqrt((vectors**2).sum(axis=1).max(initial=0))
    if bound < _EXACT:
        return queries @ vectors.T
    exact = [[int(x) for x in row] for row in vectors]
    out = np.empty((len(queries), len(vectors)), object)
    for i, query in enumerate(queries):
        whole = [int(x) for x in query]
        for j, row in enumerate(exact):
            out[i, j] = min(max(sum(a * b for a, b in zip(whole, row)), _LONG[0]), _LONG[1])
    return out


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """The k best (query id, vector id, score) of each query in one block, none below ``least``.

    Vectors come in ascending id, so that ties keep the smaller ids.
    """
    lengths = np.sqrt((vectors**2).sum(axis=1))
    query_lengths = np.sqrt((queries**2).sum(axis=1))
    longest = lengths.max(initial=0)
    found: list[tuple[int, int, int]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(query_lengths * longest > 0, least / (query_lengths * longest), np.where(least > 0, np.inf, -np.inf))
    local = np.where(np.isnan(local), -np.inf, local)
    slack = 1e-9
    for begin in range(0, len(queries), 256):
        part = np.arange(begin, min(begin + 256, len(queries)))
        part = part[local[part] <= 1 + slack]
        if not len(part):
            continue
        mask = _candidates(queries[part], query_lengths[part], local[part], least[part], vectors, lengths, slack)
        columns = np.flatnonzero(mask.any(axis=0))
        if not len(columns):
            continue
        scores = _products(queries[part], vectors[columns])
        for row, query in enumerate(part):
            line = scores[row]
            use = (line >= least[query]) & (ids[columns] != query_ids[query])
            open_at = np.flatnonzero(use)
            if len(open_at) > k:
                values = line[open_at]
                if line.dtype != object:
                    bar = np.partition(values, len(values) - k)[len(values) - k]
                    open_at = open_at[values >= bar]
                order = np.argsort(-line[open_at], kind="stable")[:k]
                open_at = open_at[order]
            found.extend((int(query_ids[query]), int(ids[columns[at]]), int(line[at])) for at in open_at)
    return found


def _candidates(queries, query_lengths, local, least, vectors, lengths, slack) -> np.ndarray:
    """Which (query, vector) pairs can reach the query's least score; by coordinates or lengths."""
    by_length = lengths[None, :] * query_lengths[:, None] * (1 + slack) >= least[:, None]
    steep = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1))
    if len(steep):
        with np.errstate(divide="ignore", invalid="ignore"):
            units = np.where(lengths[:, None] > 0, vectors / lengths[:, None], 0)
            unit_queries = queries[steep] / query_lengths[steep, None]
        focus = np.argsort(-np.abs(unit_queries), axis=1)[:, :COORDINATES]
        for row, at in enumerate(steep):
            for coordinate in focus[row]:
                q = unit_queries[row, coordinate]
                reach = math.sqrt(max(0.0, (1 - local[at] ** 2) * (1 - q * q)))
                x = units[:, coordinate]
                low = -1 if -q >= local[at] else q * local[at] - reach
                high = 1 if q >= local[at] else q * local[at] + reach
                by_length[at] &= (x >= low - slack) & (x <= high + slack)
    return by_length


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every query, or all if fewer.

    Components become floor(scale * x); scores are inner products of these integers (limited
    to the range of long). Ties go to the smaller vec_id. A query's own id is no candidate.
    Vectors that are null, hold a null or non-finite component, or have no id take no part;
    vectors are compared with queries of the same number of components only. Rows
    repeated with equal id and vector count once. Of an id with several vectors, each is a
    candidate, and as a query each competes for the same k ranks. Empty tables give an empty
    result; other columns are ignored, whatever their names.
    """

    def prepared(df: DataFrame) -> DataFrame:
        return (
            df.select(F.col(vec_id).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
            .distinct()
            .withColumn("length", _norm(F.col("v")))
            .withColumn("size", F.size("v"))
        )

    bucket = F.when(F.col("length") > 0, F.floor(F.log(F.col("length")) / math.log(RATIO)).cast("int")).otherwise(-1)
    candidates = materialise(prepared(vectors).withColumn("bucket", bucket))
    stats = candidates.groupBy("size", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.max("length").alias("longest")
    ).withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    # One row per vector size and power of 1.1: some thousands at most, whatever the input.
    known = stats.orderBy("size", F.desc("bucket")).collect()
    first: dict[int, int] = {}
    for row in known:
        first.setdefault(row["size"], row["bucket"])
    asked = materialise(prepared(queries))
    query_groups = max(1, math.ceil(asked.count() / query_rows))
    asked = asked.withColumn("query_group", F.pmod(F.xxhash64("id"), F.lit(query_groups)).cast("int"))
    spark = vectors.sparkSession
    plan = spark.createDataFrame(
        [(r["size"], r["bucket"], r["blocks"], r["longest"], first[r["size"]] == r["bucket"]) for r in known],
        "size int, bucket int, blocks int, longest double, top boolean",
    )
    groups = F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1)))
    blocked = candidates.join(F.broadcast(plan), ["size", "bucket"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )

    def searched(seed: bool, bounded: DataFrame) -> DataFrame:
        """Queries meet the first block of the longest vectors, or all others that they can use."""
        chosen = (F.col("top") & (F.col("block") == 0)) == seed
        reach = F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("least")
        left = (
            bounded.join(F.broadcast(plan), "size")
            .filter(reach)
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .filter(chosen)
            .select("size", "bucket", "block", "query_group", "id", "v", "least")
        )
        right = (
            blocked.filter(chosen)
            .withColumn("query_group", groups)
            .select("size", "bucket", "block", "query_group", "id", "v")
        )
        keys = ("size", "bucket", "block", "query_group")

        def run(asked_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if asked_rows.empty or rows.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            rows = rows.sort_values("id")
            found = search_block(
                np.stack(asked_rows["v"].to_numpy()).astype(float), asked_rows["id"].to_numpy(),
                asked_rows["least"].to_numpy(float), np.stack(rows["v"].to_numpy()).astype(float),
                rows["id"].to_numpy(), k,
            )
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            run, "query_id long, vec_id long, score long"
        )

    nothing = F.lit(float("-inf"))
    seeds = materialise(searched(True, asked.withColumn("least", nothing)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct_seeds = seeds.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    least = distinct_seeds.filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").cast("double").alias("least")
    )
    bounded = asked.join(least, "id", "left").withColumn("least", F.coalesce("least", nothing))
    rest = searched(False, bounded)
    return (
        seeds.union(rest)
        .distinct()
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
