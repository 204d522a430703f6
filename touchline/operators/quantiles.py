"""Exact quantiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.session import materialise


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    *,
    margin: float = 0.01,
    accuracy: int = 2000,
    whole_below: int = 400,
) -> DataFrame:
    """Linear-interpolated quantiles per group: ``wanted`` maps name -> (column, probability).

    A first aggregate brackets each wanted rank by approximate quantiles whose error is at
    most 1/accuracy of the rows, a twentieth of the margin. A second one counts the rows below
    each bracket, and only values inside brackets, about twice the margin of a group's rows,
    are counted, sorted and searched for the rank. Groups of fewer than ``whole_below`` rows
    are their own bracket. The result does not depend on these parameters. The brackets are
    written once: approximate quantiles vary with the order in which partial results arrive, and rows
    below and inside have to be told by the same ones. Groups whose
    columns are all null do not appear in the result.
    """
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    value = {column: f"_v{i}" for i, column in enumerate(columns)}
    keys = [f"_g{i}" for i in range(len(groups))] or ["_g"]
    rows = df.select(
        *([F.col(g).alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias("_g")]),
        *[F.col(c).cast("double").alias(v) for c, v in value.items()],
    )
    marks = list(dict.fromkeys(wanted.values()))
    low = [max(p - margin, 0.0) for _, p in marks]
    high = [min(p + margin, 1.0) for _, p in marks]
    brackets = rows.groupBy(*keys).agg(
        *[F.count(v).alias(f"n{v}") for v in value.values()],
        *[
            F.percentile_approx(value[column], [low[k], high[k]], accuracy).alias(f"b{k}")
            for k, (column, _) in enumerate(marks)
        ],
    )
    joined = rows.join(materialise(brackets), keys)

    def edge(k: int, side: int) -> Column:
        whole = F.col(f"n{value[marks[k][0]]}") < whole_below
        open_end = (low[k] <= 0.0) if side == 0 else (high[k] >= 1.0)
        return F.when(whole | F.lit(open_end), None).otherwise(F.get(f"b{k}", F.lit(side)))

    def below(k: int) -> Column:
        return F.coalesce(F.col(value[marks[k][0]]) < edge(k, 0), F.lit(False))

    def inside(k: int) -> Column:
        v = F.col(value[marks[k][0]])
        over = F.coalesce(v > edge(k, 1), F.lit(False))
        return v.isNotNull() & ~below(k) & ~over

    counted = joined.groupBy(*keys).agg(
        *[F.count_if(below(k)).alias(f"u{k}") for k in range(len(marks))],
        *[F.max(f"n{v}").alias(f"n{v}") for v in value.values()],
    )
    entries = F.array(
        *[
            F.when(inside(k), F.struct(F.lit(k).alias("k"), F.col(value[column]).alias("v")))
            for k, (column, _) in enumerate(marks)
        ]
    )
    near = (
        joined.select(*keys, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        .groupBy(*keys, "e.k", "e.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = Window.partitionBy(*keys, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("upto", F.sum("n").over(running)).join(counted, keys)

    def height(k: int) -> Column:
        return F.lit(float(marks[k][1])) * (F.col(f"n{value[marks[k][0]]}") - 1)

    def at_rank(k: int, rank: Column) -> Column:
        upto = F.col("upto") + F.col(f"u{k}")
        hit = (F.col("k") == k) & (rank >= upto - F.col("n")) & (rank < upto)
        return F.max(F.when(hit, F.col("v")))

    found = placed.groupBy(*keys).agg(
        *[at_rank(k, F.floor(height(k))).alias(f"l{k}") for k in range(len(marks))],
        *[at_rank(k, F.ceil(height(k))).alias(f"h{k}") for k in range(len(marks))],
        *[F.max(height(k) - F.floor(height(k))).alias(f"t{k}") for k in range(len(marks))],
    )
    number = {mark: k for k, mark in enumerate(marks)}
    return found.select(
        *[F.col(k).alias(g) for g, k in zip(groups, keys)],
        *[
            (F.col(f"l{k}") + F.col(f"t{k}") * (F.col(f"h{k}") - F.col(f"l{k}"))).alias(name)
            for name, mark in wanted.items()
            for k in [number[mark]]
        ],
    )


def aggregate_with_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    aggregates: Mapping[str, object],
    wanted: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """Plain aggregates and exact quantiles side by side, one row per group."""
    plain = df.groupBy(*groups).agg(*[expr.alias(name) for name, expr in aggregates.items()])
    if not wanted:
        return plain
    quantiles = exact_quantiles(df, groups, wanted)
    return plain.join(quantiles, list(groups), "left")
