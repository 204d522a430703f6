"""Ordered-series building blocks that never need a whole series in one task.

A series is the set of rows sharing ``keys``, ordered by ``order``. A plain window over
``keys`` puts one series into one task, which fails when a single key holds a large part
of the table. The helpers below cut every series into chunks of bounded size and are
exact across chunk borders:

* unbounded look-back (running sums, last seen value, row numbers): work inside each
  chunk, plus one small per-chunk summary that is scanned along the series;
* bounded look-around (lag, lead, moving frames): rows close to a border are lent to
  the neighbouring chunk (``lend_borders``) and dropped again afterwards.

``order`` must be a non-null integer column. ``keys`` must be non-null (readers
guarantee both); rows with null keys have no series and are dropped by the joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CHUNK = "_chunk"
HOME = "_home"
POS = "_pos"
DEFAULT_SPAN = 65_536
DEFAULT_ROWS = 65_536


def _chunk_number(order: Column | str, span: int) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(span)).cast("long")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    *,
    group_totals: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    tie: Sequence[str] = (),
    span: int = DEFAULT_SPAN,
    chunk: Column | None = None,
) -> DataFrame:
    """Add exact running sums along each series, and optionally whole-series sums.

    Null inputs count as 0. ``tie`` orders rows of equal ``order``; such rows must fall
    into the same chunk, which holds for the default chunk (a function of ``order``).
    """
    group_totals = dict(group_totals or {})
    staged = df.withColumn(CHUNK, chunk if chunk is not None else _chunk_number(order, span))
    for name, value in {**totals, **group_totals}.items():
        staged = staged.withColumn(f"_in_{name}", F.coalesce(value, F.lit(0)))

    per_chunk = staged.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"_in_{name}").alias(f"_sum_{name}") for name in {**totals, **group_totals}]
    )
    series = Window.partitionBy(*keys).orderBy(CHUNK)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_chunk.select(
        *keys,
        CHUNK,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.sum(f"_sum_{n}").over(whole).alias(n) for n in group_totals],
    )
    local = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(order, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = staged.join(offsets, [*keys, CHUNK])
    out = [F.col(c) for c in df.columns]
    for name in totals:
        value = F.sum(f"_in_{name}").over(local) + F.col(f"_before_{name}")
        if not inclusive:
            value = value - F.col(f"_in_{name}")
        out.append(value.alias(name))
    return joined.select(*out, *group_totals)


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    name: str = POS,
    group_totals: Mapping[str, Column] | None = None,
    tie: Sequence[str] = (),
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Number the rows of each series from 0."""
    out = running_totals(
        df, keys, order, {name: F.lit(1)}, group_totals=group_totals, inclusive=False, tie=tie, span=span
    )
    return out.withColumn(name, F.col(name).cast("long"))


def rank_distinct(
    df: DataFrame, keys: Sequence[str], order: str, *, name: str, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Distinct (keys, order) values with their 0-based rank inside the key."""
    return row_positions(df.select(*keys, order).distinct(), keys, order, name=name, span=span)


def last_seen(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    *,
    inclusive: bool = True,
    tie: Sequence[str] = (),
    group_totals: Mapping[str, Column] | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Add the latest non-null ``value`` at or before (or strictly before) each row."""
    group_totals = dict(group_totals or {})
    staged = df.withColumn(CHUNK, _chunk_number(order, span)).withColumn("_value", value)
    rank = F.struct(order, *tie)
    per_chunk = staged.groupBy(*keys, CHUNK).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), rank)).alias("_chunk_last"),
        *[F.sum(total).alias(f"_sum_{n}") for n, total in group_totals.items()],
    )
    series = Window.partitionBy(*keys).orderBy(CHUNK)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = per_chunk.select(
        *keys,
        CHUNK,
        F.last("_chunk_last", ignorenulls=True).over(before).alias("_carried"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(whole), F.lit(0)).alias(n) for n in group_totals],
    )
    local = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(order, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    return staged.join(carried, [*keys, CHUNK]).select(
        *[F.col(c) for c in df.columns],
        F.coalesce(F.last("_value", ignorenulls=True).over(local), F.col("_carried")).alias(name),
        *group_totals,
    )


@dataclass(frozen=True)
class LentChunks:
    """Rows split into bounded chunks with borrowed borders; see ``lend_borders``."""

    df: DataFrame
    keys: tuple[str, ...]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(POS)

    def chunk(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK)

    def with_df(self, df: DataFrame) -> LentChunks:
        return LentChunks(df, self.keys)

    def close(self, *, keep_pos: bool = False) -> DataFrame:
        """Drop the borrowed rows and the bookkeeping columns."""
        out = self.df.filter(F.col(HOME)).drop(CHUNK, HOME)
        return out if keep_pos else out.drop(POS)


def lend_borders(
    df: DataFrame,
    keys: Sequence[str],
    *,
    before: int = 0,
    after: int = 0,
    rows: int = DEFAULT_ROWS,
) -> LentChunks:
    """Cut positioned series (column ``_pos``) into chunks of ``rows`` rows.

    Every chunk also receives the ``before`` rows ahead of it and the ``after`` rows
    behind it, so window functions reaching that far are exact for its own rows.
    """
    rows = max(rows, before, after, 1)
    own = F.floor(F.col(POS) / F.lit(rows)).cast("long")
    offset = F.pmod(F.col(POS), F.lit(rows))
    homes = [own]
    if before:
        homes.append(F.when(offset >= rows - before, own + 1))
    if after:
        homes.append(F.when((offset < after) & (own > 0), own - 1))
    lent = df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*homes)))).withColumn(
        HOME, F.col(CHUNK) == own
    )
    return LentChunks(lent, tuple(keys))


def open_series(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    before: int = 0,
    after: int = 0,
    group_totals: Mapping[str, Column] | None = None,
    tie: Sequence[str] = (),
    span: int = DEFAULT_SPAN,
    rows: int = DEFAULT_ROWS,
) -> LentChunks:
    """Position the rows of every series and cut it into chunks with borrowed borders."""
    placed = row_positions(df, keys, order, group_totals=group_totals, tie=tie, span=span)
    return lend_borders(placed, keys, before=before, after=after, rows=rows)
