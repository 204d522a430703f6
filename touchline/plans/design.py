"""Designs of experiment grids: which rows train and test each cell, decided before any fit.

All pools of a grid are ranked together, in one histogram and one ranking pass: a row's rank in a pool
is its place in the order of its draw. A training set of n rows is the rows of rank up to n, so
larger sets contain the smaller ones and no cell samples again. Pool sizes come from
one count of rows per source and group. Cells whose pools are too small stay in the design as skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import astuple, dataclass, fields
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.operators.sampling import nested_ranks
from touchline.session import materialise

POOL = ["seed", "fold_id", "target_source"]
CELL = ["experiment", *POOL, "regime", "train_size", "n_target", "n_other"]
#: Draws of the second pool differ from those of the first, so a row's places in both are independent.
OTHER_SHIFT = 100
#: Fits that the driver keeps going at the same time.
FITS_AT_ONCE = 4

Item = TypeVar("Item")
Result = TypeVar("Result")


@dataclass(frozen=True)
class Cell:
    """Coordinates of a cell, and the rows that it takes from each pool of its split."""

    experiment: str = ""
    seed: int = 0
    fold_id: str = ""
    target_source: str = ""
    regime: str = ""
    train_size: int = 0
    n_target: int = 0
    n_other: int = 0
    parts: tuple[tuple[str, int], ...] = ()

    def tags(self) -> dict:
        return {name: getattr(self, name) for name in CELL}


def group_sides(groups: DataFrame, seeds: Sequence[int], test_size: float, strata: Sequence[str], scheme: str) -> DataFrame:
    """(seed, fold_id, source, match_id, is_test): whole groups go to one side of each split.

    ``shuffle`` sends ceil(test_size * groups) of each stratum to the test side, once per seed;
    ``lomo`` holds out every group once, with the first seed.
    """
    if scheme == "lomo":
        held = groups.select(*strata, F.col("match_id").alias("held"))
        joined = groups.join(held, list(strata)) if strata else groups.join(held, F.lit(True))
        return joined.select(
            F.lit(int(seeds[0])).alias("seed"), F.concat(F.lit("lomo:"), "held").alias("fold_id"), "source", "match_id",
            (F.col("match_id") == F.col("held")).alias("is_test"),
        )
    drawn = groups.withColumn("seed", F.explode(F.array(*(F.lit(int(s)) for s in seeds)))).withColumn(
        "draw", F.md5(F.concat_ws(":", F.col("seed").cast("string"), "match_id"))
    )
    # Groups are matches; a match without strata counts once, whatever its sources.
    by = Window.partitionBy("seed", *strata)
    ranked = drawn.withColumn("rank", F.dense_rank().over(by.orderBy("draw", "match_id"))).withColumn("all", F.max("rank").over(by))
    return ranked.select(
        "seed", F.concat(F.lit("shuffle:"), "seed").alias("fold_id"), "source", "match_id",
        (F.col("rank") <= F.ceil(F.col("all") * test_size)).alias("is_test"),
    )


def target_pools(sides: DataFrame, sources: tuple[str, str], other_sides: DataFrame) -> DataFrame:
    """Pools of splits by target: its own training and test groups, and all of the other source."""
    other = F.create_map(F.lit(sources[0]), F.lit(sources[1]), F.lit(sources[1]), F.lit(sources[0]))
    own = sides.filter(F.col("source").isin(*sources)).select(
        "seed", "fold_id", F.col("source").alias("target_source"), F.when(F.col("is_test"), "test").otherwise("target").alias("role"),
        "source", "match_id", F.col("seed").alias("draw_seed"),
    )
    splits = own.select("seed", "fold_id", "target_source").distinct()
    rest = splits.withColumn("source", F.element_at(other, F.col("target_source"))).join(other_sides, "source").select(
        "seed", "fold_id", "target_source", F.lit("other").alias("role"), "source", "match_id",
        (F.col("seed") + OTHER_SHIFT).alias("draw_seed"),
    )
    return own.unionByName(rest)


def source_pools(sides: DataFrame, sources: tuple[str, str]) -> DataFrame:
    """Pools of splits over both sources: the training groups of each source, those of both, and the test."""
    role = F.when(F.col("is_test"), F.array(F.lit("test"))).otherwise(F.array(F.col("source"), F.lit("merged")))
    return sides.filter(F.col("source").isin(*sources)).select(
        "seed", "fold_id", F.lit("").alias("target_source"), F.explode(role).alias("role"), "source", "match_id",
        F.col("seed").alias("draw_seed"),
    )


@dataclass(frozen=True)
class Design:
    """A grid: ``cells`` with their status, ranked training rows, and the groups that test each split."""

    rows: DataFrame
    ranked: DataFrame
    pools: DataFrame
    cells: tuple[Cell, ...]
    sizes: dict[tuple, dict[str, int]]

    def have(self, cell: Cell) -> dict[str, int]:
        return self.sizes.get((cell.seed, cell.fold_id, cell.target_source), {})

    def runs(self, cell: Cell) -> bool:
        have = self.have(cell)
        return sum(n for _, n in cell.parts) > 0 and all(have.get(role, 0) >= n for role, n in cell.parts)

    def _in_split(self, cell: Cell) -> Column:
        return (F.col("seed") == cell.seed) & (F.col("fold_id") == cell.fold_id) & (F.col("target_source") == cell.target_source)

    def part(self, cell: Cell, role: str) -> DataFrame:
        """Training rows that a cell takes from one pool."""
        n = dict(cell.parts).get(role, 0)
        kept = self.ranked.filter(self._in_split(cell) & (F.col("role") == role) & (F.col("pool_rank") <= n))
        return kept.select(*self.rows.columns)

    def train(self, cell: Cell) -> DataFrame:
        inside = F.lit(False)
        for role, n in cell.parts:
            inside = inside | ((F.col("role") == role) & (F.col("pool_rank") <= n))
        return self.ranked.filter(self._in_split(cell) & inside).select(*self.rows.columns)

    def test(self, cell: Cell) -> DataFrame:
        """All rows of the test groups of a cell's split."""
        groups = self.pools.filter(self._in_split(cell) & (F.col("role") == "test")).select("source", "match_id")
        return self.rows.join(groups, ["source", "match_id"], "left_semi")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per cell: coordinates, status, rows wanted of and found in its pools."""
        listed = []
        for cell in self.cells:
            have = self.have(cell)
            listed.append((
                *astuple(cell)[: len(CELL)], "ok" if self.runs(cell) else "skipped",
                sum(n for _, n in cell.parts), [(role, n, have.get(role, 0)) for role, n in cell.parts],
            ))
        kinds = {f.name: "string" if f.type == "str" else "int" for f in fields(Cell)}
        schema = ", ".join(f"{name} {kinds[name]}" for name in CELL)
        return spark.createDataFrame(listed, f"{schema}, status string, n_train int, parts array<struct<role: string, wanted: int, found: int>>")

    def memberships(self, spark: SparkSession, key: Sequence[str]) -> DataFrame:
        """(cell coordinates, key) of every training row of every cell that runs."""
        wanted = self.table(spark).filter("status = 'ok'").select(*CELL, F.explode("parts").alias("part")).select(
            *CELL, F.col("part.role").alias("role"), F.col("part.wanted").alias("wanted")
        )
        return self.ranked.join(wanted, [*POOL, "role"]).filter("pool_rank <= wanted").select(*CELL, *key)


def lay_out(
    rows: DataFrame,
    key: Sequence[str],
    sources: tuple[str, str],
    cells_of: Callable[[tuple, dict[str, int]], Iterable[Cell]],
    *,
    seeds: Sequence[int],
    test_size: float,
    scheme: str = "shuffle",
    by_target: bool = True,
) -> Design:
    """The design of a grid over ``rows`` (with source and match_id), which should be a written table.

    ``cells_of`` names the cells of a split from its coordinates (seed, fold, target) and the sizes of
    its pools. Rows without source or match_id are in no pool.
    """
    counted = materialise(rows.groupBy("source", "match_id").agg(F.count(F.lit(1)).alias("rows")).filter("source is not null and match_id is not null"))
    groups = counted.select("source", "match_id")
    sides = group_sides(groups, seeds, test_size, ["source"] if by_target else [], scheme)
    pools = materialise(target_pools(sides, sources, groups) if by_target else source_pools(sides, sources))
    sizes: dict[tuple, dict[str, int]] = {}
    # A row per split and pool.
    for r in pools.join(counted, ["source", "match_id"]).groupBy(*POOL, "role").agg(F.sum("rows").alias("n")).collect():
        sizes.setdefault((r["seed"], r["fold_id"], r["target_source"]), {})[r["role"]] = r["n"]
    cells = tuple(cell for split in sorted(sizes) for cell in cells_of(split, sizes[split]))
    most = max((n for cell in cells for role, n in cell.parts if sizes[cell.seed, cell.fold_id, cell.target_source].get(role, 0) >= n), default=0)
    training = rows.join(pools.filter("role <> 'test'"), ["source", "match_id"])
    ranked = nested_ranks(training, [*POOL, "role"], most, key, seed=F.col("draw_seed"), name="pool_rank")
    return Design(rows, materialise(ranked), pools, cells, sizes)


def in_parallel(work: Callable[[Item], Result], cells: Iterable[Item], at_once: int = FITS_AT_ONCE) -> list[Result]:
    """Results of independent cells, or other items, in their order; a bounded number of them runs at a time.

    Threads run in a copy of the caller's context, so what they write has the caller's owner.
    """
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [done.result() for done in [pool.submit(copy_context().run, work, cell) for cell in cells]]
