"""Random forests from counts of binned rows.

A tree sees of a row its bins and its class only, so rows that share them are counted once and one pass over the
rows suffices, however many trees, levels and folds there are. A bootstrap that takes each row Poisson(1) times takes a cell
of n rows Poisson(n) times, so forests on counts are distributed as forests on rows are. The trees of all folds grow together,
a job per level: tasks count the classes by tree, node, feature and bin, and the counts of each tree are added up and
give its splits. Impurity, subsets of features, votes and importances are those of Spark's forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

BINS = 32
#: Cells that draw from one generator, so that draws depend on nothing but the cells.
BLOCK = 8_192
#: Counts that a task holds at once.
HELD = 4_000_000


def bin_borders(df: DataFrame, features: Sequence[str], bins: int = BINS) -> tuple[list[list[float]], list[bool]]:
    """Upper borders of all bins but the last, and whether values are missing, by feature.

    Up to ``bins`` distinct values have a bin each; else bins have about equally many rows.
    """
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(features)])
    about = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"n_{v}") for v in rows.columns],
        *[F.approx_count_distinct(v).alias(f"d_{v}") for v in rows.columns],
    ).first()
    few = {v for v in rows.columns if about[f"d_{v}"] <= 1.25 * bins}
    shares = [k / bins for k in range(1, bins)]

    def values(v: str) -> list[float]:
        return sorted(set(found[v] or ()))

    found = rows.agg(*[
        (F.collect_set(v) if v in few else F.percentile_approx(v, shares, 200 * bins)).alias(v) for v in rows.columns
    ]).first().asDict()
    crowded = [v for v in few if len(found[v]) > bins]
    if crowded:
        few -= set(crowded)
        found |= rows.agg(*[F.percentile_approx(v, shares, 200 * bins).alias(v) for v in crowded]).first().asDict()
    borders = [values(v)[:-1] if v in few else values(v) for v in rows.columns]
    return borders, [about[f"n_{v}"] < about["n"] for v in rows.columns]


@dataclass(frozen=True)
class Cells:
    """Rows counted by their bins: ``b`` and number of a feature, ``n`` and number of a fold and class.

    ``missing`` has the bin of a missing value (-1 in the table) by fold held out and feature.
    """

    table: DataFrame
    size: int
    totals: np.ndarray
    folds: tuple[int, ...]
    classes: tuple[str, ...]
    bins: int
    missing: np.ndarray


def count_cells(
    df: DataFrame, features: Sequence[str], label: str, fold: str, folds: Sequence[int], classes: Sequence[str],
    borders: Sequence[Sequence[float]], missing: np.ndarray,
) -> Cells:
    value = [f"v{i}" for i in range(len(features))]
    rows = df.select(
        F.col(fold).alias("fold"), F.col(label).cast("string").alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(v) for v, c in zip(value, features)],
    )
    split = [i for i, found in enumerate(borders) if found]
    if split:
        # A value on a border belongs below it; Bucketizer's buckets begin at their splits.
        edges = [[-math.inf, *[math.nextafter(b, math.inf) for b in borders[i]], math.inf] for i in split]
        rows = Bucketizer(
            splitsArray=edges, inputCols=[value[i] for i in split], outputCols=[f"p{i}" for i in split], handleInvalid="keep"
        ).transform(rows)
    place = [F.col(f"p{i}").cast("int") if i in split else F.lit(0) for i in range(len(features))]
    binned = rows.select(
        "fold", "label", *[F.when(F.isnan(v), -1).otherwise(p).cast("int").alias(f"b{i}") for i, (v, p) in enumerate(zip(value, place))]
    )
    counts = [
        F.count_if((F.col("fold") == number) & (F.col("label") == name)).alias(f"n{i * len(classes) + k}")
        for i, number in enumerate(folds) for k, name in enumerate(classes)
    ]
    names = [f"b{i}" for i in range(len(features))]
    table = materialise(binned.groupBy(*names).agg(*counts))
    held = [c for c in table.columns if c.startswith("n")]
    sums = table.agg(F.count(F.lit(1)).alias("cells"), *[F.sum(c).alias(c) for c in held]).first()
    totals = np.array([sums[c] or 0 for c in held], float).reshape(len(folds), len(classes))
    most = max(len(found) for found in borders) + 1
    return Cells(table, sums["cells"], totals, tuple(folds), tuple(classes), most, missing)


@dataclass
class Forest:
    """Trees of each fold as complete trees in arrays: the split feature (-1: a leaf), its bin, and shares of classes."""

    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray
    gained: np.ndarray

    def importances(self) -> list[float]:
        """Mean over folds of the trees' mean importances, each tree's adding up to one."""
        by_tree = self.gained / np.maximum(self.gained.sum(axis=2, keepdims=True), 1e-300)
        by_fold = by_tree.sum(axis=1)
        return list((by_fold / np.maximum(by_fold.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0))


def _ordered(cells: Cells, parts: int) -> DataFrame:
    """Each part of the work with all cells, by blocks that stay together and are in order."""
    names = [c for c in cells.table.columns if c.startswith("b")]
    blocks = max(1, math.ceil(cells.size / BLOCK))
    slots = 4 * cells.table.sparkSession.sparkContext.defaultParallelism
    splits = min(blocks, max(1, math.ceil(slots / parts)))
    return (
        cells.table.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        # Some keys fall into one partition; twice the partitions leave few of them.
        .repartition(2 * parts * splits, "part", F.col("block") % splits)
        .sortWithinPartitions("part", "block", *names)
    )


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Part, block, bins (features x cells) and counts (cells x folds and classes) of one block after another."""

    def arrays(part: pd.DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
        codes = part[[c for c in part.columns if c[0] == "b" and c != "block"]].to_numpy(np.int16).T
        counts = part[[c for c in part.columns if c[0] == "n"]].to_numpy(np.int64)
        return int(part["part"].iloc[0]), int(part["block"].iloc[0]), np.ascontiguousarray(codes), counts

    kept = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if kept is None else pd.concat([kept, pdf])
        last = (pdf["part"] == pdf["part"].iloc[-1]) & (pdf["block"] == pdf["block"].iloc[-1])
        for _, part in pdf[~last].groupby(["part", "block"], sort=False):
            yield arrays(part)
        kept = pdf[last]
    if kept is not None:
        yield arrays(kept)


def _walk(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of each cell after so many levels; the children of node i are 2i + 1 and 2i + 2."""
    flat, width = codes.ravel(), codes.shape[1]
    cell = np.arange(width)
    node = np.zeros(width, np.int64)
    for _ in range(levels):
        own = feature[node]
        right = flat[np.maximum(own, 0) * width + cell] > cut[node]
        node = np.where(own >= 0, 2 * node + 1 + right, node)
    return node


def _subset(seed: int, fold: int, tree: int, nodes: np.ndarray, features: int, most: int) -> np.ndarray:
    """Features that each node may split by."""
    if most >= features:
        return np.tile(np.arange(features), (len(nodes), 1))
    drawn = np.random.default_rng([seed, 1, fold, tree, int(nodes[0])]).random((len(nodes), features))
    return np.argsort(drawn, axis=1)[:, :most]


def _impurity(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = weights.sum(axis=-1)
    return total, 1 - ((weights / np.maximum(total, 1e-300)[..., None]) ** 2).sum(axis=-1)


def _best(counts: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of counts by node, candidate, bin and class: the best candidate and bin of each node, its gain times weight, and both sides' weights."""
    left_n = counts.cumsum(axis=2)
    all_n = left_n[:, :, -1:, :]
    right_n = all_n - left_n
    left, right, whole = left_n * weight, right_n * weight, all_n * weight
    (a, gini_a), (b, gini_b), (w, gini) = _impurity(left), _impurity(right), _impurity(whole)
    gain = gini - (a * gini_a + b * gini_b) / np.maximum(w, 1e-300)
    gain[(left_n.sum(axis=-1) < least) | (right_n.sum(axis=-1) < least)] = -1.0
    at = gain.reshape(len(counts), -1).argmax(axis=1)
    candidate, border = np.divmod(at, counts.shape[2])
    node = np.arange(len(counts))
    return candidate, border, gain[node, candidate, border] * w[node, 0, 0], left[node, candidate, border], right[node, candidate, border]


def grow(
    cells: Cells, *, seed: int, numTrees: int = 20, maxDepth: int = 5, minInstancesPerNode: int = 1  # noqa: N803
) -> Forest:
    """A forest for each fold, from the counts of all others, with classes weighted alike."""
    seed %= 2**32
    folds, classes, features = len(cells.folds), len(cells.classes), cells.missing.shape[1]
    bins, missing, least = cells.bins, cells.missing, minInstancesPerNode
    most = features if numTrees == 1 else math.ceil(math.sqrt(features))
    nodes = 2 ** (maxDepth + 1) - 1
    train = cells.totals.sum(axis=0) - cells.totals
    present = np.maximum((train > 0).sum(axis=1, keepdims=True), 1)
    weight = train.sum(axis=1, keepdims=True) / (present * np.maximum(train, 1))
    forest = Forest(
        np.full((folds, numTrees, nodes), -1, np.int16), np.zeros((folds, numTrees, nodes), np.int16),
        np.zeros((folds, numTrees, nodes, classes)), np.zeros((folds, numTrees, features)),
    )
    open_nodes = {(f, t): np.zeros(1, np.int64) for f in range(folds) for t in range(numTrees)}
    for level in range(maxDepth):
        if not open_nodes:
            break
        parts = _parts(open_nodes, most * bins * classes)
        sent = [
            [(f, t, open_nodes[f, t], forest.feature[f, t, : 2**level - 1].copy(), forest.cut[f, t, : 2**level - 1].copy()) for f, t in part]
            for part in parts
        ]
        shared = cells.table.sparkSession.sparkContext.broadcast(sent)
        count = _counter(shared, level, seed, missing, folds, classes, features, most, bins)

        def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            f, t = int(key[0]), int(key[1])
            counts = sum(np.frombuffer(held, np.int64) for held in pdf["held"]).reshape(-1, most, bins, classes)
            found = _best(counts, weight[f], least)
            return pd.DataFrame({"fold": [f], "tree": [t], **{name: [np.asarray(a).tobytes()] for name, a in zip(_SPLIT, found)}})

        ordered = _ordered(cells, len(parts))
        counted = ordered.mapInPandas(count, "fold int, tree int, held binary")
        splits = counted.groupBy("fold", "tree").applyInPandas(
            choose, "fold int, tree int, " + ", ".join(f"{name} binary" for name in _SPLIT)
        ).toPandas()
        shared.destroy()
        later = {}
        for row in splits.itertuples(index=False):
            f, t = row.fold, row.tree
            at = open_nodes[f, t]
            candidate, border = np.frombuffer(row.candidate, np.int64), np.frombuffer(row.border, np.int64)
            gain = np.frombuffer(row.gain)
            sides = [np.frombuffer(side).reshape(-1, classes) for side in (row.below, row.above)]
            if not level:
                forest.share[f, t, 0] = _shares(sides[0] + sides[1])[0]
            used = np.flatnonzero(gain > 0)
            own = _subset(seed, f, t, at, features, most)[used, candidate[used]]
            forest.feature[f, t, at[used]], forest.cut[f, t, at[used]] = own, border[used]
            np.add.at(forest.gained[f, t], own, gain[used])
            children = [2 * at[used] + 1, 2 * at[used] + 2]
            for child, side in zip(children, sides):
                forest.share[f, t, child] = _shares(side[used])
            # A child of one class gains nothing by a split.
            mixed = [child[(side[used] > 0).sum(axis=1) > 1] for child, side in zip(children, sides)]
            if sum(map(len, mixed)):
                later[f, t] = np.sort(np.concatenate(mixed))
        open_nodes = later
    return forest


_SPLIT = ("candidate", "border", "gain", "below", "above")


def _shares(weights: np.ndarray) -> np.ndarray:
    return weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-300)


def _parts(open_nodes: dict[tuple[int, int], np.ndarray], of_node: int) -> list[list[tuple[int, int]]]:
    """Trees of one fold whose counts a task can hold at once."""
    parts: list[list[tuple[int, int]]] = []
    held = 0
    for tree, at in sorted(open_nodes.items()):
        if not parts or parts[-1][0][0] != tree[0] or held + len(at) * of_node > HELD:
            parts.append([])
            held = 0
        parts[-1].append(tree)
        held += len(at) * of_node
    return parts


def _counter(shared, level: int, seed: int, missing: np.ndarray, folds: int, classes: int, features: int, most: int, bins: int) -> Callable:
    """Counts of drawn rows by candidate feature, bin and class of the open nodes of each tree of a part."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent, part, held, subsets = shared.value, None, [], []

        def done() -> Iterator[pd.DataFrame]:
            for (f, t, *_), counts in zip(sent[part] if part is not None else (), held):
                yield pd.DataFrame({"fold": [f], "tree": [t], "held": [counts.tobytes()]})

        for number, block, codes, counts in _blocks(batches):
            if number != part:
                yield from done()
                part = number
                held = [np.zeros(len(at) * most * bins * classes, np.int64) for _, _, at, *_ in sent[part]]
                subsets = [_subset(seed, f, t, at, features, most) for f, t, at, *_ in sent[part]]
            f = sent[part][0][0]
            codes = np.where(codes < 0, missing[f][:, None], codes).astype(np.int16)
            by_fold = counts.reshape(-1, folds, classes)
            train = by_fold.sum(axis=1) - by_fold[:, f]
            flat, width = codes.ravel(), codes.shape[1]
            for i, (_, t, at, feature, cut) in enumerate(sent[part]):
                drawn = np.random.default_rng([seed, 0, f, t, block]).poisson(train)
                node = _walk(codes, feature, cut, level)
                slot = np.full(2 ** (level + 1) - 1, -1, np.int64)
                slot[at] = np.arange(len(at))
                slot = slot[node]
                cell = np.flatnonzero(slot >= 0)
                slot, drawn = slot[cell], drawn[cell]
                for j in range(most):
                    own = flat[subsets[i][slot, j] * width + cell]
                    place = (((slot * most + j) * bins + own) * classes)[:, None] + np.arange(classes)
                    held[i] += np.bincount(place.ravel(), drawn.ravel(), len(held[i])).astype(np.int64)
        yield from done()

    return count


def confusion(cells: Cells, forest: Forest) -> DataFrame:
    """(fold, y_true, y_pred, n): held-out rows by their class and the one with the largest sum of the trees' shares."""
    spark = cells.table.sparkSession
    folds, classes, names, missing = cells.folds, len(cells.classes), np.array(cells.classes), cells.missing
    depth = int(math.log2(forest.feature.shape[2] + 1)) - 1
    shared = spark.sparkContext.broadcast((forest.feature, forest.cut, forest.share))

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, cut, share = shared.value
        for f, _, codes, counts in _blocks(batches):
            codes = np.where(codes < 0, missing[f][:, None], codes).astype(np.int16)
            tested = counts.reshape(-1, len(folds), classes)[:, f]
            votes = sum(share[f, t][_walk(codes, feature[f, t], cut[f, t], depth)] for t in range(feature.shape[1]))
            best = votes.argmax(axis=1)
            table = np.zeros((classes, classes), np.int64)
            for k in range(classes):
                table[:, k] = tested[best == k].sum(axis=0)
            truth, chosen = np.nonzero(table)
            yield pd.DataFrame({"fold": folds[f], "y_true": names[truth], "y_pred": names[chosen], "n": table[truth, chosen]})

    found = _ordered(cells, len(folds)).mapInPandas(guess, "fold int, y_true string, y_pred string, n long")
    return found.groupBy("fold", "y_true", "y_pred").agg(F.sum("n").alias("n"))
