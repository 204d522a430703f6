"""Merkle manifest of a dataset by nested-interval labels.

Every group of rows is a tree over its rows in key order, and the groups' roots are the leaves
of one further tree. A node is labelled by its tree, its level and the interval [lo, hi) of leaf
ranks that it covers; a node of level L lies in bucket floor(lo / fanout^L). Nodes of the
next level are grouped by bucket, ``fanout`` of them at most. Ancestors are attached from the root
downwards: each level is joined to the one above by tree and bucket, where the parent's interval
must contain the child's, and what the parent's interval holds beside the child's are the siblings.
Each level is smaller than the one below by the factor ``fanout``, so all joins together move
about as many rows as the first, and no tree is ever in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import joinable
from touchline.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Rows that a range of ranks holds, about.
ROWS_PER_RANGE = 50_000

TREE, KEY, LO, HI, SIZE, DIGEST = "tree", "key", "lo", "hi", "tree_size", "digest"
BUCKET, CHILDREN, PATH, TOP = "bucket", "children", "path", "top"
SIBLINGS = "array<struct<left: string, right: string>>"
ABSENT = "-"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: every value as its UTF-8 byte count, a colon and the value; a null is ``-``."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(ABSENT))

    return digest(*(framed(value) for value in values))


def fold(start: Column, siblings: Column) -> Column:
    """Root that follows from a leaf and its siblings, lowest level first."""
    return F.aggregate(siblings, start, lambda below, s: digest(s["left"], below, s["right"]))


def sibling_text(siblings: Column) -> Column:
    """All siblings in order, without the places of the path's own nodes."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass(frozen=True)
class Forest:
    """Written nodes of all trees, level 0 first; a node covering its whole tree has no parent."""

    levels: tuple[DataFrame, ...]
    fanout: int

    def roots(self) -> DataFrame:
        """One row (tree, digest) for each tree."""
        found = [nodes.filter(_is_root()).select(TREE, DIGEST) for nodes in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def descend(self) -> DataFrame:
        """Level 0 with the siblings up to the root (``path``) and the root (``top``)."""
        above: DataFrame | None = None
        for height in range(len(self.levels) - 1, -1, -1):
            above = self._attach(height, above)
        return above

    def _attach(self, height: int, above: DataFrame | None) -> DataFrame:
        nodes = self.levels[height]
        nothing = F.array().cast(SIBLINGS)
        if above is None:
            return nodes.withColumn(PATH, nothing).withColumn(TOP, F.col(DIGEST))
        up = above.select(*(F.col(name).alias(f"up_{name}") for name in (TREE, BUCKET, LO, HI, CHILDREN, PATH, TOP)))
        joined = nodes.withColumn("at", F.floor(F.col(LO) / F.lit(self.fanout ** (height + 1)))).join(
            up,
            (F.col(TREE) == F.col(f"up_{TREE}"))
            & (F.col("at") == F.col(f"up_{BUCKET}"))
            & (F.col(f"up_{LO}") <= F.col(LO))
            & (F.col(HI) <= F.col(f"up_{HI}")),
            "left",
        )

        def beside(inside) -> Column:
            return F.array_join(F.transform(F.filter(f"up_{CHILDREN}", inside), lambda c: c[DIGEST]), "")

        # The parent's interval less the child's: what ends before it and what begins behind it.
        step = F.struct(
            beside(lambda c: c[HI] <= F.col(LO)).alias("left"), beside(lambda c: c[LO] >= F.col(HI)).alias("right")
        )
        alone = F.col(f"up_{TREE}").isNull()
        return joined.select(
            *nodes.columns,
            F.when(alone, nothing).otherwise(F.concat(F.array(step), F.col(f"up_{PATH}"))).alias(PATH),
            F.when(alone, F.col(DIGEST)).otherwise(F.col(f"up_{TOP}")).alias(TOP),
        )


def _is_root() -> Column:
    return (F.col(LO) == 0) & (F.col(HI) == F.col(SIZE))


def _ranked(leaves: DataFrame, rows_per_range: int) -> DataFrame:
    """Add the rank of each leaf in its tree (key, then digest) and the size of the tree.

    The table is cut into ranges of (tree, key, digest, number of the row), so rows that repeat
    one key, or are equal, are spread too; counts per range and tree give each range its first rank.
    """
    written = materialise(leaves)
    ranges = max(1, -(-written.count() // rows_per_range))
    order = (F.col(KEY).asc_nulls_first(), F.col(DIGEST), F.col("row_number"))
    placed = materialise(
        written.withColumn("row_number", F.monotonically_increasing_id())
        .repartitionByRange(ranges, F.col(TREE), *order)
        .withColumn("range", F.spark_partition_id())
    )
    per_tree = Window.partitionBy("in_tree")
    offsets = joinable(
        placed.groupBy(F.col(TREE).alias("in_tree"), F.col("range").alias("in_range"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn(
            "first", F.coalesce(F.sum("rows").over(per_tree.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        .withColumn(SIZE, F.sum("rows").over(per_tree))
        .drop("rows")
    )
    inside = Window.partitionBy("range", TREE).orderBy(*order)
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, (F.col(TREE) == F.col("in_tree")) & (F.col("range") == F.col("in_range")))
        .withColumn(LO, (F.col("first") + F.col("place")).cast("long"))
        .withColumn(HI, F.col(LO) + 1)
        .drop("in_tree", "in_range", "first", "place", "range", "row_number")
    )


def grow(leaves: DataFrame, fanout: int = FANOUT, rows_per_range: int = ROWS_PER_RANGE) -> Forest:
    """Build all trees over (tree, key, digest, ...); other columns stay with the leaves.

    ``tree`` must not be null. Leaves ascend by key, nulls first, then by digest. While a tree
    has several nodes on a level, each run of ``fanout`` of them, the last one possibly shorter
    or even a single node, becomes the digest of their digests.
    """
    level = materialise(_ranked(leaves, rows_per_range))
    levels = [level]
    largest = level.agg(F.max(SIZE)).first()[0] or 1
    width = 1
    while width < largest:
        width *= fanout
        children = F.sort_array(F.collect_list(F.struct(LO, HI, DIGEST)))
        level = materialise(
            level.filter(~_is_root())
            .groupBy(TREE, F.floor(F.col(LO) / F.lit(width)).alias(BUCKET))
            .agg(F.min(LO).alias(LO), F.max(HI).alias(HI), F.first(SIZE).alias(SIZE), children.alias(CHILDREN))
            .withColumn(DIGEST, F.sha2(F.array_join(F.transform(CHILDREN, lambda c: c[DIGEST]), ""), 256))
        )
        levels.append(level)
    return Forest(tuple(levels), fanout)


def prove(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    key: str = "doc_id",
    keep: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per row of ``docs``: key, group, leaf, subroot, root, siblings and the columns of ``keep``.

    ``leaf`` digests ``fields``; ``subroot`` is the root of the group's tree, ``root`` that of
    the tree over all subroots, groups in order of their UTF-8 bytes, null first. ``siblings``
    lead from the leaf over its subroot to the root: for each level the digests left and right of the
    path's own node, both empty for a node alone in its run. ``keep`` names expressions over
    ``docs`` that travel along; other columns of ``docs`` are read only as ``fields``.

    A null key or group is a value of its own, a null field is ``-`` in the leaf, an empty text is not
    null. Rows with equal keys follow by leaf; equal rows are leaves of their own. A single
    row is its own subroot and root, with no siblings. An empty table gives an empty result. A name in
    ``keep`` that is also one of the columns above is refused.
    """
    keep = dict(keep or {})
    own = [key, group, "leaf", "subroot", "root", "siblings"]
    if {name.lower() for name in keep} & {name.lower() for name in own}:
        raise ValueError(f"names in keep must differ from {own}")
    # "-" sorts before every "=...", so the null group comes first.
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    rows = docs.select(
        tree.alias(TREE), F.col(f"`{key}`").alias(KEY), leaf([F.col(f"`{name}`") for name in fields]).alias(DIGEST),
        F.col(f"`{group}`").alias("group"), F.struct(F.lit(0).alias("unused"), *(value.alias(name) for name, value in keep.items())).alias("kept"),
    )
    forest = grow(rows, fanout, rows_per_range)
    united = grow(
        forest.roots().select(F.lit("all").alias(TREE), F.col(TREE).alias(KEY), DIGEST), fanout, rows_per_range
    )
    tops = joinable(
        united.descend().select(F.col(KEY).alias("of_tree"), F.col(PATH).alias("upper"), F.col(TOP).alias("root"))
    )
    return forest.descend().join(tops, F.col(TREE) == F.col("of_tree")).select(
        F.col(KEY).alias(key),
        F.col("group").alias(group),
        F.col(DIGEST).alias("leaf"),
        F.col(TOP).alias("subroot"),
        "root",
        F.concat(PATH, "upper").alias("siblings"),
        *(F.col(f"kept.`{name}`").alias(name) for name in keep),
    )
