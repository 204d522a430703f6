"""Near-duplicate groups by an exact Jaccard join on word shingles.

1. Shingle hashes of all documents are counted in a sketch of fixed size; rarer hashes come
   first in one order for all sets.
2. Documents with equal sets become one node. Two sets that are similar enough share a hash
   among the first few of each (the prefix), so only prefixes are shuffled. As hashes shared by
   chance grow with a set, each prefix is lengthened in proportion to its set, and as many more
   hashes must be shared; nodes that share too few with all others are dropped.
3. Nodes that share prefix hashes get a common label and are dealt into blocks of bounded
   size; blocks with a prefix hash in common must meet, all parts of a label among them.
4. Each pair of blocks is one small group. There every node picks by estimated cost how many
   further hashes its prefix takes; as many more must be shared before two sets are compared
   in full. Only a spanning forest of the links found leaves the group.
5. Labels run along the links until they no longer change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bound_batches, releasing, slices, word_lists
from touchline.session import materialise

WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100
BATCH_BYTES = 4 << 20
SKETCH_BITS = (16, 24)
SKETCH_CHUNK = 1 << 14
BLOCK_NODES, BLOCK_HASHES = 128, 200_000
MAX_EXTRA = 4
#: Cost of one full comparison against that of one prefix entry.
COMPARISON_COST = 16
LABEL_ROUNDS = 2
#: One more prefix hash, and one more match, for every so many hashes of a set.
MATCH_EVERY = 16
PRUNE_ROUNDS = 2
_WORDS_REMEMBERED = 150_000
_PRIME = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_remembered = _WordHashes()


def forget() -> None:
    """Drop all remembered words of this worker."""
    _remembered.clear()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(_PRIME)
    return values ^ (values >> np.uint64(29))


def shingles(body: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of all words if they are fewer."""
    parts = [
        np.array(list(map(_remembered.__getitem__, words)), np.uint64) for words in word_lists(body.lower()) if words
    ]
    if not parts:
        return np.empty(0, np.uint64)
    words = np.concatenate(parts)
    used = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - used + 1, used * 0x51ED27 % 2**64, np.uint64)
        for at in range(used):
            factor = np.uint64(pow(_PRIME, at + 1, 2**64) | 1)
            total += _mixed(words[at : at + len(total)]) * factor
        return np.unique(_mixed(total))


def least_overlap(size: int, numerator: int, denominator: int) -> int:
    """Hashes that a set must share with any set similar enough."""
    return -(-numerator * size // denominator)


def required_matches(size: int) -> int:
    """Prefix hashes that two sets must share if the smaller one has this size."""
    return 1 + size // MATCH_EVERY


def _enough_matches(size: Column, numerator: int, denominator: int) -> Column:
    """``required_matches`` of the smallest set that is similar enough to one of this size."""
    return 1 + F.floor(F.ceil(size * numerator / denominator) / MATCH_EVERY)


def frequency_levels(bodies: DataFrame, width: int, bits: int) -> np.ndarray:
    """Level (8 per doubling) of each of 2**bits cells that count the hashes of all documents."""
    cells = 1 << bits
    chunk = min(cells, SKETCH_CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in slices(batches, "body", BATCH_BYTES):
            found = [shingles(body, width) >> np.uint64(64 - bits) for body in batch.column("body").to_pylist()]
            if found:
                at, number = np.unique(np.concatenate(found), return_counts=True)
                counts[at.astype(np.int64)] += number.astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1)
        used = [at for at in range(cells // chunk) if counts[at * chunk : (at + 1) * chunk].any()]
        packed = [pack.compress(counts[at * chunk : (at + 1) * chunk].tobytes()) for at in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed").to_pylist()):
                part = np.frombuffer(unpack.decompress(packed), np.uint32)
                sums[at] = sums[at] + part if at in sums else part.astype(np.uint64)
        levels = [np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8).tobytes() for total in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["chunk", "levels"])

    summed = bodies.mapInArrow(releasing(count, forget), "chunk int, packed binary").repartition("chunk").mapInArrow(add, "chunk int, levels binary")
    out = np.zeros(cells, np.uint8)
    for row in summed.collect():  # one byte per cell of the sketch, whatever the input
        out[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["levels"], np.uint8)
    return out


def _prefixes(bodies: DataFrame, width: int, numerator: int, denominator: int, bits: int, levels: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = np.frombuffer(levels, np.uint8)
        for batch in slices(batches, "body", BATCH_BYTES):
            sizes, digests, heads = [], [], []
            for body in batch.column("body").to_pylist():
                found = shingles(body, width)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                head = len(found) - least_overlap(len(found), numerator, denominator) + required_matches(len(found))
                order = np.lexsort((found, level_of[(found >> np.uint64(64 - bits)).astype(np.int64)]))[:head]
                heads.append(found[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(heads, pa.list_(pa.int64()))],
                ["doc", "size", "digest", "head"],
            )

    kind = bodies.schema["doc"].dataType.simpleString()
    return bodies.mapInArrow(releasing(run, forget), f"doc {kind}, size long, digest binary, head array<long>")


def block_links(sets: list[np.ndarray], side: np.ndarray | None, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Spanning links among sets: all pairs, or with ``side`` only pairs of different sides.

    A set whose hashes occur too rarely here is left out. The others order their hashes by
    local frequency and choose 1 to MAX_EXTRA prefix matches by estimated cost: more matches
    need a longer prefix, but let fewer candidates through.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if count else np.empty(0, np.uint64)
    _, inverse, frequency = np.unique(flat, return_inverse=True, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    shared, heads, extra = [], [], np.zeros(count, np.int64)
    for i in range(count):
        own = inverse[bounds[i] : bounds[i + 1]]
        own = own[frequency[own] > 1]
        own = own[np.lexsort((own, frequency[own]))]
        shared.append(own)
        slack = len(own) - least_overlap(int(sizes[i]), numerator, denominator)
        if slack < 0 or not len(own):
            heads.append(own[:0])
            continue
        entries = np.cumsum(frequency[own] - 1)
        best = None
        for matches in range(1, MAX_EXTRA + 1):
            stop = slack + matches
            if stop > len(own):
                break
            cost = entries[stop - 1] * (1 + COMPARISON_COST / matches)
            if best is None or cost < best:
                best, extra[i] = cost, matches
        heads.append(own[: slack + extra[i]])
    active = np.flatnonzero(extra > 0)
    if len(active) < 2:
        return []
    counts = np.zeros((len(active), len(active)), np.float32)
    used, columns = np.unique(np.concatenate([heads[i] for i in active]), return_inverse=True)
    rows = np.repeat(np.arange(len(active)), [len(heads[i]) for i in active])
    for begin in range(0, len(used), 4096):
        here = (columns >= begin) & (columns < begin + 4096)
        matrix = np.zeros((len(active), min(4096, len(used) - begin)), np.float32)
        matrix[rows[here], columns[here] - begin] = 1
        counts += matrix @ matrix.T
    needed = np.minimum(extra[active][:, None], extra[active][None, :])
    size = sizes[active]
    fits = (counts >= needed) & (denominator * np.minimum(size[:, None], size) >= numerator * np.maximum(size[:, None], size))
    if side is not None:
        fits &= side[active][:, None] != side[active]
    root = np.arange(count)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    marks = np.zeros(len(frequency), bool)
    links = []
    for at in range(1, len(active)):
        i = active[at]
        mine = find(i)
        others = [j for j in active[np.flatnonzero(fits[at, :at])] if find(j) != mine]
        if not others:
            continue
        marks[shared[i]] = True
        lengths = [len(shared[j]) for j in others]
        common = np.add.reduceat(marks[np.concatenate([shared[j] for j in others])], np.concatenate([[0], np.cumsum(lengths)[:-1]]), dtype=np.int64)
        marks[shared[i]] = False
        for j, both in zip(others, common):
            if denominator * both >= numerator * (sizes[i] + sizes[j] - both):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(i), int(j)))
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that the links (a, b) reach, for nodes with a link.

    Each round takes the least label among a node and its neighbours, then the label of that
    label. Every round is written to the shared folder and read back.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = materialise(
            lowered.join(jump, F.col("low") == F.col("at"), "left").select(
                "node", F.least("low", F.coalesce("next", "low")).alias("label"),
                (F.least("low", F.coalesce("next", "low")) < F.col("label")).alias("changed"),
            )
        )
        labels = moved.select("node", "label")
        if not moved.filter("changed").limit(1).count():
            return labels


def _shared(postings: DataFrame) -> DataFrame:
    """Entries (token, node) of tokens in two nodes or more, with the token's least node."""
    leaders = postings.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    return postings.join(leaders.filter("leader < last").drop("last"), "token")


def _labels(shared: DataFrame, rounds: int) -> DataFrame:
    """A label per node: the least node within ``rounds`` steps over shared prefix hashes."""
    labels = materialise(shared.groupBy("node").agg(F.min("leader").alias("label")))
    for _ in range(rounds - 1):
        labelled = shared.join(labels, "node")
        least = labelled.groupBy("token").agg(F.min("label").alias("least"))
        labels = materialise(labelled.join(least, "token").groupBy("node").agg(F.min("least").alias("label")))
    return labels


def _block_pairs(shared: DataFrame, members: DataFrame) -> DataFrame:
    """(pair, label, part, side): the blocks of every pair that must meet; a lone block is its own pair."""
    parts = materialise(members.groupBy("label").agg(F.max("parts").alias("parts"), F.count(F.lit(1)).alias("held")))
    at = shared.join(members.select("node", "label"), "node").select("token", "label").distinct()
    mixed = at.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    at = materialise(at.join(mixed.select("token"), "token"))
    other = at.select("token", F.col("label").alias("label_b"))
    cross = at.join(other, "token").filter("label < label_b").select(F.col("label").alias("label_a"), "label_b").distinct()
    lone = parts.filter("held > 1").select(F.col("label").alias("label_a"), F.col("label").alias("label_b"))
    met = (
        cross.union(lone)
        .join(parts.select(F.col("label").alias("label_a"), F.col("parts").alias("parts_a")), "label_a")
        .join(parts.select(F.col("label").alias("label_b"), F.col("parts").alias("parts_b")), "label_b")
        .withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
        .withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        .filter("label_a < label_b or part_a <= part_b")
    )
    pairs = materialise(met.select("label_a", "part_a", "label_b", "part_b").withColumn("pair", F.monotonically_increasing_id()))
    first = pairs.select("pair", F.col("label_a").alias("label"), F.col("part_a").alias("part"), F.lit(False).alias("side"))
    second = pairs.filter("label_a <> label_b or part_a <> part_b").select(
        "pair", F.col("label_b").alias("label"), F.col("part_b").alias("part"), F.lit(True).alias("side")
    )
    return first.union(second)


def _find_links(placed: DataFrame, bodies: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) between nodes; ``placed`` has doc, digest, node and its (pair, side) entries."""
    rows = bodies.join(placed, F.col("doc").eqNullSafe(F.col("first_doc"))).select("body", "digest", "node", "entries")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", BATCH_BYTES):
            found = [shingles(body, width).tobytes() for body in batch.column("body").to_pylist()]
            right = [xxhash.xxh3_128_digest(s) == d for s, d in zip(found, batch.column("digest").to_pylist())]
            whole = pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("entries"), pa.array(found, pa.binary())], ["node", "entries", "hashes"]
            )
            yield whole.filter(pa.array(right, pa.bool_()))

    meeting = (
        rows.mapInArrow(releasing(sets, forget), "node long, entries array<struct<pair: long, side: boolean>>, hashes binary")
        .select("node", "hashes", F.explode("entries").alias("entry"))
        .select("entry.pair", "entry.side", "node", "hashes")
        .repartition("pair")
        .sortWithinPartitions("pair")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, {}

        def found() -> list[tuple[int, int]]:
            nodes = list(held)
            sides = np.array([held[node][0] for node in nodes])
            near = block_links(
                [held[node][1] for node in nodes], sides if sides.any() else None, numerator, denominator
            )
            return [(nodes[i], nodes[j]) for i, j in near]

        out: list[tuple[int, int]] = []
        for batch in batches:
            for number, side, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "node", "hashes"))):
                if number != pair:
                    out += found() if len(held) > 1 else []
                    pair, held = number, {}
                held[node] = (side, np.frombuffer(hashes, np.uint64))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        out += found() if len(held) > 1 else []
        yield _edges(out)

    return meeting.mapInArrow(meet, "a long, b long")


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"]
    )


def link(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
    numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
) -> DataFrame:
    """One row (``key``, n_shingles, component_id) per row of ``docs``.

    Words are lower-cased in A-Z. A set holds the distinct shingles of ``width`` words, or
    all words as one shingle if they are fewer. Sets link when their intersection is at
    least numerator/denominator of their union. ``component_id`` is the smallest key that links
    reach. A null or blank text has no shingles and is linked with nothing: its component
    is its own key. Repeated rows share their set, hence their component, whatever their
    keys; null keys take part, but name a component only if it has no other key. Sets are
    compared by 64-bit hashes of their shingles. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    bodies = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    size = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(size / 96 + 1)), SKETCH_BITS[0]), SKETCH_BITS[1])
    levels = frequency_levels(bodies, width, bits).tobytes()
    sets = materialise(_prefixes(bodies, width, numerator, denominator, bits, levels))
    nodes = materialise(
        sets.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc").alias("first_doc"), F.first("size").alias("size"), F.first("head").alias("head"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    postings = nodes.select("node", F.explode("head").alias("token"))
    shared = materialise(_shared(postings))
    needed = nodes.select("node", _enough_matches(F.col("size"), numerator, denominator).alias("needed"))
    for _ in range(PRUNE_ROUNDS):
        matched = shared.groupBy("node").agg(F.count(F.lit(1)).alias("matches")).join(needed, "node")
        able = matched.filter("matches >= needed").select("node")
        shared = materialise(_shared(shared.select("node", "token").join(able, "node", "left_semi")))
    labels = _labels(shared, LABEL_ROUNDS)
    named = labels.join(nodes.select("node", "size", "digest", "first_doc"), "node")
    weights = named.groupBy("label").agg(F.count(F.lit(1)).alias("held"), F.sum("size").alias("hashes"))
    parts = F.ceil(F.greatest(F.col("held") / BLOCK_NODES, F.col("hashes") / BLOCK_HASHES)).cast("int")
    members = materialise(
        named.join(weights.select("label", parts.alias("parts")), "label").withColumn(
            "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        )
    )
    pairs = _block_pairs(shared, members)
    placed = (
        members.join(pairs, ["label", "part"])
        .groupBy("node", "digest", "first_doc")
        .agg(F.collect_list(F.struct("pair", "side")).alias("entries"))
    )
    links = materialise(_find_links(placed, bodies, width, numerator, denominator))
    reached = components(links)
    grouped = nodes.select("node", "digest", "first_doc").join(reached, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    least = grouped.groupBy("label").agg(F.min("first_doc").alias("least"))
    named_sets = grouped.join(least, "label").select(F.col("digest").alias("node_digest"), "least")
    return sets.join(named_sets, F.col("digest") == F.col("node_digest"), "left").select(
        F.col("doc").alias(key), F.col("size").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id")
    )
