"""Language-model scores from Brown classes: exchange clustering and class bigrams.

Words are counted over the whole training corpus. The most frequent ones, the seeds, are assigned to
classes by exchange on the driver: each is moved to the class that raises the likelihood of class
bigrams most, until none moves. All other training words are exchanged by sweeps of Spark jobs. First
those frequent enough to travel with the tasks: their neighbours are written once, and each sweep
reads them where they lie. Then all rarer ones, known by 64-bit hashes: they lie in buckets, which
send each other the classes of words that stand beside each other. In the first sweep all words take their
best class, after it random halves move in turn; sweeps end when two in a row move no word or raise
the likelihood of all bigrams by less than ``LEAST_RISE`` a token.

Unseen words belong to a class of their shape. Words found once in training count a second time as
their shape, so that bigrams with unseen words are learnt. A text's probability is that of its class
transitions and of each word within its class, both smoothed; an unseen word has the probability of
its whole shape.

Texts are cut into words once, and written as chunks of numbered words that all passes read. Counts
and classes of frequent words travel with the tasks (their number is bounded); those of all others
reach the chunks by a join on the word.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import bound_batches, free_name, releasing, slices, word_lists
from touchline.session import materialise, remove, scratch_path, scratch_tables

BATCH_BYTES = 4 << 20
#: At most so many frequent words travel with the tasks; all others are joined.
FREQUENT_WORDS = 65_536
#: So many words are exchanged on the driver; all others by sweeps over Spark tables.
SEED_WORDS, CLASSES = 1024, 64
SMOOTHING = 0.1
#: Sweeps end when two in a row raise the likelihood by less than this for each token, in nats.
LEAST_RISE = 1e-4
SHAPES = 32
#: A chunk ends with the text that fills it; a longer text is a chunk of its own.
_TOKENS_AT_ONCE, _DISTINCT_AT_ONCE = 400_000, 100_000
_NEIGHBOURS_AT_ONCE = 1_000_000
_RARE_AT_ONCE = 250_000
_WORDS_AT_ONCE = 100_000
_GAINS_AT_ONCE = 4_000
#: Gains of words with up to so many cells are added up side by side.
_FEW_CELLS = 48
#: Counts of cells for which gains are held ready.
_USUAL_COUNTS = 8


_DIGITS = b"0123456789"


def shape(word: bytes) -> int:
    """Class of a word outside the exchange: length, last character, wide characters, digits."""
    length = len(word)
    size = 0 if length <= 4 else 1 if length <= 7 else 2 if length <= 11 else 3
    ended = word[-1:] in b".,;:!?"
    return size * 8 + ended * 4 + (not word.isascii()) * 2 + (len(word.translate(None, _DIGITS)) < length)


# --- texts as numbers --------------------------------------------------------------------


@dataclass(frozen=True)
class Encoded:
    """Texts in chunks, each with its distinct words and for each token the place of its word among them.

    All passes over the corpus read these rows, so a text is cut into words once. ``rows`` of a chunk has the
    other columns of its texts, ``sizes`` their numbers of words, ``learn`` whether they are learnt from.
    """

    chunks: DataFrame
    columns: list[T.StructField]
    path: str


_CHUNK = {"shapes": "<u1", "sizes": "<u4", "learn": "<u1", "ids": "<u4"}
_LEARNT = ("words", "shapes", "sizes", "learn", "ids")


def encode(docs: DataFrame, text: str = "text", learn: Column | None = None) -> Encoded:
    """Cut all texts into lower-cased words, once; rows where ``learn`` is not true are only scored, never learnt from."""
    spark = docs.sparkSession
    bound_batches(spark)
    body = free_name(docs, "chunk_body")
    learnt = free_name(docs, "chunk_learn")
    columns = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != text]
    if not columns:
        # A struct needs a field.
        docs = docs.withColumn(free := free_name(docs, "chunk_row"), F.lit(0))
        columns = [T.StructField(free, T.IntegerType())]
    names = [f.name for f in columns]
    df = docs.select(
        *(F.col(f"`{name}`") for name in names), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(body),
        F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias(learnt),
    )
    kinds = [T.StructField("rows", T.ArrayType(T.StructType(columns)))]
    kinds += [T.StructField(name, T.BinaryType()) for name in ("words", *_CHUNK)] + [T.StructField("learning", T.LongType())]
    found = df.mapInArrow(_task(_encode, names, body, learnt), T.StructType(kinds))
    path = scratch_path(spark, "encoded")
    found.withColumn("chunk", F.monotonically_increasing_id()).write.parquet(path)
    return Encoded(spark.read.parquet(path), columns, path)


def _encode(names, body, learnt, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: defaultdict = defaultdict(itertools.count().__next__)
    parts: list[pa.RecordBatch] = []
    learn: list[bool] = []
    sizes: list[int] = []
    ids: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal numbers, held
        rows = pa.Table.from_batches(parts).combine_chunks().to_struct_array().combine_chunks()
        packed = (
            shapes_of(list(numbers)), sizes, learn, np.concatenate(ids) if ids else np.empty(0, np.int64)
        )
        columns = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([b" ".join(numbers)], pa.binary())]
        columns += [pa.array([_raw(np.asarray(part, np.int64), kind)], pa.binary()) for part, kind in zip(packed, _CHUNK.values())]
        columns.append(pa.array([sum(learn)], pa.int64()))
        numbers, held = defaultdict(itertools.count().__next__), 0
        for part in (parts, learn, sizes, ids):
            part.clear()
        return pa.RecordBatch.from_arrays(columns, ["rows", "words", *_CHUNK, "learning"])

    for batch in slices(batches, body, BATCH_BYTES):
        begin, kept, marks = 0, batch.select(names), batch.column(learnt).to_pylist()
        for row, found in enumerate(batch.column(body).to_pylist()):
            size = 0
            for words in word_lists(found.lower()):
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(words)
            sizes.append(size)
            learn.append(marks[row])
            held += size + 1
            if held > _TOKENS_AT_ONCE or len(numbers) > _DISTINCT_AT_ONCE:
                parts.append(kept.slice(begin, row + 1 - begin))
                begin = row + 1
                yield flush()
        if begin < batch.num_rows:
            parts.append(kept.slice(begin))
    if sizes:
        yield flush()


def _words(batch: pa.RecordBatch, row: int) -> list[bytes]:
    return batch.column("words")[row].as_py().split()


def _chunk(batch: pa.RecordBatch, row: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk and their shapes; sizes of the texts that are learnt from, and their tokens."""
    shapes, sizes, learn, ids = _pieces(batch, row, **_CHUNK)
    learn = learn.astype(bool)
    return _words(batch, row), shapes, sizes[learn], ids if learn.all() else ids[np.repeat(learn, sizes)]


def _path(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Tokens of successive texts, with the end before the first, between them and behind the last."""
    path = np.full(len(tokens) + len(sizes) + 1, end, np.int64)
    path[np.arange(1, len(tokens) + 1) + np.repeat(np.arange(len(sizes)), sizes)] = tokens
    return path


def _sides(path: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Left and right of each bigram, a bounded number at once."""
    for at in range(0, len(path) - 1, _NEIGHBOURS_AT_ONCE):
        stop = min(at + _NEIGHBOURS_AT_ONCE, len(path) - 1)
        yield path[at:stop], path[at + 1 : stop + 1]


def shapes_of(words: list[bytes]) -> np.ndarray:
    """``shape`` of each word; no word is empty."""
    if not words:
        return np.empty(0, np.int64)
    letters = np.frombuffer(b"".join(words), "u1")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lengths) - lengths
    sizes = np.searchsorted([4, 7, 11], lengths, "left")
    ended = np.isin(letters[first + lengths - 1], list(b".,;:!?"))
    wide = np.maximum.reduceat(letters, first) >= 128
    digits = np.maximum.reduceat((letters >= 48) & (letters <= 57), first)
    return sizes * 8 + ended * 4 + wide * 2 + digits


def count_words(texts: Encoded) -> DataFrame:
    """(word, n) of all lower-cased words that are learnt from; each chunk adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, _, _, ids = _chunk(batch, row)
                counts = np.bincount(ids, minlength=len(words))
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()).take(pa.array(found)), pa.array(counts[found].astype(np.int64))], ["word", "n"]
                )

    return texts.chunks.select(*_LEARNT).mapInArrow(_task(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Codes(dict):
    """Code of each word: its place among the frequent ones, or behind them its shape.

    Words that are not frequent are noted in ``rare``.
    """

    def __init__(self, frequent: list[bytes]):
        super().__init__(zip(frequent, range(len(frequent))))
        self.frequent = len(frequent)
        self.rare: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return self.frequent + shape(word)


class States:
    """Numbers words by code and by state: exchanged words, then shapes, then the text's end."""

    def __init__(self, frequent: list[bytes], exchanged: int):
        self.codes = _Codes(frequent)
        self.end = exchanged + SHAPES
        self.size = self.end + 1
        shapes = [exchanged + number for number in range(SHAPES)]
        self.state_of = np.array(
            [at if at < exchanged else exchanged + shape(word) for at, word in enumerate(frequent)] + shapes
        )

    def code(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))

    def path(self, body: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Codes of words, the states before them, and their own; the end comes last, without a code."""
        before = self.end
        for words in word_lists(body.lower()):
            if words:
                codes = self.code(words)
                states = self.state_of[codes]
                yield codes, np.concatenate([[before], states[:-1]]), states
                before = int(states[-1])
        yield np.empty(0, np.int64), np.array([before]), np.array([self.end])


def _xlogx(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.maximum(values, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of class bigrams, without what no exchange changes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=1)).sum() - _xlogx(pairs.sum(axis=0)).sum())


def exchange(counts: np.ndarray, words: int, classes: int = CLASSES) -> np.ndarray:
    """Class of each state: words move to the class that raises the likelihood most.

    Words start in ``classes`` classes by rank; shapes and the end keep classes of their own.
    """
    classes = max(1, min(classes, words))
    fixed = len(counts) - words
    own = np.concatenate([np.arange(words) % classes, classes + np.arange(fixed)])
    groups = classes + fixed
    # Gains below the rounding error of the likelihood are none; words would move in circles.
    least_gain = 1e-9 + 1e-12 * float(_xlogx(counts.sum()))
    best, reached, moved = own.copy(), -math.inf, words
    while moved:
        member = np.zeros((len(counts), groups))
        member[np.arange(len(counts)), own] = 1
        after, before = counts @ member, counts.T @ member
        pairs = member.T @ after
        now = likelihood(pairs)
        if now <= reached + least_gain:
            return best
        best, reached, moved = own.copy(), now, 0
        for word in range(words):
            old, out, into, self_n = own[word], after[word], before[word], counts[word, word]
            left = pairs.copy()
            left[old] -= out
            left[:, old] -= into
            left[old, old] += self_n
            # ``left`` holds the pairs without the word; ``rest`` its neighbours without itself.
            out_rest, into_rest = out.copy(), into.copy()
            out_rest[old] -= self_n
            into_rest[old] -= self_n
            rows, columns = left[:classes], left[:, :classes].T
            diagonal = np.arange(classes)
            gain = (_xlogx(rows + out_rest) - _xlogx(rows)).sum(axis=1)
            gain += (_xlogx(columns + into_rest) - _xlogx(columns)).sum(axis=1)
            corner = left[diagonal, diagonal]
            a, b = out_rest[:classes], into_rest[:classes]
            gain -= _xlogx(corner + a) + _xlogx(corner + b) - 2 * _xlogx(corner)
            gain += _xlogx(corner + a + b + self_n) - _xlogx(corner)
            # Totals of a class hold its bigrams with the word, wherever the word goes.
            followed, preceded = left[:classes].sum(axis=1) + b, left[:, :classes].sum(axis=0) + a
            for total, added in ((followed, out.sum()), (preceded, into.sum())):
                gain -= _xlogx(total + added) - _xlogx(total)
            new = int(gain.argmax())
            if new != old and gain[new] > gain[old] + least_gain:
                left[new] += out_rest
                left[:, new] += into_rest
                left[new, new] += self_n
                pairs = left
                own[word] = new
                for table, side in ((after, counts[:, word]), (before, counts[word])):
                    table[:, old] -= side
                    table[:, new] += side
                moved += 1
    return own


def _task(run, *given):
    """``run`` for mapInArrow; the worker is used again and gives back the memory of its batches."""
    return releasing(partial(run, *given), lambda: None)


def _raw(values: np.ndarray, kind: str) -> bytes:
    """Bytes of numbers; of short ones all lowest bytes first: the upper ones are mostly zero and compress well."""
    numbers = np.ascontiguousarray(values).astype(kind)
    size = numbers.dtype.itemsize
    if size in (1, 8):
        return numbers.tobytes()
    return b"".join(numbers.view("u1")[plane::size].tobytes() for plane in range(size))


def _flat(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if size in (1, 8):
        return np.frombuffer(packed, kind).astype(np.int64)
    numbers = np.zeros(len(packed) // size, "<i8")
    for plane, part in enumerate(np.frombuffer(packed, "u1").reshape(size, -1)):
        if part.any():
            numbers.view("u1")[plane::8] = part
    return numbers


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _pieces(batch: pa.RecordBatch, row: int, **kinds: str) -> list[np.ndarray]:
    return [_flat(batch.column(name)[row].as_py(), kind) for name, kind in kinds.items()]


# --- bigrams of the words that travel ----------------------------------------------------

_LINKS = pa.schema(
    [("bucket", pa.int32()), ("heads", pa.binary()), ("runs", pa.binary()), ("others", pa.binary()), ("counts", pa.binary())]
)
_LINKS_AS = "bucket int, heads binary, runs binary, others binary, counts binary"
_KINDS = {"heads": "<u4", "runs": "<u4", "others": "<u4", "counts": "<u4"}
_FIXED = -1


class Bigrams:
    """Bigrams of the words that travel, written once: each word's neighbours lie in one row.

    Codes number the words by rank; behind them follow the shapes of all other words and the text's
    end. ``heads`` are twice a word's code, one more for what stands before it; ``runs`` is how many
    of ``others`` and ``counts`` belong to a head. Bucket -1 holds bigrams without any such word.
    Sweeps read these rows where they lie and are given the classes, so no bigram is shuffled twice.
    """

    def __init__(self, texts: Encoded, frequent: list[bytes], tokens: int):
        self.words = words = len(frequent)
        self.end = words + SHAPES
        self.shapes = np.array([shape(word) for word in frequent] + list(range(SHAPES)), np.int64)
        buckets = max(8, min(tokens // _NEIGHBOURS_AT_ONCE, words, 32_000))
        found = texts.chunks.select(*_LEARNT).mapInArrow(_task(_count_bigrams, frequent, buckets), _LINKS_AS)
        dealt = found.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        self.table = materialise(dealt.mapInArrow(_task(_merge_bigrams), _LINKS_AS))

    def pairs(self, class_of: np.ndarray, groups: int, unseen: int | None = None, rare: bool = True) -> np.ndarray:
        """Counts of successive classes; ``class_of`` has those of all codes.

        With ``unseen``, the first shape's class, words found once count a second time as their shape.
        Without ``rare``, bigrams with a word that does not travel are left out.
        """
        return self._cells(_task(_class_pairs, self.words, class_of, groups, self.shapes, unseen, rare), groups)

    def changed(self, before: np.ndarray, after: np.ndarray, groups: int) -> np.ndarray:
        """What new classes of words change in ``pairs``; only bigrams of words that moved are looked at."""
        return self._cells(_task(_changed_pairs, before, after, groups), groups)

    def _cells(self, run, groups: int) -> np.ndarray:
        cells = self.table.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(groups * groups)
        counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
        return counts.reshape(groups, groups)

    def exchange(self, class_of: np.ndarray, placed: int, classes: int) -> np.ndarray:
        """Classes after sweeps over all words; those before ``placed`` have one, the others that of their shape.

        All the others take their best class first. Then a random half of the words moves in each sweep, each
        to its best class while the others stay, until two sweeps in a row move none or raise the likelihood
        by less than ``LEAST_RISE`` a token; the best classes found are kept.
        """
        groups = int(class_of[-1]) + 1
        class_of = class_of.copy()
        own = np.where(np.arange(self.words) < placed, class_of[: self.words], -1)
        best, reached, idle, sweep = class_of, -math.inf, 0, 0
        pairs = self.pairs(class_of, groups)
        while True:
            now = likelihood(pairs)
            enough = LEAST_RISE * max(pairs.sum(), 1.0)
            if sweep == 1 or now > reached:
                idle = 0 if sweep <= 1 or now - reached >= enough else idle + 1
                best, reached = class_of.copy(), now
            elif sweep:
                idle += 1
            if idle >= 2:
                return best
            run = _task(_move_words, placed, sweep, class_of, own, pairs, classes)
            moved = self.table.filter(F.col("bucket") >= 0).mapInArrow(run, "words binary, classes binary").collect()
            for row in moved:
                own[_flat(row["words"], "<u4")] = _flat(row["classes"], "<u2")
            sweep += 1
            if (own == class_of[: self.words]).all():
                idle += 1
                if idle >= 2 or placed >= self.words:
                    return best if sweep > 1 else class_of
            before = class_of.copy()
            class_of[: self.words] = own
            pairs = pairs + self.changed(before, class_of, groups)


def _count_bigrams(frequent: list[bytes], buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = dict(zip(frequent, range(len(frequent))))
    words, end = len(frequent), len(frequent) + SHAPES
    for batch in batches:
        for row in range(batch.num_rows):
            own, shapes, sizes, ids = _chunk(batch, row)
            code = np.array([codes.get(word, -1) for word in own], np.int64)
            code = np.where(code < 0, words + shapes, code)
            for left, right in _sides(_path(code[ids], sizes, end)):
                one, two, none = left < words, right < words, (left >= words) & (right >= words)
                keys = np.concatenate(
                    [
                        (left[one] % buckets + 1) << 48 | (2 * left[one]) << 24 | right[one],
                        (right[two] % buckets + 1) << 48 | (2 * right[two] + 1) << 24 | left[two],
                        (2 * left[none]) << 24 | right[none],
                    ]
                )
                yield _rows(_LINKS, _packed(*np.unique(keys, return_counts=True)))


def _packed(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows of ``_LINKS``, one per bucket, from sorted keys of bucket, head and other."""
    bucket, head, other = (keys >> 48) - 1, (keys >> 24) & 0xFFFFFF, keys & 0xFFFFFF
    rows = []
    for at in np.unique(bucket):
        begin, stop = np.searchsorted(bucket, [at, at + 1])
        heads, runs = np.unique(head[begin:stop], return_counts=True)
        packed = (heads, runs, other[begin:stop], counts[begin:stop])
        rows.append((int(at), *(_raw(part, kind) for part, kind in zip(packed, _KINDS.values()))))
    return rows


def _merge_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the rows of each bucket, which follow one another."""
    keys, counts, held, current = [], [], 0, None

    def merge() -> tuple[np.ndarray, np.ndarray]:
        merged, back = np.unique(np.concatenate(keys), return_inverse=True)
        return merged, np.bincount(back, np.concatenate(counts), len(merged)).astype(np.int64)

    for batch in batches:
        for row in range(batch.num_rows):
            bucket = batch.column("bucket")[row].as_py()
            if bucket != current and keys:
                yield _rows(_LINKS, _packed(*merge()))
                keys, counts, held = [], [], 0
            current = bucket
            heads, runs, others, n = _pieces(batch, row, **_KINDS)
            keys.append((bucket + 1) << 48 | np.repeat(heads, runs) << 24 | others)
            counts.append(n)
            held += len(n)
            if held > 2 * _NEIGHBOURS_AT_ONCE:
                merged, n = merge()
                # What is left after adding up is bounded by the bucket's distinct bigrams.
                keys, counts, held = [merged], [n], 0
    if keys:
        yield _rows(_LINKS, _packed(*merge()))


def _class_pairs(words, class_of, groups, shapes, unseen, rare, batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros(groups * groups)
    for batch in batches:
        for row in range(batch.num_rows):
            heads, runs, others, n = _pieces(batch, row, **_KINDS)
            word, side = np.repeat(heads >> 1, runs), np.repeat(heads & 1, runs)
            behind = side == 0
            if unseen is not None and len(word):
                times = np.bincount(word[behind], n[behind], int(word.max()) + 1)
            if not rare:
                kept = ((word < words) | (word == words + SHAPES)) & ((others < words) | (others == words + SHAPES))
                word, side, others, n = word[kept], side[kept], others[kept], n[kept]
            mine, beside = class_of[word], class_of[others]
            # Bigrams of two such words are read from the left one only.
            behind, before = side == 0, (side == 1) & (others >= words)
            for chosen, key in ((behind, mine * groups + beside), (before, beside * groups + mine)):
                total += np.bincount(key[chosen], n[chosen], len(total))
            if unseen is not None and len(word):
                once = (times[word] == 1) & (word < words)
                mine = unseen + shapes[word[once]]
                right = side[once] == 0
                key = np.where(right, mine * groups + beside[once], beside[once] * groups + mine)
                total += np.bincount(key, n[once], len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells].astype(np.int64))], ["cell", "n"])


def _changed_pairs(before, after, groups, batches) -> Iterator[pa.RecordBatch]:
    moved = before != after
    total = np.zeros(groups * groups)
    for batch in batches:
        for row in range(batch.num_rows):
            heads, runs, others, n = _pieces(batch, row, **_KINDS)
            # Codes of bucket -1 are those of shapes and the end, which never move.
            mine = moved[heads >> 1]
            used = np.repeat(mine, runs)
            heads, others, n = np.repeat(heads[mine], runs[mine]), others[used], n[used]
            word, behind = heads >> 1, (heads & 1) == 0
            # If both words moved, their bigram is read from the left one only.
            once = behind | ~moved[others]
            word, others, behind, n = word[once], others[once], behind[once], n[once]
            for classes, sign in ((before, -1), (after, 1)):
                own, beside = classes[word], classes[others]
                key = np.where(behind, own * groups + beside, beside * groups + own)
                total += sign * np.bincount(key, n, len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells].astype(np.int64))], ["cell", "n"])


class _Moves:
    """Finds the class of best likelihood of each word while all others stay."""

    def __init__(self, pairs: np.ndarray, classes: int):
        self.classes, self.groups = classes, len(pairs)
        self.beside = np.concatenate([pairs[:classes].T, pairs[:, :classes]])
        self.logs = _xlogx(self.beside)
        self.totals = pairs[:classes].sum(axis=1), pairs[:, :classes].sum(axis=0)
        # What a cell adds to the likelihood by count and cell; those of rarer counts follow for each batch.
        usual = np.arange(1, _USUAL_COUNTS + 1)[:, None, None]
        self.steps = (_xlogx(self.beside + usual) - self.logs).reshape(-1, classes)
        self.usual = len(self.steps)

    def best(self, own: np.ndarray, offsets: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``own`` is -1 for a word without class; cells of a word lie between its offsets."""
        found = np.empty(len(own), np.int64)
        # Words of many cells come first, so those that have another cell are always the first ones.
        order = np.argsort(-np.diff(offsets), kind="stable")
        lengths, starts = np.diff(offsets)[order], offsets[:-1][order]
        ends = np.cumsum(lengths)
        begin = 0
        while begin < len(own):
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + _GAINS_AT_ONCE, "right")))
            stop = min(stop, begin + _GAINS_AT_ONCE)
            words = order[begin:stop]
            begins = ends[begin:stop] - lengths[begin:stop] - before
            entries = np.repeat(starts[begin:stop] - begins, lengths[begin:stop]) + np.arange(ends[stop - 1] - before)
            found[words] = self._best(own[words], lengths[begin:stop], begins, cells[entries], counts[entries])
            begin = stop
        return found

    def _kinds(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Row of ``steps`` of each cell; few cells and counts differ, so the logarithms are taken once for each kind."""
        kind = (counts.astype(np.int64) - 1) * len(self.beside) + cells
        large = np.flatnonzero(counts > _USUAL_COUNTS)
        if len(large):
            kinds, back = np.unique(kind[large], return_inverse=True)
            cell, n = kinds % len(self.beside), kinds // len(self.beside) + 1
            kind[large] = self.usual + back
            room = self.usual + len(kinds) - len(self.steps)
            if room > 0:
                self.steps = np.concatenate([self.steps, np.empty((room, self.classes))])
            self.steps[self.usual : self.usual + len(kinds)] = _xlogx(self.beside[cell] + n[:, None]) - self.logs[cell]
        return kind

    def _best(self, own, lengths, begins, cells, counts) -> np.ndarray:
        gain = np.zeros((len(own), self.classes))
        number = np.repeat(np.arange(len(own)), lengths)
        kind = self._kinds(cells, counts)
        many = int((lengths > _FEW_CELLS).sum())
        for word in range(many):
            gain[word] = self.steps[kind[begins[word] : begins[word] + lengths[word]]].sum(axis=0)
        # Most words have few cells: the first cells of all of them are added, then the second ones.
        ending = np.searchsorted(-lengths, -np.arange(_FEW_CELLS))
        for place, stop in enumerate(ending):
            if stop <= many:
                break
            gain[many:stop] += self.steps[kind[begins[many:stop] + place]]
        # Where a word stands now, its own bigrams are among the pairs.
        mine = np.flatnonzero(own >= 0)
        at = np.flatnonzero(own[number] >= 0)
        held = self.beside[cells[at], own[number[at]]]
        staying = np.bincount(number[at], _xlogx(held) - _xlogx(held - counts[at]), len(own))[mine].astype(float)
        for totals, chosen in zip(self.totals, (cells < self.groups, cells >= self.groups)):
            added = np.bincount(number[chosen], counts[chosen], len(own))
            sizes, size = np.unique(added, return_inverse=True)
            gain -= (_xlogx(totals + sizes[:, None]) - _xlogx(totals))[size]
            held = totals[own[mine]]
            staying -= _xlogx(held) - _xlogx(held - added[mine])
        gain[mine, own[mine]] = staying
        new = gain.argmax(axis=1)
        rows = np.arange(len(own))
        stays = (own >= 0) & (gain[rows, new] <= gain[rows, np.maximum(own, 0)] + 1e-9)
        return np.where(stays, own, new)


def _turn(numbers: np.ndarray, sweep: int) -> np.ndarray:
    """Which words move in a sweep: all in the first, then one random half and the other in turn."""
    half = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((sweep // 2) * 0x5851F42D4C957F2D & (1 << 64) - 1)) >> np.uint64(40)
    half = (half ^ half >> np.uint64(7)) & np.uint64(1)
    return (half == sweep % 2) | (sweep == 0)


def _move_words(placed, sweep, class_of, own, pairs, classes, batches) -> Iterator[pa.RecordBatch]:
    moves, groups = _Moves(pairs, classes), len(pairs)
    for batch in batches:
        for row in range(batch.num_rows):
            heads, runs, others, n = _pieces(batch, row, **_KINDS)
            words = heads >> 1
            chosen = _turn(words, sweep) & ((words >= placed) | (sweep > 0))
            used = np.repeat(chosen, runs)
            words, at = np.unique(words[chosen], return_inverse=True)
            side = at * (2 * groups) + (heads[chosen] & 1) * groups
            key = np.repeat(side, runs[chosen]) + class_of[others[used]]
            sums = np.bincount(key, n[used], len(words) * 2 * groups).reshape(len(words), 2 * groups)
            number, cells = np.nonzero(sums)
            offsets = np.searchsorted(number, np.arange(len(words) + 1))
            new = moves.best(own[words], offsets, cells, sums[number, cells])
            yield pa.RecordBatch.from_arrays(
                [pa.array([_raw(words, "<u4")], pa.binary()), pa.array([_raw(new, "<u2")], pa.binary())], ["words", "classes"]
            )


# --- rarer words -------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    """Spark's xxhash64 of a binary."""
    return xxhash.xxh64_intdigest(word, seed=42)


#: Words of a bucket, their shapes, their neighbours that travel by class, and links to other rare words.
_RARE = {
    "words": "<i8", "shapes": "<u1", "cell_of": "<u4", "cells": "<u2", "cell_n": "<u4",
    "link_of": "<u4", "link_to": "<i8", "link_side": "<u1", "link_n": "<u4",
}
#: What every pass over the buckets reads, and what only those read that move words.
_CELLS, _LINKED = ("words", "cell_of", "cells", "cell_n"), ("link_of", "link_to", "link_side", "link_n")
_RARE_SCHEMA = pa.schema([("bucket", pa.int32())] + [(name, pa.binary()) for name in _RARE])
_RARE_AS = "bucket int, " + ", ".join(f"{name} binary" for name in _RARE)
_NEWS = {"words": "<i8", "cells": "<u2", "counts": "<u4"}
_NEWS_SCHEMA = pa.schema([("bucket", pa.int32())] + [(name, pa.binary()) for name in _NEWS] + [("own", pa.binary()), ("moved", pa.int64())])
_NEWS_LIST = "array<struct<words:binary,cells:binary,counts:binary,own:binary,moved:bigint>>"
_NEWS_AS = "bucket int, words binary, cells binary, counts binary, own binary, moved long"


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct tuples of keys with the sum of their counts."""
    # Keys come as a few sorted runs, which a stable sort merges.
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [key[order] for key in keys]
    if not len(order):
        return *keys, counts
    first = np.concatenate([[True], np.any([key[1:] != key[:-1] for key in keys], axis=0)])
    return *(key[first] for key in keys), np.add.reduceat(counts[order], np.flatnonzero(first))


def _rare_row(bucket: int, hashes, shapes, cell, link) -> tuple:
    """A bucket's row from its words with repeats, and entries that name words by place."""
    words, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    key, n = _summed([back[cell[0]] << 16 | cell[1]], cell[2])
    cell = (key >> 16, key & 0xFFFF, n)
    # Links are ordered by the word that they lead to, as news of them will be.
    link = _summed([link[1], back[link[0]], link[2]], link[3])
    parts = (words, shapes[first], *cell, link[1], link[0], link[2], link[3])
    return (bucket, *(_raw(part, kind) for part, kind in zip(parts, _RARE.values())))


def _count_rare(frequent, own, groups, buckets, batches) -> Iterator[pa.RecordBatch]:
    class_of, end = dict(zip(frequent, own.tolist())), groups - 1

    def found(left, right, hashes, shapes) -> pa.RecordBatch:
        one, two = left >= groups, right >= groups
        ahead, behind, both = one & ~two, two & ~one, one & two
        cell_of = np.concatenate([left[ahead], right[behind]]) - groups
        cells = np.concatenate([right[ahead], groups + left[behind]])
        link_of = np.concatenate([left[both], right[both]]) - groups
        link_to = hashes[np.concatenate([right[both], left[both]]) - groups]
        link_side = np.repeat([0, 1], int(both.sum()))
        bucket = _bucket_of(hashes, buckets)
        rows = []
        keys = bucket, bucket[cell_of], bucket[link_of]
        orders = [np.argsort(key, kind="stable") for key in keys]
        ends = [np.searchsorted(key[order], np.arange(buckets + 1)) for key, order in zip(keys, orders)]
        place = np.empty(len(hashes), np.int64)
        for at in np.flatnonzero(np.diff(ends[0])):
            w, c, k = (order[end[at] : end[at + 1]] for order, end in zip(orders, ends))
            place[w] = np.arange(len(w))
            cell = (place[cell_of[c]], cells[c], np.ones(len(c), np.int64))
            link = (place[link_of[k]], link_to[k], link_side[k], np.ones(len(k), np.int64))
            rows.append(_rare_row(int(at), hashes[w], shapes[w], cell, link))
        return _rows(_RARE_SCHEMA, rows)

    for batch in batches:
        for row in range(batch.num_rows):
            words, shapes, sizes, ids = _chunk(batch, row)
            number = np.array([class_of.get(word, -1) for word in words], np.int64)
            # Words of texts that are not learnt from alone are none.
            rare = np.flatnonzero((number < 0) & (np.bincount(ids, minlength=len(words)) > 0))
            number[rare] = groups + np.arange(len(rare))
            hashes = np.array([word_hash(words[at]) for at in rare], np.uint64).view(np.int64)
            for left, right in _sides(_path(number[ids], sizes, end)):
                kept = (left >= groups) | (right >= groups)
                yield found(left[kept], right[kept], hashes, shapes[rare])


def _merge_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, parts = None, []

    def merged() -> pa.RecordBatch:
        starts = np.cumsum([0] + [len(part[0]) for part in parts])
        whole = [np.concatenate(column) for column in zip(*parts)]
        for column in (2, 5):
            whole[column] = np.concatenate([part[column] + start for part, start in zip(parts, starts)])
        words, shapes, cell_of, cells, cell_n, link_of, link_to, link_side, link_n = whole
        return _rows(_RARE_SCHEMA, [_rare_row(current, words, shapes, (cell_of, cells, cell_n), (link_of, link_to, link_side, link_n))])

    for batch in batches:
        for row in range(batch.num_rows):
            bucket = batch.column("bucket")[row].as_py()
            if bucket != current and parts:
                yield merged()
                parts = []
            current = bucket
            parts.append(_pieces(batch, row, **_RARE))
    if parts:
        yield merged()


def _entries(batch: pa.RecordBatch, row: int):
    """Words of a bucket, classes (-1: none yet), neighbours by word and cell with the news, how many of these stay, words moved."""
    words, cell_of, cells, cell_n = _pieces(batch, row, **{name: _RARE[name] for name in _CELLS})
    own, parts, moved = np.full(len(words), -1), [], 0
    for news in batch.column("news")[row].as_py() or []:
        if news["own"] is not None:
            own, moved = _flat(news["own"], "<u2"), news["moved"]
        else:
            to, cell, n = (_flat(news[name], kind) for name, kind in _NEWS.items())
            parts.append((np.searchsorted(words, to), cell, n))
    static = len(cells)
    if parts:
        cell_of, cells, cell_n = (np.concatenate([a, *b]) for a, b in zip((cell_of, cells, cell_n), zip(*parts)))
    return words, own, cell_of, cells, cell_n, static, moved


def _rare_total(groups: int, own, of, cells, n) -> np.ndarray:
    """Counts of class bigrams from the cells of words, those behind a word and those before it."""
    total = np.zeros(groups * groups)
    behind = cells < groups
    mine, beside = own[of], cells % groups
    for chosen, key in ((behind, mine * groups + beside), (~behind, beside * groups + mine)):
        total += np.bincount(key[chosen], n[chosen], len(total))
    return total


def _rare_pairs(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of classes with a rare word, counted once; those with neighbours that travel come with the news.

    The cell behind the last one counts the words that the last sweep has moved.
    """
    total = np.zeros(groups * groups + 1)
    for batch in batches:
        for row in range(batch.num_rows):
            (words,), parts = _pieces(batch, row, words=_RARE["words"]), []
            for news in batch.column("news")[row].as_py() or []:
                named, n = _flat(news["words"], "<i8"), _flat(news["counts"], "<u4")
                if news["own"] is not None:
                    own = _flat(news["own"], "<u2")
                    total[named] += n
                    total[-1] += news["moved"]
                else:
                    cells = _flat(news["cells"], "<u2")
                    # Links stand in both words' rows; they are read from the left one.
                    behind = cells < groups
                    parts.append((np.searchsorted(words, named[behind]), cells[behind], n[behind]))
            for part in parts:
                total[:-1] += _rare_total(groups, own, *part)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells].astype(np.int64))], ["cell", "n"])


def _shape_pairs(groups: int, unseen: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What words found once add to the bigrams of classes as their shape."""
    total = np.zeros(groups * groups)
    for batch in batches:
        for row in range(batch.num_rows):
            words, own, of, cells, n, *_ = _entries(batch, row)
            behind = cells < groups
            once = np.bincount(of[behind], n[behind], len(words)) == 1
            (shapes,) = _pieces(batch, row, shapes=_RARE["shapes"])
            total += _rare_total(groups, unseen + shapes, *(part[once[of]] for part in (of, cells, n)))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells].astype(np.int64))], ["cell", "n"])


def _move_rare(pairs, classes, sweep, buckets, batches) -> Iterator[pa.RecordBatch]:
    """Per bucket its words' new classes, and the news of them for words in other buckets."""
    moves, groups = _Moves(pairs, classes), len(pairs)
    for batch in batches:
        for row in range(batch.num_rows):
            words, own, of, cells, n, static, _ = _entries(batch, row)
            link_of, link_to, link_side, link_n = _pieces(batch, row, **{name: _RARE[name] for name in _LINKED})
            chosen = np.flatnonzero(_turn(words, sweep))
            place = np.full(len(words), -1)
            place[chosen] = np.arange(len(chosen))
            used = place[of] >= 0
            key, summed = _summed([place[of[used]] * (2 * groups) + cells[used]], n[used])
            offsets = np.searchsorted(key, np.arange(len(chosen) + 1) * (2 * groups))
            new = own.copy()
            new[chosen] = moves.best(own[chosen], offsets, key % (2 * groups), summed.astype(float))
            # Nothing is known yet of words that stand between rare words only.
            lost = chosen[(own[chosen] < 0) & (np.diff(offsets) == 0)]
            new[lost] = words[lost] % classes
            # Pairs with neighbours that travel are known at once; ``words`` of this row names them.
            total = _rare_total(groups, new, of[:static], cells[:static], n[:static])
            named = np.flatnonzero(total)
            rows = [(
                batch.column("bucket")[row].as_py(), _raw(named, "<i8"), None, _raw(total[named], "<u4"), _raw(new, "<u2"),
                int((new != own).sum()),
            )]
            # What stands behind a word has the word before it.
            first = np.diff(link_to, prepend=link_to[:1] - 1) != 0
            linked, number = link_to[first], np.cumsum(first) - 1
            key, counts = _summed([number * (2 * groups) + new[link_of] + groups * (1 - link_side)], link_n)
            to, cell = linked[key // (2 * groups)], key % (2 * groups)
            bucket = _bucket_of(to, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for at in np.flatnonzero(np.diff(ends)):
                part = order[ends[at] : ends[at + 1]]
                rows.append((int(at), *(_raw(a[part], k) for a, k in zip((to, cell, counts), _NEWS.values())), None, 0))
            yield _rows(_NEWS_SCHEMA, rows)


def _placed_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            words, own, *_ = _entries(batch, row)
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[at : at + 50_000]), pa.array(own[at : at + 50_000].astype(np.int32))], ["word", "class"]
                )


def exchange_rare(
    texts: Encoded, frequent: list[bytes], own: np.ndarray, pairs: np.ndarray, classes: int, tokens: int
) -> tuple[DataFrame, np.ndarray]:
    """(word hash, class) of all words outside ``frequent``, and all counts of class bigrams.

    ``own`` has the classes of the frequent words, which stay; ``pairs`` counts the bigrams among them. Words
    lie in buckets by hash. They first take the class that fits their neighbours that travel; then sweeps
    go on as for the frequent words, in which buckets send each other the classes of linked words. The
    bigrams returned count words found once a second time, as their shape.
    """
    spark, groups = texts.chunks.sparkSession, len(pairs)
    buckets = max(8, tokens // _RARE_AT_ONCE)
    found = texts.chunks.select(*_LEARNT).mapInArrow(_task(_count_rare, frequent, own, groups, buckets), _RARE_AS)
    dealt = found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_task(_merge_rare), _RARE_AS)
    kept: list[tuple[str, str]] = []

    def stored(df: DataFrame) -> str:
        """Write a table by bucket; the passes join such tables where they lie."""
        name, path = f"rare_{uuid.uuid4().hex}", scratch_path(spark, "rare")
        df.write.bucketBy(buckets, "bucket").option("path", path).saveAsTable(name)
        kept.append((name, path))
        return name

    def forget(*names: str | None) -> None:
        """Remove all tables but these."""
        for name, path in [table for table in kept if table[0] not in names]:
            spark.sql(f"DROP TABLE {name}")
            remove(spark, path)
            kept.remove((name, path))

    state = stored(dealt)

    def joined(news: str | None, *columns: str) -> DataFrame:
        rows = spark.table(state).select("bucket", *columns)
        if news is None:
            return rows.withColumn("news", F.lit(None).cast(_NEWS_LIST))
        box = spark.table(news).groupBy("bucket").agg(
            F.collect_list(F.struct("words", "cells", "counts", "own", "moved")).alias("news")
        )
        return rows.join(box.hint("shuffle_hash"), "bucket", "left")

    def counted(run, news: str, *columns: str) -> np.ndarray:
        total = np.zeros(groups * groups + 1)
        found = joined(news, *columns).mapInArrow(run, "cell long, n long")
        for row in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
            total[row["cell"]] = row["n"]
        return total

    now, news, sweep, idle = pairs, None, 0, 0
    best: tuple = (-math.inf, None, pairs)
    while idle < 2:
        run = _task(_move_rare, now, classes, sweep, buckets)
        news = stored(joined(news, *_CELLS, *_LINKED).mapInArrow(run, _NEWS_AS).repartition(buckets, "bucket"))
        added = counted(_task(_rare_pairs, groups), news, "words")
        now = pairs + added[:-1].reshape(groups, groups)
        still = sweep > 0 and not added[-1]
        reached = likelihood(now)
        if reached > best[0]:
            idle = idle + 1 if reached - best[0] < LEAST_RISE * now.sum() or still else 0
            best = (reached, news, now)
        else:
            idle += 1
        forget(state, news, best[1])
        sweep += 1
    placed = materialise(joined(best[1], *_CELLS).mapInArrow(_task(_placed_rare), "word long, class int"))
    once = counted(_task(_shape_pairs, groups, classes), best[1], *_CELLS, "shapes")
    whole = best[2] + once[:-1].reshape(groups, groups)
    forget()
    return placed, whole


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs: bounded tables for the tasks, and count and class of all words as a table.

    ``class_of`` has the class of each frequent word and then of each shape. ``vocabulary`` has a
    null class where a word's shape decides.
    """

    vocabulary: DataFrame
    frequent: list[bytes]
    counted: np.ndarray
    exchanged: int
    classes: np.ndarray
    class_of: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray
    tokens: int
    texts: int
    distinct: int
    whole: bool


def train(
    docs: DataFrame | Encoded, text: str = "text", frequent_words: int = FREQUENT_WORDS,
    exchanged_words: int | None = None, classes: int = CLASSES, seed_words: int = SEED_WORDS,
) -> ClassModel:
    """Count words and class bigrams over all rows of ``docs``; null texts are empty ones.

    All words are exchanged, the ``seed_words`` most frequent ones first (ties in the order of
    words). With ``exchanged_words`` only so many are, and the others are classed by shape. Of encoded texts
    those count that are learnt from.
    """
    if not isinstance(docs, Encoded):
        encoded = encode(docs, text)
        try:
            return train(encoded, text, frequent_words, exchanged_words, classes, seed_words)
        finally:
            remove(docs.sparkSession, encoded.path)
    spark = docs.chunks.sparkSession
    bound_batches(spark)
    kept = scratch_path(spark, "vocabulary")
    with scratch_tables(spark):
        vocabulary = materialise(count_words(docs))
        texts = docs.chunks.agg(F.coalesce(F.sum("learning"), F.lit(0)).alias("texts")).collect()[0]["texts"]
        levels = (
            vocabulary.groupBy(F.floor(F.log2("n")).cast("int").alias("level"))
            .agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"))
            .orderBy(F.desc("level"))
            .collect()
        )
        words, tokens = sum(row["words"] for row in levels), sum(row["tokens"] for row in levels)
        wanted = seed_words if exchanged_words is None else exchanged_words
        rows = _most_frequent(vocabulary, levels, frequent_words, wanted)
        frequent = [word for _, word in rows]
        exchanged = min(len(rows), wanted)
        bigrams = Bigrams(docs, frequent, tokens)
        states = States(frequent, exchanged)
        state_of = np.concatenate([states.state_of, [states.end]])
        counts = bigrams.pairs(state_of, states.size)
        own = exchange(counts, exchanged, classes)
        groups, first_shape = int(own.max()) + 1, int(own[exchanged])
        class_of = own[state_of]
        if exchanged_words is None:
            class_of = bigrams.exchange(class_of, exchanged, first_shape)
            pairs = among = bigrams.pairs(class_of, groups, rare=False)
            vocabulary = _with_class(vocabulary, frequent, class_of)
            if words > len(frequent):
                rare = tokens - sum(n for n, _ in rows)
                placed, pairs = exchange_rare(docs, frequent, class_of[: len(frequent)], among, first_shape, rare)
                found = placed.select(F.col("word").alias("hash"), F.col("class").alias("placed"))
                vocabulary = vocabulary.join(found.hint("shuffle_hash"), F.xxhash64("word") == F.col("hash"), "left").select(
                    "word", "n", F.coalesce("class", "placed").alias("class")
                )
            pairs = pairs + bigrams.pairs(class_of, groups, first_shape, rare=False) - among
            vocabulary.write.parquet(kept)
            vocabulary = spark.read.parquet(kept)
            held = np.zeros(groups)
            for row in vocabulary.groupBy("class").agg(F.sum(F.col("n") + 1).alias("held")).collect():
                held[row["class"]] = row["held"]
        else:
            pairs = _by_class(counts, own)
            held = _class_sizes(vocabulary, frequent, exchanged, own, groups)
            vocabulary.withColumn("class", F.lit(None).cast("int")).write.parquet(kept)
            vocabulary = spark.read.parquet(kept)
    transitions = np.log10((pairs + SMOOTHING) / (pairs.sum(axis=1, keepdims=True) + SMOOTHING * groups))
    emissions = np.log10(np.maximum(held, 1.0))
    emissions[own[-1]] = 0.0
    return ClassModel(
        vocabulary, frequent, np.log10(np.array([n for n, _ in rows] + [0] * SHAPES) + 1.0), exchanged, own, class_of[:-1],
        transitions, emissions, tokens + texts, texts, words + (texts > 0), exchanged_words is None,
    )


def _most_frequent(vocabulary: DataFrame, levels: list, frequent_words: int, wanted: int) -> list[tuple[int, bytes]]:
    """(n, word) of all words down to the power of two of their counts that ``frequent_words`` leaves room for."""
    room, least = frequent_words, None
    for row in levels:
        room -= row["words"]
        if room < 0:
            break
        least = 2 ** row["level"]
    rows = [] if least is None else vocabulary.filter(F.col("n") >= least).collect()
    if len(rows) < wanted:
        # The words that travel are too few; the exchanged ones go by rank alone.
        rows = vocabulary.orderBy(F.desc("n"), "word").limit(wanted).collect()
    return sorted(((int(row["n"]), bytes(row["word"])) for row in rows), key=lambda row: (-row[0], row[1]))


def _by_class(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    member = np.zeros((len(own), int(own.max()) + 1))
    member[np.arange(len(own)), own] = 1
    return member.T @ counts @ member


def _with_class(vocabulary: DataFrame, frequent: list[bytes], class_of: np.ndarray) -> DataFrame:
    """``vocabulary`` with the class of each word that travels, null for other words."""
    numbers = pa.array(class_of[: len(frequent)].astype(np.int32))
    table = pa.table({"word": pa.array(frequent, pa.binary()), "class": numbers})
    return vocabulary.join(F.broadcast(vocabulary.sparkSession.createDataFrame(table)), "word", "left")


def _class_sizes(vocabulary: DataFrame, frequent: list[bytes], exchanged: int, own: np.ndarray, groups: int) -> np.ndarray:
    """Per class its tokens, its distinct words, and for shapes one more for unseen words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = States(frequent, exchanged)
        sums = np.zeros(states.size)
        for batch in batches:
            at = states.state_of[states.code(batch.column("word").to_pylist())]
            states.codes.rare.clear()
            sums += np.bincount(at, batch.column("n").to_numpy() + 1.0, states.size)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], ["state", "held"])

    rows = vocabulary.mapInArrow(run, "state long, held double").groupBy("state").agg(F.sum("held").alias("held")).collect()
    held = np.zeros(groups)
    for row in rows:
        held[own[row["state"]]] += row["held"]
    held[own[exchanged : exchanged + SHAPES]] += 1
    return held


def score(docs: DataFrame | Encoded, model: ClassModel, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, base_score and score to every row, also of encoded texts.

    ``score`` is the class model's log10 probability of the text with its end, ``base_score`` that of
    the smoothed unigrams; perplexity is 10 ** (-score / n_tokens). A null text is empty: its only token is the end.
    Every row is scored on its own, so repeated rows and ties need no rule. Columns of the
    added names are replaced; an empty table gives an empty result; without training texts
    nothing is known and base scores are 0.

    Each chunk asks once for every distinct word that does not travel with the tasks; a join on the word
    answers with its count and class.
    """
    added = ("n_tokens", "n_known", "base_score", "score")
    if not isinstance(docs, Encoded):
        docs = encode(docs.drop(*(name for name in added if name != text)), text)
    buckets = max(8, model.distinct // _WORDS_AT_ONCE)
    buckets = max(8, model.distinct // _WORDS_AT_ONCE)
    asked = docs.chunks.select("chunk", "words").mapInArrow(_task(_ask, frozenset(model.frequent), buckets), _DEALT)
    offered = model.vocabulary.select("word", "n", "class").mapInArrow(_task(_offer, buckets), _DEALT)
    met = offered.union(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("chunk"))
    found = (
        met.mapInArrow(_task(_answer), "chunk long, places binary, n binary, classes binary")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("places", "n", "classes")).alias("found"))
    )
    fields = [f for f in docs.columns if f.name not in added]
    names = [f.name for f in fields]
    kinds = [T.StructField(n, k) for n, k in zip(added, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()))]
    run = _task(
        _walk, names, added, model.frequent, model.counted, model.class_of, model.transitions, model.emissions,
        int(model.texts > 0), math.log10(model.texts + 1), math.log10(model.tokens + model.distinct + 1),
    )
    joined = docs.chunks.select("chunk", "rows", "words", "shapes", "sizes", "ids").join(
        found.hint("shuffle_hash"), "chunk", "left"
    )
    return joined.mapInArrow(run, T.StructType(fields + kinds))


_DEALT = "bucket int, chunk long, words binary, places binary, n binary, classes binary"
_FOUND = {"places": "<u4", "n": "<i8", "classes": "<u2"}


def _dealt(buckets: int, chunk: int | None, words: list[bytes], **numbers: np.ndarray) -> pa.RecordBatch:
    """A row of words and their numbers for each bucket; a word's bucket goes by its checksum."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for at in np.flatnonzero(np.diff(ends)):
        part = order[ends[at] : ends[at + 1]]
        packed = (_raw(numbers[name][part], kind) if name in numbers else None for name, kind in _FOUND.items())
        rows.append((int(at), chunk, b" ".join([words[place] for place in part]), *packed))
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["bucket", "chunk", "words", *_FOUND]
    )


def _ask(frequent: frozenset, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a chunk that do not travel, and their places in it."""
    for batch in batches:
        for row, chunk in enumerate(batch.column("chunk").to_pylist()):
            own = _words(batch, row)
            places = [at for at, word in enumerate(own) if word not in frequent]
            yield _dealt(buckets, chunk, [own[at] for at in places], places=np.array(places, np.int64))


def _offer(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vocabulary, without a chunk; classes are one more than they are, 0 where a word's shape decides."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        held.clear()
        classes = pa.compute.fill_null(table.column("class"), -1).to_numpy() + 1
        return _dealt(buckets, None, table.column("word").to_pylist(), n=table.column("n").to_numpy(), classes=classes)

    for batch in batches:
        held.append(batch)
        if sum(part.num_rows for part in held) > _DISTINCT_AT_ONCE:
            yield flush()
    if held:
        yield flush()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and classes of the words asked for; a bucket's part of the vocabulary comes before what is asked of it."""
    known: dict[bytes, int] = {}
    parts: list[list[np.ndarray]] = []
    current = None
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            bucket, chunk = batch.column("bucket")[row].as_py(), batch.column("chunk")[row].as_py()
            words = _words(batch, row)
            if bucket != current:
                known, parts, current = {}, [], bucket
            if chunk is None:
                known.update(zip(words, range(len(known), len(known) + len(words))))
                parts.append(_pieces(batch, row, n="<i8", classes="<u2"))
                continue
            if len(parts) > 1:
                parts = [[np.concatenate(column) for column in zip(*parts)]]
            at = np.array([known.get(word, -1) for word in words], np.int64)
            met = at >= 0
            if met.any():
                (places,), (n, classes) = _pieces(batch, row, places="<u4"), parts[0]
                found = places[met], n[at[met]], classes[at[met]]
                rows.append((chunk, *(_raw(part, kind) for part, kind in zip(found, _FOUND.values()))))
        columns = zip(*rows) if rows else [()] * 4
        kinds = (pa.int64(), *[pa.binary()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["chunk", *_FOUND])


def _walk(
    names, added, frequent, counted_of, class_of, transitions, emissions, end_known, end_counted, whole, batches
) -> Iterator[pa.RecordBatch]:
    """Sums of each text; an unseen word has the class of its shape."""
    codes = dict(zip(frequent, range(len(frequent))))
    groups = len(transitions)
    steps = (transitions - emissions).ravel()
    for batch in batches:
        for row in range(batch.num_rows):
            words = _words(batch, row)
            shapes, sizes, ids = _pieces(batch, row, **{name: _CHUNK[name] for name in ("shapes", "sizes", "ids")})
            code = np.array([codes.get(word, -1) for word in words], np.int64)
            known = code >= 0
            code = np.where(known, code, len(frequent) + shapes)
            own, counted = class_of[code], counted_of[code]
            for found in batch.column("found")[row].as_py() or []:
                at, n, classes = (_flat(found[name], kind) for name, kind in _FOUND.items())
                known[at], counted[at] = True, np.log10(n + 1.0)
                # Without a class the word has that of its shape.
                own[at] = np.where(classes == 0, own[at], classes - 1)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            n_known = np.bincount(text_of, known[ids], len(sizes)).astype(np.int64) + end_known
            sums = np.bincount(text_of, counted[ids], len(sizes))
            path = _path(own[ids], sizes, groups - 1)
            walked = np.add.reduceat(steps[path[:-1] * groups + path[1:]], np.cumsum(sizes + 1) - sizes - 1)
            base = sums + end_counted - (sizes + 1) * whole
            rows = dict(zip((f.name for f in batch.column("rows").type.value_type), batch.column("rows")[row].values.flatten()))
            yield pa.RecordBatch.from_arrays(
                [*(rows[name] for name in names), *map(pa.array, (sizes + 1, n_known, base, sums + walked))], [*names, *added]
            )
