"""Token ids in flat binary shards, with a minimal perfect hash index for keyed access.

A store is a folder with

* ``shards/tokens-NNNNNN.bin``: the ids of consecutive documents and nothing else, little-endian,
  two bytes each if the vocabulary allows, else four;
* ``entries``: Parquet with one row per document (key, copy, bucket, shard, place, length);
* ``index/index-NNNNNN.npz``: for each bucket of keys a minimal perfect hash function and, in its
  order, fingerprint, shard, place and length of each document;
* ``store.json``: width of an id and number of buckets.

Documents lie in ascending key order over all shards (null keys first).
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.byte_bpe import PieceCache, PieceEncoder
from touchline.llm.common import bound_batches, free_name, joinable, shared_files, slices, write_file

BATCH_BYTES = 4 << 20
KEYS_PER_BUCKET = 100_000
RANGE_BYTES = 8 << 20
CACHED_PIECES = 300_000
_GAMMA = 1.5


@lru_cache(maxsize=2)
def _engine(path: str):
    from tokenizers import Tokenizer

    engine = Tokenizer.from_file(path)
    encode = PieceEncoder(engine, "H" if engine.get_vocab_size() <= 1 << 16 else "I")
    return PieceCache(lambda pieces: encode([piece.decode() for piece in pieces]), CACHED_PIECES)


def id_width(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id)
    return 2 if largest < 1 << 16 else 4


# --- minimal perfect hashing -------------------------------------------------------------


def key_hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit words per key; the second gives the fingerprint and steps the levels."""
    digests = b"".join(xxhash.xxh3_128_digest(key.encode()) for key in keys)
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


def _slot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = hashes[:, 0] ^ (hashes[:, 1] * np.uint64(2 * level + 1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and their bits: a key's bit is on the first level where it is alone.

    Keys must be distinct. The number of set bits before its own is the key's number.
    """
    sizes, bits = [], []
    left = hashes
    while len(left):
        size = max(8, math.ceil(_GAMMA * len(left)))
        slots = _slot(left, len(sizes), size)
        alone = np.bincount(slots, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[slots]]
        if len(sizes) > 200:
            raise ValueError("keys of a bucket are not distinct")
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.empty(0, bool)


def find(hashes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Number of each key, or -1; ``before`` counts the set bits up to each position."""
    found = np.full(len(hashes), -1, np.int64)
    open_rows = np.arange(len(hashes))
    begin = 0
    for level, size in enumerate(sizes):
        at = begin + _slot(hashes[open_rows], level, int(size))
        hit = bits[at]
        found[open_rows[hit]] = before[at[hit]]
        open_rows = open_rows[~hit]
        begin += int(size)
    return found


def _pack_index(hashes: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    sizes, bits = build_hash(hashes)
    order = np.empty(len(hashes), np.int64)
    order[find(hashes, sizes, bits, np.cumsum(bits) - bits)] = np.arange(len(hashes))
    out = io.BytesIO()
    np.savez(
        out, sizes=sizes, bits=np.packbits(bits), prints=(hashes[order, 1] >> np.uint64(32)).astype(np.uint32),
        **{name: values[order] for name, values in columns.items()},
    )
    return out.getvalue()


class _Index:
    def __init__(self, uri: str, bucket: int):
        files, folder = shared_files(uri)
        with files.open_input_stream(f"{folder}/index/index-{bucket:06d}.npz") as stream:
            held = np.load(io.BytesIO(stream.read()))
            self.columns = {name: held[name] for name in held.files}
        self.sizes = self.columns.pop("sizes")
        self.bits = np.unpackbits(self.columns.pop("bits"))[: int(self.sizes.sum())].astype(bool)
        self.before = np.cumsum(self.bits) - self.bits
        self.prints = self.columns.pop("prints")

    def __call__(self, keys: list[str]) -> dict[str, np.ndarray]:
        """Columns of the entries; -1 for keys whose fingerprint says that they are not stored."""
        hashes = key_hashes(keys)
        at = find(hashes, self.sizes, self.bits, self.before)
        known = (at >= 0) & (self.prints[np.maximum(at, 0)] == (hashes[:, 1] >> np.uint64(32))) if len(self.prints) else at >= 0
        return {
            name: np.where(known, values[np.where(known, at, 0)] if len(values) else 0, -1)
            for name, values in self.columns.items()
        }


# --- Spark -------------------------------------------------------------------------------


def _index_key(key: Column, copy: Column) -> Column:
    return F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("-")), copy.cast("string"), key.isNull().cast("string"))


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text, write the store at the new folder ``path`` and return its entries.

    ``end_id`` follows each document. A null text is an empty one and stores the end alone.
    Rows with equal keys are all stored, numbered by ``copy`` (0, 1, ...) in stored order; a
    null key is a key. An empty table gives a store without shards. Other columns are not
    stored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    width = id_width(tokenizer_path, end_id)
    end = end_id.to_bytes(width, "little")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    order = ("key", F.xxhash64("body"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    key_type = rows.schema["key"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_ids = _engine(tokenizer_path)
        shard = TaskContext.get().partitionId()
        keys, lengths = [], []

        def payload() -> Iterator[bytes]:
            for batch in slices(batches, "body", BATCH_BYTES):
                keys.append(batch.column("key"))
                for body in batch.column("body").to_pylist():
                    ids = b"".join(pieces_ids(body.split())) + end
                    lengths.append(len(ids) // width)
                    yield ids

        parts = payload()
        first = next(parts, None)
        if first is None:
            return
        write_file(f"{path}/shards", f"tokens-{shard:06d}.bin", _joined(first, parts))
        sizes = np.array(lengths, np.int64)
        places = np.cumsum(sizes) - sizes
        begin = 0
        for part in keys:
            stop = begin + len(part)
            yield pa.RecordBatch.from_arrays(
                [part, pa.array(np.full(len(part), shard, np.int32)), pa.array(places[begin:stop]), pa.array(sizes[begin:stop])],
                ["key", "shard", "place", "length"],
            )
            begin = stop

    stored = ranged.mapInArrow(store, f"key {key_type}, shard int, place long, length long")
    stored.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    buckets = max(1, math.ceil(placed.count() / KEYS_PER_BUCKET))
    same = Window.partitionBy("key").orderBy("shard", "place")
    entries = placed.withColumn("copy", F.row_number().over(same) - 1)
    entries = entries.withColumn("index_key", _index_key(entries.key, entries.copy)).withColumn(
        "bucket", F.pmod(F.xxhash64("index_key"), F.lit(buckets)).cast("int")
    )
    entries.write.parquet(f"{path}/entries")
    _write_index(spark.read.parquet(f"{path}/entries"), path)
    write_file(path, "store.json", [json.dumps({"width": width, "buckets": buckets, "key": key_type}).encode()])
    return spark.read.parquet(f"{path}/entries").drop("index_key")


def _joined(first: bytes, rest: Iterator[bytes], at_once: int = 1 << 20) -> Iterator[bytes]:
    held, size = [first], len(first)
    for part in rest:
        held.append(part)
        size += len(part)
        if size >= at_once:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal values of ``column``, one table for each value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for begin, stop in zip(cuts, cuts[1:]):
            if stop == begin:
                continue
            if held and held[0].column(column)[0].as_py() != values[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, stop - begin))
    if held:
        yield pa.Table.from_batches(held)


def _write_index(entries: DataFrame, path: str) -> None:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "bucket"):
            bucket = table.column("bucket")[0].as_py()
            columns = {name: table.column(name).to_numpy() for name in ("shard", "place", "length")}
            packed = _pack_index(key_hashes(table.column("index_key").to_pylist()), columns)
            write_file(f"{path}/index", f"index-{bucket:06d}.npz", [packed])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    columns = entries.select("bucket", "index_key", "shard", "place", "length")
    dealt = columns.repartition("bucket").sortWithinPartitions("bucket", "index_key")
    dealt.mapInArrow(build, "bucket int").write.parquet(f"{path}/indexed")


def describe(path: str) -> dict:
    files, folder = shared_files(path)
    with files.open_input_stream(f"{folder}/store.json") as stream:
        return json.loads(stream.read())


def lookup(keys: DataFrame, path: str, key: str = "key", copy: str = "copy") -> DataFrame:
    """Shard, place and length of every (key, copy) from the index; null where it is not stored."""
    buckets = describe(path)["buckets"]
    name = free_name(keys, "index_key")
    bucket = free_name(keys, "bucket")
    wanted = keys.drop("shard", "place", "length").withColumn(name, _index_key(F.col(key), F.col(copy))).withColumn(
        bucket, F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name not in (name, bucket)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, _Index] | None = None
        for batch in batches:
            for table in _groups(iter([batch]), bucket):
                number = table.column(bucket)[0].as_py()
                if opened is None or opened[0] != number:
                    opened = (number, _Index(path, number))
                found = opened[1](table.column(name).to_pylist())
                rows = table.drop_columns([name, bucket]).combine_chunks().to_batches()[0]
                missing = found["shard"] < 0
                arrays = [
                    pa.array(found["shard"].astype(np.int32), mask=missing),
                    pa.array(found["place"].astype(np.int64), mask=missing),
                    pa.array(found["length"].astype(np.int64), mask=missing),
                ]
                yield pa.RecordBatch.from_arrays(
                    rows.columns + arrays, rows.schema.names + ["shard", "place", "length"]
                )

    dealt = wanted.repartition(bucket).sortWithinPartitions(bucket)
    return dealt.mapInArrow(search, ", ".join([*fields, "shard int", "place long", "length long"]))


def fetch(located: DataFrame, path: str) -> DataFrame:
    """Add ``ids``: the stored ids as unsigned 32-bit little-endian binary; null where unlocated."""
    width = describe(path)["width"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in located.schema.fields]
    reads = free_name(located, "range")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = shared_files(path)
        opened = None
        for batch in batches:
            batch = batch.drop_columns([reads])
            places = zip(*(batch.column(name).to_pylist() for name in ("shard", "place", "length")))
            held, begin, size = [], 0, 0
            for row, (shard, place, length) in enumerate(places):
                if shard is None:
                    held.append(None)
                    continue
                if opened is None or opened[0] != shard:
                    if opened:
                        opened[1].close()
                    opened = (shard, files.open_input_file(f"{folder}/shards/tokens-{shard:06d}.bin"))
                raw = opened[1].read_at(length * width, place * width)
                held.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                size += 4 * length
                if size > BATCH_BYTES:
                    yield _with_ids(batch.slice(begin, row + 1 - begin), held)
                    held, begin, size = [], row + 1, 0
            yield _with_ids(batch.slice(begin), held)
        if opened:
            opened[1].close()

    dealt = located.withColumn(reads, F.floor(F.col("place") * width / RANGE_BYTES)).repartition("shard", reads)
    ordered = dealt.sortWithinPartitions("shard", "place")
    return ordered.mapInArrow(read, ", ".join([*fields, "ids binary"]))


def _with_ids(batch: pa.RecordBatch, ids: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns + [pa.array(ids, pa.binary())], batch.schema.names + ["ids"])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Number of ids in all shards before each shard; one row per shard file."""
    sizes = spark.read.parquet(f"{path}/entries").groupBy("shard").agg(F.sum("length").alias("ids_in_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return joinable(
        sizes.select("shard", F.coalesce(F.sum("ids_in_shard").over(before), F.lit(0)).alias("shard_start"))
    )
