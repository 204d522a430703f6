"""Dictionary-compressed WARC archives of web pages, and their reader.

An archive starts with a skippable Zstandard frame that holds a dictionary built from its own
records; then each record is a frame of its own, compressed with it. Pages with equal,
long enough payloads are stored once (``response``); the others refer to that record (``revisit``).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import bound_batches, shared_files, slices, write_file

MIN_REVISIT_BYTES = 1000
#: A dictionary is trained on records of so many bytes, at most so many of each, and few are held for it.
SAMPLE_BYTES, RECORD_SAMPLE_BYTES, SAMPLE_HELD_BYTES = 2 << 20, 32 << 10, 16 << 20
_PIECE = 8192
DICTIONARY_BYTES = 64 << 10
#: An archive holds no more than about so many records and payload bytes.
ARCHIVE_ROWS, ARCHIVE_BYTES = 20_000, 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the formats: magic of the dictionary's skippable frame, profile of a revisit.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ_BYTES = 1 << 20
READERS = 20_000
READ_SCHEMA = (
    "archive string, record long, page_id long, url string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One row (page_id, digest, keeper) per distinct page and payload that has a keeper.

    ``keeper`` is the largest page_id among equal payloads of at least ``min_bytes`` bytes.
    Only digests are shuffled; they are counted on the map side first.
    """
    digests = pages.select("page_id", F.sha1("body").alias("digest"), F.octet_length("body").alias("bytes"))
    long_ones = digests.filter(F.col("bytes") >= min_bytes)
    keepers = (
        long_ones.groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"))
        .filter(F.col("keeper") > F.col("least"))
    )
    return long_ones.join(keepers.drop("least"), "digest").filter(F.col("page_id") < F.col("keeper")).select(
        "page_id", "digest", "keeper"
    ).distinct()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _record(page_id: int | None, url: str | None, body: bytes, keeper: int | None, date: str) -> bytes:
    digest = hashlib.sha1(body).hexdigest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(body)}\r\n\r\n"
    ).encode()
    block = http + (body if keeper is None else b"")
    target = re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "response" if keeper is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", target))
    if keeper is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(keeper, digest))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' end as a raw one where they are too few to train."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0"


def sample_pieces(record: bytes, limit: int = RECORD_SAMPLE_BYTES) -> list[bytes]:
    """Pieces of a record, at most ``limit`` bytes of them, spread evenly over its length."""
    pieces = [record[i : i + _PIECE] for i in range(0, len(record), _PIECE)]
    most = max(1, limit // _PIECE)
    if len(pieces) <= most:
        return pieces
    return [pieces[i * len(pieces) // most] for i in range(most)]


def archive_chunks(records: Iterable[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The dictionary frame and one frame per record.

    Samples are pieces of the first records, 2 MB of them but no more than 32 KB of each; records come
    in an order that has nothing to do with their content, so the first ones are a fair sample.
    """
    source = iter(records)
    held, size = [], 0
    samples, sampled = [], 0
    for record in source:
        held.append(record)
        size += len(record)
        pieces = sample_pieces(record)
        samples += pieces
        sampled += sum(map(len, pieces))
        if sampled >= SAMPLE_BYTES or size >= SAMPLE_HELD_BYTES:
            break
    dictionary = build_dictionary(samples)
    samples.clear()
    yield struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary
    compressor = zstandard.ZstdCompressor(
        level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True
    )
    for record in held:
        yield compressor.compress(record)
    held.clear()
    for record in source:
        yield compressor.compress(record)


def write(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
    archive_rows: int = ARCHIVE_ROWS,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write one record per page into archives below ``path``; return one row per archive.

    A null html is an empty payload; a null url gives a record without target; a page without
    an id is always a response and never a keeper. Rows repeated with equal id and payload
    are all written, each as the page's verdict says. Other columns are not archived,
    whatever their names. An empty table writes no archive. The least number of archives follows from
    all rows and bytes (the join spreads a small table over the session's shuffle partitions); pages are
    dealt to them by a hash and stored in the order of their digests.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("body"),
    )
    verdicts = decide(rows, min_bytes)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).first()
    archives = max(1, -(-total["n"] // archive_rows), -(-total["bytes"] // archive_bytes))
    # Both sides are dealt alike, so the join keeps this partitioning: a partition is an archive.
    keys = ["page_id", "digest"]
    dealt = (
        rows.withColumn("digest", F.sha1("body")).repartition(archives, *keys)
        .join(verdicts.repartition(archives, *keys), keys, "left")
        .select("page_id", "url", "body", "keeper", "digest")
        .sortWithinPartitions("digest", "page_id")
    )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.zst"
        counts = {"records": 0, "bytes": 0}

        def records() -> Iterator[bytes]:
            for batch in slices(batches, "body", 4 << 20):
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "body", "keeper"))
                for page, target, body, keeper in zip(*columns):
                    counts["records"] += 1
                    yield _record(page, target, body, keeper, date)

        def counted(chunks: Iterable[bytes]) -> Iterator[bytes]:
            for chunk in chunks:
                counts["bytes"] += len(chunk)
                yield chunk

        source = records()
        first = next(source, None)
        if first is None:
            return

        def again() -> Iterator[bytes]:
            yield first
            yield from source

        write_file(f"{path}/archives", name, counted(archive_chunks(again())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([counts["records"]]), pa.array([counts["bytes"]])],
            ["archive", "records", "bytes"],
        )

    manifest = dealt.mapInArrow(store, "archive string, records long, bytes long")
    manifest.write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.parquet(f"{path}/manifest")


def iter_records(stream) -> Iterator[bytes]:
    """Uncompressed records of one archive, read block by block."""
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with a dictionary")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = b""
    while True:
        if not rest:
            rest = stream.read(_READ_BYTES)
            if not rest:
                return
        frame = decompressor.decompressobj()
        parts = [frame.decompress(rest)]
        while not frame.eof:
            rest = stream.read(_READ_BYTES)
            if not rest:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(rest))
        rest = frame.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """Fields of one record; a revisit has no payload but its length and digest."""
    head, _, block = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"

    def page(name: str) -> int | None:
        number = fields[name].split(":")[2]
        return int(number) if number else None

    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To") if revisit else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": length,
        "payload": None if revisit else payload,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives that the manifest below ``path`` names; none for an empty table.

    As many tasks as there are archives read them, up to ``READERS``; an archive is read by one.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def rows(archive: str, first: int, held: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([archive] * len(held), pa.string()), pa.array(range(first, first + len(held)), pa.int64())]
        arrays += [pa.array([r[n] for r in held], kind) for n, kind in zip(names, types)]
        return pa.RecordBatch.from_arrays(arrays, ["archive", "record", *names])

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = shared_files(path)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                held, size, first = [], 0, 0
                with files.open_input_stream(f"{folder}/archives/{archive}", compression=None) as stream:
                    for record in iter_records(stream):
                        parsed = parse(record)
                        if parsed["payload"] is not None:
                            if hashlib.sha1(parsed["payload"]).hexdigest() != parsed["payload_digest"]:
                                raise ValueError(f"payload of {parsed['page_id']} in {archive} is damaged")
                            if not payloads:
                                parsed["payload"] = None
                        held.append(parsed)
                        size += len(record)
                        if size > 4 << 20:
                            yield rows(archive, first, held)
                            held, size, first = [], 0, first + len(held)
                if held:
                    yield rows(archive, first, held)

    manifest = spark.read.parquet(f"{path}/manifest").select("archive")
    # An explicit number: the few names would be coalesced into one task otherwise.
    readers = min(max(1, manifest.count()), READERS)
    return manifest.repartition(readers, "archive").mapInArrow(open_all, READ_SCHEMA)
