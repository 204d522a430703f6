"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import MAX_BROADCAST_ROWS, joinable  # noqa: F401

#: The white space that separates words; every other character belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal id modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the Arrow batches that the session hands to Python by bytes; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``max_bytes`` in each; one row at least."""
    for batch in batches:
        begin = 0
        size = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for row, length in enumerate(lengths):
            if row > begin and size + length > max_bytes:
                yield batch.slice(begin, row - begin)
                begin, size = row, 0
            size += length
        if begin < batch.num_rows:
            yield batch.slice(begin)


def releasing(run: Callable[[Iterator], Iterator], release: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run``, and when its task ends ``release``: workers are used again, and would keep what it remembered."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
            pa.default_memory_pool().release_unused()

    return task


_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(body: bytes, at_once: int = 2 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size unless a single word is longer."""
    begin = 0
    while begin < len(body):
        stop = begin + at_once
        if stop < len(body):
            found = _SPACE_BYTE.search(body, stop)
            stop = found.start() if found else len(body)
        yield body[begin:stop].split()
        begin = stop


def with_arrow_columns(
    batch: pa.RecordBatch, drop: tuple[str, ...], added: dict[str, pa.Array]
) -> pa.RecordBatch:
    """``batch`` without ``drop`` and with further columns at its end."""
    names = [name for name in batch.schema.names if name not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(name) for name in names] + list(added.values()), names + list(added)
    )




def shared_files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    return pa.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def write_file(uri: str, name: str, chunks: Iterable[bytes]) -> None:
    """Write a file below ``uri`` under a temporary name and rename it when complete.

    A retried or speculative task replaces the file by one of equal content.
    """
    files, folder = shared_files(uri)
    files.create_dir(folder, recursive=True)
    partial = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(partial, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(partial, f"{folder}/{name}")
