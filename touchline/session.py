"""Session defaults and the few places where a plan touches the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the plans assume (UTC clock, AQE on)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; a local session without one gets its own.

    A cluster without ``spark.checkpoint.dir`` is refused: executors would write to their
    own disks and later reads would miss those files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/touchline-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where several later steps would otherwise each recompute an expensive plan. The
    table survives lost executors and keeps column pruning, unlike a cached RDD.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    owner = _OWNER.get()
    if owner is not None:
        owner.append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Narrow tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 50_000


def joinable(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Write a table of parameters once; mark it for broadcasting only if its row count allows."""
    written = materialise(df)
    return F.broadcast(written) if written.count() <= max_rows else written


_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Remove what ``materialise`` writes inside, once the block ends; results must be stored by then."""
    written: list[str] = []
    token = _OWNER.set(written)
    try:
        yield
    finally:
        _OWNER.reset(token)
        for path in written:
            remove(spark, path)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; none if it does not exist."""
    files, place = _folder(spark, path)
    found = files.listStatus(place) if files.exists(place) else []
    return sorted(entry.getPath().getName() for entry in found if entry.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)
