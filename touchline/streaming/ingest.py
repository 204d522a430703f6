"""Incremental ingest of frame files with Structured Streaming.

Every run picks up the files that arrived since the last one and stops
(``availableNow``). Each micro-batch overwrites its own folder, so a retried batch leaves
no duplicates. Lines that do not parse go to a quarantine table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schemas


def frame_stream(spark: SparkSession, folder: str, *, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.FRAME_JSON).option("mode", "PERMISSIVE")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(f"{folder}/matches/*/*_tracking_extrapolated.jsonl")
    match_id = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)
    return rows.select(match_id.alias("match_id"), *schemas.FRAME_JSON.names)


def ingest_frames(
    spark: SparkSession, folder: str, out: str, checkpoint: str, *, max_files: int | None = None
) -> int:
    """Append new frames below ``out``/frames and bad lines below ``out``/quarantine.

    Returns the number of micro-batches of this run.
    """
    batches: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        bad = F.col("_corrupt_record").isNotNull() | F.col("frame").isNull() | F.col("period").isNull()
        batch.filter(~bad).drop("_corrupt_record").write.mode("overwrite").parquet(f"{out}/frames/batch={batch_id}")
        batch.filter(bad).select("match_id", "_corrupt_record").write.mode("overwrite").parquet(
            f"{out}/quarantine/batch={batch_id}"
        )
        batches.append(batch_id)

    running = (
        frame_stream(spark, folder, max_files=max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return len(batches)
