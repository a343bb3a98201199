"""Capture as a stream: new files or rows arrive, are processed and land in a result table exactly once.

Each micro-batch is written under its own id with overwrite, so a replay after a failure gives the same table; a page
captured again replaces its older row when the table is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def capture(stream: DataFrame, process: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing process(micro-batch) under results/batch_id=..; available_now stops after what is there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def captured(spark: SparkSession, results: str, keys: list[str], order: str) -> DataFrame:
    """The latest row of every key among all batches; of one batch the one with the greatest order."""
    rows = spark.read.parquet(results)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("batch_id", order)).alias("r"))
    return latest.select(*keys, "r.*")


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a landing folder, or of a glob, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """Captured photos of a landing folder as (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg}").load(path)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """An extension beyond capture: counts per tumbling window, later rows than the watermark dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
