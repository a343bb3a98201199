"""Queries that run as streams over what is available and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder
from ..sources.tables import table
from ..streaming import capture


def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events captured as a stream: each user's latest event, from an idempotent append."""
    schema = table(spark, sf_dir, "events").schema
    results, state = shared_folder(spark, "captured"), shared_folder(spark, "capture-state")
    # a glob of one file is what the file source takes where a table is a single file
    stream = capture.file_stream(spark, f"{sf_dir}/events.parquet*", schema)
    slim = lambda batch: batch.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
    capture.capture(stream, slim, results, state).awaitTermination()
    return capture.captured(spark, results, ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


CAPTURE_SQL = "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"

QUERIES = {"capture_stream": (capture_stream, CAPTURE_SQL)}
