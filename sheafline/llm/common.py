"""Shared plumbing: staged tables, Arrow batch sizes and text chunks of bounded size."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder, ship

#: Rows and bytes of one Arrow batch sent to a Python worker; a single longer row still travels whole.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20

#: White space of the word contracts: \x20 and \x09-\x0D; bytes.split() splits on exactly these.
SPACES = "\\x20\\x09-\\x0D"


def arrow_limits(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a worker's memory does not grow with the length of texts, and see that
    workers can import the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    path = shared_folder(spark, name)
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at the end of the program: the session may be gone by then."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` characters with the index of their first text; null counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        held.append(text)
        size += len(text)
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


#: Bits of a membership bitmap: BITS_A_KEY for each key, of which at most MOST_BITS / 64 rows of one word are broadcast.
BITS_A_KEY, MOST_BITS = 8, 1 << 26


def with_marks(frame: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """frame with `marked`: false only where no row of keys, a staged table, has the same value in the column (a long).

    The bitmap grows with the keys; with more than it can hold in its largest size every row is marked, without a
    bitmap.  A marked row still has to be joined.
    """
    bits = 1 << max(16, (BITS_A_KEY * keys.count() - 1).bit_length())
    if bits > MOST_BITS:
        return frame.withColumn("marked", F.lit(True))
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(slot.alias("__slot")).groupBy(F.expr("__slot div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__slot % 64 as int)))").alias("__bits"))
    placed = frame.withColumn("__slot", slot).withColumn("__word", F.expr("__slot div 64")).join(F.broadcast(words), "__word", "left")
    hit = F.expr("getbit(__bits, cast(__slot % 64 as int)) = 1")
    return placed.withColumn("marked", F.coalesce(hit, F.lit(False))).drop("__slot", "__word", "__bits")
