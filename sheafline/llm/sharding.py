"""Sharding by longest-processing-time scheduling.

Rows of equal text stay together.  Groups are dealt by the hash of their text into a fixed number of bundles; the
bundles, largest first, each go to the shard that is least loaded, taken from a heap.  Everything the driver sees is
bounded by the number of bundles, whatever the input: a group that holds a third of all rows is one bundle's sum,
made by map-side aggregation.

Places within a shard are gapless without a global sort: rows are numbered within cells (shard, hash), and a table of
at most shards x cells counts gives each cell its offset.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

BUNDLES, CELLS = 1 << 18, 4096


def longest_first(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item: items by falling size (ties: first given), each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = np.zeros(len(sizes), dtype=np.int32)
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, shard = heap[0]
        out[i] = shard
        heapq.heapreplace(heap, (load + int(sizes[i]), shard))
    return out


def assign_shards(docs: DataFrame, shards: int = 16, bundles: int = BUNDLES, cells: int = CELLS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and counts as equal to the empty text.  Null doc_ids and repeated rows are placed like any
    others; ties are settled by the order of bundles.  An empty table gives an empty result; other columns of docs
    are ignored.  Law: bytes; sizes differ by at most the largest group of equal texts.
    """
    spark, text = docs.sparkSession, text_or_empty()
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(bundles)).cast("int").alias("bundle"),
            F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(cells)).cast("int").alias("cell"),
        ),
        "shard-rows",
    )
    loads = rows.groupBy("bundle").agg(F.sum("size").alias("size")).toArrow().sort_by("bundle")
    placed = longest_first(loads["size"].to_numpy(), shards)
    table = pa.table({"bundle": loads["bundle"].cast(pa.int32()), "shard": pa.array(placed, type=pa.int32())})
    plan = F.broadcast(spark.createDataFrame(table))  # at most `bundles` rows
    rows = rows.join(plan, "bundle")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "cell").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(inside))
    placed_rows = numbered.join(F.broadcast(offsets.drop("count")), ["shard", "cell"])  # at most shards x cells rows
    return placed_rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
