"""Corpus preparation: quality rules, near-duplicates, secrets and packing, each stage over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafline.llm import neardup, packing, quality, secret_scan
from sheafline.llm.common import read_table, stage


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs).where("__kept").select("__doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.keep_one(docs, width=5, numerator=80, denominator=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.mask_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [("quality_rules", drop_low_quality), ("near_dedup", drop_near_duplicates), ("secret_scan", mask_secrets), ("packing", pack_sequences)]

#: Sketches, byte-level BPE and packing have no SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
