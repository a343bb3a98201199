import pytest


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(("en", "s") if len(r) == 2 else ())) for r in rows]
    full = [(*r, len(r[1] or "")) for r in full]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [(None, None), (None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "x" * 30_000), (6, long), (7, "same text twice"), (7, "same text twice"), (8, "same text twice"), (9, "dernière ligne 日本 \U0001f600")]
    frame = documents(spark, rows)
    for name in ("row", "size", "key", "fp", "found", "__words", "shard", "length", "digest"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [(1, "x")]).where("false")
