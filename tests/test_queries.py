"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import duck, rows_of
from sheafline import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small).toPandas()) == rows_of(duck(SQL[name], small))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert {"doc_id", "value", "review_reasons"} <= set(frame.columns) and frame.count() > 0


def test_verified_answers_are_never_wrong(spark, small):
    """What the vote verifies is what the page says, whatever one reader makes of it."""
    from pyspark.sql import functions as F

    from sheafline.plans import scalars, votes
    from sheafline.sources.tables import table

    opening = scalars.opening(table(spark, small, "documents")).select("doc_id", F.array_join("kept", " ").alias("truth")).toPandas()
    voted = votes.vote_words(spark, small).toPandas().merge(opening, on="doc_id")
    verified = voted[voted.words_verified == "YES"]
    letters = lambda s: "".join(c for c in s if c.isalnum())
    assert len(verified) and (verified.value.map(letters) == verified.truth.map(letters)).all()
