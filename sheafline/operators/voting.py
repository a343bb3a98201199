"""Majority voting of several readers with written reasons.

The first reader with a value is primary.  A value is verified only if the primary is the first reader, at least two
readers support it and more support it than do not; a missing reading counts against it.  Every doubt becomes a reason.
Readings of a page are one array, so a vote is a row-wise expression and needs no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTER_OR_NUMBER, alnum

# Confidence floors by reader, and the floor for the first where three or more agree and none dissents.
FLOORS = {"tesseract": 90.0, "easyocr": 30.0}
AGREED_READERS, AGREED_FLOOR = 3, 80.0
NO_TEXTS = "array<string>"
# A doubt that a later reader's agreement with the first one settles.
SETTLED = "second engine's body start located by position only"


def marks(word: Column) -> Column:
    """Characters that are neither letters nor digits."""
    return F.filter(F.split(F.regexp_replace(word, f"[{LETTER_OR_NUMBER}]", ""), ""), lambda c: c != "")


def adds_marks(primary: Column, other: Column) -> Column:
    """Does the other reading hold a mark more often than the primary?"""
    mine = marks(primary)
    theirs = marks(other)
    many = lambda a, c: F.size(F.filter(a, lambda x: x == c))
    return F.exists(theirs, lambda c: many(theirs, c) > many(mine, c))


def same_words(primary: Column, other: Column) -> Column:
    """Letters and digits equal word by word, case included; the other may omit marks but not add any."""
    pairs = F.arrays_zip(primary.alias("p"), other.alias("o"))
    return (F.size(primary) == F.size(other)) & F.forall(pairs, lambda x: (alnum(x["p"]) == alnum(x["o"])) & ~adds_marks(x["p"], x["o"]))


def merge_flags(readings: Column) -> Column:
    """readings: array<struct<reader,flags>>.  A flag that all raise is told once, others with their reader before it."""
    told = lambda r: F.transform(r["flags"], lambda f: F.when(F.forall(readings, lambda o: F.array_contains(o["flags"], f)), f).otherwise(F.concat(r["reader"], F.lit(": "), f)))
    return F.array_distinct(F.flatten(F.transform(readings, told)))


def low_confidence(reader: Column, texts: Column, confs: Column, agreed: Column) -> Column:
    """Reasons for words under the reader's floor; agreed: how many readers agree if none dissents, else 0."""
    floor = F.coalesce(F.create_map(*[x for k, v in FLOORS.items() for x in (F.lit(k), F.lit(v))])[reader], F.lit(0.0))
    floor = F.when((reader == "tesseract") & (agreed >= AGREED_READERS), F.least(floor, F.lit(AGREED_FLOOR))).otherwise(floor)
    pairs = F.filter(F.arrays_zip(texts.alias("t"), confs.alias("c")), lambda x: x["c"] < floor)
    number = lambda c: F.bround(c, 0).cast("int").cast("string")
    return F.transform(pairs, lambda x: F.concat(reader, F.lit(" confidence "), number(x["c"]), F.lit(" < "), number(floor), F.lit(" on '"), x["t"], F.lit("'")))


def vote(frame: DataFrame, has, same, readings: str = "readings") -> DataFrame:
    """Adds primary_at (from 0, null if no reader has a value), primary, backs (which readers support it), supporters,
    dissenters and verified to rows with an array of readings in voting order.

    Each step is a column of its own, so that later ones read it instead of repeating its expression.
    """
    filled = F.transform(readings, lambda r, i: F.when(has(r), i))
    found = frame.withColumn("primary_at", F.array_min(filled)).withColumn("primary", F.get(F.col(readings), F.col("primary_at")))
    backs = F.transform(readings, lambda r: F.coalesce(has(r) & same(F.col("primary"), r), F.lit(False)))
    counted = found.withColumn("backs", backs).withColumn("supporters", F.size(F.filter("backs", lambda b: b)))
    counted = counted.withColumn("dissenters", F.size(readings) - F.col("supporters"))
    majority = (F.col("primary_at") == 0) & (F.col("supporters") >= 2) & (F.col("supporters") > F.col("dissenters"))
    return counted.withColumn("verified", F.coalesce(majority, F.lit(False)))


def _settle(voted: DataFrame, value: Column, differ, low, only: str, nothing: str, confidence: Column, settled: str | None = None) -> DataFrame:
    """value, confidence and reasons from a vote.  Doubts of all readings count unless a majority outvoted the odd ones;
    the one named `settled` counts against a later reader only where the vote doesn't verify the value."""
    counted = voted.withColumn("counted", F.filter("readings", lambda r, i: ~F.col("verified") | F.get(F.col("backs"), i)))
    counted = counted.withColumn("others", F.filter("readings", lambda r, i: ~F.get(F.col("backs"), i)))
    counted = counted.withColumn("agreed", F.when(F.col("verified") & (F.col("dissenters") == 0), F.col("supporters")).otherwise(F.lit(0)))
    none = F.array().cast(NO_TEXTS)
    alone = F.when(F.col("primary_at") > 0, F.array(F.concat(F.lit(only), F.col("primary.reader")))).otherwise(none)
    # of a verified value the primary is the first of those counted
    forgiven = lambda r, i: F.when(F.col("verified") & (i > 0), F.array_remove(r["flags"], settled)).otherwise(r["flags"])
    heard = F.transform("counted", lambda r, i: F.struct(r["reader"].alias("reader"), forgiven(r, i).alias("flags"))) if settled else F.col("counted")
    told = counted.withColumn("heard", heard).withColumn("flags", merge_flags(F.col("heard"))).withColumn("low", F.flatten(F.transform("counted", low)))
    told = told.withColumn("doubts", F.when(F.col("verified"), none).otherwise(F.concat(alone, F.transform("others", differ))))
    empty = F.col("primary_at").isNull()
    return told.withColumns({
        "value": F.when(empty, F.lit("")).otherwise(value), "confidence": F.when(F.col("verified"), confidence).otherwise(F.lit(0.0)),
        "reasons": F.when(empty, F.concat("flags", F.array(F.lit(nothing)))).otherwise(F.concat("flags", "doubts", "low")),
    })


def reconcile_words(frame: DataFrame) -> DataFrame:
    """frame with readings array<struct<reader, texts, confs, flags>> -> with value, confidence, reasons and the vote."""
    voted = vote(frame, lambda r: F.size(r["texts"]) > 0, lambda a, b: same_words(a["texts"], b["texts"]))
    voted = voted.withColumn("said", F.array_join("primary.texts", " "))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    differ = lambda r: F.concat(F.lit("engines disagree on first words: "), F.col("primary.reader"), F.lit(" "), quoted(F.col("said")), F.lit(" vs "), r["reader"], F.lit(" "), quoted(F.array_join(r["texts"], " ")))
    low = lambda r: low_confidence(r["reader"], r["texts"], r["confs"], F.col("agreed"))
    return _settle(voted, F.col("said"), differ, low, "first words only read by ", "no article words found", F.array_min("primary.confs"), SETTLED)


def same_date(a: Column, b: Column) -> Column:
    return (a["iso"] == b["iso"]) & (alnum(a["printed"]) == alnum(b["printed"]))


def reconcile_date(frame: DataFrame) -> DataFrame:
    """frame with readings array<struct<reader, iso, printed, conf, flags>> -> with value, confidence, reasons and the
    vote."""
    voted = vote(frame, lambda r: r["iso"].isNotNull(), same_date)
    differ = lambda r: F.when(r["iso"].isNull(), F.concat(r["reader"], F.lit(" found no date"))).otherwise(
        F.concat(F.lit("engines disagree on date: "), F.col("primary.reader"), F.lit(" '"), F.col("primary.printed"), F.lit("' vs "), r["reader"], F.lit(" '"), r["printed"], F.lit("'")))
    low = lambda r: F.when(r["iso"].isNull(), F.array().cast(NO_TEXTS)).otherwise(low_confidence(r["reader"], F.array(r["printed"]), F.array(r["conf"]), F.col("agreed")))
    return _settle(voted, F.col("primary.iso"), differ, low, "date only read by ", "no release date found", F.col("primary.conf"))


def worse(missing: Column, reasons: Column) -> Column:
    """Sort key of a result: missing fields, then the number of separators in its reasons (none and one tie)."""
    return F.struct(missing.alias("missing"), F.greatest(F.size(F.split(reasons, r" \| ")) - 1, F.lit(0)).alias("separators"))
