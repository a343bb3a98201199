"""Adapters from plain tables to pages, lines, words and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The typed page: pixels of a character, a line's height and the distance of lines.
CHAR_PX, LINE_PX, PITCH_PX, LEFT_PX, TOP_PX = 12, 30, 60, 100, 100
#: The readers in the order in which they vote.
READERS = ("tesseract", "easyocr", "doctr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_words(text: Column) -> Column:
    """Words of a line as structs of text and c0, the character they begin at when one space parts them."""
    kind = "array<struct<text:string,c0:int>>"
    step = lambda a, t: F.struct((a["at"] + F.length(t) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(t.alias("text"), a["at"].alias("c0")))).alias("out"))
    return F.aggregate(F.array_remove(F.split(text, r"\s+"), ""), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])


def page_lines(docs: DataFrame) -> DataFrame:
    """(page, line, text, lang): each document is a page, each line break starts a line; narrow, no shuffle."""
    return docs.select(F.col("doc_id").alias("page"), "lang", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def line_words(lines: DataFrame) -> DataFrame:
    """(page, line, word, text, x0, y0, x1, y1) with boxes on the typed page."""
    flat = lines.select("page", "line", F.posexplode(placed_words(F.col("text"))).alias("word", "w"))
    x0 = F.lit(LEFT_PX) + F.col("w.c0") * CHAR_PX
    y0 = F.lit(TOP_PX) + F.col("line") * PITCH_PX
    return flat.select("page", "line", "word", F.col("w.text").alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + F.length("w.text") * CHAR_PX).alias("x1"), (y0 + LINE_PX).alias("y1"))


def swap_first_letter(word: Column) -> Column:
    """A misread word: its first letter becomes the next one of the alphabet."""
    return F.concat(F.translate(F.substr(word, F.lit(1), F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza"), F.substr(word, F.lit(2)))


def perturbed(key: Column, words: Column, reader: int) -> Column:
    """What a reader makes of words: by the key modulo small primes it drops punctuation, misreads or reads nothing."""
    none = F.array().cast("array<string>")
    if reader == 0:
        return F.when(key % 23 == 0, none).otherwise(words)
    if reader == 1:
        dropped = F.transform(words, lambda w: F.regexp_replace(w, "[.,]", ""))
        misread = F.transform(words, lambda w, i: F.when(i == 0, swap_first_letter(w)).otherwise(w))
        return F.when(key % 5 == 0, misread).when(key % 3 == 0, dropped).otherwise(words)
    return F.when(key % 7 == 0, none).when(key % 11 == 0, F.transform(words, lambda w: F.concat(w, F.lit(";")))).otherwise(words)
