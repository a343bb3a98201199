"""Data-quality rules on matched records: doubts become reasons, never silent guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hamming

# Floors and lengths.
SUBJECT_FLOOR, TYPO_LENGTH, TYPO_OFF, WORD_LENGTH, RARE_ZIPF, RARE_LENGTH = 85.0, 5, 2, 4, 3.0, 3


def add_reasons(reasons: Column, more: Column) -> Column:
    """Reasons joined by bars; nulls and empty ones are left out."""
    return F.array_join(F.filter(F.concat(F.array(reasons), more), lambda r: r.isNotNull() & (r != "")), " | ")


def typos(subjects: DataFrame, releases: DataFrame, keys: list[str]) -> DataFrame:
    """subjects(keys, word), releases(keys, word): subject words the release doesn't hold but spells one or two letters
    differently, with the first such word in order.

    Of three parts of a word with two letters off one is whole, so candidates meet on the key, the length and a part.
    """
    seen = releases.select(*keys, "word").distinct()
    unseen = subjects.select(*keys, "word").distinct().join(seen, [*keys, "word"], "left_anti").where(F.length("word") >= TYPO_LENGTH)

    def parted(frame: DataFrame, name: str) -> DataFrame:
        n = F.length("word")
        third = F.floor(n / (TYPO_OFF + 1)).cast("int")
        parts = F.array(*[F.struct(F.lit(k).alias("k"), F.substr("word", third * k + 1, third if k < TYPO_OFF else n).alias("part")) for k in range(TYPO_OFF + 1)])
        return frame.select(*keys, F.col("word").alias(name), n.alias("n"), F.explode(parts).alias("p"))

    near = parted(unseen, "word").join(parted(seen.where(F.length("word") >= TYPO_LENGTH), "other"), [*keys, "n", "p"])
    off = hamming(F.col("word"), F.col("other"))
    return near.where(off.between(1, TYPO_OFF)).groupBy(*keys, "word").agg(F.min("other").alias("release_word"))


def doubts(words: DataFrame, releases: DataFrame, keys: list[str]) -> DataFrame:
    """words(keys, word, conf, also) the release doesn't hold and that were read weakly or contradicted; a null `also`
    means not checked and raises no doubt."""
    seen = releases.select(*keys, "word").distinct()
    return words.join(seen, [*keys, "word"], "left_anti").where((F.col("conf") < SUBJECT_FLOOR) | (F.col("also").isNotNull() & ~F.col("also"))).select(*keys, "word")


def unknown(words: DataFrame, names: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """words(keys, word as printed) that are no capitalised name of the release and no known word, or rare in lower case.
    frequency(word, zipf): a word list."""
    keyed = words.withColumn("k", F.lower("word"))
    left = keyed.join(names.select(*keys, F.col("word").alias("k")).distinct(), [*keys, "k"], "left_anti")
    scored = left.join(frequency.select(F.col("word").alias("k"), "zipf"), "k", "left").withColumn("zipf", F.coalesce("zipf", F.lit(0.0)))
    lower = F.col("word") == F.col("k")
    return scored.where(((F.length("k") >= WORD_LENGTH) & (F.col("zipf") == 0)) | (lower & (F.length("k") >= RARE_LENGTH) & (F.col("zipf") < RARE_ZIPF))).select(*keys, "word")


def decide(method: Column, confident: Column, shared: Column, duplicate: Column, has_entry: Column, candidates: Column, doubt: Column, typo: Column, odd: Column, cut: Column, stray: Column) -> dict[str, Column]:
    """The decision table of a match: verified, the method told, and its reasons.  doubt, typo, odd and candidates are
    joined lists, empty if there are none."""
    settled = method == "date+text"
    reasons = F.array(
        F.when(~has_entry & ~((method == "none") & (candidates == "")), F.concat(F.when(method == "none", F.lit("no subject found in the list page")).otherwise(F.lit("subject could not be settled")), F.when(candidates != "", F.concat(F.lit(" (possible: "), candidates, F.lit(")"))).otherwise(F.lit("")))),
        F.when(has_entry & ~shared & duplicate, F.lit("another release in the folder reads the same and has the same subject; check for a duplicate copy")),
        F.when(has_entry & ~shared & (method == "date"), F.lit("subject matched by date only; the release text does not confirm it")),
        F.when(has_entry & ~shared & (method == "text"), F.lit("subject matched by its text only")),
        F.when(has_entry & ~shared & settled & (doubt != ""), F.concat(F.lit("subject may be misread ("), doubt, F.lit("); check its spelling"))),
        F.when(has_entry & ~shared & settled & (typo != ""), F.concat(F.lit("subject may have a typo ("), typo, F.lit("); check which spelling is right"))),
        F.when(has_entry & ~shared & settled & (odd != ""), F.concat(F.lit("subject has words that are not English and not named in the release ("), odd, F.lit("); check their spelling"))),
        F.when(has_entry & ~shared & settled & cut, F.lit("subject looks cut short (it ends mid-way); check the rest on the list page")),
        F.when(has_entry & ~shared & settled & (stray != ""), F.concat(F.lit("subject has marks no typewriter types ("), stray, F.lit("); check it"))),
    )
    clean = confident & (doubt == "") & (typo == "") & (odd == "") & ~cut & (stray == "")
    return {"verified": F.when(has_entry & ~shared & clean, "YES").otherwise("NO"), "method": F.when(has_entry & shared, "shared").otherwise(method), "reasons": F.array_compact(reasons)}
