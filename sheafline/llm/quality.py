"""Quality rules with distribution divergence, in DataFrame expressions only.

Per document: counts for the base rules, a histogram of character classes and one of the language's common words, in
lower case and without marks.  The references are each language's mean histograms over all documents that pass the base
rules and are long enough; every document weighs the same, so one huge text can't move them.  Both Jensen-Shannon
distances to the reference are added up, less an allowance for what chance adds to the histogram of a short text.  A
document is rejected if it fails the base rules or if this excess lies far beyond those of its language's documents, by
their quartiles.  Means and quartiles come from whole numbers, so the order of rows can't change a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stage, text_or_empty

#: Common words by language.
COMMON_WORDS = {
    "en": "the of and to a in is that for with was on as by at from it be are this or an which not his he they have but had".split(),
    "fr": "de la le et les des en un du une que est dans pour qui par sur au pas plus ne il se ce sont avec son ou aux cette".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
MARKS = ".,;:!?()[]«»“”‘’'\"-"
#: References come from documents of so many words and characters or more: histograms of shorter texts are too coarse.
LEAST_WORDS, LEAST_CHARS = 80, 400
#: The excess of a document is the sum of its distances less ALLOWANCE / sqrt(words); it is too far if it lies FENCE
#: interquartile ranges beyond its language's upper quartile, Tukey's fence for far outliers.
ALLOWANCE, FENCE = 1.0, 3.0
#: Whole numbers: parts of a share that means count in, bins of an excess of 1 that quartiles count in.
PARTS, BINS = 1_000_000_000, 2000
SYMBOLS = "#*$%&|<>"
WINDOW = 8
WORDS = max(map(len, COMMON_WORDS.values()))


def only(text: Column, kept: str) -> Column:
    """Code points of a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def normalised(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance, the square root of the divergence with base 2; null if either is null."""
    part = lambda x, m: F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(F.lit(0.0))
    each = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def features(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns of docs under __doc, and the counts and histograms under __ names."""
    text = text_or_empty()
    lang = F.lower(F.col("lang").cast("string")) if "lang" in docs.columns else F.lit(None).cast("string")
    known_lang = F.when(lang.isin(*COMMON_WORDS), lang).otherwise("")  # all others share one reference
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("__doc"), text.alias("__text"), known_lang.alias("__lang"))
    two = one.withColumns({
        "__words": F.array_remove(F.split("__text", f"[{SPACES}]+", -1), ""),
        "__lines": F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")),
    })
    each = [F.octet_length("__text") - F.octet_length(F.replace(F.col("__text"), F.lit(c), F.lit(""))) for c in SYMBOLS]
    symbols = each[0]
    for x in each[1:]:
        symbols = symbols + x
    three = two.select(
        "__doc", "__text", "__lang", "__words",
        F.size("__words").cast("long").alias("__n"),
        F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        symbols.cast("long").alias("__symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    for k in (1, 2, 4):  # hashes of 2, 4 and 8 words from those of half as many; what is past the end is cut off below
        three = three.withColumn("__hashes", F.zip_with("__hashes", F.slice("__hashes", F.lit(k + 1), F.size("__hashes")), lambda x, y: F.xxhash64(x, y)))
    three = three.withColumn("__hashes", F.slice("__hashes", F.lit(1), F.greatest(F.size("__hashes") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    four = three.withColumn("__sorted", F.when(repeats, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s, last = F.col("__sorted"), F.size("__sorted") - 1
    twice = F.filter("__sorted", lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == x["h"])))
    five = four.withColumn("__places", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        "__places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")),
    )["n"]
    classes = F.array(*[x.cast("double") for x in (
        only(F.col("__text"), "A-Z"), only(F.col("__text"), "a-z"), only(F.col("__text"), "0-9"), F.length("__text") - F.col("__word_chars"),
        only(F.col("__text"), ".,;:!?'\"()-"), F.col("__symbols"), F.length(F.regexp_replace("__text", "[\\x00-\\x7F]+", "")),
    )])
    plain = F.array_remove(F.split(F.translate(F.lower("__text"), MARKS, " " * len(MARKS)), f"[{SPACES}]+", -1), "")
    # common words as their numbers; counting whole numbers costs no object per word
    numbered = F.lit(None).cast("array<int>")
    for lang, common in COMMON_WORDS.items():
        numbered = F.when(F.col("__lang") == lang, F.transform(F.filter(plain, lambda x: x.isin(*common)), lambda x: F.array_position(F.array(*map(F.lit, common)), x).cast("int"))).otherwise(numbered)
    five = five.withColumn("__numbers", numbered)
    # one expression for all words: forty of them side by side make generated code that is too long to be compiled
    counts = F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda k: (F.size("__numbers") - F.size(F.array_remove("__numbers", k))).cast("double"))
    hits = F.when(F.col("__numbers").isNotNull(), counts)
    return five.select(
        "__doc", "__lang", "__n", "__word_chars", "__symbols", "__dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("__repeats"), F.length("__text").alias("__chars"),
        classes.alias("__classes"), hits.alias("__hits"),
    )


def upper_fence(excess: DataFrame, fence: float = FENCE) -> DataFrame:
    """excess(__lang, __bin), a row per document -> __lang, __fence: the bin beyond which a document is too far.

    Documents are counted per language and bin before they are ordered, so the window sees at most a row per bin.
    """
    counts = excess.groupBy("__lang", "__bin").agg(F.count("*").alias("n"))
    every = Window.partitionBy("__lang")
    ranked = counts.withColumns({"up_to": F.sum("n").over(every.orderBy("__bin")), "all": F.sum("n").over(every)})
    quartile = lambda k: F.min(F.when(4 * F.col("up_to") >= k * F.col("all"), F.col("__bin")))
    return ranked.groupBy("__lang").agg((quartile(3) + fence * (quartile(3) - quartile(1))).alias("__fence"))


def judge(docs: DataFrame, carried: list[str] | None = None, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS, allowance: float = ALLOWANCE, fence: float = FENCE) -> DataFrame:
    """Every row of docs with its counts, distances, __base_failed and __kept; its carried columns (all) under __doc.

    A null text is empty and fails; null and unknown languages share one reference and have no common words.
    Repeated rows are judged alike; an empty table gives an empty result; other columns, whatever their names, are
    carried under __doc untouched.
    """
    made = features(docs, carried or docs.columns)
    failed = (F.col("__n") < 20) | (F.col("__repeats") * 100 > F.col("__n") * 30)
    rest = F.col("__n") - F.aggregate("__hits", F.lit(0.0), lambda a, x: a + x)
    held = stage(made.select("*", failed.alias("__base_failed"), normalised(F.col("__classes")).alias("__p"), normalised(F.concat("__hits", F.array(F.greatest(rest, F.lit(0.0))))).alias("__q")), "quality-features")
    good = held.where(~F.col("__base_failed") & (F.col("__n") >= least_words) & (F.col("__chars") >= least_chars))
    mean = lambda c, size: F.array(*[F.sum(F.round(F.col(c)[i] * PARTS).cast("long")) / F.count(F.col(c)[i]) / PARTS for i in range(size)])
    references = good.groupBy("__lang").agg(mean("__p", 7).alias("__rp"), mean("__q", WORDS + 1).alias("__rq"))
    near = held.join(F.broadcast(references), "__lang", "left")  # a row per known language and one more
    near = near.withColumns({"__char_distance": jensen_shannon(F.col("__p"), F.col("__rp")), "__word_distance": jensen_shannon(F.col("__q"), F.col("__rq"))})
    excess = F.coalesce("__char_distance", F.lit(0.0)) + F.coalesce("__word_distance", F.lit(0.0)) - allowance / F.sqrt(F.greatest(F.col("__n"), F.lit(1)))
    near = near.withColumn("__bin", F.floor(F.round(excess, 9) * BINS))
    fences = upper_fence(near.where(~F.col("__base_failed")).select("__lang", "__bin"), fence)
    near = near.join(F.broadcast(fences), "__lang", "left")  # a row per known language and one more
    return near.withColumn("__kept", ~F.col("__base_failed") & ~F.coalesce(F.col("__bin") > F.col("__fence"), F.lit(False)))


def quality_verdicts(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the counts, base_failed, kept and both distances for every row of docs."""
    return judge(docs, ["doc_id"], **limits).select(
        F.col("__doc.doc_id").cast("long").alias("doc_id"), F.col("__n").alias("n_words"), F.col("__word_chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__dup_lines").alias("n_dup_lines"), F.col("__repeats").alias("n_repeat_words"),
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.round("__char_distance", 6).alias("char_distance"), F.round("__word_distance", 6).alias("word_distance"),
    )
