"""Secret scanning with corpus-wide ownership, in DataFrame expressions only.

Spans of three base kinds (assign, access, hex) are found by regular expressions; places are running sums over the
lengths of the matches and of what lies between them, so a text takes time in proportion to its matches.  The method
looks at candidate values across the corpus: a value's hash is counted by distinct repositories and distinct owners.  A
repository is the context the value stands in, up to CONTEXT characters on either side: exact and near copies of a
document are one.  It has one owner, the least of the sources that hold it.  A value in many repositories of several
owners is a widely copied example; any other that looks live is a credential, and its span is added as kind `live`.
Base spans stay whatever the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A credential-like run: whole, long and with a digit; its classes are checked later.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")

#: A value is an example if more owners than this hold it and more repositories repeat it.
MOST_OWNERS, MOST_REPOSITORIES = 2, 3
CONTEXT = 40  # characters on either side, as far as the neighbouring candidates
MASK = "[SECRET]"


def looks_live(value: Column) -> Column:
    """Digits and letters mixed, at least 8 distinct characters: neither a word nor a number nor a ruler of dashes."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def matches(text: Column, pattern: str, kind: int, holds) -> Column:
    """All matches of a pattern with their lengths and those of the gaps before them, in code points and in bytes."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(found)
    whole = F.arrays_zip(found.alias("value"), F.slice(between, F.lit(1), n).alias("gap"), F.slice(between, F.lit(2), n).alias("after"))
    context = lambda x: F.xxhash64(F.right(x["gap"], F.lit(CONTEXT)), F.left(x["after"], F.lit(CONTEXT)))
    return F.transform(whole, lambda x: F.struct(
        F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.octet_length(x["gap"]).alias("gap_bytes"), F.length(x["value"]).alias("length"), F.octet_length(x["value"]).alias("bytes"), holds(x["value"]).alias("holds"),
        (F.sha2(x["value"], 256) if kind == 3 else F.lit(None).cast("string")).alias("hash"), (context(x) if kind == 3 else F.lit(None).cast("long")).alias("context"),
    ))


def scanned(docs: DataFrame) -> DataFrame:
    """Every row of docs as __doc, with __owner and __found, the matches of all kinds; __any tells whether there are any.

    Each kind has a guard that costs little, so most texts meet no expensive pattern.
    """
    text = text_or_empty()
    low = F.lower(text)
    worth = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), text.alias("__text"), owner.alias("__owner"), worth.alias("__worth"))
    t = F.col("__text")
    guards = (F.col("__worth") & t.rlike(ASSIGN), t.contains("AKIA") & t.rlike(ACCESS), t.rlike(HEX), t.rlike(CANDIDATE))
    kinds = ((ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6), (ACCESS, lambda v: F.lit(True)), (HEX, lambda v: F.lit(True)), (CANDIDATE, looks_live))
    found = [F.when(g, matches(t, pattern, k, holds)) for k, (g, (pattern, holds)) in enumerate(zip(guards, kinds))]
    some = guards[0] | guards[1] | guards[2] | guards[3]
    return wide.select("__doc", "__owner", some.alias("__any"), F.flatten(F.array_compact(F.array(*found))).alias("__found"))


def placed(some: DataFrame) -> DataFrame:
    """some: __row, __owner, __found -> a row per span that holds: __row, __owner, kind, start, end, start_byte, end_byte,
    hash, context."""
    each = some.select("__row", "__owner", F.posexplode("__found").alias("at", "x")).select("__row", "__owner", "at", "x.*")
    so_far = Window.partitionBy("__row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumns({"end": F.sum(F.col("gap") + F.col("length")).over(so_far), "end_byte": F.sum(F.col("gap_bytes") + F.col("bytes")).over(so_far)})
    return each.where("holds").select("__row", "__owner", "kind", (F.col("end") - F.col("length")).alias("start"), "end", (F.col("end_byte") - F.col("bytes")).alias("start_byte"), "end_byte", "hash", "context")


def judged(spans: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Staged spans with `example`: true for candidates that many repositories of several owners repeat, false for other
    candidates and for base spans.

    Hashes are counted after the distinct (hash, context) are made, so a value that a third of all rows repeat is one
    row per task and context before it is shuffled.
    """
    candidates = spans.where("kind = 3")
    owned = candidates.groupBy("hash", "context").agg(F.min("__owner").alias("owner"))
    counts = owned.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    examples = counts.where((F.col("owners") > most_owners) & (F.col("repositories") > most_repositories)).select("hash", F.lit(True).alias("example"))
    told = candidates.join(examples, "hash", "left").withColumn("example", F.coalesce("example", F.lit(False)))
    return spans.where("kind < 3").withColumn("example", F.lit(False)).unionByName(told)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples for every row of docs.

    live: candidate values that are no examples, owned by at most most_owners owners or repeated in at most
    most_repositories repositories.  A null text has no spans; a null source is one owner; null doc_ids and repeated
    rows are kept; an empty table gives an empty result; other columns are ignored.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    found = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), source.alias("source")))
    rows = stage(found.select(F.monotonically_increasing_id().alias("__row"), F.col("__doc.doc_id").alias("doc_id"), "__owner", "__any", "__found"), "secret-rows")
    spans = judged(stage(placed(rows.where("__any")), "secret-spans"), most_owners, most_repositories)
    span = F.struct("start", "kind", "end")
    base = F.col("kind") < 3
    by_row = spans.groupBy("__row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.collect_list(F.when(base, span)).alias("base"), F.collect_list(F.when(~F.col("example"), span)).alias("all"),
        F.count_if((F.col("kind") == 3) & ~F.col("example")).alias("n_live"), F.count_if("example").alias("n_examples"),
    )
    by_row = by_row.select("__row", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_live", "n_examples")
    zero = F.lit(0).cast("long")
    filled = {"n_assign": zero, "n_access": zero, "n_hex": zero, "base_sha256": F.sha2(F.lit(b""), 256), "spans": F.lit(""), "n_live": zero, "n_examples": zero}
    some = rows.where("__any").select("__row", "doc_id").join(by_row, "__row", "left")
    return some.select("doc_id", *[F.coalesce(c, v).alias(c) for c, v in filled.items()]).unionByName(rows.where(~F.col("__any")).select("doc_id", *[v.alias(c) for c, v in filled.items()]))


def mask_secrets(docs: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """docs with base spans and live spans masked and n_chars, where there is such a column, set to the new length.

    Overlapping spans share one mask; spans that touch have one each.  Widely copied candidates outside the base kinds
    stay as they are.  Only rows with a match take part in the count of owners; all others pass as they lie.  A null
    text stays null.
    """
    names = docs.columns
    found = scanned(docs)
    plain = found.where(~F.col("__any")).select("__doc.*")
    some = stage(found.where("__any").select(F.monotonically_increasing_id().alias("__row"), "__doc", "__owner", "__found"), "secret-docs")
    spans = judged(stage(placed(some), "secret-spans"), most_owners, most_repositories).where(~F.col("example"))
    before = Window.partitionBy("__row").orderBy("start_byte", "end_byte").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("from", F.coalesce(F.max("end_byte").over(before), F.lit(0)))
    pieces = F.collect_list(F.when(F.col("start_byte") >= F.col("from"), F.struct("start_byte", "from")))
    by_row = cut.groupBy("__row").agg(F.array_sort(pieces).alias("__pieces"), F.max("end_byte").alias("__tail"))
    # the bytes are bound once, as the one element of an array; a cast inside the inner lambda would copy them per piece
    part = lambda text, a, n: F.substring(text, a.cast("int") + 1, n.cast("int")).cast("string")
    head = lambda text: F.array_join(F.transform("__pieces", lambda x: F.concat(part(text, x["from"], x["start_byte"] - x["from"]), F.lit(MASK))), "")
    whole = F.transform(F.array(F.col("__doc.text").cast("binary")), lambda text: F.concat(head(text), part(text, F.col("__tail"), F.octet_length(text))))[0]
    made = some.join(by_row, "__row", "left").select("__doc", F.when(F.col("__tail").isNotNull(), whole).otherwise(F.col("__doc.text").cast("string")).alias("__new"))
    out = {"text": F.col("__new")}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("__new").isNull(), F.col("__doc.n_chars")).otherwise(F.length("__new")).cast(docs.schema["n_chars"].dataType)
    return plain.unionByName(made.select(*[out.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in names]))
