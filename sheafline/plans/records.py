"""Queries of matching, quality, output and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching, quality, records
from ..runtime import ship
from ..sources.tables import table

def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as entries of an index."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), text.subject_tokens(F.col("text")).alias("tokens"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as releases."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("release_id"), text.subject_tokens(F.col("text")).alias("words"))


TOKENS = """list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}),
  '([\\p{{L}}\\p{{N}}_])[''’]([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}_])[''’]([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'),
  '([\\p{{L}}\\p{{N}}_])-([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}_])-([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '[a-z0-9]+'),
  lambda t: len(t) >= 3 AND t NOT IN ('the', 'and', 'for', 'from', 'with', 'new', 'of')), lambda t: CASE WHEN len(t) >= 5 AND suffix(t, 's') AND NOT suffix(t, 'ss') THEN t[:-2] ELSE t END)"""
SCORES_CTE = f"""
e AS (SELECT item_id AS entry_id, unnest({TOKENS.format("text")}) AS token FROM benchmark),
n AS (SELECT count(*) AS n FROM benchmark),
i AS (SELECT token, ln((n + 1) / (count(DISTINCT entry_id) + 0.5::DOUBLE)) AS idf FROM e, n GROUP BY token, n),
t AS (SELECT entry_id, sum(idf) AS total FROM e JOIN i USING (token) GROUP BY ALL),
r AS (SELECT DISTINCT doc_id AS release_id, unnest({TOKENS.format("text")}) AS token FROM documents),
s AS (SELECT release_id, e.entry_id, sum(idf) / any_value(total) AS score FROM r JOIN e ON e.token = r.token JOIN i ON i.token = e.token JOIN t ON t.entry_id = e.entry_id WHERE total > 0 GROUP BY ALL)
"""


def idf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted share of each entry's words that a release holds, of all pairs that matter to a claim."""
    scores = matching.exact_scores(releases(spark, sf_dir), entries(spark, sf_dir), [])
    return scores.select("release_id", "entry_id", F.round("score", 6).alias("score"))


IDF_SQL = f"WITH {SCORES_CTE} SELECT release_id, entry_id, round(score, 6) AS score FROM s WHERE score >= 0.3 - 1e-9"


def match_day_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that releases clearly point to; several releases may share one."""
    scores = matching.exact_scores(releases(spark, sf_dir), entries(spark, sf_dir), []).withColumn("score", F.round("score", 9))
    return matching.claims(scores, []).select("release_id", "entry_id", F.round("score", 6).alias("score"), "shared")


CLAIMS_SQL = f"""WITH {SCORES_CTE},
k AS (SELECT release_id, entry_id, round(score, 9) AS score, row_number() OVER w AS k, coalesce(lead(round(score, 9)) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY release_id ORDER BY round(score, 9) DESC, entry_id)),
b AS (SELECT * FROM k WHERE k = 1 AND score >= 0.5 AND score - second >= 0.2)
SELECT release_id, entry_id, round(score, 6) AS score, count(*) OVER (PARTITION BY entry_id) > 1 AS shared FROM b
"""


def unmatched_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that no release claims."""
    claimed = match_day_claims(spark, sf_dir)
    return entries(spark, sf_dir).join(claimed, "entry_id", "left_anti").select("entry_id")


UNMATCHED_SQL = f"""WITH {SCORES_CTE},
k AS (SELECT release_id, entry_id, round(score, 9) AS score, row_number() OVER w AS k, coalesce(lead(round(score, 9)) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY release_id ORDER BY round(score, 9) DESC, entry_id))
SELECT item_id AS entry_id FROM benchmark WHERE item_id NOT IN (SELECT entry_id FROM k WHERE k = 1 AND score >= 0.5 AND score - second >= 0.2)
"""


def match_folder_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole match of customers' orders (releases) with their line items' ship days (entries), folder by folder."""
    ship(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("release_id"), F.col("o_orderdate").cast("date").alias("day"), F.split(F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string"))), "[^a-z0-9]+").alias("words"))
    listed = orders.select("folder", F.col("release_id").alias("entry_id"), F.when(F.col("release_id") % 3 == 0, F.date_add("day", 1)).otherwise(F.col("day")).alias("day"), F.slice("words", 1, 4).alias("tokens"))
    return matching.match_folders(orders.withColumn("body", F.array_join("words", " ")), listed)


def near_day_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders at most thirty days apart: an interval join by equi-joins on days."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    right = orders.select("o_custkey", F.col("o_orderkey").alias("other_key"), F.col("day").alias("other_day"))
    pairs = matching.near_days(orders, right, ["o_custkey"], "day", "other_day", 30)
    return pairs.where("o_orderkey < other_key").select("o_orderkey", "other_key", F.abs(F.datediff("day", "other_day")).cast("long").alias("days_apart"))


NEAR_SQL = """
SELECT a.o_orderkey, b.o_orderkey AS other_key, abs(a.o_orderdate::DATE - b.o_orderdate::DATE)::BIGINT AS days_apart FROM orders a
JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_orderdate::DATE - b.o_orderdate::DATE) <= 30
"""


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases that open with the same forty words as another; only digests are shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.slice(text.words(F.lower("text")), 1, 40), " ").cast("binary")).alias("opening"))
    groups = docs.groupBy("opening").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")
    return docs.join(groups, "opening").select("doc_id", "first_doc", "copies")


DUPLICATES_SQL = r"""
WITH d AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')[1:40], ' ') AS o FROM documents),
g AS (SELECT o, min(doc_id) AS first_doc, count(*) AS copies FROM d GROUP BY o HAVING count(*) > 1) SELECT doc_id, first_doc, copies FROM d JOIN g USING (o)
"""


def entry_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all entries with one letter of every third one changed."""
    w = table(spark, sf_dir, "benchmark").select(F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("i", "w"))
    changed = F.concat(F.translate(F.substr("w", F.lit(1), F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "zabcdefghijklmnopqrstuvwxy"), F.substr("w", F.lit(2)))
    return w.select(F.when(F.col("i") % 3 == 0, changed).otherwise(F.col("w")).alias("word"))


def release_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("word"))


WORDS_CTE = """
p AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
q AS (SELECT unnest(range(len(w))) AS i, unnest(w) AS w FROM p),
sw AS (SELECT DISTINCT CASE WHEN i % 3 = 0 THEN translate(w[1], 'abcdefghijklmnopqrstuvwxyz', 'zabcdefghijklmnopqrstuvwxy') || w[2:] ELSE w END AS word FROM q),
rw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
"""


def subject_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry words that no release holds but one spells a letter or two differently."""
    return quality.typos(entry_words(spark, sf_dir), release_words(spark, sf_dir), [])


TYPOS_SQL = f"""WITH {WORDS_CTE},
u AS (SELECT * FROM sw WHERE len(word) >= 5 AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.word = sw.word))
SELECT u.word, min(rw.word) AS release_word FROM u JOIN rw ON len(rw.word) = len(u.word) AND hamming(u.word, rw.word) BETWEEN 1 AND 2 GROUP BY ALL
"""


def subject_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry words no release holds that were read weakly or contradicted."""
    n = F.length("word") + F.ascii("word")
    words = entry_words(spark, sf_dir).distinct().withColumns({"conf": (F.lit(70) + n % 30).cast("double"), "also": F.when(n % 3 == 0, True).when(n % 3 == 1, False)})
    return quality.doubts(words, release_words(spark, sf_dir), [])


DOUBTS_SQL = f"""WITH {WORDS_CTE}
SELECT word FROM sw WHERE (70 + (len(word) + ascii(word)) % 30 < 85 OR (len(word) + ascii(word)) % 3 = 1) AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.word = sw.word)
"""


def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry words that no release names and that are not common in the corpus."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = counts.select("word", text.zipf(F.col("n"), counts.agg(F.sum("n")).scalar()).alias("zipf"))
    names = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+)"), F.lit(1)))).alias("word")).withColumn("word", F.lower("word"))
    return quality.unknown(entry_words(spark, sf_dir).distinct(), names, frequency, [])


UNKNOWN_SQL = f"""WITH {WORDS_CTE},
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1),
z AS (SELECT word, log10(n * 1e9 / (SELECT sum(n) FROM c)) AS zipf FROM c),
nm AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+'))) AS word FROM documents)
SELECT word FROM (SELECT sw.word, coalesce(zipf, 0) AS zipf FROM sw LEFT JOIN z ON z.word = sw.word WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.word = sw.word))
WHERE len(word) >= 4 AND zipf = 0 OR len(word) >= 3 AND zipf < 3
"""


def apply_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table over every combination of outcomes that orders spell out by key."""
    k = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / by) % len(values) + 1).cast("int"))
    told = lambda m, s: F.when(k % m == 0, F.lit(s)).otherwise(F.lit(""))
    made = quality.decide(pick(["date+text", "date", "text", "none"], 1), k % 2 == 0, k % 5 == 0, k % 7 == 0, k % 3 != 0, told(4, "'Old house'"), told(11, "'wrod'"), told(13, "list 'entollment', release 'enrollment'"), told(17, "'pnd'"), k % 19 == 0, told(23, "°"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made["verified"].alias("subject_verified"), made["method"].alias("subject_match"), F.array_join(made["reasons"], " | ").alias("reasons"))


APPLY_SQL = """
WITH o AS (SELECT o_orderkey AS k, (['date+text', 'date', 'text', 'none'])[o_orderkey % 4 + 1] AS m, o_orderkey % 3 <> 0 AS h, o_orderkey % 5 = 0 AS s FROM orders)
SELECT k AS o_orderkey, CASE WHEN h AND NOT s AND k % 2 = 0 AND k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0 THEN 'YES' ELSE 'NO' END AS subject_verified, CASE WHEN h AND s THEN 'shared' ELSE m END AS subject_match,
  array_to_string(list_filter([
    CASE WHEN NOT h AND NOT (m = 'none' AND k % 4 <> 0) THEN CASE m WHEN 'none' THEN 'no subject found in the list page' ELSE 'subject could not be settled' END || CASE WHEN k % 4 = 0 THEN ' (possible: ''Old house'')' ELSE '' END END,
    CASE WHEN h AND NOT s AND k % 7 = 0 THEN 'another release in the folder reads the same and has the same subject; check for a duplicate copy' END,
    CASE WHEN h AND NOT s AND m = 'date' THEN 'subject matched by date only; the release text does not confirm it' END,
    CASE WHEN h AND NOT s AND m = 'text' THEN 'subject matched by its text only' END,
    CASE WHEN h AND NOT s AND m = 'date+text' AND k % 11 = 0 THEN 'subject may be misread (''wrod''); check its spelling' END,
    CASE WHEN h AND NOT s AND m = 'date+text' AND k % 13 = 0 THEN 'subject may have a typo (list ''entollment'', release ''enrollment''); check which spelling is right' END,
    CASE WHEN h AND NOT s AND m = 'date+text' AND k % 17 = 0 THEN 'subject has words that are not English and not named in the release (''pnd''); check their spelling' END,
    CASE WHEN h AND NOT s AND m = 'date+text' AND k % 19 = 0 THEN 'subject looks cut short (it ends mid-way); check the rest on the list page' END,
    CASE WHEN h AND NOT s AND m = 'date+text' AND k % 23 = 0 THEN 'subject has marks no typewriter types (°); check it' END], lambda x: x IS NOT NULL), ' | ') AS reasons FROM o
"""


def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per folder and over all of them."""
    docs = table(spark, sf_dir, "documents").join(match_day_claims(spark, sf_dir).select(F.col("release_id").alias("doc_id"), "entry_id"), "doc_id", "left")
    counts = docs.rollup("source").agg(F.count("*").alias("releases"), F.count("entry_id").alias("matched"), F.count_if(F.col("entry_id").isNull()).alias("no_subject"), F.countDistinct("entry_id").alias("entries"))
    return counts.select(F.coalesce("source", F.lit("ALL")).alias("folder"), "releases", "matched", "no_subject", "entries")


SUMMARY_SQL = f"""WITH {SCORES_CTE},
k AS (SELECT release_id, entry_id, round(score, 9) AS score, row_number() OVER w AS k, coalesce(lead(round(score, 9)) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY release_id ORDER BY round(score, 9) DESC, entry_id)),
b AS (SELECT * FROM k WHERE k = 1 AND score >= 0.5 AND score - second >= 0.2)
SELECT coalesce(source, 'ALL') AS folder, count(*) AS releases, count(entry_id) AS matched, count(*) FILTER (entry_id IS NULL) AS no_subject, count(DISTINCT entry_id) AS entries FROM documents LEFT JOIN b ON release_id = doc_id GROUP BY ROLLUP (source)
"""


def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder's pages read again: its old rows go, the new ones come last, other folders stay."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"), (F.col("doc_id") % 3).alias("page"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source")).alias("folder"), F.col("doc_id").alias("ord"), "lang")
    again = docs.where("folder in ('src1', '')")
    new = again.withColumns({"folder": F.lit("src1"), "lang": F.upper("lang")})
    return records.upsert(docs, new, again.select("file", "page"), "src1").select("file", "page", "folder", "ord", "lang")


UPSERT_SQL = """
WITH d AS (SELECT doc_id || '.jpg' AS file, doc_id % 3 AS page, CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END AS folder, doc_id AS ord, lang FROM documents),
k AS (SELECT * FROM d WHERE folder NOT IN ('src1', '')), t AS (SELECT max(ord) AS top FROM k)
SELECT * FROM k UNION ALL SELECT file, page, 'src1', ord + top + 1, upper(lang) FROM d, t WHERE folder IN ('src1', '')
"""


def number_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return records.number_releases(docs, "source", "doc_id", 5).select("doc_id", F.concat(F.lit("B7_"), "source", F.lit("_"), F.col("release_no").cast("string"), F.lit(".pdf")).alias("file_name"))


NUMBER_SQL = "SELECT doc_id, 'B7_' || source || '_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) + 4) || '.pdf' AS file_name FROM documents"


def infer_box_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels out of paths of several shapes."""
    k = F.col("p_partkey")
    n = k.cast("string")
    path = F.when(k % 5 == 0, F.concat(F.lit("/scans/Box 7/Folder "), n)).when(k % 5 == 1, F.concat(F.lit("/scans/box_12/"), n)).when(k % 5 == 2, F.concat(F.lit("/scans/Folder-"), n, F.lit("/"))).when(k % 5 == 3, F.concat(F.lit("/scans/Box 3 Folder "), n)).otherwise(F.concat(F.lit("/scans/misc/page"), n))
    box, folder = records.box_and_folder(path)
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("box"), folder.alias("folder"))


BOX_SQL = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '7' WHEN 1 THEN '12' WHEN 3 THEN '3' ELSE '' END AS box, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE p_partkey::VARCHAR END AS folder FROM part
"""


def template_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("r"), F.col("p_partkey").cast("string"))).otherwise(F.lit("")).alias("file_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("subject"), F.col("p_name").alias("first_five_words"), "p_size")
    return records.project(rows, [("Title", "{title}"), ("Id", "no. {file_name}/{p_size}"), ("Title", "{first_five_words}"), ("Note", "typed")])


TEMPLATE_SQL = "SELECT CASE WHEN p_partkey % 3 = 0 OR p_type = '' THEN p_name ELSE p_type END AS c0, 'no. r' || p_partkey || '/' || p_size AS c1, p_name AS c2, 'typed' AS c3 FROM part WHERE p_partkey % 4 <> 0"


def next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.next_number(table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).otherwise(F.lit("scan")), F.lit("-2.jpg")).alias("name")))


NEXT_SQL = "SELECT max(o_orderkey) FILTER (o_orderkey % 2 = 0) + 1 AS next_number FROM orders"


def duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label pairs that more than one folder carries, whatever their case."""
    s = table(spark, sf_dir, "supplier").select(F.lower(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "B").otherwise("b"), (F.col("s_suppkey") % 30).cast("string"))).alias("label"), "s_name")
    return s.groupBy("label").agg(F.count("*").alias("folders")).where("folders > 1")


LABELS_SQL = "SELECT lower('b' || s_suppkey % 30) AS label, count(*) AS folders FROM supplier GROUP BY 1 HAVING count(*) > 1"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about documents and their key: value, verified and truth per field."""
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("doc_id").alias("ord"), F.when(F.col("n_chars") % 10 == 0, "").otherwise((F.col("n_chars") > 300).cast("int").cast("string")).alias("quality"), (F.col("n_chars") % 3 != 0).alias("quality_ok"), F.lit("0").alias("toxic"), (F.col("n_chars") % 2 == 0).alias("toxic_ok"))
    key = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("quality").cast("string")).alias("true_quality"), F.col("toxic").cast("string").alias("true_toxic"))
    joined = key.join(records.last_of_file(results, "ord"), "file")
    return joined.select("file", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), records.bucket(F.col(f), F.col(f"{f}_ok"), F.col(f"true_{f}")).alias("bucket")) for f in ("quality", "toxic")])).alias("x")).select("file", "x.field", "x.bucket")


def evaluate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("bucket is not null").groupBy("field", "bucket").agg(F.count("*").alias("n"))


BUCKETS_SQL = """
WITH j AS (SELECT CASE WHEN n_chars % 10 = 0 THEN '' ELSE (n_chars > 300)::INT::VARCHAR END AS q, n_chars % 3 <> 0 AS qo, n_chars % 2 = 0 AS t, CASE WHEN l.doc_id % 9 = 0 THEN '' ELSE quality::VARCHAR END AS tq, toxic::VARCHAR AS tt FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT 'quality' AS field, CASE WHEN tq = '' THEN NULL WHEN q = '' THEN 'no_answer' ELSE CASE WHEN qo THEN 'verified_' ELSE 'flagged_' END || CASE WHEN q = tq THEN 'right' ELSE 'wrong' END END AS bucket FROM j
  UNION ALL SELECT 'toxic', CASE WHEN t THEN 'verified_' ELSE 'flagged_' END || CASE WHEN tt = '0' THEN 'right' ELSE 'wrong' END FROM j)
SELECT field, bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY ALL
"""


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that no key covers."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


MISSING_SQL = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def diff_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ours = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 1, F.upper("p_name")).when(k % 5 == 2, F.concat("p_name", F.lit("."))).when(k % 5 == 3, F.concat(F.upper("p_name"), F.lit("!"))).otherwise(F.concat(F.lit("q"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", records.diff_kind(ours, F.col("p_name")).alias("kind"))


DIFF_SQL = "SELECT p_partkey, (['', 'CASE', 'PUNCT', 'CASE+PUNCT', 'LETTERS'])[p_partkey % 5 + 1] AS kind FROM part"


def answer_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files in the order first seen, with empty answers."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_page"))
    return rows.select(F.col("conv_id").alias("file"), "first_page", F.lit("").alias("release_date"), F.lit("").alias("first_five_words"))


ANSWER_SQL = "SELECT conv_id AS file, min(turn) AS first_page, '' AS release_date, '' AS first_five_words FROM conversations GROUP BY 1"

QUERIES = {
    "idf_scores": (idf_scores, IDF_SQL), "match_day_claims": (match_day_claims, CLAIMS_SQL), "unmatched_entries": (unmatched_entries, UNMATCHED_SQL), "match_folder_subjects": (match_folder_subjects, None), "near_day_candidates": (near_day_candidates, NEAR_SQL),
    "duplicate_texts": (duplicate_texts, DUPLICATES_SQL), "subject_typos": (subject_typos, TYPOS_SQL), "subject_doubts": (subject_doubts, DOUBTS_SQL), "unknown_words": (unknown_words, UNKNOWN_SQL), "apply_match": (apply_match, APPLY_SQL), "folder_summary": (folder_summary, SUMMARY_SQL),
    "upsert_results": (upsert_results, UPSERT_SQL), "number_releases": (number_releases, NUMBER_SQL), "infer_box_folder": (infer_box_folder, BOX_SQL), "template_projection": (template_projection, TEMPLATE_SQL), "next_number": (next_number, NEXT_SQL),
    "duplicate_labels": (duplicate_labels, LABELS_SQL), "evaluate_buckets": (evaluate_buckets, BUCKETS_SQL), "missing_files": (missing_files, MISSING_SQL), "diff_kinds": (diff_kinds, DIFF_SQL), "answer_template": (answer_template, ANSWER_SQL),
}
