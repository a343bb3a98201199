"""Queries of the reader vote: opening words, dates, confidence floors, flags and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import voting
from ..sources.tables import READERS, perturbed, table
from .scalars import OPENING_CTE, opening


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and an array of three readers' opening words with confidences, in voting order."""
    made = opening(table(spark, sf_dir, "documents"))
    key = F.col("doc_id")
    conf = lambda i: (80 + (key * (i + 3) + i * 7) % 20).cast("double")
    one = lambda i: F.struct(F.lit(READERS[i]).alias("reader"), perturbed(key, F.col("kept"), i).alias("texts"))
    rows = made.select("doc_id", F.array(*[one(i) for i in range(3)]).alias("r"), F.array(*[conf(i) for i in range(3)]).alias("c"))
    few = lambda r: F.when(F.size(r["texts"]) < 5, F.array(F.format_string("only %d body word(s) found", F.size(r["texts"])))).otherwise(F.array().cast("array<string>"))
    full = F.transform("r", lambda r, i: F.struct(r["reader"].alias("reader"), r["texts"].alias("texts"), F.transform(r["texts"], lambda t: F.get(F.col("c"), i)).alias("confs"), few(r).alias("flags")))
    return rows.select("doc_id", full.alias("readings"))


def vote_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readers' opening words settled by vote: value, verified, confidence and reasons; no shuffle."""
    voted = voting.reconcile_words(readings(spark, sf_dir))
    clean = F.size("reasons") == 0
    return voted.select(
        "doc_id", "value", F.when(F.col("verified") & clean, "YES").otherwise("NO").alias("words_verified"), "confidence", F.col("supporters").cast("long").alias("supporters"),
        F.when(clean, "no").otherwise("YES").alias("needs_review"), F.array_join("reasons", " | ").alias("review_reasons"),
    )


_ALNUM = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_MARKS = "list_filter(string_split(regexp_replace({}, '[\\p{{L}}\\p{{N}}]', '', 'g'), ''), lambda m: m <> '')"


def _same(p: str, o: str) -> str:
    a = lambda x: _ALNUM.format(x)
    m = lambda x: _MARKS.format(x)
    return (
        f"(len({p}) = len({o}) AND len(list_filter(range(1, len({p}) + 1), lambda i: {a(p + '[i]')} <> {a(o + '[i]')} OR "
        f"len(list_filter({m(o + '[i]')}, lambda c: len(list_filter({m(o + '[i]')}, lambda d: d = c)) > len(list_filter({m(p + '[i]')}, lambda d: d = c)))) > 0)) = 0)"
    )


READINGS_CTE = f"""{OPENING_CTE},
ks AS (SELECT doc_id AS k, kept AS w FROM opening),
rs AS (SELECT k,
  CASE WHEN k % 23 = 0 THEN [] ELSE w END AS r0,
  CASE WHEN k % 5 = 0 AND len(w) > 0 THEN list_concat([translate(w[1][1], 'abcdefghijklmnopqrstuvwxyz', 'bcdefghijklmnopqrstuvwxyza') || w[1][2:]], w[2:]) WHEN k % 5 = 0 THEN w
    WHEN k % 3 = 0 THEN list_transform(w, lambda x: regexp_replace(x, '[.,]', '', 'g')) ELSE w END AS r1,
  CASE WHEN k % 7 = 0 THEN [] WHEN k % 11 = 0 THEN list_transform(w, lambda x: x || ';') ELSE w END AS r2,
  80 + (k * 3) % 20 AS c0, 80 + (k * 4 + 7) % 20 AS c1, 80 + (k * 5 + 14) % 20 AS c2 FROM ks)"""
VOTE_SQL = f"""WITH RECURSIVE {READINGS_CTE},
ps AS (SELECT *, CASE WHEN len(r0) > 0 THEN 0 WHEN len(r1) > 0 THEN 1 WHEN len(r2) > 0 THEN 2 END AS p, CASE WHEN len(r0) > 0 THEN r0 WHEN len(r1) > 0 THEN r1 ELSE r2 END AS pw FROM rs),
ss AS (SELECT *, len(r0) > 0 AND {_same("pw", "r0")} AS s0, len(r1) > 0 AND {_same("pw", "r1")} AS s1, len(r2) > 0 AND {_same("pw", "r2")} AS s2 FROM ps),
vs AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE s0::INT + s1::INT + s2::INT END AS n, CASE WHEN p = 0 AND s0::INT + s1::INT + s2::INT >= 2 THEN true ELSE false END AS v FROM ss),
fs AS (SELECT *, [struct_pack(e := 'tesseract', w := r0, c := c0, s := s0, f := CASE WHEN v AND n = 3 THEN 80 ELSE 90 END), struct_pack(e := 'easyocr', w := r1, c := c1, s := s1, f := 30), struct_pack(e := 'doctr', w := r2, c := c2, s := s2, f := 0)] AS a FROM vs),
gs AS (SELECT *, list_filter(a, lambda x: x.s OR NOT v) AS g, CASE p WHEN 0 THEN 'tesseract' WHEN 1 THEN 'easyocr' ELSE 'doctr' END AS pe, array_to_string(pw, ' ') AS val FROM fs),
hs AS (SELECT *, list_filter(list_transform(CASE WHEN p IS NULL THEN a ELSE g END, lambda x: CASE WHEN len(x.w) < 5 THEN 'only ' || len(x.w) || ' body word(s) found' ELSE '' END), lambda f: f <> '') AS few,
  list_transform(CASE WHEN p IS NULL THEN a ELSE g END, lambda x: CASE WHEN len(x.w) < 5 THEN 'only ' || len(x.w) || ' body word(s) found' ELSE '' END) AS each FROM gs),
is_ AS (SELECT *, list_distinct_in_order FROM (SELECT *, list_filter(list_transform(range(1, len(each) + 1), lambda i: CASE WHEN each[i] = '' THEN '' WHEN len(list_filter(each, lambda f: f = each[i])) = len(each) THEN CASE WHEN i = 1 THEN each[i] ELSE '' END ELSE g2[i].e || ': ' || each[i] END), lambda f: f <> '') AS list_distinct_in_order
  FROM (SELECT *, CASE WHEN p IS NULL THEN a ELSE g END AS g2 FROM hs))),
js AS (SELECT *, list_concat(list_distinct_in_order, CASE WHEN p IS NULL THEN ['no article words found'] ELSE list_concat(
    CASE WHEN v THEN [] ELSE list_concat(CASE WHEN p > 0 THEN ['first words only read by ' || pe] ELSE [] END, list_transform(list_filter(a, lambda x: NOT x.s), lambda x: 'engines disagree on first words: ' || pe || ' ''' || val || ''' vs ' || x.e || ' ''' || array_to_string(x.w, ' ') || '''')) END,
    flatten(list_transform(list_filter(g, lambda x: x.c < x.f), lambda x: list_transform(x.w, lambda t: x.e || ' confidence ' || x.c || ' < ' || x.f || ' on ''' || t || '''')))) END) AS reasons FROM is_)
SELECT k AS doc_id, CASE WHEN p IS NULL THEN '' ELSE val END AS value, CASE WHEN v AND len(reasons) = 0 THEN 'YES' ELSE 'NO' END AS words_verified, CASE WHEN v THEN c0 ELSE 0 END::DOUBLE AS confidence, n::BIGINT AS supporters,
  CASE WHEN len(reasons) > 0 THEN 'YES' ELSE 'no' END AS needs_review, array_to_string(reasons, ' | ') AS review_reasons FROM js
"""


def vote_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readers' release dates of every order, settled by vote."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey")
    no_text, no_flags = F.lit(None).cast("string"), F.array().cast("array<string>")
    iso = lambda days, gone: F.when(gone, no_text).otherwise(F.date_format(F.date_add("day", days), "yyyy-MM-dd"))
    say = lambda days, gone: F.when(gone, no_text).otherwise(F.date_format(F.date_add("day", days), "MMMM d, yyyy"))
    gone = [k % 13 == 0, k % 5 == 0, k % 17 == 0]
    days = [F.lit(0), F.when(k % 3 == 0, 1).otherwise(0), F.when(k % 4 == 0, 2).otherwise(0)]
    conf = [85.0 + 0, 50.0, 70.0]
    one = lambda i: F.struct(F.lit(READERS[i]).alias("reader"), iso(days[i], gone[i]).alias("iso"), say(days[i], gone[i]).alias("printed"), (F.lit(conf[i]) + k % 15).alias("conf"), no_flags.alias("flags"))
    rows = orders.select("o_orderkey", F.array(*[one(i) for i in range(3)]).alias("readings"))
    voted = voting.reconcile_date(rows)
    return voted.select("o_orderkey", "value", F.col("verified").alias("majority"), "confidence", F.array_join("reasons", " | ").alias("review_reasons"))


VOTE_DATE_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders),
r AS (SELECT k, CASE WHEN k % 13 <> 0 THEN d END AS d0, CASE WHEN k % 5 <> 0 THEN d + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS d1, CASE WHEN k % 17 <> 0 THEN d + CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END END AS d2,
  85 + k % 15 AS c0, 50 + k % 15 AS c1, 70 + k % 15 AS c2 FROM o),
p AS (SELECT *, coalesce(d0, d1, d2) AS pd, CASE WHEN d0 IS NOT NULL THEN 0 WHEN d1 IS NOT NULL THEN 1 WHEN d2 IS NOT NULL THEN 2 END AS p FROM r),
s AS (SELECT *, coalesce(d0 = pd, false) AS s0, coalesce(d1 = pd, false) AS s1, coalesce(d2 = pd, false) AS s2 FROM p),
v AS (SELECT *, s0::INT + s1::INT + s2::INT AS n, coalesce(p = 0 AND s0::INT + s1::INT + s2::INT >= 2, false) AS v, (['tesseract', 'easyocr', 'doctr'])[p + 1] AS pe, strftime(pd, '%B %-d, %Y') AS pp FROM s),
a AS (SELECT *, [struct_pack(e := 'tesseract', d := d0, c := c0, s := s0, f := CASE WHEN v AND n = 3 THEN 80 ELSE 90 END), struct_pack(e := 'easyocr', d := d1, c := c1, s := s1, f := 30), struct_pack(e := 'doctr', d := d2, c := c2, s := s2, f := 0)] AS a FROM v),
t AS (SELECT *, CASE WHEN p IS NULL THEN ['no release date found'] ELSE list_concat(
    CASE WHEN v THEN [] ELSE list_concat(CASE WHEN p > 0 THEN ['date only read by ' || pe] ELSE [] END,
      list_transform(list_filter(a, lambda x: NOT x.s), lambda x: CASE WHEN x.d IS NULL THEN x.e || ' found no date' ELSE 'engines disagree on date: ' || pe || ' ''' || pp || ''' vs ' || x.e || ' ''' || strftime(x.d, '%B %-d, %Y') || '''' END)) END,
    list_transform(list_filter(a, lambda x: x.d IS NOT NULL AND (x.s OR NOT v) AND x.c < x.f), lambda x: x.e || ' confidence ' || x.c || ' < ' || x.f || ' on ''' || strftime(x.d, '%B %-d, %Y') || '''')) END AS reasons FROM a)
SELECT k AS o_orderkey, coalesce(strftime(pd, '%Y-%m-%d'), '') AS value, v AS majority, CASE WHEN v THEN c0 ELSE 0 END::DOUBLE AS confidence, array_to_string(reasons, ' | ') AS review_reasons FROM t
"""


def low_confidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a reader under its floor, with two and with three readers agreeing."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("texts"), F.array((70 + F.col("c_custkey") % 31).cast("double"), (70 + F.col("c_custkey") % 29).cast("double")).alias("confs"))
    reader = F.element_at(F.array(*map(F.lit, READERS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    agreed = F.when(F.col("c_custkey") % 2 == 0, 3).otherwise(2)
    return rows.select("c_custkey", F.array_join(voting.low_confidence(reader, F.col("texts"), F.col("confs"), agreed), " | ").alias("reasons"))


LOW_SQL = """
WITH r AS (SELECT c_custkey, c_custkey % 3 AS e, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 80 ELSE 90 END WHEN c_custkey % 3 = 1 THEN 30 ELSE 0 END AS f,
  [struct_pack(t := c_name, c := 70 + c_custkey % 31), struct_pack(t := c_mktsegment, c := 70 + c_custkey % 29)] AS w FROM customer)
SELECT c_custkey, array_to_string(list_transform(list_filter(w, lambda x: x.c < f), lambda x: (['tesseract', 'easyocr', 'doctr'])[e + 1] || ' confidence ' || x.c || ' < ' || f || ' on ''' || x.t || ''''), ' | ') AS reasons FROM r
"""


def merge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that all readers raise are told once, others with their reader's name."""
    k = F.col("p_partkey")
    flag = lambda m, name: F.when(k % m == 0, F.lit(name))
    one = lambda i: F.struct(F.lit(READERS[i]).alias("reader"), F.array_compact(F.array(flag(2, "small print"), flag(i + 2, "torn edge"), flag(5 - i, "stamp"))).alias("flags"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array(*[one(i) for i in range(3)]).alias("r")).select("p_partkey", F.array_join(voting.merge_flags(F.col("r")), " | ").alias("flags"))


MERGE_SQL = """
WITH f AS (SELECT p_partkey AS k, i, n, name FROM part, (VALUES (0, 'tesseract'), (1, 'easyocr'), (2, 'doctr')) e(i, name), range(3) t(n)),
g AS (SELECT k, i, n, name, CASE n WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'small print' END WHEN 1 THEN CASE WHEN k % (i + 2) = 0 THEN 'torn edge' END ELSE CASE WHEN k % (5 - i) = 0 THEN 'stamp' END END AS flag FROM f),
h AS (SELECT k, i, n, name, flag, count(flag) OVER (PARTITION BY k, n) AS c FROM g),
j AS (SELECT k, i, n, CASE WHEN flag IS NULL OR c = 3 AND i > 0 THEN NULL WHEN c = 3 THEN flag ELSE name || ': ' || flag END AS told FROM h)
SELECT k AS p_partkey, coalesce(string_agg(told, ' | ' ORDER BY i, n), '') AS flags FROM j GROUP BY k
"""


def retry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flagged page read again after clean-up; the second reading is kept only if it is strictly better."""
    k = F.col("o_orderkey")
    row = lambda a, b: F.struct((k % a).alias("missing"), F.array_join(F.array_repeat(F.lit("doubt"), (k % b).cast("int")), " | ").alias("reasons"))
    both = table(spark, sf_dir, "orders").select("o_orderkey", row(3, 4).alias("first"), row(2, 5).alias("second"))
    better = voting.worse(F.col("second.missing"), F.col("second.reasons")) < voting.worse(F.col("first.missing"), F.col("first.reasons"))
    flagged = (F.col("first.missing") > 0) | (F.col("first.reasons") != "")
    return both.select("o_orderkey", F.when(flagged & better, "second").otherwise("first").alias("kept"))


RETRY_SQL = """
WITH r AS (SELECT o_orderkey, o_orderkey % 3 AS m1, greatest(o_orderkey % 4 - 1, 0) AS s1, o_orderkey % 2 AS m2, greatest(o_orderkey % 5 - 1, 0) AS s2, o_orderkey % 3 > 0 OR o_orderkey % 4 > 0 AS flagged FROM orders)
SELECT o_orderkey, CASE WHEN flagged AND (m2 < m1 OR m2 = m1 AND s2 < s1) THEN 'second' ELSE 'first' END AS kept FROM r
"""

QUERIES = {
    "vote_words": (vote_words, VOTE_SQL), "vote_date": (vote_date, VOTE_DATE_SQL), "low_confidence_reasons": (low_confidence_reasons, LOW_SQL),
    "merge_flags": (merge_flags, MERGE_SQL), "retry_choice": (retry_choice, RETRY_SQL),
}
