"""Queries of small operators: places on a line and a page, texts as keys, list headers, languages, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import listhead, naming, paging, spots
from ..runtime import ship
from ..sources.tables import LINE_PX, PITCH_PX, TOP_PX, page_lines, table
from .scalars import DETECT_SQL, TODAY_YEAR, detect_language


def words_at_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every line that overlap a span of it, and the first word at or after the span's start."""
    words, start = F.col("words"), F.pmod("page", F.lit(40)).cast("int")
    lines = page_lines(table(spark, sf_dir, "documents")).select("page", "line", text.words(F.col("text")).alias("words"))
    return lines.select("page", "line", F.array_join(spots.words_in_span(words, start, start + 25), " ").alias("inside"), spots.word_index_at(words, start).cast("long").alias("first_at"))


SPANS_SQL = r"""
WITH l AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
v AS (SELECT page, line, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS ws FROM l),
w AS (SELECT page, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM v),
p AS (SELECT *, sum(len(w) + 1) OVER (PARTITION BY page, line ORDER BY i) - len(w) - 1 AS a, page % 40 AS s FROM w),
g AS (SELECT page, line, string_agg(w, ' ' ORDER BY i) FILTER (a + len(w) > s AND a < s + 25) AS inside, count(*) FILTER (a < s) AS first_at FROM p GROUP BY ALL)
SELECT v.page, v.line::INT AS line, coalesce(inside, '') AS inside, coalesce(first_at, 0)::BIGINT AS first_at FROM v LEFT JOIN g USING (page, line)
"""


def boxes_that_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a spot: do they meet, and the first one padded inside its page."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    box = lambda m: F.struct(*[c.cast("int").alias(n) for n, c in (("x0", k % (50 + m)), ("y0", k % (30 + m)), ("x1", k % (50 + m) + 20 + k % 13), ("y1", k % (30 + m) + 8 + k % 11))])
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box(1).alias("a"), box(4).alias("b"))
    return both.select("l_orderkey", "l_linenumber", spots.same_spot(F.col("a"), F.col("b")).alias("same"), spots.padded(F.col("a"), F.lit(12), F.lit(70), F.lit(40)).alias("p")).select("l_orderkey", "l_linenumber", "same", "p.*")


BOXES_SQL = """
WITH k AS (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, k % 51 AS ax, k % 31 AS ay, k % 54 AS bx, k % 34 AS by_, 20 + k % 13 AS w, 8 + k % 11 AS h FROM k)
SELECT l_orderkey, l_linenumber, abs(ax - bx) < w AND (h - abs(ay - by_)) * 2 > h AS same, greatest(ax - 12, 0)::INT AS x0, greatest(ay - 12, 0)::INT AS y0, least(ax + w + 12, 70)::INT AS x1, least(ay + h + 12, 40)::INT AS y1 FROM b
"""


def nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each page nearest the middle of a crop."""
    top = lambda i: F.lit(TOP_PX) + i * PITCH_PX
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.cast("long").alias("line"), top(i).alias("y0"), (top(i) + LINE_PX).alias("y1")))
    pages = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return pages.select("doc_id", spots.nearest_line(F.col("lines"), F.pmod("doc_id", F.lit(40)) * 35)["line"].alias("line"))


NEAREST_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY abs({TOP_PX} + i * {PITCH_PX} + {LINE_PX} / 2.0 - (doc_id % 40) * 35 / 2.0), i) AS k FROM l)
SELECT d.doc_id, r.i::BIGINT AS line FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k = 1
"""


def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names and segments from a recogniser's time steps: every character twice, then a blank."""
    said = F.concat_ws(" ", "c_mktsegment", "c_name")
    chars = F.transform(F.sequence(F.lit(1), F.length(said)), lambda i: F.ascii(F.substr(said, i, F.lit(1))))
    step = lambda c, p: F.struct(c.cast("int").alias("code"), p.cast("double").alias("prob"))
    steps = F.flatten(F.transform(chars, lambda c, i: F.array(step(c, (F.lit(50) + i % 7) / 100), step(c, F.lit(0.9)), step(F.lit(0), F.lit(0.99)))))
    words = table(spark, sf_dir, "customer").select("c_custkey", steps.alias("s")).select("c_custkey", spots.steps_to_words(F.col("s")).alias("w"))
    return words.select("c_custkey", F.array_join("w.text", " ").alias("words"), F.array_join(F.transform("w.conf", lambda c: F.round(c).cast("int").cast("string")), " ").alias("confs"))


RECOGNISED_SQL = """
WITH t AS (SELECT c_custkey, c_mktsegment || ' ' || c_name AS t FROM customer),
c AS (SELECT c_custkey, t, unnest(range(1, len(t) + 1)) AS i FROM t),
m AS (SELECT *, t[i] = ' ' AS gap, sum((t[i] = ' ')::INT) OVER (PARTITION BY c_custkey ORDER BY i) AS n FROM c),
w AS (SELECT c_custkey, n, min(50 + (i - 1) % 7) AS conf FROM m WHERE NOT gap GROUP BY ALL)
SELECT c_custkey, any_value(t) AS words, string_agg(conf::VARCHAR, ' ' ORDER BY n) AS confs FROM w JOIN t USING (c_custkey) GROUP BY 1
"""


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as typed into a key: brought to one form, and checked."""
    k, day = F.col("c_custkey"), F.date_add(F.lit("1969-01-01").cast("date"), F.pmod("c_custkey", F.lit(9000)).cast("int"))
    said = F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(day, "yyyy-MM")).when(k % 5 == 2, F.date_format(day, " MMMM d, yyyy ")).when(k % 5 == 3, F.lit(" undated ")).otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", said.alias("said"))
    return rows.select("c_custkey", dates.norm_date(F.col("said"), TODAY_YEAR).alias("normal"), dates.valid_iso(F.col("said")).alias("valid"))


DATE_TEXTS_SQL = """
WITH d AS (SELECT c_custkey, DATE '1969-01-01' + (c_custkey % 9000)::INT AS d FROM customer)
SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN strftime(d, '%Y-%m') WHEN 3 THEN 'undated' WHEN 4 THEN year(d) || '-02-30' ELSE strftime(d, '%Y-%m-%d') END AS normal, c_custkey % 5 < 2 AS valid FROM d
"""


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole texts as letters and spaces only, and with single spaces."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.letters_only(F.col("text")).cast("binary")).alias("letters"), F.md5(text.single_spaced(F.col("text")).cast("binary")).alias("spaced"))


PLAIN_SQL = r"""
SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z ]', '', 'g')) AS letters, md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), ' ')) AS spaced FROM documents
"""


def list_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month and year typed above a list, through misread, broken and missing words."""
    ship(spark)
    k, day = F.col("o_custkey") + F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    month, year = F.date_format(day, "MMMM"), F.date_format(day, "yyyy")
    dropped, split = F.concat(F.left(month, F.lit(1)), F.substr(month, F.lit(3))), F.concat(F.left(month, F.lit(3)), F.lit(" "), F.substr(month, F.lit(4)))
    line = F.when(k % 6 == 0, F.concat_ws(" ", F.lit("MONTH ......"), month, year)).when(k % 6 == 1, F.concat_ws(" ", F.lit("M0NTH .."), month, year)).when(k % 6 == 2, F.concat_ws(" ", F.lit("month"), dropped, year))
    line = line.when(k % 6 == 3, F.concat_ws(" ", F.lit("MONTH"), split, year)).when(k % 6 == 4, F.concat_ws(" ", F.lit("INDEX of"), month, year)).otherwise(F.concat_ws(" ", F.lit("Month"), month, F.lit("1066")))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit("Press Office"), line, F.lit("Date   Subject")).alias("lines"))
    return listhead.header_month_year(lines, "o_orderkey", TODAY_YEAR)


HEADERS_SQL = """
WITH o AS (SELECT o_orderkey, (o_custkey + o_orderkey) % 6 AS v, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN v <> 4 THEN lower(strftime(d, '%B'))[1:3] END AS month, CASE WHEN v < 4 THEN year(d)::INT END AS year FROM o
"""


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language a page is read in, and why it is in doubt, narrow pages among the reasons."""
    width = (F.lit(1000) + F.pmod("doc_id", F.lit(1000))).cast("int")
    lang, doubt = paging.reading_language(F.col("lang"), F.col("score"), list(text.STOPWORDS))
    return detect_language(spark, sf_dir).select("doc_id", lang.alias("language"), F.concat_ws(" | ", paging.low_resolution(width), doubt).alias("reasons"))


LANGUAGE_SQL = f"""
SELECT doc_id, CASE WHEN lang <> '' AND score >= 2 THEN lang ELSE 'en' END AS language,
  concat_ws(' | ', CASE WHEN doc_id % 1000 < 500 THEN 'low-resolution page (' || (1000 + doc_id % 1000) || 'px wide); a closer photo would be more reliable' END,
  CASE WHEN lang NOT IN ('', 'en') AND score < 2 THEN 'text may be non-English (weak signal for ''' || lang || '''); read as English' END) AS reasons FROM ({DETECT_SQL})
"""


def leading_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages of files: a list after a release of its file is the release that its other reading shows."""
    n = F.length(F.coalesce("text", F.lit("")))
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", (n % 3 != 0).alias("is_list"), (n % 5 != 0).alias("has_release"))
    return paging.leading_lists(pages, "conv_id", "turn").select("conv_id", "turn", "kind")


LEADING_SQL = """
WITH p AS (SELECT conv_id, turn, length(coalesce(text, '')) % 3 <> 0 AS l, length(coalesce(text, '')) % 5 <> 0 AS r FROM conversations),
f AS (SELECT conv_id, min(turn) FILTER (NOT l) AS f FROM p GROUP BY 1)
SELECT p.conv_id, turn, CASE WHEN l AND NOT (r AND coalesce(turn > f, false)) THEN 'list' ELSE 'release' END AS kind FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id
"""


def file_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases with their line items as pages: which files are written, left alone or out of date."""
    template, listed = "B{box}_F{folder}_R{release}", "B{box}_F{folder}_list"
    naming.check_naming("7", "3b", 1, template, listed)
    items = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(F.concat(F.lit("B7_F3b_R"), "l_orderkey").alias("file_name"), F.concat(F.lit("scan"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("page"), F.col("l_linenumber").alias("ord"))
    there = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "B7_F3b_R").otherwise("notes"), "o_orderkey").alias("file_name"))
    return naming.write_plan(items, there, naming.owns(F.col("file_name"), template, listed, "7", "3b"))


PLAN_SQL = """
WITH m AS (SELECT 'B7_F3b_R' || l_orderkey AS file_name, count(*) AS n, string_agg('scan' || l_orderkey || '#' || l_linenumber, ' ' ORDER BY l_linenumber) AS pages FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
t AS (SELECT 'B7_F3b_R' || o_orderkey AS file_name FROM orders WHERE o_orderkey % 6 = 0)
SELECT file_name, n AS n_pages, pages, CASE WHEN file_name IN (SELECT file_name FROM t) THEN 'leave' ELSE 'write' END AS action FROM m
UNION ALL SELECT file_name, 0, '', 'stale' FROM t WHERE file_name NOT IN (SELECT file_name FROM m)
"""

QUERIES = {
    "words_at_spans": (words_at_spans, SPANS_SQL), "boxes_that_meet": (boxes_that_meet, BOXES_SQL), "nearest_lines": (nearest_lines, NEAREST_SQL), "recognised_words": (recognised_words, RECOGNISED_SQL),
    "date_texts": (date_texts, DATE_TEXTS_SQL), "plain_texts": (plain_texts, PLAIN_SQL), "list_headers": (list_headers, HEADERS_SQL), "page_language": (page_language, LANGUAGE_SQL),
    "leading_lists": (leading_lists, LEADING_SQL), "file_plan": (file_plan, PLAN_SQL),
}
