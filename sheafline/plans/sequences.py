"""Queries over ordered pages and rows: cues, grouping, list pages, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import columns, days, layout, listing, paging
from ..operators.layout import HEADER_CUE, NON_BODY
from ..runtime import ship
from ..sources.tables import CHAR_PX, LEFT_PX, LINE_PX, PITCH_PX, TOP_PX, placed_words, table


def cued_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its lines, with a head and a foot line chosen by key."""
    k = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, ["FOR IMMEDIATE RELEASE", "- 2 -", "Page 3", "(continued)", "plain head", "News add 1", "Page 1"])), (k % 7 + 1).cast("int"))
    foot = F.element_at(F.array(*map(F.lit, ["-more-", "-30-", "# # #", "(MORE)", "the foot"])), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array(head), F.split("text", "\n"), F.array(foot)).alias("lines"))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's head and foot say about where releases begin and end; row-wise, no shuffle."""
    pages = cued_pages(spark, sf_dir)
    any_of = lambda part, test: F.exists(part, test)
    return pages.select(
        "doc_id",
        any_of(F.slice("lines", 1, paging.HEAD), lambda x: x.rlike(HEADER_CUE)).alias("starts"),
        any_of(F.slice("lines", 1, 4), lambda x: paging.continues(x, F.lit(False))).alias("cont"),
        any_of(F.slice("lines", -paging.FOOT, paging.FOOT), paging.goes_on).alias("more"),
        any_of(F.slice("lines", -paging.FOOT, paging.FOOT), paging.ends).alias("ends"),
    )


SIGNALS_SQL = r"""
WITH p AS (SELECT doc_id, list_concat([(['FOR IMMEDIATE RELEASE', '- 2 -', 'Page 3', '(continued)', 'plain head', 'News add 1', 'Page 1'])[doc_id % 7 + 1]], string_split(text, chr(10)), [(['-more-', '-30-', '# # #', '(MORE)', 'the foot'])[doc_id % 5 + 1]]) AS l FROM documents)
SELECT doc_id,
  len(list_filter(l[1:8], lambda x: regexp_matches(x, '(?i)\bfor\s+(?:immediate\s+)?release\b|\bimmediate\s+release\b|\brelease\s+date\b|\bembargo'))) > 0 AS starts,
  len(list_filter(l[1:4], lambda x: regexp_matches(x, '(?i)\(?\bcont(?:inued|''d)\b\)?')
    OR coalesce(try_cast(translate(regexp_extract(x, '(?i)\badd\W{0,4}([0-9lI]{1,2})\b', 1), 'lI', '11') AS INT), 0) >= 1
    OR coalesce(try_cast(regexp_extract(x, '(?i)^\W*(?:page\s*)?(\d{1,2})\W*$', 1) AS INT), 0) >= 2
    OR coalesce(try_cast(regexp_extract(x, '(?i)\bpage\s+(\d{1,2})\b', 1) AS INT), 0) >= 2
    OR coalesce(try_cast(regexp_extract(x, '(?:^|\s)[-–—_~]+\s*(\d{1,2})\s*[-–—_~]?\s*$', 1) AS INT), 0) >= 2)) > 0 AS cont,
  len(list_filter(l[-3:], lambda x: regexp_matches(x, '(?i)^[\W_]*\(?\s*[mn]ore\s*\)?[\W_]*$'))) > 0 AS more,
  len(list_filter(l[-3:], lambda x: lower(regexp_replace(x, '[\s*\-–—_~]', '', 'g')) IN ('30', 'end', 'ends') OR regexp_matches(regexp_replace(x, '[\s*\-–—_~]', '', 'g'), '^#{3,}$'))) > 0 AS ends
FROM p
"""


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as folders of pages in scan order, with cues by key."""
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        c.alias("folder"), t.alias("seq"), ((c + t * t) % 3 == 0).alias("starts"), ((c * 3 + t) % 4 == 0).alias("cont"), ((c + t) % 5 == 0).alias("more"), ((c + t * 2) % 3 == 0).alias("ends"), "text",
    )


def group_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages into releases with doubts: one window over the scan order of each folder."""
    return paging.group_in_order(turn_pages(spark, sf_dir).drop("text")).select("folder", "seq", F.col("release_id").cast("long").alias("release_id"), "flag")


GROUP_SQL = f"""
WITH p AS (SELECT conv_id AS folder, turn AS seq, (conv_id + turn * turn) % 3 = 0 AS s, (conv_id * 3 + turn) % 4 = 0 AS c, (conv_id + turn) % 5 = 0 AS m, (conv_id + turn * 2) % 3 = 0 AS e FROM conversations),
q AS (SELECT *, row_number() OVER w = 1 AS f, coalesce(lag(m) OVER w, false) AS pm, coalesce(lag(e) OVER w, false) AS pe, coalesce(lead(s AND NOT c) OVER w, false) AS nf FROM p WINDOW w AS (PARTITION BY folder ORDER BY seq))
SELECT folder, seq, sum((f OR (s AND NOT c) OR (NOT s AND NOT c AND NOT pm AND pe))::INT) OVER (PARTITION BY folder ORDER BY seq)::BIGINT AS release_id,
  concat_ws(' | ', nullif(CASE WHEN f THEN CASE WHEN c AND NOT s THEN '{paging.FIRST_MISSING.replace("'", "''")}' ELSE '' END WHEN c AND s THEN '{paging.BOTH}' WHEN c THEN '' WHEN s THEN CASE WHEN pm THEN '{paging.MORE_DENIED.replace("'", "''")}' ELSE '' END
    WHEN pm THEN '' WHEN pe THEN '{paging.NO_HEADER}' ELSE '{paging.ASSUMED}' END, ''), CASE WHEN m AND nf THEN '{paging.MORE_DENIED.replace("'", "''")}' END) AS flag FROM q
"""


def group_pages_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As group_pages, and a later page whose slug shares no word with its release begins a new one."""
    ship(spark)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))
    tagged = turn_pages(spark, sf_dir).withColumn("words", words).withColumn("tag", F.when(F.col("seq") % 2 == 1, F.slice("words", 1, 1)).otherwise(F.array().cast("array<string>")))
    return paging.group_with_slugs(tagged)


def list_dates_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("date"))
    return listing.fill_dates(orders, "o_custkey", ["o_orderkey"]).select("o_orderkey", F.coalesce(F.date_format("final_date", "yyyy-MM-dd"), F.lit("")).alias("final_date"), "flag")


FILLED_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS d FROM orders),
p AS (SELECT *, max(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)
SELECT o_orderkey, coalesce(strftime(coalesce(d, m), '%Y-%m-%d'), '') AS final_date, CASE WHEN d < m THEN 'date is out of sequence (after ' || strftime(m, '%Y-%m-%d') || ')' ELSE '' END AS flag FROM p
"""


def ordered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' orders read like a continued list: enough days that mostly don't go back."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.month("o_orderdate") * 40 + F.year("o_orderdate") * 500).alias("day"))
    return listing.in_order(rows, "o_custkey", "o_orderkey", "day")


ORDERED_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN month(o_orderdate) * 40 + year(o_orderdate) * 500 END AS d FROM orders),
u AS (SELECT o_custkey, d >= lag(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS up FROM r WHERE d IS NOT NULL),
c AS (SELECT o_custkey, count(*) AS dated, count(*) FILTER (up) AS rising FROM u GROUP BY 1), e AS (SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1)
SELECT e.o_custkey, rows, coalesce(dated, 0) AS dated, coalesce(rising, 0) AS rising, coalesce(dated, 0) >= 5 AND coalesce(dated, 0) >= 0.6 * rows AND coalesce(rising, 0) >= 0.8 * (coalesce(dated, 0) - 1) AS is_list FROM e LEFT JOIN c USING (o_custkey)
"""


def list_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common year of each customer's orders; ties to the year seen first."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"))
    return listing.usual(rows, "o_custkey", "year", "o_orderkey")


YEAR_SQL = """
WITH c AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL)
SELECT o_custkey, year::INT AS year FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1
"""


def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of list pages with misread months and days, parsed and repaired."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.date_format(day, "MMM")).alias("month"), day.alias("d"), "o_orderpriority")
    mon = F.date_format("d", "MMM")
    misread = F.concat(F.substr(mon, F.lit(1), F.lit(2)), F.lit("x"))
    number = F.dayofmonth("d").cast("string")
    subject = F.concat(F.lit(" Letter of "), "o_orderpriority", F.when(k % 3 == 0, F.lit(" -")).otherwise(F.lit("")))
    line = F.when(k % 6 == 0, F.concat(F.lit("° "), F.trim(subject))).when(k % 6 == 1, F.concat(misread, F.lit(". "), number, subject)).when(k % 6 == 2, F.concat(mon, F.lit(". "), F.translate(number, "015", "OlS"), subject)).when(k % 6 == 3, F.concat(mon, F.lit(" zz"), subject)).otherwise(F.concat(mon, F.lit(". "), number, F.lit(", "), F.year("d").cast("string"), subject))
    parsed = listing.parse_rows(orders.withColumn("text", line))
    return parsed.select("o_orderkey", F.coalesce("abbr", F.lit("")).alias("abbr"), F.coalesce("day", F.lit(0)).cast("long").alias("day"), F.coalesce("year_raw", F.lit("")).alias("year_raw"), "subject", F.array_join("flags", " | ").alias("flags"))


LIST_ROWS_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, strftime(o_orderdate, '%b') AS m, day(o_orderdate) AS d, year(o_orderdate) AS y, 'Letter of ' || o_orderpriority AS s FROM orders),
p AS (SELECT *, translate(d::VARCHAR, '015', 'OlS') AS raw FROM o)
SELECT o_orderkey, CASE WHEN k <> 0 THEN lower(m) ELSE '' END AS abbr, CASE WHEN k NOT IN (0, 3) THEN d ELSE 0 END::BIGINT AS day, CASE WHEN k IN (4, 5) THEN y::VARCHAR ELSE '' END AS year_raw, s AS subject,
  CASE k WHEN 0 THEN 'no date printed; assumed same day as the entry above' WHEN 1 THEN 'month read as ''' || m[1:2] || 'x''; taken as ' || m
    WHEN 2 THEN CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN '' ELSE 'day read as ''' || raw || '''; taken as ' || d END WHEN 3 THEN 'day unreadable (''zz''); assumed same day as the entry above' ELSE '' END AS flags FROM p
"""


def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians of the line lengths and word lengths of each page, over its lines of five words or more."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.size(text.words(x)) >= 5).alias("long"))
    lengths = F.sort_array(F.transform("long", F.length))
    sizes = F.sort_array(F.transform(F.flatten(F.transform("long", text.words)), F.length))
    middle = lambda a: F.get(a, (F.size(a) / 2).cast("int"))
    return lines.select("doc_id", F.size("long").cast("long").alias("long_lines"), F.coalesce(middle(lengths), F.lit(0)).cast("long").alias("line_chars"), F.coalesce(middle(sizes), F.lit(0)).cast("long").alias("word_chars"))


GEOMETRY_SQL = r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 5) AS l FROM documents),
m AS (SELECT doc_id, l, list_sort(list_transform(l, lambda x: len(x))) AS a, list_sort(list_transform(list_filter(flatten(list_transform(l, lambda x: string_split_regex(x, '\s+'))), lambda w: w <> ''), lambda w: len(w))) AS b FROM l)
SELECT doc_id, len(l) AS long_lines, coalesce(a[len(a) // 2 + 1], 0) AS line_chars, coalesce(b[len(b) // 2 + 1], 0) AS word_chars FROM m
"""


def words_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose centre lies in a layout block of their page.  Pages and their blocks are one row: only the lines at a
    block's height are taken apart, and nothing is shuffled."""
    k = F.col("doc_id")
    box = lambda n, x0, y0, x1, y1: F.struct(F.lit(n).alias("region"), (x0 + k % 7 * 10).alias("x0"), (y0 + k % 3 * 60).alias("y0"), (x1 + k % 11 * 40).alias("x1"), (y1 + k % 5 * 120).alias("y1"))
    pages = table(spark, sf_dir, "documents").select(k.alias("page"), F.split("text", "\n").alias("lines"), F.explode(F.array(box(1, 100, 100, 700, 200), box(2, 400, 160, 2000, 800))).alias("r"))
    centre = TOP_PX + LINE_PX / 2
    top = F.greatest(F.ceil((F.col("r.y0") - centre) / PITCH_PX), F.lit(0)).cast("int")
    low = F.floor((F.col("r.y1") - centre) / PITCH_PX).cast("int")
    middle = lambda w: LEFT_PX + CHAR_PX * (w["c0"] + F.length(w["text"]) / 2)
    held = F.flatten(F.transform(F.slice("lines", top + 1, F.greatest(low - top + 1, F.lit(0))), lambda t: F.filter(placed_words(t), lambda w: middle(w).between(F.col("r.x0"), F.col("r.x1")))))
    return pages.select("page", "r.region", held.alias("held")).where(F.size("held") > 0).select("page", "region", F.size("held").cast("long").alias("n_words"), F.col("held")[0]["text"].alias("first_word"))


REGIONS_SQL = r"""
WITH l AS (SELECT doc_id AS page, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
t AS (SELECT page, line, list_filter(string_split_regex(t, '\s+'), lambda w: w <> '') AS ws FROM l WHERE len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) > 0),
w AS (SELECT page, line, unnest(range(len(ws))) AS word, unnest(ws) AS text FROM t),
b AS (SELECT *, 100 + coalesce(sum(len(text) + 1) OVER (PARTITION BY page, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 12 AS x0, 100 + line * 60 AS y0 FROM w),
r AS (SELECT doc_id AS page, 1 AS region, 100 + doc_id % 7 * 10 AS x0, 100 + doc_id % 3 * 60 AS y0, 700 + doc_id % 11 * 40 AS x1, 200 + doc_id % 5 * 120 AS y1 FROM documents
  UNION ALL SELECT doc_id, 2, 400 + doc_id % 7 * 10, 160 + doc_id % 3 * 60, 2000 + doc_id % 11 * 40, 800 + doc_id % 5 * 120 FROM documents)
SELECT b.page, region::INT AS region, count(*) AS n_words, arg_min(text, line * 1000000 + word) AS first_word FROM b JOIN r ON b.page = r.page AND b.x0 + len(text) * 6 BETWEEN r.x0 AND r.x1 AND b.y0 + 15 BETWEEN r.y0 AND r.y1 GROUP BY ALL
"""


def split_dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words glued by dashes into pieces and dashes, each with its share of the box."""
    k = F.col("p_partkey")
    glue = F.element_at(F.array(*map(F.lit, ["—", "--", " – "])), (k % 3 + 1).cast("int"))
    words = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", glue).alias("t"), (k % 50 + 10).alias("x0"))
    words = words.withColumn("per", F.lit(601.0) / F.length("t"))
    parts = F.regexp_extract_all("t", F.lit("(—|–|―|‒|--|(?:(?!—|–|―|‒|--).)+)"), F.lit(1))
    placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(F.concat_ws("@", p, F.floor(F.col("x0") + a["at"] * F.col("per")).cast("string")))).alias("out")))
    return words.select("p_partkey", F.array_join(placed["out"], ";").alias("pieces"))


DASHES_SQL = r"""
WITH w AS (SELECT p_partkey, replace(p_name, ' ', (['—', '--', ' – '])[p_partkey % 3 + 1]) AS t, p_partkey % 50 + 10 AS x0 FROM part),
p AS (SELECT p_partkey, t, x0, list_filter(string_split(replace(replace(t, '—', chr(1) || '—' || chr(1)), '--', chr(1) || '--' || chr(1)), chr(1)), lambda x: x <> '') AS a FROM w),
q AS (SELECT p_partkey, t, x0, list_filter(flatten(list_transform(a, lambda x: string_split(replace(x, '–', chr(1) || '–' || chr(1)), chr(1)))), lambda x: x <> '') AS a FROM p)
SELECT p_partkey, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || '@' || floor(x0 + len(array_to_string(a[1:i - 1], '')) * (601.0::DOUBLE / len(t)))::BIGINT), ';') AS pieces FROM q
"""


def body_words_dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty words of each page, those hyphenated across a line break joined, lone punctuation left out."""
    made = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"[.]\n", "-\n")).otherwise(F.col("text")).alias("t"))
    joined = made.withColumn("j", F.regexp_replace("t", r"(\S)-\n(\S)", "$1$2"))
    kept = F.filter(text.words(F.col("j")), text.is_word)
    joins = (F.length("t") - F.length("j")) / 2
    return joined.select("doc_id", F.array_join(F.slice(kept, 1, 40), " ").alias("words"), joins.cast("long").alias("joins"))


BODY_SQL = r"""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '.' || chr(10), '-' || chr(10)) ELSE text END AS t FROM documents),
j AS (SELECT doc_id, t, regexp_replace(t, '(\S)-\n(\S)', '\1\2', 'g') AS j FROM m)
SELECT doc_id, array_to_string(list_filter(string_split_regex(j, '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))[1:40], ' ') AS words, ((len(t) - len(j)) // 2)::BIGINT AS joins FROM j
"""


def find_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three short lines above the first long one, going up until a cue or a long line."""
    lines = cued_pages(spark, sf_dir).withColumn("body", F.array_position(F.transform("lines", lambda x: F.size(text.words(x)) > 12), True).cast("int"))
    above = F.reverse(F.when(F.col("body") > 1, F.slice("lines", F.greatest(F.col("body") - 3, F.lit(1)), F.least(F.lit(3), F.col("body") - 1))).otherwise(F.array().cast("array<string>")))
    stops = F.transform(above, lambda x: x.rlike(HEADER_CUE) | x.rlike(NON_BODY))
    first_stop = F.array_position(stops, True)
    kept = F.when(first_stop > 0, F.slice(above, F.lit(1), (first_stop - 1).cast("int"))).otherwise(above)
    return lines.select("doc_id", F.array_join(F.reverse(kept), " ").alias("slug"))


SLUG_SQL = r"""
WITH p AS (SELECT doc_id, list_concat([(['FOR IMMEDIATE RELEASE', '- 2 -', 'Page 3', '(continued)', 'plain head', 'News add 1', 'Page 1'])[doc_id % 7 + 1]], string_split(text, chr(10)), [(['-more-', '-30-', '# # #', '(MORE)', 'the foot'])[doc_id % 5 + 1]]) AS l FROM documents),
b AS (SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) > 12), true), 0) AS b FROM p),
a AS (SELECT doc_id, CASE WHEN b > 1 THEN list_reverse(l[greatest(b - 3, 1):b - 1]) ELSE [] END AS a FROM b),
s AS (SELECT doc_id, a, coalesce(list_position(list_transform(a, lambda x: regexp_matches(x, '(?i)\bfor\s+(?:immediate\s+)?release\b|\bimmediate\s+release\b|\brelease\s+date\b|\bembargo') OR regexp_matches(x, '(?i)\b(?:contact|phone|telephone|tel\.|fax|e-?mail)\b|for more information|www\.|https?://|@')), true), 0) AS s FROM a)
SELECT doc_id, array_to_string(list_reverse(CASE WHEN s > 0 THEN a[1:s - 1] ELSE a END), ' ') AS slug FROM s
"""


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in key order as a list page: their days, priorities and keys."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.struct(F.col("o_orderkey").alias("key"), F.dayofmonth("o_orderdate").alias("day"), F.col("o_orderpriority").alias("subject")).alias("o"))
    return rows.groupBy("folder").agg(F.array_sort(F.collect_list("o")).alias("orders"))


def day_reads(readers: int):
    """Readings of a page's days: by the key a reader misses one or reads its last digit alone."""
    read = lambda r: F.filter(F.transform("orders", lambda o, i: F.when((o["key"] + r) % 5 != 0, F.struct(
        F.when(((o["key"] + r) % 4 == 0) & (o["day"] > 9), o["day"] % 10).otherwise(o["day"]).cast("string").alias("text"), F.lit(90.0 - r).alias("conf"), F.lit(150.0).alias("x0"), (100.0 + 60 * i).alias("y0"), F.lit(174.0).alias("x1"), (130.0 + 60 * i).alias("y1"), F.lit(r).alias("reader"),
    ))), lambda w: w.isNotNull())
    return F.flatten(F.array(*[read(r) for r in range(readers)]))


def vote_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readings of each customer's order days, voted per spot with a cost for going back."""
    voted = list_pages(spark, sf_dir).select("folder", F.posexplode(days.vote_days(day_reads(4))).alias("spot", "w"))
    return voted.select("folder", F.col("spot").cast("long").alias("spot"), F.col("w.text").cast("long").alias("day"))


def days_beside_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading of each customer's days put beside the subjects of the page, which stand a little lower; rows that got
    none and their cells in the column."""
    subjects = F.transform("orders", lambda o, i: F.transform(F.split(o["subject"], " "), lambda t, k: F.struct(t.alias("text"), F.lit(95.0).alias("conf"), (260.0 + 100 * k).alias("x0"), (104.0 + 60 * i).alias("y0"), (340.0 + 100 * k).alias("x1"), (134.0 + 60 * i).alias("y1"))))
    found = F.transform(day_reads(1), lambda w: F.struct(*[w[c].alias(c) for c in ("text", "conf", "x0", "y0", "x1", "y1")]))
    pages = list_pages(spark, sf_dir).select("folder", "orders", subjects.alias("rows"), found.alias("found")).withColumn("rows", days.pair_days(F.col("rows"), F.col("found")))
    column = F.struct(F.lit(200.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(1e9).alias("y1"))
    made = pages.withColumn("cells", F.size(columns.missing_days(F.col("rows"), column)))
    each = made.select("folder", "cells", F.posexplode(F.arrays_zip("rows", "orders")).alias("i", "x"))
    day = F.when(days.is_day(F.col("x.rows")[0]), F.col("x.rows")[0]["text"].cast("long"))
    return each.select("folder", F.col("x.orders.key").alias("o_orderkey"), F.coalesce(day, F.lit(0)).cast("long").alias("day"), F.col("cells").cast("long").alias("cells"))


BESIDE_SQL = """
WITH o AS (SELECT o_custkey AS folder, o_orderkey, day(o_orderdate) AS d FROM orders),
r AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 4 = 0 AND d > 9 THEN d % 10 ELSE d END AS day, o_orderkey % 5 = 0 AS missed FROM o)
SELECT folder, o_orderkey, day::BIGINT AS day, (sum(missed::INT) OVER (PARTITION BY folder))::BIGINT AS cells FROM r
"""


def wrapped_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page as rows of a list: undated lines that continue the entry above are joined to it."""
    row = lambda t, i: F.struct((100.0 + 50 * i - F.when(i % 3 == 2, 20).otherwise(0)).alias("top"), (260.0 + F.when(i % 3 == 2, 30).otherwise(0)).alias("start"), (260.0 + 12 * F.least(F.length(t), F.lit(60))).alias("end"), (i % 3 != 2).alias("dated"), t.alias("subject"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.transform(F.split("text", "\n"), row).alias("rows"))
    return pages.select("page", F.posexplode(days.join_wraps(F.col("rows"), F.lit(30.0))).alias("entry", "subject")).withColumn("entry", F.col("entry").cast("long"))


def typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a typed page with a header and a body, its third line set in by five characters."""
    k = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, ["FOR IMMEDIATE RELEASE", "Contact: the office, phone 555", "TOWN, N.Y. -- ", "TOWN, N.Y. "])), (k % 4 + 1).cast("int"))
    texts = F.concat(F.array(F.lit("News Office")), F.when(k % 4 < 2, F.concat(F.array(head), F.split("text", "\n"))).otherwise(F.split(F.concat(head, "text"), "\n")))
    pages = table(spark, sf_dir, "documents").select(k.alias("page"), texts.alias("texts"))
    return pages.select("page", layout.typed_lines(F.col("texts"), lambda i: LEFT_PX + F.when(i == 2, 5 * CHAR_PX).otherwise(0)).alias("lines"))


def body_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the body of each page begins, and with which doubt; row-wise, no shuffle."""
    found = layout.starts(layout.with_facts(typed_pages(spark, sf_dir)))
    at = lambda c: F.coalesce(F.col(f"start.{c}"), F.lit(-1)).cast("long")
    return found.select("page", at("line").alias("line"), at("word").alias("word"), F.coalesce("start.flag", F.lit(layout.NOT_FOUND)).alias("flags"))


QUERIES = {
    "body_start": (body_start, None), "days_beside_rows": (days_beside_rows, BESIDE_SQL),
    "page_signals": (page_signals, SIGNALS_SQL), "group_pages": (group_pages, GROUP_SQL), "group_pages_by_slug": (group_pages_by_slug, None), "list_dates_filled": (list_dates_filled, FILLED_SQL),
    "ordered_days": (ordered_days, ORDERED_SQL), "list_year": (list_year, YEAR_SQL), "list_rows": (list_rows, LIST_ROWS_SQL), "line_geometry": (line_geometry, GEOMETRY_SQL), "words_in_regions": (words_in_regions, REGIONS_SQL),
    "split_dashes": (split_dashes, DASHES_SQL), "body_words_dehyphenated": (body_words_dehyphenated, BODY_SQL), "find_slug": (find_slug, SLUG_SQL), "vote_days": (vote_days, None), "wrapped_subjects": (wrapped_subjects, None),
}
