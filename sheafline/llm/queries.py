"""The queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat, html_text, lm, media, neardup, packing, quality, secret_scan, sharding
from .common import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), shards=16)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm.language_model_scores(read_table(spark, sf_dir, "documents"), held_out)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack_documents(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, numerator=85, denominator=100)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe.token_digests(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


#: The conversation that the contract adds: both turns hold control strings.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return chat.format_conversations(table.unionByName(extra))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_sharding, op2_lm_scoring, op3_packing, op4_secret_scan, op5_near_dedup, op6_quality_rules, op7_media_columns, op8_html_extraction, op9_byte_bpe, op10_chat_formatting, pipeline)
    return {f.__name__: f for f in made}


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reached) AS c FROM r GROUP BY 1) m ON m.node = d.doc_id
"""

_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SPANS = """list_transform(list_filter(range(1, len({m}) + 1), lambda i: {keep}), lambda i: {{
  's': (list_sum(list_transform({g}[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: len(x))), 0))::BIGINT, 'k': {kind}, 'n': len({m}[i]), 'v': {m}[i]}})""".format
_JOIN = "array_to_string(list_transform(list_sort(list_transform({}, lambda x: {{'s': x.s, 'k': x.k, 'n': x.n}})), lambda x: (['assign', 'access', 'hex', 'live'])[x.k + 1] || ':' || x.s || ':' || (x.s + x.n)), ',')".format
_BEFORE = "greatest(coalesce(q[i - 1].s + q[i - 1].n, 0), q[i].s - {0})".format(secret_scan.CONTEXT)
_LIVE = f"NOT (owners > {secret_scan.MOST_OWNERS} AND repositories > {secret_scan.MOST_REPOSITORIES})"
OP4_SQL = f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, row_number() OVER () AS r FROM documents),
m AS (SELECT *, regexp_extract_all(t, '{_ASSIGN}') AS am, string_split_regex(t, '{_ASSIGN}') AS ag, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS km, string_split_regex(t, 'AKIA[A-Z0-9]+') AS kg,
  regexp_extract_all(t, '[0-9a-f]+') AS hm, string_split_regex(t, '[0-9a-f]+') AS hg, regexp_extract_all(t, '[A-Za-z0-9+/_-]+') AS cm, string_split_regex(t, '[A-Za-z0-9+/_-]+') AS cg FROM b),
f AS (SELECT r, doc_id, t, owner, {_SPANS(m="am", g="ag", kind=0, keep=f"len(regexp_extract(am[i], '{_ASSIGN}', 1)) >= 6")} AS a, {_SPANS(m="km", g="kg", kind=1, keep="len(km[i]) >= 20")} AS k, {_SPANS(m="hm", g="hg", kind=2, keep="len(hm[i]) >= 24")} AS h,
  {_SPANS(m="cm", g="cg", kind=3, keep="len(cm[i]) >= 20 AND regexp_matches(cm[i], '[0-9]')")} AS q FROM m),
c AS (SELECT r, t, owner, unnest(list_transform(range(1, len(q) + 1), lambda i: {{'s': q[i].s, 'k': q[i].k, 'n': q[i].n, 'v': q[i].v, 'before': substring(t, {_BEFORE} + 1, q[i].s - {_BEFORE}),
  'after': substring(t, q[i].s + q[i].n + 1, least({secret_scan.CONTEXT}, coalesce(q[i + 1].s, len(t)) - q[i].s - q[i].n))}})) AS x FROM f),
e AS (SELECT * FROM c WHERE regexp_matches(x.v, '[A-Za-z]') AND len(list_distinct(string_split(x.v, ''))) >= 8),
p AS (SELECT x.v AS v, min(owner) AS owner FROM e GROUP BY x.v, x.before, x.after),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(*) AS repositories FROM p GROUP BY 1),
l AS (SELECT r, list({{'s': x.s, 'k': x.k, 'n': x.n, 'v': x.v}}) FILTER ({_LIVE}) AS live, count(*) FILTER (NOT ({_LIVE})) AS examples FROM e JOIN o ON o.v = e.x.v GROUP BY r)
SELECT doc_id, len(a) AS n_assign, len(k) AS n_access, len(h) AS n_hex, sha256({_JOIN("list_concat(a, k, h)")}) AS base_sha256, {_JOIN("list_concat(a, k, h, coalesce(live, []))")} AS spans, coalesce(len(live), 0) AS n_live, coalesce(examples, 0) AS n_examples
FROM f LEFT JOIN l ON l.r = f.r
"""

_COMMON = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality.COMMON_WORDS.items()) + " END"
_MARKS = quality.MARKS.replace("'", "''")
_CLASS = "len(regexp_replace(t, '[^{}]+', '', 'g'))::DOUBLE".format
_SHARES = "CASE WHEN list_sum({0}) > 0 THEN list_transform({0}, lambda x: x / list_sum({0})) ELSE list_transform({0}, lambda x: 0.0::DOUBLE) END".format
_PART = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END".format
_DISTANCE = "sqrt(greatest(list_sum(list_transform(range(1, len({0}) + 1), lambda i: {2} + {3})) / 2, 0))".format
OP6_SQL = rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lower(lang) IN ({", ".join(repr(k) for k in quality.COMMON_WORDS)}) THEN lower(lang) ELSE '' END AS lang FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM b),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), range(8) r(k) WHERE c > 1 GROUP BY 1),
f AS (SELECT w.doc_id, t, lang, ws, len(ws) AS n, len(array_to_string(ws, '')) AS wc, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS sy, len(ls) - len(list_distinct(ls)) AS dl, coalesce(cov.n, 0) AS rw, {_COMMON} AS cw FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
h AS (SELECT *, n < 20 OR 100 * rw > 30 * n AS bf, n >= {quality.LEAST_WORDS} AND len(t) >= {quality.LEAST_CHARS} AS enough,
  [{_CLASS("A-Z")}, {_CLASS("a-z")}, {_CLASS("0-9")}, (len(t) - wc)::DOUBLE, {_CLASS(".,;:!?''" + '"' + "()-")}, sy::DOUBLE, len(regexp_replace(t, '[\x00-\x7F]+', '', 'g'))::DOUBLE] AS cs,
  CASE WHEN cw IS NOT NULL THEN list_transform(cw, lambda c: len(list_filter(pw, lambda x: x = c))::DOUBLE) END AS hs FROM (SELECT *, list_filter(string_split_regex(translate(lower(t), '{_MARKS}', '{" " * len(quality.MARKS)}'), '[\x20\x09-\x0D]+'), lambda x: list_contains(cw, x)) AS pw FROM f)),
s AS (SELECT *, CASE WHEN hs IS NOT NULL THEN list_concat(hs, [greatest(n - list_sum(hs), 0)]) END AS qs FROM h),
p AS (SELECT *, {_SHARES("cs")} AS p, CASE WHEN qs IS NOT NULL THEN {_SHARES("qs")} END AS q FROM s),
good AS (SELECT lang, p, q FROM p WHERE NOT bf AND enough),
rp AS (SELECT lang, list(v ORDER BY i) AS rp FROM (SELECT lang, i, sum(round(p[i] * {quality.PARTS})::BIGINT)::DOUBLE / count(p[i]) / {quality.PARTS} AS v FROM good, range(1, 8) r(i) GROUP BY ALL) GROUP BY lang),
rq AS (SELECT lang, list(v ORDER BY i) AS rq FROM (SELECT lang, i, sum(round(q[i] * {quality.PARTS})::BIGINT)::DOUBLE / count(q[i]) / {quality.PARTS} AS v FROM good, range(1, {quality.WORDS + 2}) r(i) WHERE q IS NOT NULL GROUP BY ALL) GROUP BY lang),
d AS (SELECT p.*, {_DISTANCE("p", "rp", _PART("p[i]", "rp[i]"), _PART("rp[i]", "p[i]"))} AS dc, {_DISTANCE("q", "rq", _PART("q[i]", "rq[i]"), _PART("rq[i]", "q[i]"))} AS dw FROM p LEFT JOIN rp USING (lang) LEFT JOIN rq USING (lang)),
x AS (SELECT *, floor(round(coalesce(dc, 0) + coalesce(dw, 0) - {quality.ALLOWANCE} / sqrt(greatest(n, 1)), 9) * {quality.BINS})::BIGINT AS bin FROM d),
c AS (SELECT lang, bin, sum(count(*)) OVER (PARTITION BY lang ORDER BY bin) AS up_to, sum(count(*)) OVER (PARTITION BY lang) AS every FROM x WHERE NOT bf GROUP BY lang, bin),
u AS (SELECT lang, min(bin) FILTER (4 * up_to >= 3 * every) AS q3, min(bin) FILTER (4 * up_to >= every) AS q1 FROM c GROUP BY lang)
SELECT doc_id, n AS n_words, wc AS word_chars, sy AS n_symbols, dl AS n_dup_lines, rw AS n_repeat_words, bf AS base_failed,
  NOT bf AND NOT coalesce(bin > q3 + {quality.FENCE} * (q3 - q1), false) AS kept, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance FROM x LEFT JOIN u USING (lang)
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS learnt,
    sum(length(role) + length(text) + 17 + length(text) - length(replace(replace(text, '\', ''), '<', '')))::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": OP4_SQL, "op5_near_dedup": OP5_SQL, "op6_quality_rules": OP6_SQL, "op10_chat_formatting": OP10_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
