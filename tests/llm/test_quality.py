import random
import re
from collections import Counter

from compare import duck, rows_of
from sheafline.llm import quality, queries


def brute(text):
    text = text or ""
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    words, seen, dup = split(text), set(), 0
    for line in text.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if twice[w] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op6_quality_rules(spark, small).collect()
    check(rows, {r.doc_id: r.text for r in table.collect()})
    clean = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    assert all(r.kept for r in rows if r.doc_id in clean and not r.base_failed)


def test_query_equals_sql(spark, small):
    assert rows_of(queries.op6_quality_rules(spark, small).toPandas()) == rows_of(duck(queries.OP6_SQL, small))


def test_no_python_in_the_plan(spark, small):
    plan = queries.op6_quality_rules(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_small_cases(docs, odd, none):
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\n{line}\n \n{line} ten"), (2, "a " * 40), (3, None), (4, ""), (5, "#" * 50), (6, " ".join(str(i) for i in range(30)) + "\n\n\n"), (7, "é ß 日本 | < >"), (8, "x\x0by\x0cz\r\nx y"), (9, "\n".join(["same"] * 30))]
    check(quality.quality_verdicts(docs(rows)).collect(), dict(rows))
    assert quality.quality_verdicts(odd).count() == odd.count() and quality.quality_verdicts(none).count() == 0
    judged = quality.judge(odd).select("__doc.*")
    assert judged.columns == odd.columns


def test_divergence_rejects_what_is_unlike_its_language(docs):
    words = "the of and to a in is that for with was on house garden river stone light water people morning".split()
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(words) + ("," if rng.random() < 0.1 else "") for _ in range(220))
    rows = [(i, plain()) for i in range(40)] + [(100, plain().upper()), (101, " ".join(w + "$$##%%" for w in plain().split())), (102, "XYZ QQQ")]
    got = {r.doc_id: r for r in quality.quality_verdicts(docs(rows)).collect()}
    fair = [i for i in range(40) if not got[i].base_failed]
    assert fair and all(got[i].kept for i in fair) and not got[100].kept and not got[101].kept and not got[102].kept


def test_spread_rejects_labelled_junk_and_keeps_clean_documents(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, small).collect()}
    passed = [r.doc_id for r in docs.collect() if not brute(r.text)[5]]
    junk, clean = ([d for d in passed if labels.get(d) == q] for q in (0, 1))
    assert len(junk) > 0 and sum(d not in kept for d in junk) >= 0.9 * len(junk) and sum(d in kept for d in clean) >= 0.99 * len(clean)


def test_distance(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    assert [round(r.d, 9) for r in frame.select(quality.jensen_shannon(F.col("p"), F.col("q")).alias("d")).collect()] == [0.0, 1.0]
