import corpus_pipeline
from pyspark.sql import functions as F

from test_neardup import brute as groups
from test_packing import check as check_packing
from test_quality import brute as counts


def stages(spark, docs):
    made = [docs]
    for _, function in corpus_pipeline.STAGES:
        made.append(function(spark, made[-1], ""))
    return made


def test_each_stage_on_its_own_input(spark, small):
    docs, good, single, masked, packed = stages(spark, spark.read.parquet(f"{small}/documents.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in good.collect()}
    assert all(not counts(texts[d])[5] for d in kept) and good.columns == docs.columns
    clean = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    assert all(d in kept for d in clean if not counts(texts[d])[5])
    rows = sorted((d, texts[d]) for d in kept)
    label = {}
    for line in groups(rows, 5, 80, 100):
        d, _, c = (int(x) for x in line.strip("()").split(", "))
        label[d] = c
    left = [r.doc_id for r in single.collect()]
    assert len(left) == len(set(label.values())) and {label[d] for d in left} == set(label.values())
    after = {r.doc_id: r for r in masked.collect()}
    assert set(after) == set(left) and masked.columns == docs.columns
    changed = [d for d in after if after[d].text != texts[d]]
    assert all("[SECRET]" in after[d].text and after[d].n_chars == len(after[d].text) for d in changed)
    used, bound = check_packing(packed.collect(), {d: r.text for d, r in after.items()})
    assert used <= bound * 1.03 + 1


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_odd_rows(spark, odd, none):
    for made in (stages(spark, odd), stages(spark, none)):
        assert all(m.count() >= 0 for m in made) and made[3].columns == made[0].columns
    long = odd.where("doc_id = 6").withColumn("text", F.regexp_replace("text", "word(\\d+)", "w$1 the"))
    assert stages(spark, long)[4].count() >= 0
