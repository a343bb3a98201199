import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import lm, queries, tokenhash


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def base(rows):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in tokens(t))
    size = sum(counts.values()) + len(counts) + 1
    return held, counts, {d: sum(math.log10((counts[w] + 1) / size) for w in tokens(t)) for d, t in rows}


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def test_base_score_is_exact_and_the_model_beats_it(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    held, counts, expected = base(rows)
    got = {r.doc_id: r for r in queries.op2_lm_scoring(spark, small).collect()}
    for d, t in rows:
        assert (got[d].held_out, got[d].n_tokens, got[d].train_tokens) == (held[d], len(tokens(t)), sum(counts.values()))
        assert got[d].n_known == sum(counts[w] > 0 for w in tokens(t)) and got[d].base_score == pytest.approx(expected[d], rel=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_many_buckets_and_a_small_head_give_the_same(docs):
    """One bucket that the head covers; 256 buckets with a head of a few words, so that most is asked."""
    rows = [(i, " ".join(f"w{(i * k) % 40}" for k in range(1, 60))) for i in range(60)]
    one = lm.language_model_scores(docs(rows), held_out()).orderBy("doc_id").collect()
    many = lm.language_model_scores(docs(rows), held_out(), bucket_bytes=64, head_bytes=64, top_tokens=3).orderBy("doc_id").collect()
    assert lm.bucket_bits(sum(len(t) for _, t in rows), 64) >= 7
    for a, b in zip(one, many):
        assert a.score == pytest.approx(b.score, rel=0.05) and a.base_score == pytest.approx(b.base_score) and a.n_known == b.n_known


def model_by_hand(rows, held):
    """Scores from exact counts, quantised as the filter does, with the weights chosen by leave-one-out likelihood."""
    words, pairs = Counter(), Counter()
    for d, t in rows:
        if not held[d]:
            words.update(tokens(t))
            pairs.update(zip([None, *tokens(t)], tokens(t)))
    starts = sum(not held[d] for d, _ in rows)
    size = sum(words.values()) + len(words) + 1
    quantised = lambda n: float(lm.MEANING[lm.levels_of(np.array([n]))[0]])

    def log_p(cw, cv, c2, x):
        p1 = (cw + 1) / size
        return math.log10(p1) if cv <= 0 else math.log10((1 - x) * p1 + x * (min(c2, cv) / cv if c2 > 0 else 0))

    kind = lambda cv: max(i for i, e in enumerate(lm.CONTEXT_EDGES) if e <= cv)
    seen = {i: [(quantised(words[w]), quantised(starts if v is None else words[v]), quantised(pairs[v, w])) for v, w in zip([None, *tokens(t)], tokens(t))] for i, (_, t) in enumerate(rows)}
    likely = [[0.0] * len(lm.LAMBDAS) for _ in lm.CONTEXT_EDGES]
    for i, (d, _) in enumerate(rows):
        for cw, cv, c2 in seen[i] if not held[d] else []:
            cw, cv, c2 = max(cw - 1, 0), max(cv - 1, 0), max(c2 - 1, 0)
            if cv > 0:
                for j, x in enumerate(lm.LAMBDAS):
                    likely[kind(cv)][j] += log_p(cw, cv, c2, x)
    best = [lm.LAMBDAS[max(range(len(row)), key=row.__getitem__)] for row in likely]
    return [sum(log_p(cw, cv, c2, best[kind(cv)] if cv > 0 else 0) for cw, cv, c2 in seen[i]) for i in range(len(rows))]


@pytest.mark.parametrize("bucket_bytes, head_bytes, top_tokens", [(1 << 20, 1 << 16, 1000), (200, 64, 3), (40, 8, 0)])
def test_scores_by_hand(docs, bucket_bytes, head_bytes, top_tokens):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) % 300)) for i in range(50)] + [(60, ""), (61, None), (62, "w1 w1 w1 never seen")]
    held, counts, expected = base(rows)
    got = {r.doc_id: r for r in lm.language_model_scores(docs(rows), held_out(), bucket_bytes, head_bytes, top_tokens).collect()}
    wanted = model_by_hand(rows, held)
    for (d, t), score in zip(rows, wanted):
        assert got[d].base_score == pytest.approx(expected[d], rel=1e-9) and got[d].n_known == sum(counts[w] > 0 for w in tokens(t))
        assert got[d].score >= score - 1e-9 or got[d].score == pytest.approx(score, rel=0.1)  # the filter only over-reports
    assert sum(r.score for r in got.values()) == pytest.approx(sum(wanted), rel=0.03)
    assert sum(abs(got[d].score - s) < 0.03 * abs(s) for (d, _), s in zip(rows, wanted)) > len(rows) // 2


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = lm.language_model_scores(odd, held_out()).collect()
    _, _, expected = base([x for x in rows])
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)
    for r in got:
        if r.doc_id in (1, 4, 6, 9):
            assert r.base_score == pytest.approx(expected[r.doc_id], rel=1e-9)
    assert lm.language_model_scores(none, held_out()).count() == 0


def test_filter_never_reports_less():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    levels = lm.levels_of(np.maximum(1, rng.pareto(1.0, len(keys)).astype(np.int64)))
    for bits in (0, 3, 12):
        buckets, short = lm.buckets_of(keys, bits), lm.short_of(keys, bits)
        held = lm.Filter([lm.slab(short[buckets == b], levels[buckets == b]) for b in range(1 << bits)])
        found = held.levels(buckets, short)
        assert (found >= levels).all() and (found == levels).mean() > 0.9
        other = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
        assert (held.levels(lm.buckets_of(other, bits), lm.short_of(other, bits)) > 0).mean() < 0.1
    assert (lm.MEANING[lm.levels_of(np.arange(1, 6))] == np.arange(1, 6)).all()


def test_pairs_seen_once_are_kept():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a b a b c", "a d"])], names=["text"])
    merged = lm.merge_bucket(0, 1000)(pa.Table.from_batches(list(lm.count_batches(0)(iter([batch])))))
    ids, lengths = tokenhash.with_ends(*tokenhash.word_hashes(["a b a b c", "a d"]), lm.END)
    seen = Counter(lm.short_of(lm.pair_keys(lm.context_of(ids, lengths, lm.START), ids), 0).tolist())
    levels = dict(zip(np.frombuffer(merged["pairs"][0].as_py(), "<u4").tolist(), np.frombuffer(merged["levels"][0].as_py(), np.uint8).tolist()))
    assert sorted(seen.values()) == [1, 1, 1, 1, 1, 2, 2] and levels == {k: lm.levels_of(np.array([n]))[0] for k, n in seen.items()}
    held = lm.Filter([merged["slab"][0].as_py()])
    assert all(held.levels(np.zeros(1, np.int64), np.array([k], np.uint32))[0] >= level for k, level in levels.items())


def test_the_head_is_bounded(docs):
    """Whatever the corpus, the head holds no more than its bytes and a word a bucket, the top no more than its words."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.zipf(1.3, 400) % 5000)) for _ in range(100)]
    table = pa.Table.from_batches(list(lm.count_batches(4)(iter([pa.record_batch([pa.array(texts)], names=["text"])]))))
    spark = docs([]).sparkSession
    counted = spark.createDataFrame(table.to_pandas(), lm.COUNTED)
    merged = counted.groupBy("bucket").applyInArrow(lm.merge_bucket(4, 2000), lm.MERGED)
    pair_level, word_level = lm.least_level(merged, "pair_levels", 2000, lambda x: x), lm.least_level(merged, "top_levels", 50, lambda x: 1)
    head = lm.head_of(merged, pair_level, word_level)
    assert sum(len(b or b"") for b in head["slab"].to_pylist()) <= 2000 * lm.BITS_PER_LEVEL // 8 + 16 * 8
    assert 0 < sum(len(b) // 8 for b in head["words"].to_pylist()) <= 50


def test_word_hashes_follow_words():
    texts = ["The the  THE\tx\ny", "", " \n", "a b", "É é the", "x" * 5000]
    hashes, counts = tokenhash.word_hashes(texts)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert counts.tolist() == [len(t.encode().lower().split()) for t in texts] and len(hashes) == len(words)
    by_word = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
