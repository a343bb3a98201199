import itertools
import random

import numpy as np
import pytest

from compare import duck, rows_of
from sheafline.llm import components, neardup, queries


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, numerator, denominator):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (d, _), k in zip(rows, label):
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return sorted(str((d, len(s), least.get(k) if s else d)) for (d, _), s, k in zip(rows, sets, label))


def family(seed, n, most):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(160)]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(most)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width, numerator", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, width, numerator):
    texts = family(1, 60, 16) + family(2, 25, 6) + ["a", "a", "a b", "A B", "", None, "  ", "x y z", "X  y\nz"] + [" ".join(f"u{i}_{k}" for k in range(30)) for i in range(40)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[5 * i : 5 * i + 150]) for i in range(10)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(docs(rows), width, numerator, 100).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, width, numerator, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_many_small_blocks_lose_no_link(docs, monkeypatch):
    """Families cut by members and by shingles: similar long texts, most of them not linked with the pivot."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(400)], []
    for i in range(60):  # 60 texts a fifth of which differs from the common one, and a near copy of each third of them
        words = [f"x{i}_{k}" if rng.random() < 0.055 else w for k, w in enumerate(base)]
        texts.append(" ".join(words))
        if i % 3 == 0:
            texts.append(" ".join(words[:-2]))
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(docs(rows)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, 5, 80, 100)
    assert len({r.component_id for r in got}) > 1


def test_marks_grow_with_the_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sheafline.llm import common

    frame, keys = spark.range(5000).withColumnRenamed("id", "k"), common.stage(spark.range(0, 5000, 50).withColumnRenamed("id", "k"), "test-keys")
    got = common.with_marks(frame, keys, "k")
    assert got.where((F.col("k") % 50 == 0) & ~F.col("marked")).count() == 0 and got.where("marked").count() < 200
    monkeypatch.setattr(common, "MOST_BITS", 1 << 10)
    assert common.with_marks(frame, keys, "k").where("marked").count() == 5000


def test_query_equals_sql(spark, small):
    assert rows_of(queries.op5_near_dedup(spark, small).toPandas()) == rows_of(duck(queries.OP5_SQL, small))


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = neardup.near_duplicates(odd).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, 5, 80, 100)
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_one_of_each_group_stays(odd, docs):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("same text twice") == 1 and texts.count(None) == 2 and len(texts) == odd.count() - 2
    rows = [(i, t) for i, t in enumerate(family(3, 30, 3))]
    assert [r.doc_id for r in neardup.keep_one(docs(rows)).collect()].__len__() == len({x.split(", ")[2] for x in brute(rows, 5, 80, 100)})


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    a, b = np.unique(items[:600]), np.unique(items[300:])
    whole = neardup.sketch(np.unique(items))
    assert (neardup.merge_sketches(neardup.sketch(a), neardup.sketch(b)) == whole).all()
    pairs = []
    for _ in range(20):
        u = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        pairs.append((neardup.sketch(np.sort(u[:380])), neardup.sketch(np.sort(u[20:]))))
    x, y = (np.array(p) for p in zip(*pairs))
    n = np.full(20, 380.0)
    assert abs((x == y).mean() - 0.9) < 0.04 and neardup.could_reach(x, y, n, n, 0.85).all()
    assert not neardup.could_reach(x, np.roll(y, 1, axis=0), n, n, 0.85).any()
    assert neardup.sketch(np.zeros(0, np.uint64)).sum() == 0


def test_cells_are_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    links = neardup.cell_links(sets, list(range(40)), np.ones(40, dtype=bool), 60, 100)
    label = list(range(40))
    for i, j in links:
        both = len(set(sets[i]) & set(sets[j]))
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    want = list(range(40))
    for i, j in itertools.combinations(range(40), 2):
        both = len(set(sets[i]) & set(sets[j]))
        if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
            want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert len(set(label)) == len(set(want)) and len(links) == 40 - len(set(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(roots.values()) == {0, 100} and roots[40] == 0 and roots[129] == 100
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
