import zlib
from collections import defaultdict

import numpy as np

from sheafline.llm import queries, sharding


def check(rows, texts, shards):
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (d for d, _ in texts)))
    slots, homes, loads = defaultdict(list), defaultdict(set), [0] * shards
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    by_id = defaultdict(list)
    for d, t in texts:
        by_id[d].append(t)
    for r in rows:
        for t in by_id[r.doc_id]:
            if zlib.crc32((t or "").encode()) == r.text_crc32:
                homes[t or ""].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    return loads


def test_groups_stay_and_loads_are_near(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in frame.collect()]
    loads = check(queries.op1_sharding(spark, small).collect(), texts, 16)
    largest = defaultdict(int)
    for _, t in texts:
        largest[t] += len(t.encode()) + 1
    assert max(loads) <= sum(loads) / 16 + max(largest.values())


def test_longest_first_is_the_greedy_rule():
    sizes = np.array([7, 7, 6, 6, 5, 4, 4, 4, 1])
    loads = np.bincount(sharding.longest_first(sizes, 3), weights=sizes)
    assert loads.max() <= 4 / 3 * np.ceil(sizes.sum() / 3)
    assert len(sharding.longest_first(np.zeros(0, dtype=np.int64), 3)) == 0


def test_odd_rows(odd, none):
    rows = sharding.assign_shards(odd, 4).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], 4)
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {1} and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert sharding.assign_shards(none, 4).count() == 0


def test_a_group_with_a_third_of_all_rows(docs):
    rows = [(i, "the hot text") for i in range(400)] + [(1000 + i, f"text number {i}") for i in range(800)]
    check(sharding.assign_shards(docs(rows), 16).collect(), rows, 16)
