import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from sheafline.llm import packing, queries

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def check(rows, texts, capacity=2048):
    """texts: by doc_id, each id once."""
    tok = Tokenizer.from_file(JSON)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for d, pieces in by_doc.items():
        ids = np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        total += len(ids)
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or r.piece == 0
            at += r.length
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), -(-total // capacity)


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    used, bound = check(queries.op3_packing(spark, small).collect(), texts)
    assert used <= bound * 1.02 + 1


def test_odd_rows(docs, odd, none):
    rows = [(1, None), (2, ""), (3, "a " * 9000), (4, "x" * 9000), (5, "<|endoftext|> is text"), (6, "tail "), (7, "two  spaces\n\n"), (8, " lead")]
    check(packing.pack_documents(docs(rows), JSON, RANKS, P.PATTERN).collect(), dict(rows))
    assert packing.pack_documents(odd, JSON, RANKS, P.PATTERN).where("piece = 0").count() == odd.count()
    assert packing.pack_documents(none, JSON, RANKS, P.PATTERN).count() == 0


def test_both_encoders_agree(docs, spark, small):
    rows = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    fast, slow = packing.encoder(JSON, RANKS, P.PATTERN), packing.encoder(JSON, "", "")
    rows += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext", "no\n<|endoftext|>\n\nyes <|endoftext|>", ""]
    assert fast.encode_all(rows) == slow.encode_all(rows)
    assert fast.encode_all(["x<|endoftext|>"])[0][-4:] == (50256).to_bytes(4, "little")


def test_crossover_wins_where_best_fit_misses_the_bound(spark):
    """A table that best fit, largest first, packs into more sequences than the bound; the islands reach fewer."""
    rng = np.random.default_rng(12)
    pairs = zip(rng.integers(560, 800, 200).tolist(), rng.integers(560, 740, 200).tolist())
    sizes = [x for a, b in pairs for x in (a, b, 2048 - a - b)]  # sequences of three pieces that fill them
    plain = packing.best_fit(np.array(sizes), np.argsort(-np.array(sizes), kind="stable"), 2048).max() + 1
    bound = -(-sum(sizes) // 2048)
    frame = spark.createDataFrame([(i, i, 0, 0, x, 0) for i, x in enumerate(sizes)], packing.PIECES)
    packed = packing.pack(frame, islands=4, epochs=3).collect()
    used = len({r.sequence_id for r in packed})
    assert bound <= used < plain


def test_islands_improve_and_keep_items():
    rng = np.random.default_rng(5)
    sizes = rng.integers(300, 1100, 600).astype(np.int32)
    first = packing.best_fit(sizes, np.arange(len(sizes)), 2048)
    grown = packing.evolve(sizes, [], 2048, [1, 2, 3], generations=20)
    again = packing.evolve(sizes, [grown[0], first], 2048, [4], generations=10)
    for packed in (*grown, *again):
        fill = np.bincount(packed, weights=sizes)
        assert fill.max() <= 2048 and fill.min() > 0 and len(packed) == len(sizes)
    key = lambda x: packing.fitness(sizes, x, 2048)
    assert key(again[0]) >= key(grown[0]) >= key(packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 2048)) > key(first)


def test_many_blocks(spark):
    rows = [(i, i, 0, 0, 100 + i * 37 % 1900, 0) for i in range(500)]
    frame = spark.createDataFrame(rows, packing.PIECES)
    packed = packing.pack(frame, block_items=64, islands=3, epochs=3).collect()
    assert sorted(r.row for r in packed) == list(range(500))
    loads = defaultdict(int)
    for r in packed:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 2048 and len(loads) <= 1.1 * sum(loads.values()) / 2048 + 16
