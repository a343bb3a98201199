import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sheafline.llm import bpe, queries

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_whole_table(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, small).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_random_texts(own, library):
    rng = random.Random(5)
    parts = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "é", "日本", "1", "22", "!!", "'s", "'re", " ", "aaaa", "zzzz", "http://", "\x1c", "\x85", " ", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(800)]
    memo = bpe.remembered(RANKS, P.PATTERN)
    for text, packed in zip(texts, memo.encode_all(texts)):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == library.encode_ordinary(text) and own.decode(ids.astype(np.int64)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000)), "\U0001f600" * 3000, "é" * 5001, ""])
def test_long_pretokens(own, library, text):
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_both_ways_of_the_queue_agree(own, library):
    words = [w.encode() for w in "unbelievable xylophone aaaaaaa mississippi internationalisation zzzyzzz".split()]
    ids, counts = own.merge(words)
    again, same = own._one_by_one(words)
    assert ids.tolist() == again.tolist() and counts.tolist() == same.tolist()
    assert own.merge([])[0].tolist() == []


def test_queue_orders_ranks():
    queue = bpe.RankQueue(50_256)
    for rank in (50_255, 7, 4096, 64, 63, 7):
        queue.push(rank, np.array([rank]))
    out = []
    while (popped := queue.pop()) is not None:
        out.append(popped[0])
        if popped[0] == 64:
            queue.push(5, np.array([1]))
    assert out == [7, 63, 64, 5, 4096, 50_255]


def test_odd_rows(odd, none, library):
    got = bpe.token_digests(odd, RANKS, P.PATTERN).collect()
    want = sorted((str(r.doc_id), len(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got) == want
    assert bpe.token_digests(none, RANKS, P.PATTERN).count() == 0
