"""Byte-level BPE by a hierarchical-bitmap rank queue.

All symbols of a batch of pre-tokens form one linked list with barriers between pre-tokens.  Each merge rank has a
bucket of list positions; a three-level bitmap of 64-bit words says which buckets hold something, and find-first-set
yields the lowest rank.  A position popped from its bucket is stale, and skipped, if it was merged away or its pair has
changed.  Pre-tokens are independent and pops are in rank order, so a batch does what each pre-token alone would; a
pre-token of any length costs its number of merges, not its square.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkmemo import ChunkMemo
from .common import arrow_limits, chunks, text_or_empty


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks + 63) // 64)
        self.mid = [0] * ((len(self.low) + 63) // 64)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with its positions, in order; None when all buckets are empty."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) | ((word & -word).bit_length() - 1)
        word = self.low[a]
        rank = (a << 6) | ((word & -word).bit_length() - 1)
        self.low[a] &= word - 1
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


class Codec:
    """Encoder and decoder of one vocabulary file of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], dtype=np.int64)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.find = regex.compile(pattern)
        self._pair_table()
        # for decoding by slices of one byte string
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _pair_table(self) -> None:
        """Open-addressed table from pairs of tokens to the rank of their concatenation."""
        ranks, keys, values = self.ranks, [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.slot_keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_ranks = np.full(1 << self.bits, -1, dtype=np.int32)
        keys, values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slot_keys[at[put]], self.slot_ranks[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation; -1 if it is no token or a barrier stands there (token -1)."""
        out = np.full(len(left), -1, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo] << 20 | right[todo]
        at = self._slot(keys)
        while len(todo):
            found = self.slot_keys[at]
            hit = found == keys
            out[todo[hit]] = self.slot_ranks[at[hit]]
            on = ~hit & (found != -1)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of ids of each."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        n = int(sizes.sum()) + len(pieces)
        barrier = np.cumsum(sizes + 1) - 1
        body = np.ones(n, dtype=bool)
        body[barrier] = False
        token = np.full(n, -1, dtype=np.int64)
        token[body] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, dtype=bool)
        rank_at = np.full(n, -1, dtype=np.int32)
        rank_at[:-1] = self.pair_ranks(token[:-1], token[1:])
        queue = RankQueue(self.size)

        def push(positions: np.ndarray) -> int:
            """Into their buckets, in order of position; the lowest rank."""
            ranks = rank_at[positions]
            some = ranks >= 0
            positions, ranks = positions[some], ranks[some]
            if not len(ranks):
                return self.size
            if len(ranks) <= 2:
                for r, p in zip(ranks.tolist(), positions):
                    queue.push(r, np.array([p]))
                return int(ranks.min())
            order = np.lexsort((positions, ranks))
            positions, ranks = positions[order], ranks[order]
            edges = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1], [True]])).tolist()
            for a, b in zip(edges, edges[1:]):
                queue.push(int(ranks[a]), positions[a:b])
            return int(ranks[0])

        push(np.flatnonzero(rank_at >= 0))
        while (popped := queue.pop()) is not None:
            rank, at = popped
            at = at[alive[at] & (rank_at[at] == rank)]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping pairs of one rank the left one merges first
                joined = after[at[:-1]] == at[1:]
                if joined.any():
                    run = np.concatenate([[0], np.cumsum(~joined)])
                    first = np.flatnonzero(np.concatenate([[True], ~joined]))
                    at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            right = after[at]
            token[at] = rank
            alive[right] = False
            rank_at[right] = -1
            beyond = after[right]
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            left = left[left >= 0]
            touched = np.unique(np.concatenate([at, left])) if len(at) > 1 else np.concatenate([left, at])
            rank_at[touched] = self.pair_ranks(token[touched], token[after[touched]])
            if push(touched) < rank:
                # a pair of lower rank came up: other places of this rank in the same pre-token may have had to wait
                return self._one_by_one(pieces)
        kept = alive & body
        return token[kept], np.add.reduceat(kept.astype(np.int64), barrier - sizes) if len(pieces) else np.zeros(0, np.int64)

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same queue, one position at a time."""
        ids, counts = [], []
        for piece in pieces:
            token = [int(self.single[x]) for x in piece] + [-1]
            n = len(piece)
            after, before, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * n
            rank_of = lambda i: self.ranks.get(self.tokens[token[i]] + self.tokens[token[after[i]]], -1) if token[after[i]] >= 0 else -1
            rank_at = [rank_of(i) for i in range(n)]
            buckets: dict[int, list[int]] = {}
            queue = RankQueue(self.size)

            def push(i, buckets=buckets, queue=queue, rank_at=rank_at):
                if rank_at[i] >= 0:
                    queue.push(rank_at[i], np.array([i]))

            for i in range(n):
                push(i)
            while (popped := queue.pop()) is not None:
                rank, at = popped
                live = [i for i in at.tolist() if alive[i] and rank_at[i] == rank]
                if not live:
                    continue
                i, rest = live[0], live[1:]
                j = after[i]
                token[i], alive[j], rank_at[j] = rank, False, -1
                after[i] = after[j]
                before[after[i]] = i
                for k in (before[i], i):
                    if k >= 0:
                        rank_at[k] = rank_of(k)
                        push(k)
                for k in rest:
                    push(k)
            out = [token[i] for i in range(n) if alive[i]]
            ids += out
            counts.append(len(out))
        return np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: a pre-token that is a token is that token; the others go through the queue."""
        pieces = [p.encode() for p in self.find.findall(text)]
        if not pieces:
            return np.zeros(0, dtype=np.uint32)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        if not len(rest):
            return whole.astype(np.uint32)
        ids, counts = self.merge([pieces[i] for i in rest.tolist()])
        size = np.ones(len(pieces), dtype=np.int64)
        size[rest] = counts
        out = np.empty(int(size.sum()), dtype=np.uint32)
        mine = np.repeat(whole < 0, size)
        out[mine] = ids
        out[~mine] = whole[whole >= 0]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the vocabulary's bytes."""
        if not len(ids):
            return b""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]))].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def remembered(path: str, pattern: str) -> ChunkMemo:
    own = codec(path, pattern)
    return ChunkMemo(own.encode, own.lengths, most=1_000_000)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs: encoded, then decoded again.

    A null text is empty and has no tokens.  Null doc_ids and repeated rows are kept, an empty table gives an empty
    result, other columns are ignored, and texts and pre-tokens may have any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = codec(ranks_path, pattern), remembered(ranks_path, pattern)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in chunks(batch.column("text").to_pylist(), 8 << 20):
                counts, digests, backs = [], [], []
                for packed in memo.encode_all(texts):
                    ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(packed).hexdigest())
                    backs.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.record_batch([pa.array(doc_ids[first : first + len(texts)], pa.int64()), pa.array(counts, pa.int64()), pa.array(digests), pa.array(backs)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, DIGESTS)
