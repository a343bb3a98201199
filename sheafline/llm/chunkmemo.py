"""Encoding of whole texts by remembered chunks.

The pre-token pattern never matches across the point before a single space that stands between two non-space
characters, so a text without other runs of white space there is the concatenation of its chunks " word", each encoded
alone.  Chunks not seen yet are encoded together, in one call; texts that don't split this way go to the encoder whole.
The memory is bounded: it starts anew beyond a fixed number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 256  # longer chunks are encoded but not remembered


class ChunkMemo:
    def __init__(self, encode: Callable[[str], np.ndarray], lengths: np.ndarray, most: int = 600_000):
        """encode: a text's ids; lengths: bytes of each id."""
        self.encode, self.lengths, self.most = encode, lengths, most
        self.memo: dict[str, bytes | None] = {}  # chunks after a space
        self.heads: dict[str, bytes | None] = {}  # chunks at a text's start

    def _learn(self, missing: list[str], memo: dict[str, bytes | None], separator: str) -> None:
        """Encode the chunks, each after the separator; " " belongs to its chunk, a line break is a token of its own."""
        good, skip = [], separator != " "
        for chunk in missing:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                memo[chunk] = None  # its white space meets the space before or after it
            else:
                good.append(chunk)
        if not good:
            return
        ids = np.asarray(self.encode(separator + separator.join(good)), dtype="<u4")
        ends = np.cumsum(self.lengths[ids])
        edges = np.cumsum([len(x.encode()) + 1 for x in good])
        last = np.searchsorted(ends, edges)
        if not (last < len(ends)).all() or not (ends[last] == edges).all():
            raise ValueError("a token crosses a chunk's edge")
        packed, a = ids.tobytes(), 0
        for chunk, b in zip(good, ((last + 1) * 4).tolist()):
            memo[chunk] = packed[a + 4 * skip : b]
            a = b

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for memory in (self.memo, self.heads):
            if len(memory) > self.most:
                memory.clear()
        memo, heads = self.memo, self.heads
        parts = [t.split(" ") for t in texts]
        wanted: set[str] = set()
        for p in parts:
            wanted.update(p)
        missing = [x for x in wanted if x not in memo]
        self._learn(missing, memo, " ")
        starts = [x for x in {p[0] for p in parts} if x not in heads]
        self._learn(starts, heads, "\n")
        out = []
        for text, p in zip(texts, parts):
            packed = None
            if (head := heads[p[0]]) is not None:
                try:
                    packed = head + b"".join(map(memo.__getitem__, p[1:]))
                except TypeError:  # a chunk with white space at its edge
                    pass
            if packed is None:
                packed = np.asarray(self.encode(text), dtype="<u4").tobytes() if text else b""
            out.append(packed)
        for memory, new in ((memo, missing), (heads, starts)):
            for chunk in new:
                if len(chunk) > LONGEST:
                    del memory[chunk]
        return out
