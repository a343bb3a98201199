"""64-bit hashes of all words of many texts at once.

Words are runs outside \\x20 and \\x09-\\x0D after A-Z are put in lower case.  The hash of a word is a polynomial over
random 64-bit values of its bytes, taken as a difference of prefix sums, then mixed with its length; no word becomes a
Python object.
"""

from __future__ import annotations

import numpy as np

STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche permutation of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """STEP**i and its inverse for i below n or more."""
    if len(_powers[0]) < n:
        size = -(-n >> 18) + 1 << 18
        for k, step in enumerate((STEP, pow(STEP, -1, 1 << 64))):
            table = np.full(size, step, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, out=table)
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer((b" ".join(raw) + b" ").lower(), dtype=np.uint8)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    after = space.copy()
    after[1:] &= ~space[:-1]
    after[0] = False
    starts, ends = np.flatnonzero(begins), np.flatnonzero(after)
    up, down = powers(len(data))
    sums = VALUES[data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    edges = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    return hashes, np.diff(edges, prepend=0)


def with_ends(hashes: np.ndarray, counts: np.ndarray, end: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more word, the end, after each text."""
    lengths = counts + 1
    out = np.full(int(lengths.sum()), end, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside] = hashes
    return out, lengths
