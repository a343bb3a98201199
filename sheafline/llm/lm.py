"""Language-model scoring from a log-frequency Bloom filter.

Counts of token pairs are quantised on a quarter-octave scale and kept in a Bloom filter: a pair of level q is inserted
q times, with the levels 1..q mixed into its hash.  A lookup probes level after level until one is absent, so it never
under-reports and over-reports with a small probability.  The probability of a token interpolates the pair estimate
with the add-one token estimate; the weight depends on how often the context occurs and is chosen by leave-one-out
likelihood over all training documents.

The work is in proportion to the input, on one path for every size.  N-grams are dealt by the high bits of their hash
into buckets of about BUCKET_BYTES of text; a bucket counts its own n-grams and builds its own slab of the filter.  The
head of the filter, the most frequent pairs, has at most HEAD_BYTES and is broadcast.  Texts are read once more, in
chunks: what the head and the most frequent words settle is summed up at once; every other distinct pair or word of a
chunk is asked of the bucket that holds it, in one shuffle of packed keys, and the levels go back to the chunk.

Token counts (for the base score) are exact.  Tokens are known by 64-bit hashes; of ten million different tokens two
share one with a probability of about 3e-6.  Within its bucket a pair is known by 32 bits; two pairs of a bucket share
them far more rarely than the filter over-reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, binary, chunks, stage, text_or_empty
from .tokenhash import mix, with_ends, word_hashes

#: Parameters of the model, documented in the README.
BITS_PER_LEVEL, PROBES = 10, 5
HEAD_BYTES = 16 << 20  # of the filter's head, which is broadcast
TOP_TOKENS = 200_000  # tokens whose exact counts are broadcast
BUCKET_BYTES = 16 << 20  # of text behind one bucket of n-grams
MOST_BUCKETS = 1 << 24
FLUSHED_TOKENS = 2_000_000  # tokens counted together by a task before they are dealt
SCORED_CHARS = 2 << 20  # texts scored at once: the more, the fewer lookups of words and pairs that come again
HASHED_CHARS = 1 << 18  # of these, texts hashed at once, which takes many bytes a character
LAMBDAS = (0.0, 0.02, 0.08, 0.2, 0.4, 0.65, 0.85)
CONTEXT_EDGES = (1, 4, 16, 128, 2048)  # classes of context counts that have a weight of their own

#: Hashes of the end of a text and of what stands before its first word.
END, START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
THRESHOLDS = np.unique(np.floor(2.0 ** (np.arange(4 * 50) / 4.0)).astype(np.int64))
#: What a level stands for: the middle of its range; exact for small counts.
MEANING = np.concatenate([[0.0], np.where(np.diff(THRESHOLDS, append=THRESHOLDS[-1] * 2) == 1, THRESHOLDS, (THRESHOLDS + np.append(THRESHOLDS[1:], THRESHOLDS[-1] * 2) - 1) / 2)])
OPEN = 255  # in place of a level: not known yet
#: The bits that one insertion sets in a word of the filter.
MASKS = np.bitwise_or.reduce(np.uint64(1) << np.random.default_rng(11).integers(0, 64, (1 << 14, PROBES), dtype=np.uint64), axis=1)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, side="right").astype(np.uint8)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0x5851F42D4C957F2D)))


def bucket_bits(size: int, of: int) -> int:
    """The number of high bits that name a bucket, for a text of so many bytes."""
    return min(MOST_BUCKETS.bit_length() - 1, max(0, (size // of).bit_length()))


def buckets_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def short_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after those of the bucket; they keep the order inside a bucket."""
    return (keys >> np.uint64(32 - bits)).astype(np.uint32)


def edges_of(keys: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Buckets that sorted keys fall into, and where each begins, with the end."""
    which, starts = np.unique(buckets_of(keys, bits), return_index=True)
    return which.tolist(), [*starts.tolist(), len(keys)]


class Filter:
    """Slabs of the filter, one after another: words of 64 bits; an insertion sets PROBES bits of one word."""

    def __init__(self, slabs: list[bytes | None]):
        blobs = [s or b"" for s in slabs]
        sizes = np.array([len(s) // 8 for s in blobs], dtype=np.uint64)
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.words = np.frombuffer(b"".join(blobs), dtype=np.uint64)

    def levels(self, buckets: np.ndarray, short: np.ndarray) -> np.ndarray:
        """The level of each key of a bucket's slab."""
        out = np.zeros(len(short), dtype=np.uint8)
        alive = np.arange(len(short))
        sizes, first = self.sizes[buckets], self.first[buckets]
        if (self.sizes == 0).any():
            alive = np.flatnonzero(sizes > 0)
            sizes, first = sizes[alive], first[alive]
        base = mix(short[alive].astype(np.uint64))
        level = 0
        while len(alive) and level < len(MEANING) - 1:
            level += 1
            at, mask = placed(base, level, sizes)
            hit = np.flatnonzero(self.words[first + at] & mask == mask)
            alive, base, sizes, first = alive[hit], base[hit], sizes[hit], first[hit]
            out[alive] = level
        return out


def placed(base: np.ndarray, level: int, sizes) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bits of an insertion at a level."""
    x = base + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)) * sizes >> np.uint64(32), MASKS[(x & np.uint64(len(MASKS) - 1)).astype(np.int64)]


def slab(short: np.ndarray, levels: np.ndarray) -> bytes | None:
    """The filter of a bucket's keys; None without any."""
    weight = int(levels.sum(dtype=np.int64))
    if not weight:
        return None
    words = np.zeros(-(-weight * BITS_PER_LEVEL // 64), dtype=np.uint64)
    base = mix(short.astype(np.uint64))
    for level in range(1, int(levels.max()) + 1):
        keep = levels >= level
        base, levels = base[keep], levels[keep]
        at, mask = placed(base, level, np.uint64(len(words)))
        np.bitwise_or.at(words, at.astype(np.int64), mask)
    return words.tobytes()


def context_of(ids: np.ndarray, lengths: np.ndarray, start) -> np.ndarray:
    """What stands before each token; `start` before the first of each document."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    ends = np.cumsum(lengths)
    before[(ends - lengths)[lengths > 0]] = start
    return before


COUNTED = "bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"


def count_batches(bits: int):
    """Per flush and bucket one row: words (64 bits) and pairs (32 bits) with their counts."""

    def packed(tokens: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        found: dict[int, list] = {}
        for place, held in ((0, tokens), (2, pairs)):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            which, edges = edges_of(keys, bits)
            keys, counts = short_of(keys, bits) if place else keys, counts.astype("<u4")
            for b, x, y in zip(which, edges, edges[1:]):
                found.setdefault(b, [None] * 4)[place : place + 2] = keys[x:y].tobytes(), counts[x:y].tobytes()
        return pa.record_batch([pa.array(found, pa.int32()), *[binary(list(c)) for c in zip(*found.values())]], names=[x.split()[0] for x in COUNTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs, size = [], [], 0
        for batch in batches:
            for _, texts in chunks(batch.column("text").to_pylist()):
                ids, lengths = with_ends(*word_hashes(texts), END)
                tokens.append(ids)
                pairs.append(pair_keys(context_of(ids, lengths, START), ids))
                size += len(ids)
                if size > FLUSHED_TOKENS:
                    yield packed(tokens, pairs)
                    size = 0
        if size:
            yield packed(tokens, pairs)

    return run


#: words and word_counts: all of the bucket; top: its most frequent words; pairs, levels: its most frequent pairs.
MERGED = "bucket int, distinct long, total long, words binary, word_counts binary, top_levels array<int>, slab binary, pairs binary, levels binary, pair_levels array<int>"


def histogram(levels: np.ndarray) -> list[int]:
    return np.bincount(levels, minlength=len(MEANING)).tolist()


def merge_bucket(bits: int, head_levels: int):
    """The bucket's exact word counts, its slab, and what of it may belong to the head: pairs whose levels add up to a
    little more than the bucket's share of the head."""
    most = 5 * head_levels // (4 << bits) + 1024

    def added(keys: list, counts: list, kind: str) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.frombuffer(b"".join(x or b"" for x in held), dtype=t) for held, t in ((keys, kind), (counts, "<u4")))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[starts], np.add.reduceat(counts.astype(np.int64), starts) if len(keys) else np.zeros(0, dtype=np.int64)

    def run(table: pa.Table) -> pa.Table:
        held = {c: table.column(c).to_pylist() for c in table.column_names if c != "bucket"}
        words, many = added(held["words"], held["word_counts"], "<u8")
        pairs, often = added(held["pairs"], held["pair_counts"], "<u4")
        levels = levels_of(often)
        order = np.argsort(-levels.astype(np.int16), kind="stable")
        order = np.sort(order[: int(np.searchsorted(np.cumsum(levels[order], dtype=np.int64), most))])
        one = {
            "bucket": table.column("bucket")[0].as_py(), "distinct": len(words), "total": int(many.sum()), "words": words.tobytes(), "word_counts": many.astype("<i8").tobytes(), "top_levels": histogram(levels_of(many)),
            "slab": slab(pairs, levels), "pairs": pairs[order].tobytes(), "levels": levels[order].tobytes(), "pair_levels": histogram(levels[order]),
        }
        return pa.Table.from_pylist([one], schema=pa.schema([
            ("bucket", pa.int32()), ("distinct", pa.int64()), ("total", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("top_levels", pa.list_(pa.int32())),
            ("slab", pa.binary()), ("pairs", pa.binary()), ("levels", pa.binary()), ("pair_levels", pa.list_(pa.int32())),
        ]))

    return run


def least_level(merged: DataFrame, column: str, most: int, weigh) -> int:
    """The least level from which all n-grams together weigh at most `most`; at most one number a level is collected."""
    spread = merged.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    held, least = 0, len(MEANING)
    for r in sorted((r for r in spread if r["pos"]), key=lambda r: -r["pos"]):
        held += r["n"] * weigh(r["pos"])
        if held > most:
            break
        least = r["pos"]
    return least


def head_of(merged: DataFrame, pair_level: int, word_level: int) -> pa.Table:
    """The head's slabs (at most HEAD_BYTES and a word each) and the most frequent words (at most TOP_TOKENS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slabs, words, counts = [], [], []
            for r in batch.to_pylist():
                pairs, levels = np.frombuffer(r["pairs"], "<u4"), np.frombuffer(r["levels"], np.uint8)
                slabs.append(slab(pairs[levels >= pair_level], levels[levels >= pair_level]))
                many = np.frombuffer(r["word_counts"], "<i8")
                keep = levels_of(many) >= word_level
                words.append(np.frombuffer(r["words"], "<u8")[keep].tobytes())
                counts.append(many[keep].tobytes())
            yield pa.record_batch([batch.column("bucket"), binary(slabs), binary(words), binary(counts)], names=["bucket", "slab", "words", "counts"])

    return merged.select("bucket", "pairs", "levels", "words", "word_counts").mapInArrow(run, "bucket int, slab binary, words binary, counts binary").toArrow()


class Weights:
    """Sums of log10 probabilities for every class of context counts and every weight."""

    def __init__(self, size: float):
        self.size = size

    def sums(self, cw, cv, c2, doc, docs):
        """Per document: tokens without a known context have the plain estimate; the others by class and weight."""
        n_lambda, n_class = len(LAMBDAS), len(CONTEXT_EDGES)
        p1 = (cw + 1.0) / self.size
        log1 = np.log(p1)
        usable = cv > 0
        plain = np.bincount(doc[~usable], weights=log1[~usable], minlength=docs)
        kind = np.clip(np.searchsorted(CONTEXT_EDGES, cv, side="right") - 1, 0, n_class - 1)
        cell = doc * n_class + kind
        hit = usable & (c2 > 0)
        miss = usable & ~hit
        lows = np.bincount(cell[miss], weights=log1[miss], minlength=docs * n_class)
        many = np.bincount(cell[miss], minlength=docs * n_class)
        cell, q = cell[hit], p1[hit]
        ml = np.minimum(c2[hit], cv[hit]) / cv[hit]
        out = np.empty((docs * n_class, n_lambda))
        for i, x in enumerate(LAMBDAS):
            out[:, i] = lows + many * np.log1p(-x) + np.bincount(cell, weights=np.log((1 - x) * q + x * ml), minlength=docs * n_class)
        return plain / np.log(10.0), out.reshape(docs, n_class * n_lambda) / np.log(10.0)

    def both(self, levels, doc, docs, own):
        """Sums per document, and over all training documents with their own occurrence left out of each count."""
        counts = [MEANING[x] for x in levels]
        plain, parts = self.sums(*counts, doc, docs)
        left_out = self.sums(*(np.maximum(x[own] - 1, 0) for x in counts), np.zeros(int(own.sum()), dtype=np.int64), 1)[1][0]
        return plain, parts, left_out


ASKED = "bucket int, chunk long, words binary, pairs binary, body binary"


def body_of(columns: dict) -> bytes:
    """One row of lists as compressed bytes."""
    batch = pa.record_batch([pa.array([v], pa.list_(t)) for v, t in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def ask_batches(shared, bits: int, size: float, starts: int):
    """Per chunk of texts: a row for each bucket that it asks, and a row of what is known and what is open."""
    start_level = int(levels_of(np.array([starts]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_keys, top_counts, slabs = shared.value
        head, weights = Filter(slabs), Weights(size)
        for batch in batches:
            for first, texts in chunks(batch.column("text").to_pylist(), SCORED_CHARS):
                docs = len(texts)
                ids, lengths = map(np.concatenate, zip(*(with_ends(*word_hashes(some), END) for _, some in chunks(texts, HASHED_CHARS))))
                uniq, at = np.unique(ids, return_inverse=True)
                where = np.searchsorted(top_keys, uniq)
                where[where == len(top_keys)] = 0
                known = top_keys[where] == uniq if len(top_keys) else np.zeros(len(uniq), dtype=bool)
                counts = np.where(known, top_counts[where], 0) if len(top_keys) else np.zeros(len(uniq), dtype=np.int64)
                word_level = np.where(known, levels_of(counts), OPEN).astype(np.uint8)
                before = context_of(at, lengths, len(uniq))
                keys, back = np.unique(pair_keys(np.append(uniq, START)[before], ids), return_inverse=True)
                level = np.stack([word_level[at], np.append(word_level, start_level).astype(np.uint8)[before], head.levels(buckets_of(keys, bits), short_of(keys, bits))[back]])
                undone = (level[0] == OPEN) | (level[1] == OPEN) | (level[2] == 0)
                doc, done = np.repeat(np.arange(docs), lengths), ~undone
                train = ~np.array(batch.column("held_out").slice(first, docs).to_pylist(), dtype=bool)
                plain, parts, left_out = weights.both(level[:, done], doc[done], docs, train[doc[done]])
                in_top = known[at]
                base = np.bincount(doc, weights=np.where(known, np.log10((counts + 1) / size), 0.0)[at], minlength=docs)
                # what is asked: the pairs of open tokens, in page order within a bucket, and distinct words that are not
                # frequent; what precedes an open token and is not frequent is the last open token itself
                asked = keys[back[undone]]
                place = buckets_of(asked, bits)
                word_place = np.cumsum(~known) - 1
                chunk = batch.column("row")[first].as_py()
                yield from ask(chunk, uniq[~known], asked[np.argsort(place, kind="stable")])
                body = {
                    "row": (batch.column("row").slice(first, docs).to_pylist(), pa.int64()), "doc_id": (batch.column("doc_id").slice(first, docs).to_pylist(), pa.int64()), "train": (train, pa.bool_()), "lengths": (lengths, pa.int64()),
                    "n_top": (np.bincount(doc[in_top], minlength=docs), pa.int64()), "base": (base, pa.float64()), "plain": (plain, pa.float64()), "parts": (parts.ravel(), pa.float64()), "left_out": (left_out, pa.float64()),
                    "open": (np.bincount(doc[undone], minlength=docs), pa.int64()), "place": (place.astype(np.uint8 if bits <= 8 else np.uint32), pa.uint8() if bits <= 8 else pa.uint32()), "w_level": (level[0][undone], pa.uint8()), "v_level": (level[1][undone], pa.uint8()),
                    "w": (word_place[at[level[0] == OPEN]].astype(np.uint32), pa.uint32()),
                }
                yield pa.record_batch([pa.array([buckets_of(mix(np.array([chunk], dtype=np.uint64)), bits)[0]], pa.int32()), pa.array([chunk], pa.int64()), binary([None]), binary([None]), binary([body_of(body)])], names=["bucket", "chunk", "words", "pairs", "body"])

    def ask(chunk: int, words: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for place, held in enumerate((words, keys)):
            which, edges = edges_of(held, bits)
            held = short_of(held, bits) if place else held
            for b, x, y in zip(which, edges, edges[1:]):
                found.setdefault(b, [None, None])[place] = held[x:y].tobytes()
        if found:
            yield pa.record_batch([pa.array(found, pa.int32()), pa.array([chunk] * len(found), pa.int64()), *[binary(list(c)) for c in zip(*found.values())], binary([None] * len(found))], names=["bucket", "chunk", "words", "pairs", "body"])

    return run


ANSWERED = "chunk long, bucket int, counts binary, levels binary, body binary"


def answer(asked: pa.Table, merged: pa.Table) -> pa.Table:
    """What a bucket answers to every chunk: counts of its words, levels of its pairs, in the order asked."""
    own = merged.to_pylist()
    words, many = (np.frombuffer(own[0][c] if own else b"", dtype=t) for c, t in (("words", "<u8"), ("word_counts", "<i8")))
    held = Filter([own[0]["slab"] if own else None])
    counts, levels = [], []
    for w, p in zip(asked.column("words").to_pylist(), asked.column("pairs").to_pylist()):
        w, p = np.frombuffer(w or b"", "<u8"), np.frombuffer(p or b"", "<u4")
        at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
        counts.append((np.where(words[at] == w, many[at], 0) if len(words) else np.zeros(len(w))).astype("<i8").tobytes())
        levels.append(held.levels(np.zeros(len(p), dtype=np.int64), p).tobytes())
    return pa.table([asked.column("chunk"), asked.column("bucket"), binary(counts), binary(levels), asked.column("body")], names=["chunk", "bucket", "counts", "levels", "body"])


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, plain double, parts array<double>, left_out array<double>"


def score_chunk(size: float):
    """All answers to a chunk and its own row -> a row per document."""
    weights = Weights(size)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["body"] is not None, r["bucket"]))
        counts = np.frombuffer(b"".join(r["counts"] for r in rows[:-1]), "<i8")
        levels = np.frombuffer(b"".join(r["levels"] for r in rows[:-1]), np.uint8)
        own = next(iter(pa.ipc.open_stream(rows[-1]["body"])))
        x = {c: own.column(c).values for c in own.schema.names}
        get = lambda c: x[c].to_numpy(zero_copy_only=False)
        docs = len(x["row"])
        doc = np.repeat(np.arange(docs), get("open"))
        word_levels = levels_of(counts)
        level = np.stack([get("w_level"), get("v_level"), np.zeros(len(doc), dtype=np.uint8)])
        level[2][np.argsort(get("place"), kind="stable")] = levels
        rare = level[0] == OPEN
        w = get("w")
        level[0][rare] = word_levels[w]
        after_rare = np.flatnonzero(level[1] == OPEN)
        level[1][after_rare] = level[0][after_rare - 1]
        train = get("train").astype(bool)
        plain, parts, left_out = weights.both(level, doc, docs, train[doc])
        n_known = get("n_top") + np.bincount(doc[rare][counts[w] > 0], minlength=docs)
        base = get("base") + np.bincount(doc[rare], weights=np.log10((counts[w] + 1) / size), minlength=docs)
        parts = parts + get("parts").reshape(docs, -1)
        offsets = pa.array(np.arange(docs + 1, dtype=np.int32) * np.int32(parts.shape[1]))
        left = pa.array([(left_out + get("left_out")).tolist()] + [None] * (docs - 1), pa.list_(pa.float64()))
        return pa.table([x["row"], x["doc_id"], pa.array(~train), x["lengths"], pa.array(n_known), pa.array(base), pa.array(plain + get("plain")), pa.ListArray.from_arrays(offsets, pa.array(parts.ravel())), left], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def language_model_scores(docs: DataFrame, held_out, bucket_bytes: int = BUCKET_BYTES, head_bytes: int = HEAD_BYTES, top_tokens: int = TOP_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    held_out: a boolean column of docs; such rows are scored but not learnt from.  A null text is empty and has one
    token, the end.  Null doc_ids and repeated rows are kept; an empty table gives an empty result; with no training
    row every token has the probability 1/(0+0+1).  Columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    train = rows.where("not held_out").select("text")
    text_bytes, starts = train.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    bits = bucket_bits(text_bytes or 0, bucket_bytes)
    head_levels = head_bytes * 8 // BITS_PER_LEVEL
    merged = stage(train.mapInArrow(count_batches(bits), COUNTED).groupBy("bucket").applyInArrow(merge_bucket(bits, head_levels), MERGED), "lm-buckets")
    distinct, total = (x or 0 for x in merged.agg(F.sum("distinct"), F.sum("total")).first())
    size = float(total + distinct + 1)
    head = head_of(merged, least_level(merged, "pair_levels", head_levels, lambda level: level), least_level(merged, "top_levels", top_tokens, lambda level: 1))
    top_keys, top_counts = (np.frombuffer(b"".join(head.column(c).to_pylist()), t) for c, t in (("words", "<u8"), ("counts", "<i8")))
    order = np.argsort(top_keys)
    slabs: list[bytes | None] = [None] * (1 << bits)
    for b, blob in zip(head.column("bucket").to_pylist(), head.column("slab").to_pylist()):
        slabs[b] = blob
    shared = spark.sparkContext.broadcast((top_keys[order], top_counts[order], slabs))
    asked = rows.mapInArrow(ask_batches(shared, bits, size, starts), ASKED)
    answered = asked.groupBy("bucket").cogroup(merged.select("bucket", "words", "word_counts", "slab").groupBy("bucket")).applyInArrow(answer, ANSWERED)
    scored = stage(answered.groupBy("chunk").applyInArrow(score_chunk(size), SCORED), "lm-scored")
    shared.unpersist()

    n, k = len(LAMBDAS), len(CONTEXT_EDGES)
    likely = scored.where("left_out is not null").agg(*[F.sum(F.col("left_out")[i]).alias(f"x{i}") for i in range(n * k)]).first()
    best = [max(range(n), key=lambda j: likely[c * n + j] or 0.0) for c in range(k)]
    score = F.col("plain")
    for c in range(k):
        score = score + F.col("parts")[c * n + best[c]]
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", score.alias("score"))
