"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token ids; only those longer than a sequence are cut, so at most one piece of a document is shorter
than a sequence and has to be packed.  These pieces are dealt by hash into blocks of a bounded number of items.  Each
block is solved by several islands: a population of packings is improved by crossover, which injects whole well-filled
bins of one parent into the other, removes the bins that hold their items a second time and best-fits the displaced
items.  Between epochs every island's elite migrates to the next island of its block.  An island stops when it reaches
the lower bound, the tokens divided by the capacity.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkmemo import ChunkMemo
from .common import arrow_limits, binary, chunks, stage, text_or_empty

CAPACITY, END_ID = 2048, 0
BLOCK_ITEMS, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 8192, 4, 2, 4, 16


class WithAdded:
    """The library takes the strings of added tokens out of a text first, each as one id, and encodes what lies between."""

    def __init__(self, plain: ChunkMemo, added: dict[str, int]):
        self.plain = plain
        self.ids = {token: np.array([i], dtype="<u4").tobytes() for token, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        held = [i for i, t in enumerate(texts) if self.split and self.split.search(t)]
        if not held:
            return self.plain.encode_all(texts)
        parts = {i: self.split.split(texts[i]) for i in held}
        flat = iter(self.plain.encode_all([x for i, t in enumerate(texts) for x in (parts[i][::2] if i in parts else (t,))]))
        return [b"".join(self.ids[x] if k % 2 else next(flat) for k, x in enumerate(parts[i])) if i in parts else next(flat) for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str):
    """Ids as the tokenizers library gives them for json_path; the strings of its added tokens are those tokens.

    The file of ranks is the same vocabulary; its encoder is used for what lies between added tokens because it is
    several times as fast; this asks that added tokens match anywhere and take no white space with them, or else, and
    without that file, the tokenizers library encodes.
    """
    import json

    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if ranks_path and plain:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        return WithAdded(ChunkMemo(lambda text: own.encode_to_numpy(text, disallowed_special=()), lengths), {t["content"]: t["id"] for t in added})
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)

    class Whole:
        def encode_all(self, texts):
            return [np.array(x.ids, dtype="<u4").tobytes() for x in slow.encode_batch_fast(texts, add_special_tokens=False)]

    return Whole()


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, json_path: str, ranks_path: str = "", pattern: str = "", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the ids of every document, which end with the id 0; the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(json_path, ranks_path, pattern)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows, doc_ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for first, texts in chunks(batch.column("text").to_pylist(), 8 << 20):
                out: list[list] = [[], [], [], [], [], []]
                for i, packed in enumerate(memo.encode_all(texts), first):
                    ids = packed + end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                        for column, value in zip(out, (rows[i], doc_ids[i], piece, a, b - a, zlib.crc32(ids[a * 4 : b * 4]))):
                            column.append(value)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), *[pa.array(x, pa.int64()) for x in out[3:]]], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    arrow_limits(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


class Bins:
    """Open bins by the room they have left, under a bitmap: the tightest bin that fits is a find-first-set."""

    def __init__(self, room: np.ndarray, capacity: int):
        self.capacity, self.mask, self.count = capacity, 0, len(room)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b, r in enumerate(room.tolist()):
            self.by_room[r].append(b)
        for r in range(1, capacity + 1):
            if self.by_room[r]:
                self.mask |= 1 << r

    def put(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = self.by_room[room]
            b = held.pop()
            if not held:
                self.mask ^= 1 << room
        else:
            b, room = self.count, self.capacity
            self.count += 1
        left = room - size
        if left:
            self.by_room[left].append(b)
            self.mask |= 1 << left
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: Bins | None = None, bin_of: np.ndarray | None = None) -> np.ndarray:
    bins = bins or Bins(np.zeros(0, dtype=np.int64), capacity)
    bin_of = np.full(len(sizes), -1, dtype=np.int32) if bin_of is None else bin_of
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        bin_of[i] = bins.put(size)
    return bin_of


def fitness(sizes: np.ndarray, bin_of: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the mean of squared fillings, which prefers full bins beside emptier ones."""
    fill = np.bincount(bin_of, weights=sizes)
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with some of b's well-filled bins injected; what they displace is best-fitted, largest first."""
    fill_a, fill_b = np.bincount(a, weights=sizes), np.bincount(b, weights=sizes)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.25))
    injected = rng.choice(good, max(1, len(good) // 6), replace=False)
    is_injected = np.zeros(len(fill_b), dtype=bool)
    is_injected[injected] = True
    inside = is_injected[b]
    gone = np.zeros(len(fill_a), dtype=bool)
    gone[a[inside]] = True
    gone[np.argsort(fill_a, kind="stable")[: 1 + len(fill_a) // 50]] = True  # mutation: the emptiest bins are dissolved
    loose = np.flatnonzero(gone[a] & ~inside)
    name_a = np.cumsum(~gone) - 1
    name_b = np.full(len(fill_b), -1, dtype=np.int64)
    name_b[injected] = np.arange(len(injected)) + int((~gone).sum())
    child = np.where(inside, name_b[b], name_a[a]).astype(np.int32)
    room = (capacity - np.concatenate([fill_a[~gone], fill_b[injected]])).astype(np.int64)
    return best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], capacity, Bins(room, capacity), child)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: list[int], generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first; a new population if none is given."""
    rng = np.random.default_rng(seed)
    if not len(sizes):
        return [np.zeros(0, dtype=np.int32)]
    bound = -int(-int(sizes.sum()) // capacity)
    key = lambda x: fitness(sizes, x, capacity)
    if not population:
        population = [best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)]
        while len(population) < POPULATION and -key(population[0])[0] > bound:
            noisy = sizes * rng.uniform(0.8, 1.25, len(sizes))
            population.append(best_fit(sizes, np.argsort(-noisy, kind="stable"), capacity))
    population = sorted(population, key=key, reverse=True)[:POPULATION]
    for _ in range(generations):
        if -key(population[0])[0] <= bound or len(population) < 2:
            break
        children = []
        for i in range(len(population)):
            j = int(rng.integers(0, len(population) - 1))
            children.append(crossover(sizes, population[i], population[j + (j >= i)], capacity, rng))
        population = sorted(population + children, key=key, reverse=True)[:POPULATION]
    return population


STATE = "block long, island int, migrant boolean, rows binary, sizes binary, population array<binary>"


def epoch_on(epoch: int, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        """One (block, island): its own row and, after the first epoch, its neighbour's elite."""
        rows = table.to_pylist()
        own = next(r for r in rows if not r["migrant"])
        sizes = np.frombuffer(own["sizes"], dtype=np.int32)
        held = [np.frombuffer(p, dtype=np.int32) for r in rows for p in r["population"] or []]
        best = evolve(sizes, held, capacity, [own["block"], own["island"], epoch])
        return pa.Table.from_pylist([own | {"population": [p.tobytes() for p in best]}], schema=table.schema)

    return run


def gather(islands: int):
    schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("migrant", pa.bool_()), ("rows", pa.binary()), ("sizes", pa.binary()), ("population", pa.list_(pa.binary()))])

    def run(table: pa.Table) -> pa.Table:
        rows, sizes = table.column("row").to_numpy(), table.column("length").to_numpy().astype(np.int32)
        order = np.argsort(rows, kind="stable")
        one = {"block": table.column("block")[0].as_py(), "migrant": False, "rows": rows[order].tobytes(), "sizes": sizes[order].tobytes(), "population": []}
        return pa.Table.from_pylist([one | {"island": i} for i in range(islands)], schema=schema)

    return run


def settle(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        """The best packing of a block's islands: bin and offset of every item."""
        best = None
        for r in sorted(table.to_pylist(), key=lambda r: r["island"]):
            sizes = np.frombuffer(r["sizes"], dtype=np.int32)
            bin_of = np.frombuffer(r["population"][0], dtype=np.int32)
            if best is None or fitness(sizes, bin_of, capacity) > fitness(sizes, best[2], capacity):
                best = np.frombuffer(r["rows"], dtype=np.int64), sizes, bin_of, r["block"]
        rows, sizes, bin_of, block = best
        order = np.argsort(bin_of, kind="stable")
        ends = np.cumsum(sizes[order].astype(np.int64))
        starts = ends - sizes[order]
        first = np.concatenate([[True], bin_of[order][1:] != bin_of[order][:-1]])
        offset = starts - np.maximum.accumulate(np.where(first, starts, 0))
        emptiest = bin_of[order] == np.argmin(np.bincount(bin_of, weights=sizes))
        return pa.table([pa.array(rows[order]), pa.array(sizes[order].astype(np.int64)), pa.array((np.int64(block) << 32) + bin_of[order].astype(np.int64)), pa.array(offset), pa.array(emptiest)], names=["row", "length", "sequence_id", "offset", "open"])

    return run


PLACED = "row long, length long, sequence_id long, offset long, open boolean"


def solve(dealt: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """dealt(block, row, length) -> every row's place, and whether it lies in its block's emptiest bin."""
    state = dealt.groupBy("block").applyInArrow(gather(islands), STATE)
    for epoch in range(epochs):
        if epoch:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.lit(True).alias("migrant"), F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("sizes"), F.slice("population", 1, 1).alias("population"))
            state = state.unionByName(elite)
        state = stage(state.groupBy("block", "island").applyInArrow(epoch_on(epoch, capacity), STATE), "pack-epoch")
    return state.groupBy("block").applyInArrow(settle(capacity), PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Pieces (row, piece, length, ...), staged, with sequence_id and offset; at most one piece of a row is short."""
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block_items))
    dealt = short.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "row", "length")
    placed = stage(solve(dealt, capacity, islands, epochs), "pack-placed")
    if blocks > 1:  # the emptiest bin of each block is opened again and packed with those of other blocks
        loose = placed.where("open").select("row", "length")
        again = max(1, -(-loose.count() // block_items))
        dealt = loose.select((F.pmod(F.xxhash64("row"), F.lit(again)) + blocks).alias("block"), "row", "length")
        placed = placed.where("not open").unionByName(solve(dealt, capacity, islands, epochs))
    placed = placed.select("row", "sequence_id", "offset")
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return short.join(placed, "row").unionByName(full)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str = "", pattern: str = "", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of every row of docs.

    A null text is empty: its one piece is the id 0.  Null doc_ids and repeated rows are packed each for itself; an
    empty table gives an empty result; other columns are ignored.
    """
    pieces = stage(cut_documents(docs, json_path, ranks_path, pattern, capacity), "pack-pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
