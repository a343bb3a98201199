"""Near-duplicate detection with SetSketch registers.

A document's set of word shingles is summed up in m registers, truncated minima on an exponential scale: the register
value is floor(1 - log_b x) for the least of the exponentially distributed points that the elements send there.
Sketches merge by maximum, and equal registers are likely for similar sets.  Bands of registers propose candidates,
a joint likelihood over all registers and both set sizes drops hopeless ones, and the full sets decide.

Documents with equal sets form one class.  Within a band's bucket each class is compared with a pivot, the member that
shares most buckets with others, so a group of copies around one original costs a row per copy.  The members that share
a pivot are its family; those that are not in the pivot's component are compared with all of the family that are in
another one.  Families are cut into blocks of a bounded size, every pair of blocks is a cell of its own, and a cell
counts intersections of full sets by matrix products and returns a spanning forest of its links, never its pairs.  So
no pair of a bucket is left open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, binary, chunks, stage, text_or_empty, with_marks
from .components import connected_components
from .tokenhash import mix, word_hashes

#: Sketch: registers, base b, scale a and bands.  A band takes as many registers as leave a pair at the threshold a
#: probability below MOST_MISSED to share none of as many independent bands.  The bands take their registers from the
#: same 128, so the probability is higher: 3e-6 at 0.85 and 5e-7 at 0.8, by simulation.
REGISTERS, BANDS, BASE, SCALE, MOST_MISSED = 128, 48, 1.02, 16.0, 1e-7
#: Members of a block of a family, and shingles that they have on average together (8 bytes each).
BLOCK, BLOCK_SHINGLES = 1024, 2 << 20
#: A candidate is dropped if its best similarity over the threshold is this much less likely than its best of all.
LOG_MARGIN = 14.0


def shingle_hashes(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's word shingles, in order; texts shorter than a shingle have one."""
    ids, counts = word_hashes(texts)
    n = max(0, len(ids) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            whole = np.array([n], dtype=np.uint64)
            for k in range(n):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + ids[at + k : at + k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketch(items: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of a set of hashes, as unsigned 16-bit integers.

    Every item sends ascending exponential points to registers in a random order of its own; an item is done once its
    next point lies beyond the largest minimum so far, so large sets cost about one point an item.
    """
    m = registers
    least = np.full(m, np.inf)
    todo, t = items, np.zeros(len(items))
    free = None
    for step in range(m):
        if not len(todo):
            break
        draw = mix(todo + np.uint64((2 * step + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
        t = t - np.log(unit(draw)) / (m - step)
        pick = mix(draw ^ np.uint64(0xA0761D6478BD642F))
        if step == 0:
            target = (pick % np.uint64(m)).astype(np.int64)
        else:
            if free is None:  # only items that go on need an order of registers of their own
                free = np.tile(np.arange(m, dtype=np.int16), (len(todo), 1))
                rows = np.arange(len(todo))
                free[rows, last] = m - 1
            j = (pick % np.uint64(m - step)).astype(np.int64)
            rows = np.arange(len(todo))
            target = free[rows, j].astype(np.int64)
            free[rows, j] = free[rows, m - step - 1]
        np.minimum.at(least, target, t)
        worst = least.max()
        on = t < worst
        todo, t, last = todo[on], t[on], target[on]
        if free is not None:
            free = free[on]
    value = np.floor(1.0 - (np.log(least) - np.log(1.0 / SCALE)) / np.log(BASE)) + 2048
    return np.clip(value, 0, 65535).astype("<u2") if len(items) else np.zeros(m, dtype="<u2")


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def could_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether the similarity may be `least` or more, from the joint likelihood of all registers and the set sizes.

    Registers of two sets with relative sizes u and v compare as a > b with probability p(u - v J), a < b with
    p(v - u J) and are equal otherwise, where p(x) = -log_b(1 - x (b - 1) / b).
    """
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 65)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    one = p(u[:, None] - v[:, None] * grid)
    two = p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    like = up[:, None] * np.log(one + tiny) + down[:, None] * np.log(two + tiny) + same[:, None] * np.log(np.maximum(1 - one - two, tiny))
    fits = grid >= least - 0.02
    best = like.max(axis=1)
    reach = np.where(fits, like, -np.inf).max(axis=1)
    return (top >= least - 1e-9) & (reach >= best - LOG_MARGIN)


SKETCHED = "doc_id long, k1 long, k2 long, n_shingles long, fp binary, sketch binary, bands array<long>"


def rows_a_band(least: float) -> int:
    fit = [r for r in range(1, 33) if (1 - least**r) ** BANDS <= MOST_MISSED]
    return max(fit, default=1)


def band_registers(rows: int) -> np.ndarray:
    """Which registers each band takes: every permutation of all registers gives as many bands as it can."""
    rng = np.random.default_rng(2021)
    a_turn = REGISTERS // rows
    turns = [rng.permutation(REGISTERS)[: a_turn * rows].reshape(a_turn, rows) for _ in range(-(-BANDS // a_turn))]
    return np.concatenate(turns)[:BANDS]


def sketch_documents(docs: DataFrame, width: int, least: float) -> DataFrame:
    """Narrow rows: keys of the text, size and fingerprint of the shingle set, sketch and band hashes."""
    taken = band_registers(rows_a_band(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        for batch in batches:
            for first, texts in chunks(batch.column("text").to_pylist()):
                sets = shingle_hashes(texts, width)
                sketches = [sketch(s) for s in sets]
                bands = np.array(sketches).astype(np.uint64)[:, taken]
                h = np.broadcast_to(salt, (len(sets), BANDS)).copy()
                for k in range(taken.shape[1]):
                    h = mix(h ^ (bands[:, :, k] + np.uint64(k << 32)))
                h = h.view(np.int64).tolist()
                n = len(texts)
                yield pa.record_batch([
                    *[batch.column(c).slice(first, n) for c in ("doc_id", "k1", "k2")], pa.array([len(s) for s in sets], pa.int64()), binary([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]),
                    binary([s.tobytes() if len(x) else None for s, x in zip(sketches, sets)]), pa.array([b if len(x) else None for b, x in zip(h, sets)], pa.list_(pa.int64())),
                ], names=["doc_id", "k1", "k2", "n_shingles", "fp", "sketch", "bands"])

    arrow_limits(docs.sparkSession)
    return keyed(docs).mapInArrow(run, SKETCHED)


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def pivot_pairs(members: DataFrame) -> DataFrame:
    """members(band, fp) of buckets of two or more -> (band, fp, pivot); the pivot shares most places in buckets."""
    sizes = members.groupBy("band").agg(F.count("*").alias("n"))
    popular = members.join(sizes, "band").groupBy("fp").agg(F.sum("n").alias("n"))
    pivots = members.join(popular, "fp").groupBy("band").agg(F.max(F.struct("n", "fp"))["fp"].alias("pivot"))
    return members.join(pivots, "band").select("band", "fp", "pivot")


def likely(pairs: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of fingerprints that the joint likelihood leaves open, with the text keys of both classes."""
    least = numerator / denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            ok = could_reach(a, b, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float), least)
            yield batch.filter(pa.array(ok)).select(["a", "b", "ka", "kb"])

    one = classes.select(F.col("fp").alias("a"), F.col("k").alias("ka"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("fp").alias("b"), F.col("k").alias("kb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * denominator >= F.greatest("na", "nb") * numerator)
    return near.mapInArrow(run, "a binary, b binary, ka struct<k1:long,k2:long>, kb struct<k1:long,k2:long>")


def sets_of(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """k1, k2, items: the full shingle sets of the texts that keys(k1, k2, distinct) name; only those are shuffled."""
    keys = stage(keys, "dup-keys")
    texts = with_marks(keyed(docs), keys, "k1").where("marked").select("k1", "k2", "text")
    # an inner join: Spark would move a semi join before the filter
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(keys, ["k1", "k2"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in chunks(batch.column("text").to_pylist()):
                packed = [s.tobytes() for s in shingle_hashes(some, width)]
                yield pa.record_batch([batch.column("k1").slice(first, len(some)), batch.column("k2").slice(first, len(some)), binary(packed)], names=["k1", "k2", "items"])

    return stage(texts.mapInArrow(sets, "k1 long, k2 long, items binary"), "dup-sets")


def verified(docs: DataFrame, pairs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) whose full sets reach the threshold."""
    held = sets_of(docs, pairs.select(F.explode(F.array("ka", "kb")).alias("k")).select("k.k1", "k.k2").distinct(), width)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(denominator * both >= numerator * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    side = lambda k, x: held.select(F.struct("k1", "k2").alias(k), F.col("items").alias(x))
    return pairs.join(side("ka", "xa"), "ka").join(side("kb", "xb"), "kb").select("a", "b", "xa", "xb").mapInArrow(check, "a binary, b binary")


def cell_links(sets: list[np.ndarray], roots: list, is_open: np.ndarray, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a cell between members of different components, at least one of them open."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[at]
    keep = shared[at]
    row, column = row[keep], column[keep]
    rows = np.flatnonzero(is_open)
    both = np.zeros((len(rows), n), dtype=np.float32)
    for low in range(0, int(shared.sum()), 4096):
        some = (column >= low) & (column < low + 4096)
        width = min(4096, int(shared.sum()) - low)
        dense = np.zeros((n, width), dtype=np.float32)
        dense[row[some], column[some] - low] = 1
        both += dense[rows] @ dense.T
    both = np.rint(both).astype(np.int64)
    linked = denominator * both >= numerator * (sizes[rows][:, None] + sizes[None, :] - both)
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    root = np.array([names[r] for r in roots])
    linked &= root[rows][:, None] != root[None, :]
    near = np.zeros((n, n), dtype=bool)
    near[rows] = linked
    near |= near.T
    seen, out = np.zeros(n, dtype=bool), []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & ~seen).tolist()
            seen[new] = True
            out += [(x, y) for y in new]
            todo += new
    return out


def family_links(docs: DataFrame, named: DataFrame, classes: DataFrame, width: int, numerator: int, denominator: int, block: int, block_shingles: int) -> DataFrame:
    """named(pivot, fp, root, main), distinct -> links (a, b) that the pivots left open.

    A family has as many blocks as keep both its members and their shingles within the bounds of a block.
    """
    named = named.join(classes.select("fp", F.col("k").alias("key"), "n"), "fp")
    size = named.groupBy("pivot").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.count(F.when(F.col("root") != F.col("main"), 1)).alias("open"))
    blocks = size.where("open > 0 and k > 2").select("pivot", F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("n") / block_shingles)).cast("int").alias("blocks"))
    members = named.join(blocks, "pivot").withColumnRenamed("key", "k")
    members = stage(members.select("pivot", "fp", "root", "k.k1", "k.k2", "blocks", (F.col("root") != F.col("main")).alias("open"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")), "dup-families")
    held = sets_of(docs, members.select("k1", "k2").distinct(), width)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = members.select("*", other).select("fp", "root", "open", "k1", "k2", F.xxhash64("pivot", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))
    cells = cells.join(held, ["k1", "k2"]).select("cell", "fp", "root", "open", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, found = None, [], []

        def close():
            if len(rows) > 2:
                for a, b in cell_links([np.frombuffer(r["items"], dtype=np.uint64) for r in rows], [r["root"] for r in rows], np.array([r["open"] for r in rows]), numerator, denominator):
                    found.append((rows[a]["fp"], rows[b]["fp"]))
            rows.clear()

        def flush():
            out = pa.record_batch([binary([a for a, _ in found]), binary([b for _, b in found])], names=["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    close()
                    cell = r["cell"]
                rows.append(r)
            if found:
                yield flush()
        close()
        if found:
            yield flush()

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a binary, b binary")


def labelled(docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """doc_id, k1, k2, n_shingles, fp and root for every row of docs; root, a fingerprint, names the component and is
    null for rows without shingles."""
    sketched = stage(sketch_documents(docs, width, numerator / denominator), "dup-sketches")
    full = sketched.where("fp is not null")
    classes = stage(full.groupBy("fp").agg(F.min(F.struct("k1", "k2")).alias("k"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.max("bands").alias("bands")), "dup-classes")
    spread = classes.select("fp", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    shared = stage(shared, "dup-bands")
    members = stage(with_marks(spread, shared, "band").where("marked").select("fp", "band").join(shared, "band"), "dup-members")
    pivoted = stage(pivot_pairs(members), "dup-pivots")
    first_pairs = pivoted.where("fp <> pivot").select(F.least("fp", "pivot").alias("a"), F.greatest("fp", "pivot").alias("b")).distinct()
    links = stage(verified(docs, stage(likely(first_pairs, classes, numerator, denominator), "dup-pairs"), width, numerator, denominator), "dup-links")
    roots = connected_components(links)

    named = pivoted.select("pivot", "fp").distinct().join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("main")), "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))
    more = stage(family_links(docs, stage(named, "dup-named"), classes, width, numerator, denominator, BLOCK, BLOCK_SHINGLES), "dup-links")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    out = sketched.select("doc_id", "k1", "k2", "n_shingles", "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return out.withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Two rows are linked if their shingle sets are equal and not empty or denominator * |intersection| >= numerator *
    |union|.  component_id is the least doc_id of the component.  A null or blank text has no shingles and is its own
    component.  A null doc_id takes part in its component and is kept only if no row of it has a doc_id.  Of repeated
    rows all that have the least doc_id are marked kept.  An empty table gives an empty result; other columns are
    ignored.
    """
    rows = labelled(docs, width, numerator, denominator)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    out = rows.join(least, "root", "left")
    component_id = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """docs with one row of each component, the one with the least (doc_id, text keys); all columns as they came.

    Rows without shingles are no one's duplicates and stay, but of rows repeated with their doc_id and text one stays.
    """
    rows = labelled(docs, width, numerator, denominator).select("root", "k1", F.struct("doc_id", "k1", "k2").alias("key"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("key").alias("key")).select("key")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.first("k1").alias("k1"), F.count_if(F.col("root").isNull()).alias("blank"))
    keys = stage(keys.join(least.withColumn("least", F.lit(True)), "key", "left").select("key", "k1", "n", (F.col("least").isNotNull() | (F.col("blank") > 0)).alias("stays")), "dup-keys")
    # rows that no removed or repeated key can mean are done; only the others' texts are shuffled
    text = text_or_empty()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    whole = with_marks(whole.withColumn("key", F.struct(F.col("__id").alias("doc_id"), "k1", "k2")), keys.where("n > 1 or not stays"), "k1")
    open_ones = whole.where("marked").select("key", "doc").groupBy("key").agg(F.first("doc").alias("doc")).join(keys.where("stays").select("key"), "key")
    return whole.where("not marked").select("doc").unionByName(open_ones.select("doc")).select("doc.*")
