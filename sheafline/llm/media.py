"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG image, 576 samples a row, in a tar shard under the name of its digest.
Rows carry digest, shard, offset and length.  A task stores each digest once; the catalogue names one place for each
digest of the corpus.  Columns such as width and height come from range reads of the image header; features come from
reading the whole stored image back, once for each digest.

Shards are written through pyarrow's file systems, so the shared folder may be a local path, HDFS or an object store.
Their names are new for every task attempt: what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, chunks, new_path, stage, text_or_empty

UNIT, FILLER = 576, b"\xff"
SHARD_BYTES = 32 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw + FILLER * (size - len(raw))


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows of UNIT samples of 8 bits, each after the filter byte 0."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    plain = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    plain[:, 1:] = rows
    header = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + png_chunk(b"IHDR", header) + png_chunk(b"IDAT", zlib.compress(plain.tobytes(), 2)) + png_chunk(b"IEND", b"")


def header_of(start: bytes) -> tuple[int, int]:
    """Width and height from the first 33 bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">II", start[16:24])


def from_png(data: bytes) -> bytes:
    width, height = header_of(data)
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    plain = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    if plain[:, 0].any():
        raise ValueError("unexpected row filter")
    return plain[:, 1:].tobytes()


def feature_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean, deviation, entropy and the share of each sixteenth of the sample range."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = counts / counts.sum()
    levels = np.arange(256)
    mean = float((p * levels).sum())
    deviation = float(np.sqrt((p * (levels - mean) ** 2).sum()))
    some = p[p > 0]
    shares = ",".join(f"{x:.4f}" for x in p.reshape(16, 16).sum(axis=1))
    return f"{width}x{height};mean={mean:.4f};dev={deviation:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};hist={shares}"


class Shard:
    """One tar file being written."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        fs, path = pa.fs.FileSystem.from_uri(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.size = fs.open_output_stream(path), 0

    def add(self, name: str, data: bytes) -> int:
        """Where the data starts."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        at = self.size + len(head)
        self.size = at + len(data) + -len(data) % 512
        return at

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Payloads of all rows into tar shards; each row with digest and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, places = None, {}
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in chunks(batch.column("text").to_pylist()):
                out: list[list] = [[], [], [], [], []]
                for text in texts:
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    place = places.get(digest)
                    if place is None:
                        if shard is None or shard.size > SHARD_BYTES:
                            if shard is not None:
                                shard.close()
                            shard = Shard(folder)
                        data = to_png(payload)
                        place = places[digest] = (shard.uri, shard.add(digest + ".png", data), len(data))
                        if len(places) > 200_000:
                            places.clear()
                    for column, value in zip(out, (len(text.encode("utf-8", "replace")), digest, *place)):
                        column.append(value)
                yield pa.record_batch([pa.array(doc_ids[first : first + len(texts)], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2]), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, STORED)


READ = "digest string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def ranges(places: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[str, int, int, bytes]]:
    """Digest, width, height and (if whole) the stored bytes of each place; one open file at a time."""
    held, source = "", None
    for batch in places:
        for p in batch.to_pylist():
            if p["shard"] != held:
                if source is not None:
                    source.close()
                fs, path = pa.fs.FileSystem.from_uri(p["shard"])
                held, source = p["shard"], fs.open_input_file(path)
            source.seek(p["offset"])
            start = source.read(33)
            width, height = header_of(start)
            yield p["digest"], width, height, start + source.read(p["length"] - 33) if whole else b""
    if source is not None:
        source.close()


def catalogue(stored: DataFrame) -> DataFrame:
    """One place for each digest, in the order of shards and offsets."""
    one = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return one.repartition("shard").sortWithinPartitions("shard", "offset")


def header_columns(stored: DataFrame) -> DataFrame:
    """digest, width, height by range reads of the first 33 bytes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x[:3] for x in ranges(batches, False)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2)]], names=["digest", "width", "height"])

    return catalogue(stored).mapInArrow(run, "digest string, width int, height int")


def read_back(stored: DataFrame) -> DataFrame:
    """Header columns and what the whole stored image gives, for each digest."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, width, height, data in ranges(iter([batch]), True):
                payload = from_png(data)
                rows.append((digest, width, height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload, width, height)))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return catalogue(stored).mapInArrow(run, READ)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """A row per row of docs: its digest and place, header columns and features read back from the shard.

    A null text is empty; its payload is one unit of filler.  Null doc_ids and repeated rows are kept and share the
    payload of equal texts; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    stored = stage(store(docs, folder or new_path(spark, "media")), "media-rows")
    return stored.select("doc_id", "n_bytes", "digest").join(read_back(stored), "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "width", "height")
