"""Chat formatting by columnar byte assembly.

A turn becomes `<turn ROLE>` LF text LF `</turn>` LF, with the text escaped so that no `<` is left in it.  A batch of
turns is assembled at once: lengths of headers, escaped contents and tails give cumulative offsets and scatter indices,
and all bytes are copied into one preallocated Arrow buffer.  Turns are formatted where they lie; only then are they
brought together by conversation, sorted, and read as a stream, so a conversation of any length needs no more memory
than a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

TAIL = b"\n</turn>\n"
#: Fixed values of the escape: what each byte becomes; the backslash itself is one of them.
ESCAPES = {b"\\": b"\\\\", b"<": b"\\l"}
ROLE_ESCAPES = {**ESCAPES, b">": b"\\g", b"\n": b"\\n"}
BACK = {b"\\": b"\\", b"l": b"<", b"g": b">", b"n": b"\n"}
UNESCAPE = re.compile(rb"\\(.)", re.S)


def unescape(data: bytes) -> bytes:
    return UNESCAPE.sub(lambda m: BACK[m[1]], data)


def header_for(role: str) -> bytes:
    raw = role.encode("utf-8", "replace")
    return b"<turn " + re.sub(rb"[\\<>\n]", lambda m: ROLE_ESCAPES[m[0]], raw) + b">\n"


def assemble(roles: list[str], texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted segments of a batch of turns, with the start and the length of each escaped text in its segment."""
    n = len(texts)
    heads: dict[str, int] = {}
    head_of = np.array([heads.setdefault(r, len(heads)) for r in roles], dtype=np.int64)
    head_bytes = [header_for(r) for r in heads]
    head_len = np.array([len(h) for h in head_bytes], dtype=np.int64)[head_of] if n else np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    raw_len = np.array([len(t) for t in texts], dtype=np.int64)
    special = np.isin(raw, np.frombuffer(b"\\<", dtype=np.uint8))
    # escaped length of each text: one byte more for each special byte
    upto = np.concatenate([[0], np.cumsum(special)])
    raw_ends = np.cumsum(raw_len)
    extra = upto[raw_ends] - upto[raw_ends - raw_len]
    text_len = raw_len + extra
    seg_len = head_len + text_len + len(TAIL)
    offsets = np.concatenate([[0], np.cumsum(seg_len)])
    out = np.empty(int(offsets[-1]), dtype=np.uint8)
    start = offsets[:-1]
    # headers and tails
    for k, head in enumerate(head_bytes):
        rows = np.flatnonzero(head_of == k)
        out[(start[rows][:, None] + np.arange(len(head))).ravel()] = np.tile(np.frombuffer(head, np.uint8), len(rows))
    if n:
        out[((start + head_len + text_len)[:, None] + np.arange(len(TAIL))).ravel()] = np.tile(np.frombuffer(TAIL, np.uint8), n)
    # contents: each byte moves by its text's place and by the special bytes up to and including it
    shift = np.repeat(start + head_len - (raw_ends - raw_len) - upto[raw_ends - raw_len], raw_len)
    to = np.arange(len(raw)) + shift + upto[1:]
    out[to] = np.where(raw == ord("<"), ord("l"), raw)
    out[to[special] - 1] = ord("\\")
    if offsets[-1] >= 1 << 31:
        segments = pa.array([out[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.large_binary())
    else:
        segments = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return segments, head_len, text_len


SEGMENTS = "conv_id long, turn long, segment binary, loss_start long, loss_length long"


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: its formatted segment and the part of it that the loss mask covers (none: length -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            segments, head_len, text_len = assemble(roles, [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            mine = np.array([r == "assistant" for r in roles], dtype=bool)
            yield pa.record_batch([batch.column("conv_id"), batch.column("turn"), segments, pa.array(np.where(mine, head_len, 0)), pa.array(np.where(mine, text_len, -1))], names=["conv_id", "turn", "segment", "loss_start", "loss_length"])

    arrow_limits(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return slim.mapInArrow(run, SEGMENTS)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def code_points(data: bytes) -> int:
    """Bytes that don't continue a code point."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def read_conversations(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted segments in order of turn."""
    HEAD = re.compile(rb"<turn ([^<>\n]*)>\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_BACK.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        open_id, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != open_id:
                    if state is not None:
                        done.append((open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    open_id, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = row["segment"]
                head = HEAD.match(data)
                if head is None or not data.endswith(TAIL):
                    raise ValueError("a segment doesn't follow the template")
                state[0] += 1
                state[1].update(unescape(head[1]) + b"\n" + unescape(data[head.end() : -len(TAIL)]) + b"\n")
                state[4] += code_points(data)
                if row["loss_length"] >= 0:
                    learnt = unescape(data[row["loss_start"] : row["loss_start"] + row["loss_length"]])
                    state[2] += code_points(learnt)
                    state[3].update(learnt)
            if done:
                yield pa.record_batch([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
                done.clear()
        if state is not None:
            last = (open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
            yield pa.record_batch([pa.array([v], t) for v, t in zip(last, types)], names=names)

    together = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return together.mapInArrow(run, READ_BACK)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for every conversation.

    Turns go by number; equal numbers by their formatted text; null numbers first.  A null text or role is empty, a
    null conv_id is a conversation like any other, repeated rows are repeated turns, an empty table gives an empty
    result; other columns are ignored.
    """
    return read_conversations(format_turns(conversations))
