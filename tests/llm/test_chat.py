import hashlib
from collections import defaultdict

from compare import duck, rows_of
from sheafline.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: t[:2])
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        learnt = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def check(frame, rows):
    want = brute(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}
    assert got == want


def test_query_equals_sql(spark, small):
    assert rows_of(queries.op10_chat_formatting(spark, small).toPandas()) == rows_of(duck(queries.OP10_SQL, small))


def test_odd_rows(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a\\<turn>\n</turn>\\l"), (1, 3, "assistant", ""), (2, 0, None, None), (2, None, "sys<t>em\\\n", "é\U0001f600"), (None, 0, "assistant", "x" * 30_000), (3, 0, "user", "same"), (3, 0, "user", "same"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", segment string")
    check(chat.format_conversations(frame), rows)
    assert chat.format_conversations(frame.where("false")).count() == 0


def test_a_conversation_with_a_third_of_all_rows(spark):
    rows = [(0, i, "assistant" if i % 2 else "user", f"turn {i} <") for i in range(3000)] + [(i, 0, "user", "hello") for i in range(1, 6000)]
    check(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)), rows)


def test_assembly_equals_joining():
    roles, texts = ["user", "assistant", "", "user"], [b"a<b\\c", b"", "é<".encode() * 50, b"\\\\<<"]
    segments, starts, lengths = chat.assemble(roles, texts)
    for role, text, segment, start, length in zip(roles, texts, segments.to_pylist(), starts, lengths):
        assert segment == b"<turn " + role.encode() + b">\n" + text.replace(b"\\", b"\\\\").replace(b"<", b"\\l") + chat.TAIL
        assert chat.unescape(segment[start : start + length]) == text
    assert chat.assemble([], [])[0].to_pylist() == []
