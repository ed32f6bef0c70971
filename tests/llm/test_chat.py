"""Chat formatting: typed parts, the way back, and conversations that spread over chunks and tasks."""

import hashlib

import duckdb
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from wardline.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows, **options):
    return chat.format_conversations(spark.createDataFrame(rows, SCHEMA), **options).collect()


def texts(rows):
    return [(c, t, r, None if x is None else [part("text", x)]) for c, t, r, x in rows]


def expected(rows):
    """rows (conv_id, turn, role, text) -> what must be read back, by plain loops."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is None, t or 0, r or "", hashlib.sha256(escaped(x or "").encode()).hexdigest(), x or ""))
    found = {}
    for c, own in out.items():
        own.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, _, r, _, x in own), "".join(x for _, _, r, _, x in own if r == "assistant")
        found[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return found


def escaped(text):
    for c in ["\\", *chat.CONTROLS]:
        text = text.replace(c, "\\" + c)
    return text


def back(spark, rows):
    chunks = chat.format_conversations(spark.createDataFrame(texts(rows), SCHEMA).withColumn("chunk", F.lit(1)).withColumn("formatted", F.lit("")))
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    return chunks, {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chunks).collect()}


ODD = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "\\\\[INST]\\"), (2, 0, "system", "[SYS]\\n[/SYS]<s"), (3, None, "tool", "x"), (3, 5, "to[/ROLE]ol\n", "[IMAGE]"),
    (None, 0, None, None), (None, 0, None, None), (4, 0, "assistant", ""), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (6, 2, "user", "😀 é\u0000</s"),
]


def test_odd_rows(spark):
    chunks, got = back(spark, ODD)
    assert got == expected(ODD)
    assert back(spark, ODD[:0])[1] == {} and sum(r.n_turns for r in chunks.collect()) == len(ODD)


def test_long_conversations(spark, monkeypatch):
    """Chunks end at turns; a conversation that holds a third of all rows spreads over several tasks."""
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} " + "[INST]" * (i % 3)) for i in range(3000)]
    rows += [(100 + i // 4, i % 4, ("user", "assistant")[i % 2], f"</s>{i}") for i in range(6000)]
    chunks, got = back(spark, rows)
    assert got == expected(rows)
    spread = spark.createDataFrame(texts(rows), SCHEMA).repartition(7)
    chunks = chat.format_conversations(spread).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("whole").alias("whole")).collect()
    assert max(r.n for r in chunks if r.conv_id == 7) >= 1 and sum(r.whole for r in chunks) > 1400
    seen = {r.conv_id for r in chunks}
    assert seen == {r[0] for r in rows}


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "see [IMAGE] "), part("image", ref="a.png", width=57, height=28), part("text", " and"), part("audio", ref="b.wav", seconds=2.01), part("document", ref="c.pdf", pages=3)]),
        (1, 1, "assistant", [part("text", "x"), part("video", ref="d"), part("text", "y"), part("document", "in</s>side", "e.txt"), part("image")]),
        (1, 2, "user", None), (1, 3, "user", []), (1, 4, "assistant", [part("text")]),
    ]
    row = formatted(spark, rows)[0]
    assert row.formatted == "[INST]see \\[IMAGE] [IMAGE] and[AUDIO][DOCUMENT][/INST]<s>x[FILE]y[DOCUMENT]in\\</s>side[IMAGE]</s>[INST][/INST][INST][/INST]<s></s>"
    got = [(a.kind, a.ref, a.tokens) for a in row.attachments]
    assert got == [("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 768), ("file", "d", 0), ("document", "e.txt", 0), ("image", None, 1)]
    marks = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]", "file": "[FILE]"}
    assert all(row.formatted.startswith(marks[a.kind], a.position) for a in row.attachments)
    assert [row.formatted[s.start : s.stop] for s in row.loss] == ["x[FILE]y[DOCUMENT]in\\</s>side[IMAGE]"]
    assert list(chat.turns_of(row.formatted)) == [("user", "see [IMAGE]  and"), ("assistant", "xyin</s>side"), ("user", ""), ("user", ""), ("assistant", "")]
    own = formatted(spark, rows[:1], visitor=chat.Visitor(patch=14, audio_per_second=1.0, tokens_per_page=2))[0]
    assert [a.tokens for a in own.attachments] == [10, 3, 6]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST]", "[", "INST]", "<", "a", "[ROLE]", "[/ROLE]", "[FILE]"]), max_size=6)), max_size=5))
def test_texts_come_back(turns):
    shown = ""
    for role, bits in turns:
        head, foot = chat.MARKS.get(role, (chat.ROLE + role + chat.ROLE_END, chat.OTHER_END))
        shown += head + escaped("".join(bits)) + foot
    assert list(chat.turns_of(shown)) == [(r, "".join(b)) for r, b in turns]


def test_engines_escape_alike(spark):
    text = "".join(x for _, _, _, x in ODD if x)
    assert spark.range(1).select(chat.escape(F.lit(text)).alias("x")).first().x == escaped(text)
    assert duckdb.execute(f"SELECT regexp_replace(?, '({chat.ANY})', '\\\\\\1', 'g')", [text]).fetchone()[0] == escaped(text)
