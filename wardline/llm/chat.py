r"""Conversations of typed content parts as templated text with a loss mask, and the way back.

A message holds parts: text, image, audio, document. `Visitor` has a method for each type, which gives what the part shows
in the text: a text shows itself, escaped; the others show a placeholder in their place among the parts and leave a record
(kind, reference, tokens that the placeholder expands to). All of that is column expressions on single rows. The template marks
a turn by control strings of its role; the body of each assistant turn is under the loss mask.

Escaping: a backslash goes before each backslash and each control string of a text. No control string holds a
backslash or the first character of another, so what follows a backslash is always what was escaped, and no text can form a
control string with what stands beside it. `read_back` undoes it.

Turns are dealt by ranges of (conversation, turn), so that a conversation of any length spreads over tasks, and each task
joins its sorted turns to chunks of some CHUNK_CHARS characters, in which it holds one chunk at a time. A conversation is its
chunks in order. Reading back streams through chunks; those of a conversation that one task formatted alone are read where
they are, and only the first and last of each task and long ones meet by conversation. A SHA-256 over a whole conversation can
only be taken in order, so one task reads the chunks of a long conversation one after the other, with one in memory.

Defined results: a null text counts as empty, a message without parts is empty, a null role is the empty role. Turns are
ordered by turn (nulls last), then role, then SHA-256 of the body; repeated rows are repeated turns. A null conv_id
is a conversation of its own. Parts of an unknown type show [FILE] and expand to nothing, missing sizes count as the least.
An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import stage, text_batches

#: Marks of turns by role; other roles are named between the ROLE marks. Placeholders by type of part.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
ROLE, ROLE_END, OTHER_END = "[ROLE]", "[/ROLE]", "</s>"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
UNKNOWN = "[FILE]"
CONTROLS = [x for pair in MARKS.values() for x in pair] + [ROLE, ROLE_END, *PLACEHOLDERS.values(), UNKNOWN]
#: One pattern for both engines: a backslash or a control string.
ANY = r"\\|" + "|".join(re.sub(r"([\[\]])", r"\\\1", c) for c in CONTROLS)
TOKEN, ESCAPED = re.compile(rf"\\(?:{ANY})|{ANY}"), re.compile(rf"\\({ANY})")
#: Characters after which a chunk of a conversation ends, at the end of a turn.
CHUNK_CHARS = 1 << 18
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({ANY})", r"\\$1")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Visitor:
    """What each type of part shows, and the tokens that its placeholder expands to."""

    patch: int = 28
    audio_per_second: float = 25.0
    tokens_per_page: int = 256

    def text(self, part: Column) -> Column:
        return self._seen(escape(part["text"]))

    def image(self, part: Column) -> Column:
        tiles = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(1)), F.lit(1)) / self.patch)
        return self._seen(F.lit(PLACEHOLDERS["image"]), "image", part["ref"], tiles(part["width"]) * tiles(part["height"]))

    def audio(self, part: Column) -> Column:
        return self._seen(F.lit(PLACEHOLDERS["audio"]), "audio", part["ref"], F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * self.audio_per_second))

    def document(self, part: Column) -> Column:
        """A document whose text is known shows it after its placeholder, which then expands to nothing."""
        pages = F.when(part["text"].isNull(), F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.tokens_per_page).otherwise(0)
        return self._seen(F.concat(F.lit(PLACEHOLDERS["document"]), escape(part["text"])), "document", part["ref"], pages)

    def unknown(self, part: Column) -> Column:
        return self._seen(F.lit(UNKNOWN), "file", part["ref"], F.lit(0))

    def visit(self, part: Column) -> Column:
        """The part's own method decides: a struct (shown, kind, ref, tokens), kind null for text."""
        seen = self.unknown(part)
        for name in ("document", "audio", "image", "text"):
            seen = F.when(part["type"] == name, getattr(self, name)(part)).otherwise(seen)
        return seen

    def flatten(self, parts: Column) -> tuple[Column, Column]:
        """The body that the parts show, in order, and the records of their placeholders."""
        seen = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), self.visit)
        records = F.transform(F.filter(seen, lambda s: s["kind"].isNotNull()), lambda s: F.struct(s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens")))
        return F.array_join(F.transform(seen, lambda s: s["shown"]), ""), records

    @staticmethod
    def _seen(shown: Column, kind: str | None = None, ref: Column | None = None, tokens: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(shown.alias("shown"), F.lit(kind).cast("string").alias("kind"), (none if ref is None else ref).alias("ref"), (F.lit(0) if tokens is None else tokens).cast("long").alias("tokens"))


def text_part(text: Column) -> Column:
    """Parts of a message that is one text."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def turns(messages: DataFrame, visitor: Visitor | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """Messages with parts -> a row for each turn: conv_id, turn, role, head, body, foot, records."""
    body, records = (visitor or Visitor()).flatten(F.col(parts_col))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    head, foot = F.concat(F.lit(ROLE), escape(role), F.lit(ROLE_END)), F.lit(OTHER_END)
    for name, (opens, closes) in MARKS.items():
        head, foot = F.when(role == name, opens).otherwise(head), F.when(role == name, closes).otherwise(foot)
    return messages.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), head.alias("head"), body.alias("body"), foot.alias("foot"), records.alias("records"))


class Chunk:
    """Turns of one conversation that are joined to a text."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.loss: list[dict] = []
        self.attachments: list[dict] = []
        self.turns = self.chars = 0

    def add(self, role: str, head: str, body: str, foot: str, records: list[dict] | None) -> None:
        start = self.chars + len(head)
        if role == "assistant" and body:
            self.loss.append({"start": start, "stop": start + len(body)})
        if records:
            places = (m.start() for m in TOKEN.finditer(body) if m[0] in (UNKNOWN, *PLACEHOLDERS.values()))
            self.attachments += [r | {"position": start + at} for r, at in zip(records, places, strict=True)]
        self.pieces += (head, body, foot)
        self.chars = start + len(body) + len(foot)
        self.turns += 1


FORMATTED = ("chunk", "whole", "n_turns", "formatted", "loss", "attachments")


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> chunks; `whole` marks a chunk that is a conversation of its own, which only the turns around it can tell."""
    part, number, at = TaskContext.get().partitionId() << 33, 0, None
    now, first, kind, rows, held = Chunk(), True, None, [], 0
    single = False  # whether the chunk at hand begins its conversation

    def close(whole: bool) -> None:
        nonlocal now, number, held
        rows.append((at, part + number, whole, now.turns, "".join(now.pieces), now.loss, now.attachments))
        number, held, now = number + 1, held + now.chars, Chunk()

    def flush() -> pa.RecordBatch:
        nonlocal rows, held
        columns = list(zip(*rows, strict=True))
        rows, held = [], 0
        kinds = [kind, pa.int64(), pa.bool_(), pa.int32(), pa.string(), SPANS, ATTACHMENT]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *FORMATTED])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, role, head, body, foot, records in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "head", "body", "foot", "records")), strict=True):
            if now.turns + number and conv != at:
                if now.turns:
                    close(single and not first)
                first, single = False, True
            elif now.chars >= CHUNK_CHARS:
                close(False)
                single = False
            at = conv
            now.add(role, head, body, foot, records)
            if held > 16 * CHUNK_CHARS or len(rows) > 1024:
                yield flush()
    if now.turns:
        close(False)
    if rows:
        yield flush()


def format_conversations(messages: DataFrame, visitor: Visitor | None = None, **columns: str) -> DataFrame:
    """Messages (conv_id, turn, role, parts) -> conv_id, chunk, whole, n_turns, formatted, loss, attachments.

    The text of a conversation is `formatted` of its chunks in order; places in `loss` (start, stop) and `attachments`
    (kind, ref, position, tokens) are code points within the chunk. Turns are never cut.
    """
    text_batches(messages.sparkSession)
    rows = turns(messages, visitor, **columns)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("tie")]
    dealt = rows.withColumn("tie", F.sha2("body", 256)).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]
    found = "chunk long, whole boolean, n_turns int, formatted string, loss array<struct<start:long,stop:long>>, attachments array<struct<kind:string,ref:string,position:long,tokens:long>>"
    return dealt.drop("turn", "tie").mapInArrow(joined, f"conv_id {kind}, {found}")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and unescaped text of each turn of a formatted text; placeholders are left out of texts."""
    role, parts, start, closes = None, [], 0, {a: b for a, b in MARKS.values()}
    names = {opens: name for name, (opens, _) in MARKS.items()}
    ends, naming = "", False
    for m in TOKEN.finditer(text):
        mark = m[0]
        if mark[0] == "\\":
            continue
        if naming or (role is not None and (mark == ends or mark == UNKNOWN or mark in PLACEHOLDERS.values())):
            parts.append(text[start : m.start()])
        if naming:
            role, parts, naming, ends = unescape("".join(parts)), [], False, OTHER_END
        elif role is None and mark == ROLE:
            naming, parts = True, []
        elif role is None:
            role, parts, ends = names[mark], [], closes[mark]
        elif mark == ends:
            yield role, unescape("".join(parts))
            role = None
        start = m.end()


def shown(text: str) -> str:
    """A piece of a body without placeholders, unescaped."""
    return unescape("".join(x for x in re.split(rf"(\\(?:{ANY})|{ANY})", text) if x != UNKNOWN and x not in PLACEHOLDERS.values()))


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, those of a conversation side by side and in order -> a row for each conversation."""
    at, begun, kind = None, False, None
    n = loss_chars = chars = 0
    said, loss = hashlib.sha256(), hashlib.sha256()
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal rows
        columns, rows = list(zip(*rows, strict=True)), []
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            if begun and conv != at:
                rows.append((at, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                n = loss_chars = chars = 0
                said, loss = hashlib.sha256(), hashlib.sha256()
            at, begun = conv, True
            chars += len(text)
            for role, body in turns_of(text):
                said.update(f"{role}\n{body}\n".encode())
                n += 1
            for span in spans:
                body = shown(text[span["start"] : span["stop"]])
                loss.update(body.encode())
                loss_chars += len(body)
            if len(rows) > 4096:
                yield flush()
    if begun:
        rows.append((at, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield flush()


def read_back(chunks: DataFrame) -> DataFrame:
    """Staged chunks -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, taken from the text and the mask alone."""
    text_batches(chunks.sparkSession)
    out, columns = f"conv_id {dict(chunks.dtypes)['conv_id']}, {DIGEST}", ["conv_id", "formatted", "loss"]
    parted = chunks.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return chunks.where("whole").select(*columns).mapInArrow(read, out).unionByName(parted.select(*columns).mapInArrow(read, out))


#: A conversation that consists of control strings.
ODD = "</s>[INST] ok [/INST]"


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    messages = rows.unionByName(odd).withColumn("parts", text_part(F.col("text")))
    return read_back(stage(format_conversations(messages), "formatted"))


_MARK_CHARS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
OP11_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{ODD}' FROM range(2) t(i)),
escaped AS (SELECT *, regexp_replace(t, '({ANY})', '\\\1', 'g') AS body FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, role, sha256(body))) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, role, sha256(body)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE role {_MARK_CHARS} ELSE {len(ROLE) + len(ROLE_END) + len(OTHER_END)} + length(regexp_replace(role, '({ANY})', '\\\1', 'g')) END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
