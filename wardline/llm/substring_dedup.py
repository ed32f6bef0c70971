"""Substring dedup: recurring runs of WINDOW words are found by phrase automata and cut from later documents.

1. Anchors. In each window of WINDOW words, the PHRASE-word phrase with the least hash is chosen (winnowing), so
   a window that occurs twice chooses the same phrase twice; about one word in 23 starts a chosen phrase.
2. Recurring phrases are those that documents of different doc_id choose, compared as strings.
3. Automata. The recurring phrases of a batch of documents are compiled to an Aho-Corasick automaton, one shard for each
   batch, and the whole texts stream through it. Its hits alone say where recurring phrases are: each run of windows
   that choose a phrase that was hit is a passage, known by 128 bits of hashes of its words. So a passage of some
   70 words is one row, not one for each of its windows.
4. A passage that a smaller doc_id has too goes as a whole. Passages that differ but share the phrase are held against
   each other by their windows, once for each different passage: a window goes if a smaller doc_id has it in any passage.

Documents without a recurring phrase are kept in place by a Bloom filter and not read again until the result is
written. Passages and windows are matched by aggregation before shuffling, and by joins that leave the rows of hot keys
where they are.

Defined results: null, empty and short texts (fewer than WINDOW words) keep all words; equal windows within one
document, or of rows with the same doc_id, are kept; a null doc_id comes after all others; an empty table gives
no rows; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm import placed_words as words
from wardline.llm.common import number_rows, partnered, passing, spread_join, stage, text_batches

WINDOW, PHRASE = 50, 6
#: Windows that a task holds before it passes them on.
FLUSH = 200_000
#: Stands for a null doc_id where ids are compared.
LAST_ID = (1 << 63) - 1


def chosen(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and for each window that of the phrase it chooses."""
    g = words.runs(h, PHRASE)
    return g, words.sliding_min(g, WINDOW - PHRASE + 1) if len(h) >= WINDOW else g[:0]


def choices(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of one text that choose the same phrase: number of the text, first and last (exclusive) window, where the phrase first
    occurs in the first window, and its hash. Words h are those of all texts, of which each begins at its bound."""
    g, least = chosen(h)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    window = np.flatnonzero(text[: len(least)] == text[WINDOW - 1 :]) if len(least) else np.empty(0, np.int64)
    if not len(window):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (g[:0],)
    value, own = least[window], text[window]
    cut = np.flatnonzero((value[1:] != value[:-1]) | (own[1:] != own[:-1])) + 1
    first, last = window[np.append(0, cut)], window[np.append(cut, len(window)) - 1] + 1
    value = least[first]
    place = first + (g[first[:, None] + np.arange(WINDOW - PHRASE + 1)] == value[:, None]).argmax(axis=1)
    return text[first], first, last, place, value


def phrases(own: words.Placed, place: np.ndarray) -> pa.Array:
    """The phrases at these words, with one space between words."""
    joined, spaces = own.joined()
    begin = np.append(0, spaces + 1)[place]
    size = spaces[place + PHRASE - 1] - begin
    ends = np.append(0, np.cumsum(size))
    letters = joined[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, own in words.placed(batch.column(2)):
            text, _, _, place, value = choices(own.hashes(), own.bounds)
            order = np.lexsort((value, text))
            text, place, value = text[order], place[order], value[order]
            new = np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])) if len(text) else np.empty(0, bool)
            at = pa.array(text[new] + row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), phrases(own, place[new])], ["id", "part", "phrase"])


def occurrences(automaton, own: words.Placed) -> np.ndarray:
    """Numbers of the words at which the automaton's phrases occur, which may go on into the next text."""
    joined, spaces = own.joined()
    ends = np.fromiter((end for end, _ in automaton.iter(f" {joined.tobytes().decode('latin-1')}")), np.int64)
    return np.unique(np.searchsorted(spaces + 1, ends) - PHRASE + 1)


def compiled(phrases: Iterable[bytes]):
    """An automaton for phrases as bytes, each of which stands for a character."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ", 1)
    automaton.make_automaton()
    return automaton


def spans(h: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of words from first to end (exclusive), by differences of a polynomial's prefix sums."""
    step = (int(words.M1) + 2 * seed) % 2**64
    power = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(h), x, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words.mixed(h + np.uint64(seed)) * power(step)[:-1])])
    return words.mixed((sums[end] - sums[first]) * power(pow(step, -1, 2**64))[first] + (end - first).astype(np.uint64))


PASSAGES = "g long, h1 long, h2 long, id long, part long, start int, n int"


def _passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, text, phrases) -> passages: the phrase's hash, two hashes of the words, id, part, first window and number of windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        automaton = compiled(batch.column(3).flatten().unique().to_pylist())
        out: list[list[np.ndarray]] = [[] for _ in PASSAGES.split(", ")]
        ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for row, own in words.placed(batch.column(2)):
            h = own.hashes()
            text, first, last, place, value = choices(h, own.bounds)
            hits = np.zeros(len(h), bool)
            hits[occurrences(automaton, own)] = True
            text, first, last, value = (x[hits[place]] for x in (text, first, last, value))
            ends = last - 1 + WINDOW
            found = value, spans(h, first, ends, 0), spans(h, first, ends, 41), ids[text + row], parts[text + row], first - own.bounds[text], last - first
            for x, y in zip(out, found, strict=True):
                x.append(y)
        kinds = [np.int64] * 5 + [np.int32] * 2
        cols = [pa.array((np.concatenate(x) if x else np.empty(0)).astype(kind)) for x, kind in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PASSAGES.split(", ")])


#: Windows by two hashes: their place (number of the passage, and in it), and roles (1: may go; 2: may make others go).
WINDOWS = "w long, c int, place long, role int"
PLACE_BITS = 26


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, passages as (start, n, kid, role)) -> the windows of the passages."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    for batch in batches:
        held: list[tuple[np.ndarray, ...]] = []
        passages = batch.column(1).flatten()
        begin = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy()))
        for row, own in words.placed(batch.column(0)):
            h, rows = own.hashes(), len(own.bounds) - 1
            start, n, kid, role = (passages.field(x).to_numpy()[begin[row] : begin[row + rows]] for x in ("start", "n", "kid", "role"))
            start = start + np.repeat(own.bounds[:-1], np.diff(begin[row : row + rows + 1]))
            ends = np.cumsum(n, dtype=np.int64)
            offset = np.arange(n.sum()) - np.repeat(ends - n, n)
            at = np.repeat(start, n) + offset
            w, c = spans(h, at, at + WINDOW, 0).view(np.int64), (spans(h, at, at + WINDOW, 41) >> np.uint64(33)).astype(np.int32)
            held.append((w, c, np.repeat(kid << PLACE_BITS, n) | offset, np.repeat(role, n).astype(np.int32)))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, runs of windows) -> ranges of words under the windows, as pairs of 32-bit numbers."""
    for batch in batches:
        out = []
        for x in batch.column(2):
            runs = np.sort(x.values.to_numpy())  # first window in the high half, number of windows in the low one
            first = runs >> 32
            end = np.maximum.accumulate(first + (runs & 0xFFFFFFFF) - 1 + WINDOW)
            cut = np.flatnonzero(first[1:] > end[:-1]) + 1
            out.append(np.stack([first[np.append(0, cut)], end[np.append(cut - 1, len(end) - 1)]], 1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["rid", "rpart", "ranges"])


def keep_mask(n: int, ranges: bytes | None) -> np.ndarray:
    keep = np.ones(n, bool)
    for a, b in np.frombuffer(ranges or b"", np.int32).reshape(-1, 2).tolist():
        keep[a:b] = False
    return keep


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all of docs), text, id (null last) and part, 31 bits of the text's hash that tell rows of one doc_id apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs can clash with ours
    return docs.select(row, F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.shiftrightunsigned(F.xxhash64(text_col), 33).alias("part"))


def _of_documents(base: DataFrame, side: DataFrame) -> DataFrame:
    """base (id, part, text) with the columns of a staged side (sid, spart, ...); other texts stay where they are."""
    same = (F.col("id") == F.col("sid")) & (F.col("part") == F.col("spart"))
    return partnered(base, side, same, F.xxhash64("id", "part"), F.xxhash64("sid", "spart"))


KEY = ["g", "h1", "h2"]


def passages(base: DataFrame) -> DataFrame:
    """Staged passages of the documents (id, part, text), as the automata locate them."""
    spark = base.sparkSession
    with passing(spark):
        with passing(spark):
            anchors = stage(base.mapInArrow(_anchors, "id long, part long, phrase binary"), "anchors")
            recurring = anchors.groupBy("phrase").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("copies")).where("least < most")
            recurring = stage(recurring.select("phrase", "copies"), "recurring")
            lists = spread_join(anchors, recurring, ["phrase"], "copies", few=True).groupBy(F.col("id").alias("sid"), F.col("part").alias("spart")).agg(F.collect_set("phrase").alias("phrases"))
            lists = stage(lists, "lists", lasts=True)
        texts = _of_documents(base, lists)
        return stage(texts.select("id", "part", "text", "phrases").mapInArrow(_passages, PASSAGES), "passages", lasts=True)


def covered(base: DataFrame, classes: DataFrame) -> DataFrame:
    """KEY, offsets: windows of a passage that a smaller doc_id has in another passage with the same phrase.

    Passages (one of each kind) are numbered in the order of doc_id, so the least number that has a window tells whether
    an earlier document has it. Those of a phrase's least doc_id can't lose windows, those of its greatest make none go.
    """
    shared = classes.groupBy("g").agg(F.min("at.id").alias("least"), F.max("at.id").alias("most"), F.count(F.lit(1)).alias("kinds")).where("least < most")
    role = (F.col("at.id") > F.col("least")).cast("int") + (F.col("at.id") < F.col("most")).cast("int") * 2
    kinds = spread_join(classes, stage(shared, "shared"), ["g"], "kinds", few=True).select(*KEY, "at", role.alias("role"))
    kinds = stage(number_rows(kinds, F.col("at.id"), name="kid"), "kinds")
    firsts = kinds.groupBy(F.col("at.id").alias("sid")).agg(F.min("kid").alias("first"))
    wanted = kinds.groupBy(F.col("at.id").alias("sid"), F.col("at.part").alias("spart")).agg(F.collect_list(F.struct("at.start", "at.n", "kid", "role")).alias("passages"))
    with passing(base.sparkSession):
        texts = _of_documents(base, stage(wanted, "wanted"))
        windows = stage(texts.select("text", "passages").mapInArrow(_windows, WINDOWS), "windows", lasts=True)
    kid = F.shiftright("place", PLACE_BITS)
    least, most = F.min(F.when(F.expr("role & 2 > 0"), kid)), F.max(F.when(F.expr("role & 1 > 0"), kid))
    # windows that no later passage has make nothing go, so they stay out of the join, and those without a maker don't move
    makers = windows.groupBy("w", "c").agg(least.alias("least"), most.alias("most"), F.count_if(F.expr("role & 1 > 0")).cast("int").alias("copies")).where("least < most")
    met = spread_join(windows.where("role & 1 > 0"), stage(makers.drop("most"), "makers"), ["w", "c"], "copies", few=True)
    later = met.where(F.col("least") < kid).select(kid.alias("kid"), "least", F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("offset"))
    found = later.groupBy("kid").agg(F.collect_set(F.struct("offset", "least")).alias("found"))
    named = found.join(kinds.select("kid", *KEY, F.col("at.id").alias("sid")), "kid").join(firsts, "sid")
    gone = F.transform(F.filter("found", lambda x: x["least"] < F.col("first")), lambda x: x["offset"])
    return named.select(*KEY, gone.alias("offsets")).where(F.size("offsets") > 0)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (rid, rpart, ranges) for each document that has words to remove."""
    text_batches(docs.sparkSession)
    with passing(docs.sparkSession):
        base = _keyed(docs, id_col, text_col).select("id", "part", "text")
        found = passages(base)
        classes = stage(found.groupBy(*KEY).agg(F.min(F.struct("id", "part", "start", "n")).alias("at"), F.count(F.lit(1)).alias("copies")), "classes")
        known = spread_join(found, classes, KEY, "copies")
        whole = known.where(F.col("id") > F.col("at.id")).select("id", "part", "start", "n")
        first = known.where(F.col("id") == F.col("at.id")).join(covered(base, classes), KEY)
        some = first.select("id", "part", F.explode(F.transform("offsets", lambda x: F.col("start") + x)).alias("start"), F.lit(1).alias("n"))
        runs = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
        gone = whole.unionByName(some).groupBy("id", "part").agg(F.collect_set(runs).alias("runs"))
        return stage(gone.mapInArrow(_ranges, "rid long, rpart long, ranges binary"), "ranges", lasts=True)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    same = (F.col("id") == F.col("rid")) & (F.col("part") == F.col("rpart"))
    return partnered(_keyed(docs, id_col, text_col), repeats(docs, id_col, text_col), same, F.xxhash64("id", "part"), F.xxhash64("rid", "rpart"), "left")


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, sha = [], [], []
        ranges = batch.column(2).to_pylist()
        for row, own in words.placed(batch.column(1)):
            joined, spaces = own.joined()
            begin = np.append(0, spaces + 1)
            for i, (first, end) in enumerate(zip(own.bounds[:-1].tolist(), own.bounds[1:].tolist(), strict=True)):
                cut = first + np.frombuffer(ranges[row + i] or b"", np.int32)
                kept = begin[np.concatenate([[first], cut, [end]])].tolist()  # from and to in turns
                n.append(end - first)
                gone.append(int((cut[1::2] - cut[::2]).sum()))
                sha.append(hashlib.sha256(b"".join(joined[x:y].tobytes() for x, y in zip(kept[::2], kept[1::2], strict=True))[:-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    rows = _marked(docs, id_col, text_col).select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), "text", "ranges")
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words cut; the kept words of a changed text are joined by one space, other texts stay."""

    @F.pandas_udf("string")
    def cut(texts, ranges):
        out = []
        for text, r in zip(texts, ranges, strict=True):
            own = (text or "").encode().split()
            out.append(b" ".join(own[i] for i in np.flatnonzero(keep_mask(len(own), r)).tolist()).decode())
        import pandas as pd

        return pd.Series(out)

    changed = F.when(F.col("ranges").isNotNull(), cut(F.col("text"), F.col("ranges"))).otherwise(F.col("text"))
    columns = [changed.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return _marked(docs, id_col, text_col).select(*columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, row, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS x FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
f AS (SELECT x, min(coalesce(doc_id, {LAST_ID})) AS least FROM s GROUP BY x),
r AS (SELECT DISTINCT row, unnest(range(i, i + {WINDOW})) AS j FROM s JOIN f USING (x) WHERE coalesce(doc_id, {LAST_ID}) > least),
g AS (SELECT row, list(j) AS gone FROM r GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE (SELECT coalesce(list(ws[k] ORDER BY k), []) FROM unnest(range(1, len(ws) + 1)) t(k) WHERE NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (row)
"""
