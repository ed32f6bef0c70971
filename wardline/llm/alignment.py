"""Alignment of two tokenizers' tokens by bytes, and how often pairs of tokens are linked in the corpus.

Both tokenizers cut a text at each single space between two characters that aren't white space, so the text falls apart
into pieces (a space and what follows) that are tokenized and aligned on their own; a worker keeps what it found for
pieces it has met. All new pieces of a batch are aligned at once in numpy: cumulated token lengths are ends, `intersect1d`
finds the ends that both sides have, `searchsorted` numbers the groups between them and gives the tokens that overlap each
token, and links are expanded by `repeat`.

A document's different links are staged as sorted codes (A id * 2^15 + B id, 4 bytes) with their numbers of occurrences. Tasks add up
the documents of each code before they send (code, salt, documents); a first shuffle adds up by code and salt, a second by code.
So many of the most frequent codes as HOT_PAIRS allows, with their counts, are broadcast to a pass over the staged links, and so is the
highest count of each A id, one for each entry of the vocabulary. Only links whose code is rarer shuffle, to be
joined with the other counts; none of these has many rows.

Defined results: a text that is null, empty, or whose tokens of either side don't join to the bytes of a space and the
text has no tokens: zeros and an empty string. Strings of special tokens in texts are plain text. Rows that repeat
are documents of their own and each counts; a null doc_id is passed through. An empty table gives no rows. Extra
columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import stage, text_batches
from wardline.llm.packing import SAFE_SPACE, UNSAFE, Ids, byte_tokens, same_merges

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bits of a code that hold the B id. Different pieces that a worker keeps. Codes that a task holds before it sends sums.
B_BITS, CACHE_PIECES, HELD_CODES = 15, 250_000, 1 << 21
#: Codes whose counts are broadcast, 12 bytes each. Shares of a code in the first shuffle.
HOT_PAIRS, SALTS = 1 << 18, 8
#: The mark that stands for a space in pieces of the second tokenizer.
BLOCK = "▁"


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def padded(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by id -> their bytes one after the other, and the place of each (ids + 1 places)."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times for each i, by one repeat and no loop."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def bytes_of(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    data, place = table
    return data[expand(place[ids], place[ids + 1] - place[ids])]


class Pieces:
    """Token ids of many pieces of text, laid end to end; ends: where each piece's tokens end."""

    def __init__(self, ids: np.ndarray, sizes: list[int] | np.ndarray) -> None:
        self.ids, self.sizes = ids, np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)

    def lengths(self, length: np.ndarray) -> np.ndarray:
        """Bytes of each piece."""
        return np.diff(np.concatenate([[0], np.cumsum(length[self.ids])])[np.concatenate([[0], self.ends])])

    def only(self, keep: np.ndarray) -> Pieces:
        """The pieces of these numbers."""
        if len(keep) == len(self.sizes):
            return self
        return Pieces(self.ids[expand((self.ends - self.sizes)[keep], self.sizes[keep])], self.sizes[keep])


def align(a: Pieces, b: Pieces, lengths_a: np.ndarray, lengths_b: np.ndarray) -> list[tuple[int, str, bytes]]:
    """Pieces whose tokens of both sides cover the same bytes, all aligned at once: where one piece ends is a common cut.

    Gives for each piece its numbers of tokens and groups (`packed`), its groups as text, its links as codes of 4 bytes.
    """
    ends_a, ends_b = np.cumsum(lengths_a[a.ids]), np.cumsum(lengths_b[b.ids])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    # B tokens that overlap an A token: from the first that ends after its start to the first that ends at its end or later
    first = np.searchsorted(ends_b, ends_a - lengths_a[a.ids], side="right")
    n = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    codes = ((np.repeat(a.ids, n) << B_BITS) | b.ids[expand(first, n)]).astype("<u4").tobytes()
    # tokens in the order of the text of groups: A's, then B's of each group, each after its mark
    at_a = np.arange(len(a.ids)) + np.searchsorted(group_b, group_a, side="left")
    at_b = np.arange(len(b.ids)) + np.searchsorted(group_a, group_b, side="right")
    shown = np.empty(len(a.ids) + len(b.ids), np.int64)
    shown[at_a] = a.ids + NAMED * np.where(np.diff(group_a, prepend=-1) > 0, 1, 0)
    shown[at_b] = b.ids + NAMED * np.where(np.diff(group_b, prepend=-1) > 0, 2, 0)
    text = list(map(names().__getitem__, shown.tolist()))
    groups, links = group_a[a.ends - 1] + 1, np.cumsum(n)[a.ends - 1] * 4
    counts = packed(a.sizes, b.sizes, np.diff(groups, prepend=0))
    edges, cut = [0, *(a.ends + b.ends).tolist()], [0, *links.tolist()]
    return [(k, "".join(text[i:j])[1:], codes[lo:hi]) for k, i, j, lo, hi in zip(counts, edges, edges[1:], cut, cut[1:], strict=False)]


#: More than any id; ids as text after a comma, a semicolon, a bar.
NAMED = 1 << 16
FIELD = 40


@functools.cache
def names() -> list[str]:
    return [f"{mark}{i}" for mark in ",;|" for i in range(NAMED)]


def packed(*counts: np.ndarray) -> list[int]:
    """Numbers side by side in one integer, FIELD bits each, so that one sum adds them all up."""
    return [x | y << FIELD | z << 2 * FIELD for x, y, z in zip(*(c.tolist() for c in counts), strict=True)]


class Aligner:
    """Both tokenizers with their tokens as bytes, and the pieces met so far (None: the bytes differ)."""

    def __init__(self, a_path: str, b_path: str, fast: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = Ids(a_path, fast)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        known = byte_tokens(a_path)[0]
        tokens_a = [b""] * (max(known.values()) + 2)
        for token, i in known.items():
            tokens_a[i] = token
        tokens_b = [self._bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        # pieces may be tokenized alone only if no token holds a space after something else
        self.apart = not any(BLOCK in t.lstrip(BLOCK) for t in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.table_a, self.table_b = padded(tokens_a), padded(tokens_b)
        self.lengths_a, self.lengths_b = np.diff(self.table_a[1]), np.diff(self.table_b[1])
        self.known: dict[str, tuple[int, str, bytes] | None] = {}

    @staticmethod
    def _bytes(piece: str) -> bytes:
        own = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
        return bytes([int(own[1], 16)]) if own else piece.replace(BLOCK, " ").encode()

    def learn(self, pieces: list[str]) -> None:
        """Tokenize and align pieces (without the space before them)."""
        bytes_a, ids_b = self.a._encode_parts(pieces), self.b.encode(pieces, num_threads=1)
        texts = [f" {p}".encode() for p in pieces]
        a = Pieces(np.frombuffer(b"".join(bytes_a), "<u4").astype(np.int64), [len(x) // 4 for x in bytes_a])
        b = Pieces(np.fromiter(itertools.chain.from_iterable(ids_b), np.int64), list(map(len, ids_b)))
        sizes = np.array(list(map(len, texts)))
        sound = np.flatnonzero((a.lengths(self.lengths_a) == sizes) & (b.lengths(self.lengths_b) == sizes))
        a, b = a.only(sound), b.only(sound)
        whole = np.frombuffer(b"".join([texts[i] for i in sound.tolist()]), np.uint8)
        differs = (bytes_of(a.ids, self.table_a) != whole) | (bytes_of(b.ids, self.table_b) != whole)
        if differs.any():
            broken = np.searchsorted(np.cumsum(sizes[sound]), np.flatnonzero(differs), side="right")
            same = np.setdiff1d(np.arange(len(sound)), broken)
            sound, a, b = sound[same], a.only(same), b.only(same)
        self.known.update(dict.fromkeys(pieces))
        if len(sound):
            self.known.update(zip((pieces[i] for i in sound.tolist()), align(a, b, self.lengths_a, self.lengths_b), strict=True))

    def pieces_of(self, text: str) -> list[str]:
        """The text cut before each space that both tokenizers cut at; spaces before pieces are left out."""
        if not self.apart or not text:
            return [text] if text else []
        return SAFE_SPACE.split(text) if UNSAFE.search(text) or text[0] == " " or text[-1] == " " else text.split(" ")

    def batch(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, bytes, bytes]]:
        """n_a, n_b, n_groups, n_links, digest of groups, different codes in order, occurrences of each."""
        parts = [self.pieces_of(t or "") for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        missing = list(set(itertools.chain.from_iterable(parts)).difference(self.known))
        if missing:
            self.learn(missing)
        out = []
        for own in parts:
            found = list(map(self.known.__getitem__, own))
            if not found or None in found:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            counts, groups, codes = zip(*found, strict=True)
            n, linked = sum(counts), b"".join(codes)
            known, times = np.unique(np.frombuffer(linked, "<u4"), return_counts=True)
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            low = (1 << FIELD) - 1
            out.append((n & low, n >> FIELD & low, n >> 2 * FIELD, len(linked) // 4, digest, known.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
        for p in missing:  # long pieces are not worth keeping
            if len(p) > 40:
                del self.known[p]
        return out


@functools.cache
def aligner(a_path: str, b_path: str, fast: bool) -> Aligner:
    return Aligner(a_path, b_path, fast)


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKED = f"doc_id long, {COUNTS}, codes binary, times binary"


def links_of(a_path: str, b_path: str, fast: bool):
    """A function for mapInArrow over (doc_id, text)."""
    columns = [x.split()[0] for x in LINKED.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path, fast)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = own.batch(part.column(1).to_pylist())
                found = [part.column(0).to_pylist(), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], columns)

    return run


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal codes added up."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def partial_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each code in this task: code, salt, n. At most HELD_CODES different codes and as many new ones are held."""
    salt = TaskContext.get().partitionId() % SALTS
    codes, n, new, waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(codes), 1 << 16):
            c = codes[lo : lo + (1 << 16)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.full(len(c), salt, np.int32)), pa.array(n[lo : lo + (1 << 16)])], ["code", "salt", "n"])

    for batch in batches:
        for data in batch.column(0).to_pylist():
            new.append(np.frombuffer(data, "<u4"))
            waiting += len(new[-1])
            if waiting >= HELD_CODES:
                fresh, times = np.unique(np.concatenate(new), return_counts=True)
                codes, n = summed(np.concatenate([codes, fresh]), np.concatenate([n, times]))
                new, waiting = [], 0
                if len(codes) >= HELD_CODES:
                    yield from sent()
                    codes, n = codes[:0], n[:0]
    if waiting:
        fresh, times = np.unique(np.concatenate(new), return_counts=True)
        codes, n = summed(np.concatenate([codes, fresh]), np.concatenate([n, times]))
    yield from sent()


def pair_counts(linked: DataFrame) -> DataFrame:
    """Staged links -> code, n (documents that hold it), staged: two shuffles, the first by code and salt."""
    partial = linked.where("n_links > 0").select("codes").mapInArrow(partial_counts, "code long, salt int, n long")
    salted = partial.groupBy("code", "salt").agg(F.sum("n").alias("n"))
    return stage(salted.groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")


def hot_counts(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent codes in order and their counts, `most` at most: whole classes of counts, by logarithm, from the top."""
    level = F.floor(F.log2("n") * 16).cast("int")
    least, held = None, 0
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("codes")).orderBy(F.desc("level")).collect():  # 16 rows for each doubling of counts
        if held + row.codes > most:
            break
        least, held = row.level, held + row.codes
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(level >= least).toPandas().sort_values("code")  # `most` rows at most
    return found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


SCORED = f"at long, doc_id long, {COUNTS}, n_best long, count_sum long, rare array<long>, rare_times array<long>"


def scored(hot, best):
    """A function for mapInArrow over (at, doc_id, counts, codes, times): sums over links whose code is hot, and the rare ones as they are."""
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, counts), most = hot.value, best.value
        for batch in batches:
            n_best, total, rare, rare_times = [], [], [], []
            for data, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                own, k = np.frombuffer(data, "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                n = np.where(known, counts[at], 0) if len(codes) else np.zeros(len(own), np.int64)
                n_best.append(int(k[known & (n == most[own >> B_BITS])].sum()))
                total.append(int((n * k).sum()))
                rare.append(own[~known])
                rare_times.append(k[~known])
            kept = [batch.column(c) for c in names[:-4]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(rare_times, pa.list_(pa.int64()))], names)

    return run


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum: one row for each document."""
    spark = docs.sparkSession
    text_batches(spark)
    a_path, b_path = a_path or path_of(A_FILE), b_path or path_of(B_FILE)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    linked = stage(rows.mapInArrow(links_of(a_path, b_path, same_merges(a_path)), LINKED).withColumn("at", F.monotonically_increasing_id()), "links")
    counts = pair_counts(linked)
    best = np.zeros(1 << (32 - B_BITS), np.int64)
    for row in counts.groupBy(F.shiftright("code", B_BITS).alias("a")).agg(F.max("n").alias("n")).toLocalIterator():  # one row for each entry of A's vocabulary
        best[row.a] = row.n
    hot = spark.sparkContext.broadcast(hot_counts(counts, hot_pairs))
    most = spark.sparkContext.broadcast(best)
    found = stage(linked.select("at", "doc_id", *[x.split()[0] for x in COUNTS.split(", ")], "codes", "times").mapInArrow(scored(hot, most), SCORED), "scored")
    rare = found.where("size(rare) > 0").select("at", F.inline(F.arrays_zip(F.col("rare").alias("code"), F.col("rare_times").alias("times"))))
    tops = counts.groupBy(F.shiftright("code", B_BITS).alias("a")).agg(F.max("n").alias("top"))
    told = counts.withColumn("a", F.shiftright("code", B_BITS)).join(F.broadcast(tops), "a").select("code", "n", (F.col("n") == F.col("top")).alias("is_best"))  # as many rows as A's vocabulary
    more = rare.join(told, "code").groupBy("at").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    d = found.drop("rare", "rare_times").join(more, "at", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long").alias(a)
    return d.select("doc_id", *[x.split()[0] for x in COUNTS.split(", ")], plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def op13(spark, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
