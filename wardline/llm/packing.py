"""Packing documents into sequences of SEQ tokens by Karmarkar-Karp multiway differencing.

Documents are tokenized as they stream through a task, and the places of their pieces are staged. Tasks with some
TASK_PIECES pieces each, whatever the number of files, pack every BLOCK rests together; nothing is shuffled and no key
can be hot. A document (its ids and a closing id) gives full
sequences first; the rest of less than SEQ ids is cut at multiples of CUT. The rests of a block are dealt to
windows by multiway differencing: the two partial partitions with the largest imbalances are merged, the
fullest window of one with the emptiest of the other, until one near-equal partition is left. If a window
exceeds SEQ, the number of windows rises by one and the rests are dealt anew.

Tokenizing caches the ids of words: the tokenizer's pattern never spans a single space that stands between two
other characters, except as the first character of what follows, so the text is cut there and each different
part is tokenized once for each batch or taken from a bounded cache. A faster engine, which merges the pair of tokens
whose concatenation has the lowest id, serves for printable Latin text if `same_merges` shows that it must agree with the
tokenizer. Sequence numbers are unique, not dense.

Defined results: a null text counts as empty and gives the closing id alone; rows that repeat are packed as
often as they occur; null doc_id is passed through; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import stage, text_batches

SEQ, CUT, BLOCK, TASK_PIECES, END_ID = 2048, 512, 1024, 16_384, 1
#: The tokenizer's one special token; texts that hold it are left to the tokenizer.
SPECIAL = "<|endoftext|>"
#: Different words that a worker keeps the ids of.
CACHE_WORDS = 500_000
#: Parts encoded in one call.
JOIN = 64
#: A space between two characters that aren't white space: parts on its two sides tokenize independently.
#: Parts of printable Latin characters, whose classes are the same in all versions of Unicode since 5.0, and single line ends.
LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+(?:\n[!-~\u00a1-\u00ac\u00ae-\u024f]+)*")
SAFE_SPACE, UNSAFE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_tokens(path: str) -> tuple[dict[bytes, int], dict[bytes, tuple[bytes, bytes]]]:
    """Ids of the tokens as bytes, and the two tokens that each merged one is made of."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    others = [x for x in range(256) if x not in own]
    byte_of = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}
    as_bytes = lambda token: bytes(byte_of[c] for c in token)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return {as_bytes(token): i for token, i in model["vocab"].items() if token != SPECIAL}, {a + b: (a, b) for a, b in pairs}


@functools.cache
def same_merges(path: str) -> bool:
    """Whether merging by lowest concatenation must give the tokenizer's ids.

    Both engines take the leftmost pair of the lowest rank; they differ only where two tokens that are not listed as a
    merge concatenate to a token. A token that arises within a text arises by the same steps from its own bytes alone,
    since no step that crosses its ends came before. So it is enough that each token's own last step is its listed merge,
    that tokens are made by one merge each, and that ids rise in the order of merges.
    """
    ids, made_of = byte_tokens(path)
    order = [ids[t] for t in made_of]
    if sorted(set(order)) != order or len(ids) != len(made_of) + sum(len(t) == 1 for t in ids):
        return False
    for token, pair in made_of.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [ids.get(a + b, len(ids) + 1_000_000) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            if parts[at] + parts[at + 1] not in ids:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if tuple(parts) != pair:
            return False
    return True


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes. fast: whether `same_merges` holds."""

    def __init__(self, path: str, fast: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spaced = [i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith("\u0120")]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[spaced] = True
        self.merge = self._fast(path) if fast else lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}  # a part after a space -> ids of the space and the part

    @staticmethod
    def _fast(path: str):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_tokens(path)[0], special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts after a space. Latin ones are encoded together, JOIN at a time, and told apart by the tokens that begin with a space."""
        plain = [LATIN.fullmatch(p) is not None and SPECIAL not in p for p in parts]
        joined = [p for p, ok in zip(parts, plain, strict=True) if ok]
        runs = [" " + " ".join(joined[i : i + JOIN]) for i in range(0, len(joined), JOIN)]
        found: list[bytes] = []
        for run in runs:
            ids = np.array(self.merge(run), "<u4")
            cuts, data = (4 * np.flatnonzero(self.spaced[ids])).tolist(), ids.tobytes()
            found += [data[i:j] for i, j in zip(cuts, [*cuts[1:], len(data)], strict=True)]
        assert len(found) == len(joined)
        alone = iter(self._encode([f" {p}" for p, ok in zip(parts, plain, strict=True) if not ok]))
        together = iter(found)
        return [next(together) if ok else next(alone) for ok in plain]

    def batch(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") if not UNSAFE.search(t) else SAFE_SPACE.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        missing = list(set(itertools.chain.from_iterable(x[1:] for x in parts)).difference(known))
        known.update(zip(missing, self._encode_parts(missing), strict=True))
        heads = self._encode([x[0] for x in parts])
        out = [head + b"".join(map(known.__getitem__, x[1:])) for head, x in zip(heads, parts, strict=True)]
        for p in missing:  # long parts are not worth keeping
            if len(p) > 40:
                del known[p]
        return out


@functools.cache
def ids_of(path: str, fast: bool) -> Ids:
    return Ids(path, fast)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items to windows: Karmarkar-Karp differencing over partial partitions, kept as their non-empty windows."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        meet = max(0, len(a) + len(b) - windows)  # so many of each have no empty window to go with
        both = a[: len(a) - meet] + b[: len(b) - meet]
        both += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - meet :], reversed(b[len(b) - meet :]), strict=True)]
        both.sort(key=lambda x: -x[0])
        low = both[-1][0] if len(both) == windows else 0
        heapq.heappush(heap, (low - both[0][0], made, both))  # windows keep their full sums; only the spread counts
        made += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = SEQ) -> list[list[int]]:
    """Windows (lists of item numbers) none of which exceeds capacity."""
    if not sizes:
        return []
    windows = -(-sum(sizes) // capacity)
    while True:
        dealt = difference(sizes, windows)
        if max(sum(sizes[i] for i in items) for items in dealt) <= capacity:
            return dealt
        windows += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
FIELDS = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def tokenized(path: str, fast: bool, with_ids: bool):
    """A function for mapInArrow over (doc_id, text) that gives the pieces of documents, with their ids as bytes if wanted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = ids_of(path, fast), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo in range(0, len(names), 64):
                rows: list[tuple] = []
                texts = [t or "" for t in batch.column(1).slice(lo, 64).to_pylist()]
                for doc_id, ids in zip(names[lo : lo + 64], own.batch(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    starts = [*range(0, n - n % SEQ, SEQ), *range(n - n % SEQ, n, CUT)]
                    for start, stop in zip(starts, [*starts[1:], n], strict=True):
                        piece = ids[4 * start : 4 * stop]
                        rows.append((doc_id, start, stop - start, zlib.crc32(piece), n, *((piece,) if with_ids else ())))
                cols = list(zip(*rows, strict=True))
                found = [pa.array(c, pa.int64()) for c in cols[:5]]
                if with_ids:
                    yield pa.RecordBatch.from_arrays([*found, pa.array(cols[5], pa.binary())], schema=FIELDS.append(pa.field("ids", pa.binary())))
                else:
                    yield pa.RecordBatch.from_arrays(found, schema=FIELDS)

    return run


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with sequence_id and offset, packed BLOCK rests at a time."""
    base = TaskContext.get().partitionId() << 36
    held: list[pa.RecordBatch] = []
    rests = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal base, rests
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        rests = 0
        size = table.column(2).to_numpy()
        sequence, offset = np.empty(len(size), np.int64), np.zeros(len(size), np.int64)
        whole, rest = np.flatnonzero(size == SEQ), np.flatnonzero(size < SEQ)
        sequence[whole] = base + np.arange(len(whole))
        base += len(whole)
        for items in pack(size[rest].tolist()):
            at = rest[items]
            sequence[at], offset[at] = base, np.cumsum(size[at]) - size[at]
            base += 1
        out = table.add_column(5, "sequence_id", pa.array(sequence)).add_column(6, "offset", pa.array(offset))
        yield from out.to_batches()

    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK // 4):
            held.append(batch.slice(lo, BLOCK // 4))
            rests += int((held[-1].column(2).to_numpy() < SEQ).sum())
            if rests >= BLOCK or len(held) >= 16:
                yield from flush()
    if held:
        yield from flush()


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; with_ids adds the piece's token ids, else texts are read but not kept."""
    text_batches(docs.sparkSession)
    path = path or vocabulary()
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    ids = ", ids binary" if with_ids else ""
    pieces = stage(rows.mapInArrow(tokenized(path, same_merges(path), with_ids), PIECES + ids), "pieces")
    packed = pieces.coalesce(max(1, pieces.count() // TASK_PIECES)).mapInArrow(_placed, f"{PIECES}, sequence_id long, offset long{ids}")
    if not with_ids:
        return packed

    @F.pandas_udf("array<int>")
    def numbers(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.frombuffer(x, "<u4").astype(np.int32))

    return packed.withColumn("ids", numbers("ids"))


def op7(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
