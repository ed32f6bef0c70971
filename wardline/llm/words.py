"""Hashes of words and of runs of words, for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Different words that a worker keeps the hash of.
CACHE_WORDS = 200_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Known()


def split(text: bytes | None) -> list[bytes]:
    """Words: what bytes.split() separates is exactly ASCII white space."""
    return text.split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > CACHE_WORDS:
        _known.clear()
    out = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words (none if there are fewer), sensitive to their order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = h[:n] + np.uint64(k)
    for j in range(1, k):
        x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * M1 + h[j : j + n]
    return mixed(x)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width`, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of sorted batches, cut such that no group of equal values in the first `keys` integer columns is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in range(keys):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            change |= x[1:] != x[:-1]
        if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups of equal keys begin, and the number of rows."""
    n = table.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for c in range(keys):
        x = table.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), n)
