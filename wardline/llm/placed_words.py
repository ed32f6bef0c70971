"""Words of whole Arrow batches: where they are, and hashes that are made for all words of a batch at once.

Most words of a large corpus are in few texts, so a cache of hashes, as in `words`, would mostly be asked for new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from wardline.llm.words import M1, M2, mixed, runs, sliding_min, split, texts

__all__ = ["M1", "Placed", "hashes", "mixed", "placed", "runs", "sliding_min", "spelled", "split", "texts"]

#: Bytes of texts whose words are held as arrays at once (a longer text is held alone); arrays this small stay in a core's cache.
SLICE_BYTES = 1 << 18
#: Bytes that a step of the hash takes in, and the longest word that is hashed in such steps.
STEP, LONGEST = 8, 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def spelled(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes and their number alone. Words are given by their bytes, one after another, and by their ends."""
    size = np.diff(ends, prepend=0)
    begin = ends - size
    padded = np.append(letters, np.zeros(STEP, np.uint8))
    eight = np.ndarray(len(letters) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    out = size.astype(np.uint64) * M2
    at = np.flatnonzero(size <= LONGEST)
    done = 0
    while len(at):
        rest = np.minimum(size[at] - done, STEP).astype(np.uint64)
        value = eight[begin[at] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - rest * np.uint64(8)))
        out[at] = mixed(out[at] + value)
        done += STEP
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(letters[begin[i] : ends[i]])
    return out


def hashes(own: list[bytes]) -> np.ndarray:
    """The same for words in a list."""
    return spelled(np.frombuffer(b"".join(own), np.uint8), np.cumsum([len(w) for w in own], dtype=np.int64))


class Placed(NamedTuple):
    """Words of consecutive texts: their bytes without white space, where each word ends in them, and the number of words before each text and in all."""

    letters: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return spelled(self.letters, self.ends)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words with one space after each, and where these spaces are."""
        spaces = self.ends + np.arange(len(self.ends))
        out = np.full(len(self.letters) + len(self.ends), 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[spaces] = False
        out[inside] = self.letters
        return out, spaces


def placed(column: pa.Array) -> Iterator[tuple[int, Placed]]:
    """Words of a column of texts (null: none), a slice of rows at a time, with the number of the slice's first row."""
    column = column.cast(pa.binary())
    column = column.fill_null(b"") if column.null_count else column
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < rows:
        after = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        own, begin = data[offsets[row] : offsets[after]], offsets[row : after + 1] - offsets[row]
        inside = ~_SPACE[own]
        apart = np.ones(len(own) + 1, bool)  # whether a byte is not of the same word as the one before
        apart[1:-1] = ~inside[:-1]
        apart[begin] = True
        first = np.flatnonzero(inside & apart[:-1])
        apart[:-1] |= ~inside
        end = np.flatnonzero(inside & apart[1:]) + 1
        yield row, Placed(own[inside], np.cumsum(end - first), np.searchsorted(first, begin))
        row = after
