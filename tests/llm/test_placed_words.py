"""Words of whole batches, as substring dedup takes them, against bytes.split()."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import placed_words as words, substring_dedup

TEXTS = [None, "", " \t\n\x0b\x0c\r", "a", " a  b\tc ", "é 東京 🙂 x", "x" * 64 + " " + "x" * 65 + " " + "x" * 5000, "abcdefgh abcdefghi abcdefg", None, "\x00 \x00\x00 a\x00", "end "]


@pytest.mark.parametrize("slice_bytes", [1, 20, 1 << 18])
def test_words_of_a_batch(monkeypatch, slice_bytes):
    monkeypatch.setattr(words, "SLICE_BYTES", slice_bytes)
    for column in (pa.array(TEXTS), pa.array(["before", *TEXTS, "after"]).slice(1, len(TEXTS)), pa.array(TEXTS, pa.large_string()), pa.array([], pa.string())):
        got, hashes = [], []
        for row, own in words.placed(column):
            assert row == len(got)
            joined, spaces = own.joined()
            every, begin = joined.tobytes(), [0, *(spaces + 1).tolist()]
            assert every.count(b" ") == len(spaces)
            got += [[every[begin[k] : begin[k + 1] - 1] for k in range(a, b)] for a, b in zip(own.bounds[:-1], own.bounds[1:], strict=True)]
            hashes += own.hashes().tolist()
        want = [(t or "").encode().split() for t in column.to_pylist()]
        assert got == want
        flat = [w for t in want for w in t]
        assert hashes == words.hashes(flat).tolist() == [words.hashes([w])[0] for w in flat]
        assert len(set(hashes)) == len(set(flat))


def test_phrases_of_a_batch_stay_within_texts(monkeypatch):
    """Each text has the phrases that it has alone, whatever stands beside it; a phrase that repeats in it is listed once."""
    rng = np.random.default_rng(5)
    texts = ["  ".join(f"w{rng.integers(30)}" for _ in range(n)) for n in (49, 50, 51, 400, 0, 3, 90)] + ["a " * 200, None, "b " * 55]

    def anchors(rows, slice_bytes):
        monkeypatch.setattr(words, "SLICE_BYTES", slice_bytes)
        batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([0] * len(rows)), pa.array([texts[i] for i in rows], pa.string())], ["id", "part", "text"])
        return sorted((r["id"], r["phrase"]) for r in pa.Table.from_batches(substring_dedup._anchors([batch])).to_pylist())

    want = []
    for i, text in enumerate(texts):
        own = (text or "").encode().split()
        g, least = substring_dedup.chosen(words.hashes(own))
        want += {(i, b" ".join(own[p : p + substring_dedup.PHRASE])) for p in np.flatnonzero(np.isin(g, least)).tolist()}
    assert anchors(list(range(len(texts))), 1 << 18) == anchors(list(range(len(texts))), 1) == sorted(want)
    assert {i for i, _ in want} == {1, 2, 3, 6, 7, 9}


def test_digests_of_cut_texts():
    own = [f"w{i}" for i in range(10)]
    cuts = [None, [(0, 3)], [(2, 4), (7, 10)], [(0, 10)]]
    ranges = [None if c is None else np.array(c, np.int32).tobytes() for c in cuts]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([" \t ".join(own)] * 4), pa.array(ranges, pa.binary())], ["doc_id", "text", "ranges"])
    for row, cut in zip(pa.Table.from_batches(substring_dedup._digest([batch])).to_pylist(), cuts, strict=True):
        kept = [w for i, w in enumerate(own) if not any(a <= i < b for a, b in cut or [])]
        assert row == {"doc_id": row["doc_id"], "n_words": 10, "n_removed": 10 - len(kept), "kept_sha256": hashlib.sha256(" ".join(kept).encode()).hexdigest()}


def test_anchors_take_no_steps_for_each_word():
    """Listing phrases costs a few times what splitting the texts does, also if most words are new."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**7, 600)) for _ in range(256)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array([0] * 256), pa.array(texts)], ["id", "part", "text"])

    def least(run):
        taken = []
        for _ in range(7):
            start = time.process_time()
            run()
            taken.append(time.process_time() - start)
        return min(taken)

    assert least(lambda: list(substring_dedup._anchors([batch]))) < 6 * least(lambda: [t.encode().split() for t in texts])
