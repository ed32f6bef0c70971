"""Packing against plain tokenizing and the rules of the layout."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import packing


def brute(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}


def check(rows, docs):
    ids, seqs = brute(docs), {}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQ
    return len(seqs)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.op7(spark, sf).collect()
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    n = check(rows, plain)
    assert sum(r.length for r in rows) > 0.98 * packing.SEQ * (n - 4)


def test_fill_with_many_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(64)
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows) > 0.98 * packing.SEQ * len({r.sequence_id for r in rows})


def test_engines_agree(spark):
    """The faster engine is used where its merges are shown to be the tokenizer's, and not where they aren't."""
    path = packing.vocabulary()
    assert packing.same_merges(path)
    rng = np.random.default_rng(9)
    own, tokenizer = packing.Ids(path, True), Tokenizer.from_file(path)
    texts = ["".join(chr(int(c)) for c in rng.integers(32, 127, int(rng.integers(1, 60)))) for _ in range(2000)]
    texts += ["".join(chr(int(c)) for c in rng.integers(0xA1, 0x250, int(rng.integers(1, 40)))) for _ in range(2000)]
    texts += [" ".join(own.tokenizer.decode(rng.integers(0, 50_000, 30).tolist()).split()) for _ in range(500)]
    texts += ["".join(rng.choice(list("abeinrst'é東 \n\x1c\x85"), int(rng.integers(1, 40)))) for _ in range(2000)]
    assert own.batch(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_merges_that_differ(monkeypatch):
    ids = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5}
    for last, same in (((b"a", b"bc"), True), ((b"ab", b"c"), False)):
        monkeypatch.setattr(packing, "byte_tokens", lambda path, last=last: (ids, {b"bc": (b"b", b"c"), b"ab": (b"a", b"b"), b"abc": last}))
        assert packing.same_merges.__wrapped__("") == same


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "a  b \n c d 　e "), (4, "x" * 9000), (5, "<|endoftext|> y z<|endoftext|>"), (6, "it's  'll\t\r\n"), (None, "z")]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1)).coalesce(1), with_ids=True).collect()
    check(rows, docs)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string")
    assert len(packing.pack_documents(twice).collect()) == 3


def test_differencing():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (5, 3), (40, 7), (200, 60)):
        sizes = rng.integers(1, 500, n).tolist()
        dealt = packing.difference(sizes, m)
        assert sorted(i for x in dealt for i in x) == list(range(n)) and len(dealt) <= m
    assert packing.pack([]) == []
    assert max(sum(x) for x in packing.pack([2000, 2000, 100, 100])) <= packing.SEQ
