"""Alignment of two tokenizers against plain loops."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import alignment, packing

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def placed(ids, token):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(token(i)), i))
        at = out[-1][1]
    return out


def brute(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {i: t for t, i in packing.byte_tokens(public_tokenizers.path("byte_bpe_50k.json"))[0].items()}

    def piece(i):
        own = re.fullmatch("<0x(..)>", pieces.id_to_piece(i))
        return bytes([int(own[1], 16)]) if own else pieces.id_to_piece(i).replace("▁", " ").encode()

    docs, count = [], Counter()
    for d, t in rows:
        a = tokenizer.encode(f" {t}", add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        if t and not b"".join(map(known.__getitem__, a)) == b"".join(map(piece, b)) == f" {t}".encode():
            a = b = []
        a, b = placed(a, known.__getitem__), placed(b, piece)
        links, j = [], 0
        for lo, hi, i in a:
            while b[j][1] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][0] < hi:
                links.append((i, b[k][2]))
                k += 1
        cuts, groups = sorted({x[1] for x in a} & {x[1] for x in b}), []
        rest = [list(reversed(a)), list(reversed(b))]
        for hi in cuts:
            sides = [[], []]
            for side, left in zip(sides, rest, strict=True):
                while left and left[-1][1] <= hi:
                    side.append(str(left.pop()[2]))
            groups.append("|".join(map(",".join, sides)))
        docs.append((d, len(a), len(b), len(cuts), links, ";".join(groups)))
        count.update(set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(repr((d, na, nb, ng, len(x), hashlib.sha256(g.encode()).hexdigest() if na else "", sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x))) for d, na, nb, ng, x, g in docs)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b \n c d 　e "), (5, "x" * 900), (6, "<|endoftext|> y z<|endoftext|> </s> <s>a"), (7, "a▁b c"), (8, "  lead"), (9, "é ﬁ ½ ａｂ"), (10, "日本 語 \U0001f600 ë \x00 q"),
    (None, "z z"), (11, "tab\there \r\n x\x1c y\x85 z"), (12, " ̈a ̈"), (13, "� ​ ퟿"), (14, "it's don't"), (14, "it's don't"), (15, "trailing "), (16, "one"), (17, "▁"), (18, "\t"),
]


def run(df, **options):
    rows = alignment.alignment(df.withColumn("codes", F.lit(1)).withColumn("at", F.lit("x")), **options).collect()
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in rows)


def test_whole_table_and_odd_texts(spark, sf):
    """The same whether all counts are broadcast, some or none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for hot in (alignment.HOT_PAIRS, 500, 0):
        assert run(docs.repartition(5), hot_pairs=hot) == want
    assert run(docs.where("false")) == []


def test_caches_and_partial_sums(spark, monkeypatch):
    """Small caches and early sums change nothing."""
    import numpy as np
    import pyarrow as pa

    path = alignment.path_of(alignment.A_FILE)
    texts = [t for _, t in ODD] * 3
    own = alignment.Aligner(path, alignment.path_of(alignment.B_FILE), True)
    want = own.batch(texts)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 2)
    assert [own.batch([t])[0] for t in texts] == want
    monkeypatch.setattr(alignment, "HELD_CODES", 8)

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 3

    monkeypatch.setattr(alignment, "TaskContext", Context)
    data = [r[5] for r in want if r[5]]
    total = Counter()
    for out in alignment.partial_counts([pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["codes"])]):
        for code, n in zip(out.column("code").to_pylist(), out.column("n").to_pylist(), strict=True):
            total[code] += n
    assert total == Counter(int(c) for d in data for c in np.frombuffer(d, "<u4"))
