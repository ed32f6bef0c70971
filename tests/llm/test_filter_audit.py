"""The audit of filters against plain loops over every order."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in first and (d is None or d > first[t])}
        said = [x for x in labels if x[0] == d and d is not None]
        rows.append((s or "", fails, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                redundant = sum(r[1][f] for r in own) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def case(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "  \t", " ".join(f"w{i}" for i in range(200)), "a " * 300, "ABC def", "x # y", " ".join(f"W{i}" for i in range(250)), " ".join(f"v{i}$" for i in range(220)), "\x0b" + " ".join(["p q"] * 200)]
    docs = [(rng.choice([None, rng.randrange(n)]) if rng.random() < 0.1 else rng.randrange(n), rng.choice(texts), rng.choice(["s1", "s2", "", None])) for _ in range(n)]
    labels = [(rng.choice([None, rng.randrange(n)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit(3)).withColumn("good", F.lit("x"))
    rows = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(""))).collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def test_against_loops(spark, monkeypatch):
    for seed in (1, 2):
        docs, labels = case(120, seed)
        assert run(spark, docs, labels) == brute(docs, labels)
    from wardline.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)  # beyond what is broadcast
    assert run(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    assert run(spark, [], []) == {}
    one = run(spark, [(5, "a b", "s")], [(5, 1, 0), (5, 0, 1)])
    assert len(one) == 600 and one["s", "ABCDE", 1] == (0, 1, 0, 1, 1, 1, 120) and one["s", "EDCBA", 5][:2] == (0, 1)
    same = run(spark, [(1, "#", "s"), (1, "#", "s"), (2, "#", "t")], [])
    assert same["s", "EABCD", 1][:2] == (2, 0) and same["t", "EABCD", 1][:2] == (0, 1)


def test_survivors_are_subset_sums():
    counts = np.random.default_rng(3).integers(0, 9, (4, 32))
    got = filter_audit.survivors(counts)
    assert all(got[p, s] == sum(counts[p, m] for m in range(32) if not m & s) for p in range(4) for s in range(32))
