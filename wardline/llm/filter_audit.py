"""What filters take from a corpus in every order, from one count for each set of failed filters.

Each document gets a mask of the filters it fails; documents of a part with the same mask are only counted, and so are
those among them that labels call good or toxic. A subset-zeta transform turns a part's 32 counts into the survivors of
every subset of filters: g(T) sums the counts of the masks within T, so the survivors of a subset are g of its complement.
A step of an order is the difference between two neighbouring subsets, for documents and labels alike, so 120 orders
cost as much as one pass over the texts.

Copies are found by SHA-256 of whole texts. Only rows (doc_id, part, mask, digest) move, never texts; the verdict
on a group of copies goes to its rows by `spread_join`, so a group may hold any share of the rows. Counts are added up
within tasks before they move.

Defined results: a null text counts as empty, a null part as the empty string. A copy is a row with a text that a row
with a smaller doc_id has; rows that repeat with the smallest doc_id are no copies of each other, a null doc_id comes after all
others. A document is good or toxic if any of its rows in labels says so; labels of unknown or null ids count for nothing.
Filters are judged on the input, whether a document is removed by an earlier one or not. An empty table has no parts
and gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import SPACE, partnered, spread_join, stage, text_batches

#: Filters by letter, each a bit of the mask, and the bounds of the first three.
LETTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
ORDERS = list(permutations(range(len(LETTERS))))
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails on its own (A to D)."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))[0]
    fails = [
        n["n"] < FEWEST_WORDS,
        n["own"] * 100 < n["n"] * LEAST_DISTINCT,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS,
        text.rlike("[#$%&*|]"),
    ]
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic (0 or 1): one row for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("sha"))
    rows = stage(rows, "masks")
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    groups = stage(rows.groupBy("sha").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    copies = spread_join(rows, groups, ["sha"], "n", few=True).where(~F.col("doc_id").eqNullSafe(F.col("first.id"))).select("doc_id", "part", "mask")
    # the rest are all rows less the copies, as counts: no row has to move to be told that it is alone
    failing = rows.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(copies.select("doc_id", "part", "mask", F.lit(-1).alias("n")))
    failing = failing.unionByName(copies.select("doc_id", "part", F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), F.lit(1).alias("n")))
    said = labels.select(F.col("doc_id").alias("__id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("__id IS NOT NULL AND (good OR toxic)")
    said = stage(said.groupBy("__id").agg(F.max(F.coalesce("good", F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce("toxic", F.lit(False)).cast("int")).alias("toxic")), "labelled")
    lost = failing.where("mask > 0")  # what fails nothing is never lost, so its labels don't matter
    marked = partnered(lost, said, F.col("doc_id") == F.col("__id"), F.xxhash64("doc_id"), F.xxhash64("__id"), "left")
    none = F.lit(None).cast("int")
    return marked.select("part", "mask", "n", "good", "toxic").unionByName(failing.where("mask = 0").select("part", "mask", "n", none.alias("good"), none.alias("toxic")))


def mask_counts(rows: DataFrame) -> DataFrame:
    """One row for each part: n, good, toxic, each an array of 2^5 counts by mask."""
    size = 1 << len(LETTERS)
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    return counts.groupBy("part").agg(*[F.array(*[at(c, m) for m in range(size)]).alias(c) for c in ("n", "good", "toxic")])


def survivors(counts: np.ndarray) -> np.ndarray:
    """(parts, 2^k) counts by mask -> (parts, 2^k) survivors by subset of filters applied: the subset-zeta transform, reversed."""
    inside = counts.copy()
    for bit in range(counts.shape[1].bit_length() - 1):
        pairs = inside.reshape(len(counts), -1, 2, 1 << bit)
        pairs[:, :, 1] += pairs[:, :, 0]
    return inside[:, ::-1]  # the complement of a subset is its mirror image


def steps() -> dict[str, np.ndarray]:
    """For each order and step: the subset before, the subset after, the filter."""
    before = [[sum(1 << f for f in order[:i]) for i in range(len(order))] for order in ORDERS]
    own = np.array(ORDERS)
    before = np.array(before)
    return {"before": before, "after": before | (1 << own), "own": own}


def audit_part(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by mask (parts, 32) -> each measure as (parts, orders, steps)."""
    at, k = steps(), len(LETTERS)
    left, kept = survivors(n), {}
    removed = left[:, at["before"]] - left[:, at["after"]]
    kept["kept"], kept["removed"] = left[:, at["after"]], removed
    failing = np.stack([n[:, [m for m in range(1 << k) if m >> f & 1]].sum(1) for f in range(k)], 1)
    kept["redundant"] = failing[:, at["own"]] - removed
    kept["unique_fails"] = n[:, 1 << at["own"]]
    for name, counts in (("good_lost", good), ("toxic_lost", toxic)):
        alive = survivors(counts)
        kept[name] = alive[:, at["before"]] - alive[:, at["after"]]
    shapley = np.zeros((len(n), k), np.int64)
    for f in range(k):
        for subset in (s for s in range(1 << k) if not s >> f & 1):
            size = subset.bit_count()  # orders in which exactly these filters come before f
            shapley[:, f] += factorial(size) * factorial(k - 1 - size) * (left[:, subset] - left[:, subset | 1 << f])
    kept["shapley"] = shapley[:, at["own"]]
    return kept


def expanded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their counts -> a row for each part, order and step, 64 parts at a time."""
    names, width = ["".join(LETTERS[f] for f in order) for order in ORDERS], len(LETTERS)
    for whole in batches:
        for lo in range(0, whole.num_rows, 64):
            batch = whole.slice(lo, 64)
            parts = batch.column(0).to_pylist()
            n, good, toxic = (np.array(batch.column(i).to_pylist(), np.int64).reshape(len(parts), -1) for i in (1, 2, 3))
            each = len(names) * width
            columns = [np.repeat(np.array(parts, object), each), np.tile(np.repeat(np.array(names, object), width), len(parts)), np.tile(np.arange(1, width + 1, dtype=np.int32), len(parts) * len(names))]
            columns += [x.reshape(-1) for x in audit_part(n, good, toxic).values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:2]] + [pa.array(c) for c in columns[2:]], [x.split()[0] for x in OUT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of each step."""
    text_batches(docs.sparkSession)
    return mask_counts(masks(docs, labels, id_col, text_col, part_col)).mapInArrow(expanded, OUT)


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
flagged AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e FROM worded),
marked AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(q, 0) AS good, coalesce(x, 0) AS toxic
  FROM flagged LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY 1) USING (doc_id)),
letters AS (SELECT chr(65 + i::INT) AS f, (1 << i)::INT AS bit FROM range(5) t(i)),
orders AS (
  SELECT [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits, p.f || q.f || r.f || s.f || t.f AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, (i + 1)::INT AS step, bits[i + 1] AS own, coalesce(list_sum(bits[1:i]), 0)::INT AS before FROM orders, range(5) u(i)),
grouped AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL),
counted AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM grouped, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
