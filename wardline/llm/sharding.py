"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. n-1 in the order of doc_id (ties by size, then checksum). A balanced Feistel network
over the smallest even number of bits that holds n permutes numbers; a value of n or more is sent through
again until it falls below n (cycle walking), which keeps the map a permutation of 0 .. n-1. The permuted
place p gives shard p mod k and slot p div k, so anyone who knows n, k and the seed can compute the place of
a row. Shards differ by at most one row: law `rows`. Groups of equal texts are not kept together, since a
group may hold a third of all rows, which that law excludes.

Defined results: null text has no bytes (size 8, checksum 0); null doc_id comes last; rows that repeat in
doc_id, size and checksum are interchangeable, and are spread over ranges by their place in the input; an empty table
gives no rows; `write_shards` keeps all columns, and names its own shard_2 or slot_2 if those names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import free_name, number_rows

SHARDS, SEED, ROUNDS = 24, 20_240, 6
#: Multipliers and additive keys stay small enough for signed 64-bit products in any SQL engine.
LOW = (1 << 20) - 1


def round_keys(seed: int = SEED) -> list[tuple[int, int]]:
    """An odd multiplier below 2^21 and a key below 2^30 for each round, by a linear congruence from the seed."""
    keys, x = [], seed
    for _ in range(ROUNDS):
        x = (x * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) & ((1 << 64) - 1)
        keys.append(((x >> 40) & ((1 << 21) - 1) | 1, (x >> 8) & ((1 << 30) - 1)))
    return keys


def half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def mixed(r, a: int, b: int, mask: int):
    """The round function, on Python or numpy integers below 2^20."""
    t = r * a + b
    t = t ^ (t >> 11)
    t = (t & LOW) * 40_503 + (t >> 17)
    return (t >> 5) & mask


def permuted(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The place of each number; cycle walking repeats the network for values outside 0 .. n-1."""
    half, out = half_bits(n), numbers.astype(np.int64)
    mask, todo = (1 << half) - 1, np.arange(len(numbers))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for a, b in round_keys(seed):
            left, right = right, left ^ mixed(right, a, b, mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out


def with_shards(numbered: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED, number: str = "row_number") -> DataFrame:
    """Adds shard and slot to rows that carry their global number."""

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(permuted(x.to_numpy(), n, seed))

    placed = numbered.withColumn("__place", place(F.col(number)))
    return placed.withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"__place div {shards}")).drop("__place")


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot: the texts themselves are not moved."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + F.lit(8)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = narrow.withColumn("place", F.monotonically_increasing_id())
    numbered = number_rows(placed, F.asc_nulls_last("doc_id"), F.asc("size"), F.asc("text_crc32"), F.asc("place")).drop("place")
    return with_shards(numbered, docs.count(), shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id") -> None:
    """Write docs as one folder for each shard, rows within a file in slot order; one shuffle carries whole rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs can clash with ours
    numbered = number_rows(docs.select(row, F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place")), F.asc_nulls_last("id"), F.asc("place"))
    rows = with_shards(numbered, docs.count(), shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    rows.select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot)).write.partitionBy(shard).parquet(path)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc32_sql() -> str:
    """CRC-32 over the UTF-8 bytes, four bits at a time: DuckDB has no such function of its own."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    half = lambda c, v: f"xor({c} >> 4, list_extract({table}::BIGINT[], (xor({c}, {v}) & 15) + 1))"
    first = half("c", "b")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: {half(f'({first})', '(b >> 4)')}), 4294967295)"


def _network_sql(x: str, half: str) -> str:
    """The Feistel network as nested SELECTs over a table that has x, n and the number of half bits."""
    mask = f"((1::BIGINT << {half}) - 1)"
    inner = f"SELECT *, {x} >> {half} AS l, {x} & {mask} AS r FROM walk WHERE step = 0 OR x >= n"
    for a, b in round_keys():
        t = f"SELECT * EXCLUDE (l, r), l AS l0, r AS r0, r * {a} + {b} AS t FROM ({inner})"
        t = f"SELECT *, xor(t, t >> 11) AS u FROM ({t})"
        inner = f"SELECT * EXCLUDE (l0, r0, t, u), r0 AS l, xor(l0, ((((u & {LOW}) * 40503 + (u >> 17)) >> 5) & {mask})) AS r FROM ({t})"
    return f"SELECT * EXCLUDE (l, r, {x}), (l << {half}) | r AS {x} FROM ({inner})"


OP10_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
summed AS (SELECT doc_id, size, {_crc32_sql()} AS text_crc32 FROM sized),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM summed),
walk AS (
  SELECT number, number AS x, n, greatest(1, (ceil(log2(greatest(n, 2)))::BIGINT + 1) // 2) AS half, 0 AS step FROM numbered
  UNION ALL
  SELECT number, x, n, half, step + 1 AS step FROM ({_network_sql("x", "half")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INT AS shard, x // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM numbered JOIN (SELECT number, x FROM walk WHERE step > 0 AND x < n) USING (number)
"""
