"""Exact top-k inner products by vector-approximation files.

1. Vectors become integers, floor(256 x). Of equal vectors only the K + 1 smallest ids can be among the best, as they tie.
2. Each vector is divided by its greatest component's size, its scale. Each dimension's range of what is left is cut into
   CELLS equal cells; a vector's approximation is its scale and its cell numbers, a byte for each dimension. The middle
   of the cells gives the product but for an error that is the scale times what depends on the query alone. So a vector of
   unusual size makes its own bounds wide and no other's.
3. Queries (a stated set) are held against all approximations in blocks. A block passes on each query's candidates
   whose upper bound reaches the block's K-th greatest lower bound; then the K-th greatest lower bound of all blocks
   rules out more.
4. Exact vectors are read in the order of upper bounds: the FIRST of each query, whose K-th product settles which others
   can still matter, then those. Only such pairs ever meet a whole vector.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
without vec_id; vectors of different lengths never meet; rows that share a vec_id are one query (the least
vector), all of them are candidates to others and none to themselves; ties go to the smaller vec_id; an empty
table gives no rows; extra columns don't matter. Scores must fit 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from wardline.llm import words
from wardline.llm.common import stage

K, EVERY, SCALE = 5, 50, 256
CELLS, FIRST, QUERY_BLOCK, ROW_BLOCK, STEP = 256, 16, 1024, 16_384, 64


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the integer vector, of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.withColumn("v", v).where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scales of vectors, and the vectors divided by them (within -1 and 1)."""
    scale = np.maximum(1, np.abs(x).max(axis=1))
    return scale, x / scale[:, None]


def ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the least scaled component of each dimension and the width of its cells."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                u = scaled(x)[1]
                low, high = held.get(d, (u[0], u[0]))
                held[d] = np.minimum(low, u.min(axis=0)), np.maximum(high, u.max(axis=0))
        for d, (low, high) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(low), pa.array(high)], ["d", "dim", "low", "high"])

    found = vectors.select("v").mapInArrow(local, "d long, dim long, low double, high double")
    table = found.groupBy("d", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d", "dim").toArrow()  # as long as a vector
    d, low, high = (table.column(c).to_numpy() for c in ("d", "low", "high"))
    return {int(k): (low[d == k], np.maximum(2.0**-40, (high[d == k] - low[d == k]) / CELLS)) for k in np.unique(d)}


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a list column by length: the length, their places and their values."""
    flat, length = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    begin = np.cumsum(length) - length
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        yield d, at, flat[begin[at][:, None] + np.arange(d)]


def approximations(vectors: DataFrame, grid: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rid, vec_id, d, scale and cells (a byte for each dimension) of (rid, vec_id, v)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, scales, near = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, object)
            for d, at, x in by_length(batch.column(2)):
                low, width = grid[d]
                scale, u = scaled(x)
                cells = np.clip((u - low) // width, 0, CELLS - 1).astype(np.uint8)
                length[at], scales[at] = d, scale
                near[at] = [row.tobytes() for row in cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), pa.array(scales), pa.array(near, pa.binary())], ["rid", "vec_id", "d", "scale", "cells"])

    return vectors.select("rid", "vec_id", "v").mapInArrow(run, "rid long, vec_id long, d long, scale long, cells binary")


def candidates(query: np.ndarray, q_ids: np.ndarray, near: np.ndarray, scale: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For some queries at a time: their ids, the rows that can be among the K best, and bounds of the products below and above."""
    middle, d = (low + (near + 0.5) * width) * scale[:, None], len(low)
    for lo in range(0, len(query), STEP):
        q, own = query[lo : lo + STEP].astype(float), q_ids[lo : lo + STEP]
        size = np.abs(q)
        error = size @ (width / 2.0) + size.sum(axis=1) * (d + 8) * 2.0**-49  # cells; rounding of cells, middles and sums
        s, far = q @ middle.T, error[:, None] * scale[None, :]
        same = own[:, None] == ids[None, :]
        below = np.where(same, -np.inf, s - far)
        least = np.full(len(q), -np.inf) if s.shape[1] <= K else np.partition(below, s.shape[1] - K, axis=1)[:, s.shape[1] - K]
        i, row = np.nonzero((s + far >= least[:, None]) & ~same)
        yield own[i], row, below[i, row], s[i, row] + far[i, row]


FOUND = "query_id long, rid long, vec_id long, below double, above double"


def scanned(asked: DataFrame, near: DataFrame, grid: dict[int, tuple[np.ndarray, np.ndarray]], n: int, m: int) -> DataFrame:
    """Staged candidates of all queries, from a grid of blocks of queries (vec_id, v) and of approximations."""
    q_blocks, r_blocks = -(-m // QUERY_BLOCK), max(1, -(-n // ROW_BLOCK))
    own_q, own_r = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)), F.pmod(F.xxhash64("rid"), F.lit(r_blocks))
    none = lambda kind: F.lit(None).cast(kind)
    q = asked.select(F.size("v").cast("long").alias("d"), F.explode(F.sequence(own_q * r_blocks, own_q * r_blocks + r_blocks - 1)).alias("cell"), none("long").alias("rid"), "vec_id", "v", none("binary").alias("cells"), none("long").alias("scale"))
    r = near.select("d", F.explode(F.sequence(own_r, own_r + (q_blocks - 1) * r_blocks, F.lit(r_blocks))).alias("cell"), "rid", "vec_id", none("array<long>").alias("v"), "cells", "scale")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.grouped(batches, 2):
            at = words.bounds(table, 2)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                group = table.slice(lo, hi - lo)
                rows, asks = group.filter(group.column(5).is_valid()), group.filter(group.column(4).is_valid())
                if not rows.num_rows or not asks.num_rows:
                    continue
                d = group.column(0)[0].as_py()
                low, width = grid[d]
                cells = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(-1, d)
                query = np.concatenate([c.flatten().to_numpy() for c in asks.column(4).chunks]).reshape(-1, d)
                rids, ids = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                for q_id, row, below, above in candidates(query, asks.column(3).to_numpy(), cells, rows.column(6).to_numpy(), ids, low, width):
                    yield pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(rids[row]), pa.array(ids[row]), pa.array(below), pa.array(above)], ["query_id", "rid", "vec_id", "below", "above"])

    dealt = q.unionByName(r).repartition("d", "cell").sortWithinPartitions("d", "cell")
    return stage(dealt.mapInArrow(run, FOUND), "candidates")


def top_k(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score from staged integer vectors (vec_id, v)."""
    rank = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    kth = lambda rows, bound, name: rows.withColumn("place", rank(F.desc(bound))).where(F.col("place") <= K).groupBy("query_id").agg(F.max(F.when(F.col("place") == K, F.col(bound))).alias(name))
    asked = stage(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    different = stage(vectors.withColumn("copy", copy).where(F.col("copy") <= K + 1).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"), "different")
    grid = ranges(vectors)
    found = scanned(asked, approximations(different, grid), grid, different.count(), max(1, asked.count()))
    open_ = found.join(kth(found, "below", "sure"), "query_id").where("sure is null or above >= sure")
    open_ = stage(open_.select("query_id", "rid", "vec_id", "above", rank(F.desc("above"), "rid").alias("turn")), "open")

    def read(pairs: DataFrame) -> DataFrame:
        """Exact products of pairs: whole vectors are looked up for these alone."""
        both = pairs.join(different.select("rid", "v"), "rid").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
        return both.select("query_id", "vec_id", product.alias("score"))

    first = stage(read(open_.where(F.col("turn") <= FIRST)), "first")
    later = open_.where(F.col("turn") > FIRST).join(kth(first, "score", "settled"), "query_id").where(F.col("above") >= F.col("settled"))
    products = first.unionByName(read(later.select("query_id", "rid", "vec_id")))
    best = products.withColumn("rank", rank(F.desc("score"), "vec_id")).where(F.col("rank") <= K)
    return best.select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = stage(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP6_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
