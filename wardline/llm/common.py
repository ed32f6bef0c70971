"""Shared helpers of the training-data operators: patterns, joins that bound what moves, batches of texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from wardline.sources.staging import number_rows, passing, shared_dir, stage

__all__ = ["SPACE", "WORD", "bit_at", "bitmaps", "free_name", "number_rows", "partnered", "passing", "prefix_sums", "shared_dir", "sized", "spread_join", "stage", "text_batches"]

#: Words are maximal runs of anything but ASCII white space (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A side is broadcast only if its rows, measured with their strings and lists, stay below this; what any row takes besides.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 64
#: Rows in one Arrow batch of texts handed to Python; bounds a worker's memory.
TEXT_BATCH_ROWS = 256
#: Groups of more than one in HOT rows number HOT at most, so that they can be broadcast.
HOT = 65_536
#: Filters are rows of dense bits, of 4 kB each. The most memory that is broadcast of a Bloom filter, its bits for each key, and the
#: bits that a key sets.
FILTER_BITS, FILTER_ROW_BYTES, FILTER_BYTES, BITS_PER_KEY, PROBES = 1 << 15, (1 << 12) + 64, 512 << 20, 16, 4


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of texts that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name_2, name_3, ... if docs has such a column already."""
    taken, out, i = {c.lower() for c in docs.columns}, name, 1
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        add = lambda total, x: total + _width(x, kind.elementType)
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), add), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a staged table may be broadcast, as measured: its rows are counted first and, if few, read for the widths of what varies."""
    limit = BROADCAST_BYTES if limit is None else limit
    least = df.count() * (ROW_BYTES + 8 * len(df.columns))
    if least > limit or all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema):
        return least <= limit
    widths = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES).cast("long"))
    return (df.agg(F.sum(widths)).first()[0] or 0) <= limit


def sized(df: DataFrame) -> DataFrame:
    """Mark a staged table for broadcasting if its measured size is small; otherwise leave it to a shuffled join."""
    return F.broadcast(df) if fits(df) else df


def bitmaps(keys: DataFrame, at: Column) -> DataFrame:
    """Staged (row, bits) of a filter: keys have the number of their row, and `at` gives the positions in it that they set."""
    return stage(keys.repartition("row").select("row", at.alias("at")).groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")), "filter")


def bit_at(bits: Column, at: Column) -> Column:
    """Whether the bit at a position is set; false without bits."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def flagged(rows: DataFrame, row_hash: Column, side: DataFrame, side_hash: Column) -> DataFrame:
    """rows with __may: whether they may have a partner in a staged side, by a broadcast Bloom filter.

    The filter grows with the keys, BITS_PER_KEY bits for each, and lets one stranger in some 400 through, up to FILTER_BYTES:
    268 million keys. Beyond that it has fewer bits for a key (one stranger in six is let through at a billion keys). What it
    lets through is decided by a join, so nothing is lost.
    """
    size = max(1, -(-min(side.count() * BITS_PER_KEY, FILTER_BYTES * 8) // FILTER_BITS))
    places = lambda h: [F.shiftright(F.xxhash64(h, F.lit(11)), 15 * i).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in range(PROBES)]
    keys = side.select(side_hash.alias("h")).distinct().withColumn("row", F.pmod("h", F.lit(size)))
    filled = bitmaps(keys, F.explode(F.array(*places(F.col("h"))))).withColumnsRenamed({"row": "__word", "bits": "__bits"})
    found = rows.withColumn("__h", row_hash).withColumn("__w", F.pmod("__h", F.lit(size)))
    found = found.join(F.broadcast(filled), F.col("__w") == F.col("__word"), "left")  # FILTER_BYTES at most
    may = reduce(lambda a, b: a & b, [bit_at(F.col("__bits"), at) for at in places(F.col("__h"))])
    return found.withColumn("__may", may).drop("__h", "__w", "__word", "__bits")


def partnered(rows: DataFrame, side: DataFrame, on: Column, row_hash: Column, side_hash: Column, how: str = "inner") -> DataFrame:
    """rows (wide, with texts) joined with a staged side: inner, left or left_anti.

    A side that is small as measured is broadcast. Otherwise only rows that may have a partner (`flagged`) shuffle; the
    rest are decided where they are.
    """
    if fits(side):
        return rows.join(F.broadcast(side), on, how)
    found = flagged(rows, row_hash, side, side_hash)
    joined = found.where("__may").drop("__may").join(side, on, how)
    if how == "inner":
        return joined
    return joined.unionByName(found.where("not __may").drop("__may"), allowMissingColumns=True)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, few: bool = False) -> DataFrame:
    """Staged rows joined with one staged row for each of their groups, whose `size` counts the group's rows.

    few: most rows have no group, so those that may have one are told apart first (`flagged`).

    Groups that are small as measured are broadcast. Otherwise the groups of more than one in HOT rows, HOT at most,
    are broadcast and their rows stay where they are; no key of the shuffled rest has more than one in HOT rows.
    """
    if fits(groups):
        return rows.join(F.broadcast(groups), keys)
    if few:
        rows = flagged(rows, F.xxhash64(*keys), groups, F.xxhash64(*keys)).where("__may").drop("__may")
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(size).cast("long") * HOT > total))
    cold = groups.where(F.col(size).cast("long") * HOT <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each new name -> column, the sum of that column over the rows before, in an order without ties.

    Rows are dealt by range and sorted within ranges; one row for each range is ever gathered.
    """
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    totals = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), "__part")  # one row for each range
    out = joined.select("*", *[(F.col(f"__{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in sums.items()])
    return out.drop("__at", "__part", *[f"__{name}" for name in sums])
