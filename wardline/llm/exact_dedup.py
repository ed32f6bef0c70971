"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Pass 1 reads the texts once and stages a narrow digest (doc_id, 64-bit hash, SHA-256). Each hash falls on one cell of a
counting filter of CELLS_PER_ROW cells for each row of the table; counts are added up within tasks first, so what
moves is at most one (cell, count) pair for each row and task, whatever the copies, and never a digest. Cells hit twice
or more are kept as dense bits. Pass 2 tests every digest with a look-up of its bit: a row whose cell was hit
once is certainly unique and passes from there as a group of one. Only the others, repeated rows and about one unique
row in CELLS_PER_ROW, shuffle by SHA-256, which decides. No more than FILTER_BYTES of the bits are broadcast at a time, 134 million
rows' worth: a larger table takes its cells in turns, each of which reads the digests of its own range (they are sorted by cell
where they are) and meets its own bits, so that at no size does a digest of a unique row shuffle.

A group of copies, however large, is added up within tasks, and its verdict goes to its rows by `spread_join`.

Defined results: null text counts as empty; empty texts are equal to each other. A null doc_id comes after
all others, and keep_id is null only if a group has no other id. Rows that repeat with the same doc_id and
text are all marked kept by `verdicts`, and reduced to one row by `exact_dedup`. Empty tables give empty
results. Extra columns are carried along by `exact_dedup` and ignored by `verdicts`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import FILTER_BITS, FILTER_ROW_BYTES, SPACE, bit_at, bitmaps, partnered, spread_join, stage

#: Cells of the filter for each row of the table; the most that is broadcast of its bits in one turn.
CELLS_PER_ROW, FILTER_BYTES = 16, 256 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (64 bits) and SHA-256 of the normalised text, staged."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return stage(norm.select("doc_id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "digests")


def placed(rows: DataFrame, cells: int) -> DataFrame:
    """rows with the cell of their hash, the row of the filter that has its bit, and the bit's position there."""
    cell = rows.withColumn("cell", F.pmod("h", F.lit(cells)))
    return cell.withColumn("row", F.floor(F.col("cell") / FILTER_BITS)).withColumn("at", F.pmod("cell", F.lit(FILTER_BITS)))


def again(rows: DataFrame, cells: int) -> DataFrame:
    """Pass 1: the filter's staged rows (row, bits), with a bit for each cell hit twice or more."""
    counts = placed(rows, cells).groupBy("row", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bitmaps(counts, F.col("at"))


def tested(rows: DataFrame) -> DataFrame:
    """Pass 2: staged rows with `maybe`, false where the hash is certainly unique."""
    cells = max(1, rows.count() * CELLS_PER_ROW)
    bits, at_once = again(rows, cells), max(1, FILTER_BYTES // FILTER_ROW_BYTES) * FILTER_BITS

    def looked_up(some: DataFrame, own: DataFrame) -> DataFrame:
        hit = some.join(F.broadcast(own), "row", "left")  # FILTER_BYTES at most
        return hit.select(*rows.columns, bit_at(F.col("bits"), F.col("at")).alias("maybe"))

    every = placed(rows, cells)
    if cells <= at_once:
        return looked_up(every, bits)
    every = stage(every.sortWithinPartitions("cell"), "by_cell")
    turn = lambda df, column, a, b: df.where((F.col(column) >= a) & (F.col(column) < b))
    turns = [(a, a + at_once) for a in range(0, cells, at_once)]
    return reduce(DataFrame.unionByName, [stage(looked_up(turn(every, "cell", a, b), turn(bits, "row", a // FILTER_BITS, b // FILTER_BITS)), "turn") for a, b in turns])


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, sha."""
    rows = tested(digests(docs, id_col, text_col))
    suspects, alone = stage(rows.where("maybe").drop("maybe", "h"), "suspects"), rows.where(~F.col("maybe"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id")))
    groups = stage(suspects.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    in_groups = spread_join(suspects, groups, ["sha"], "group_size").select("doc_id", F.col("first.id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("first.id")).alias("kept"), "sha")
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha").unionByName(in_groups)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept; the smallest doc_id stays.

    Only groups of two or more need a verdict; documents of their own pass without a shuffle of texts.
    """
    found = stage(verdicts(docs, id_col, text_col).where("group_size > 1"), "verdicts")
    per_row = stage(found.groupBy("sha", "doc_id").agg(F.first("kept").alias("__kept"), (F.count(F.lit(1)) > 1).alias("__again")), "per_row")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs can clash with ours
    keyed = docs.select(row, F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"), F.col(id_col).alias("id"))
    marks = per_row.select(F.col("sha").alias("sha2"), F.col("doc_id").alias("id2"), "__kept", "__again")
    same = (F.col("sha") == F.col("sha2")) & F.col("id").eqNullSafe(F.col("id2"))
    seen = partnered(keyed, marks, same, F.xxhash64("sha", "id"), F.xxhash64("sha2", "id2"), "left").where(F.coalesce("__kept", F.lit(True)))
    if per_row.where("__kept and __again").isEmpty():
        return seen.select("row.*")
    again = seen.where("__again").dropDuplicates(["sha", "id"])
    return seen.where(~F.coalesce("__again", F.lit(False))).select("row.*").unionByName(again.select("row.*"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(docs).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
