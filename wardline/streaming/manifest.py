"""Which batches of a table are committed: one entry for each, written after everything it stands for.

A batch is written to a hidden folder and renamed into its place, so that a stream over the folders never meets the files of
an attempt that failed; then its entry is written. Readers take the batches that have entries and nothing else. A batch that
is in its place already is not written again. An entry names the stream that wrote it: a stream
with another checkpoint that comes upon it is refused, since it would give the same numbers to other rows.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY = "name string, batch_id long, writer string, rows long, head long, needs long"


class ForeignBatch(RuntimeError):
    """A batch with this number was committed by another stream."""


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def batch_dir(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch_id={batch_id}"


def writer_of(spark: SparkSession) -> str:
    """The id of the stream whose batch runs in this thread; it stays with its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def entries(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Entries of a table's committed batches, one row for each."""
    try:
        return spark.read.schema(ENTRY).json(f"{root}/commits/{name}")
    except AnalysisException:
        return spark.createDataFrame([], ENTRY)


def entry(spark: SparkSession, root: str, name: str, batch_id: int):
    """One batch's entry, or None."""
    store, path = _fs(spark, root)
    at = f"{root}/commits/{name}/entry={batch_id}"
    return spark.read.schema(ENTRY).json(at).first() if store.exists(path(at)) else None


def publish(batch: DataFrame, root: str, name: str, batch_id: int) -> str:
    """Put a batch's rows in their place, all at once; what is there already stays. Returns the folder."""
    spark, place = batch.sparkSession, batch_dir(root, name, batch_id)
    store, path = _fs(spark, root)
    if not store.exists(path(place)):
        hidden = f"{root}/{name}/_batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(hidden)
        if not store.rename(path(hidden), path(place)):
            raise OSError(f"can't rename {hidden}")
    return place


def commit(spark: SparkSession, root: str, name: str, batch_id: int, rows: int, head: int = 0, needs: int = -1) -> None:
    """Write a batch's entry. head: the last number given; needs: the last batch of another table that it builds on."""
    row = [(name, batch_id, writer_of(spark), rows, head, needs)]
    spark.createDataFrame(row, ENTRY).coalesce(1).write.mode("overwrite").json(f"{root}/commits/{name}/entry={batch_id}")


def begin(spark: SparkSession, root: str, name: str, batch_id: int) -> bool:
    """Whether a batch is still to be written; an entry of another stream is an error."""
    found = entry(spark, root, name, batch_id)
    if found and found.writer != writer_of(spark):
        raise ForeignBatch(f"{name}, batch {batch_id}: written by {found.writer}")
    return found is None


def committed(spark: SparkSession, root: str, name: str, schema: str, after: int = -1) -> DataFrame:
    """Rows of the committed batches beyond `after`: a reader beside a writer sees whole batches only."""
    ids = sorted(r.batch_id for r in entries(spark, root, name).where(F.col("batch_id") > after).select("batch_id").collect())  # one number for each batch
    return spark.read.schema(schema).parquet(*[batch_dir(root, name, i) for i in ids]) if ids else spark.createDataFrame([], schema)


def await_batches(spark: SparkSession, root: str, name: str, seconds: float = 30) -> int:
    """Wait until every published batch of a table has its entry; returns the last one (-1: there is none)."""
    store, path = _fs(spark, root)
    end = time.time() + seconds
    while True:
        placed = [f.getPath().getName() for f in store.globStatus(path(f"{root}/{name}/batch_id=*")) or []]
        missing = [p for p in placed if not store.exists(path(f"{root}/commits/{name}/entry={p.split('=')[1]}"))]
        if not missing:
            return max((int(p.split("=")[1]) for p in placed), default=-1)
        if time.time() > end:
            raise TimeoutError(f"{name}: no entry for {missing}")
        time.sleep(0.1)


def await_first(spark: SparkSession, root: str, name: str, seconds: float = 600) -> None:
    """Wait for a table's first committed batch."""
    end = time.time() + seconds
    while entry(spark, root, name, 0) is None:
        if time.time() > end:
            raise TimeoutError(f"{name}: nothing is committed")
        time.sleep(0.1)


def truncate(spark: SparkSession, root: str, name: str, before: int) -> int:
    """Drop the batches before a number, each with its entry first, so that no reader is led to a folder that is going."""
    store, path = _fs(spark, root)
    old = sorted(r.batch_id for r in entries(spark, root, name).where(F.col("batch_id") < before).collect())
    for i in old:
        store.delete(path(f"{root}/commits/{name}/entry={i}"), True)
        store.delete(path(batch_dir(root, name, i)), True)
    return len(old)
