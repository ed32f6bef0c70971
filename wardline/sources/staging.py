"""Tables staged in the folder that all executors share, and row numbers made from them."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


#: Least seconds between two collections of the driver's garbage, and when the last one was.
SWEEP_S, _swept = 5.0, [0.0]
#: Folders of the tables staged in each of the `passing` blocks that are open, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset (tests on a local master) a temporary folder is used; on any other
    master that is an error, since executors could not see the driver's own disk.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='wardline-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wardline/{name}-{uuid.uuid4().hex}"


def _goes_with_driver(spark: SparkSession, path: str, make: bool) -> None:
    """Have a folder deleted when the driver ends."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = own.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        store.mkdirs(own)
    store.deleteOnExit(own)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for what the application needs while it runs."""
    path = _path(spark, name)
    _goes_with_driver(spark, path, make=True)
    return path


def sweep(spark: SparkSession, now: bool = False) -> None:
    """Have the driver collect its garbage, unless it has just done so (now: in any case). Spark drops the shuffle files and broadcasts of what is
    finished, on all machines, when the driver finds them unreachable; a driver that runs many small jobs would fill its heap, and
    the executors' disks, before it looks."""
    if now or time.monotonic() - _swept[0] >= SWEEP_S:
        gc.collect()  # what Python holds in cycles the JVM can't drop
        spark._jvm.java.lang.System.gc()
        _swept[0] = time.monotonic()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged in this block are deleted at its end, so nothing that reads them may be left to be computed then."""
    own: list[str] = []
    token = _passing.set((*_passing.get(), own))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        sweep(spark, now=bool(own))


def stage(df: DataFrame, name: str, lasts: bool = False, **options: object) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and lets go of the
    shuffles behind it (`sweep`). The table is deleted when the driver ends, or before that with the `passing` block it is
    staged in (lasts: with the one around that, if there is any)."""
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    _goes_with_driver(spark, path, make=False)
    blocks = _passing.get()[: -1 if lasts else None]
    if blocks:
        blocks[-1].append(path)
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, *order: Column, name: str = "row_number", first: int = 0) -> DataFrame:
    """Number rows first, first + 1, ... in the given order, without gathering them in one task.

    Rows are dealt by range, sorted within partitions and staged with their place; the offsets of the
    partitions come from one count per partition, so only that small table is ever gathered.
    Rows that tie in every order column get numbers in arbitrary order among themselves.
    """
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row for each partition
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + first).drop("__at", "__part", "__before")
