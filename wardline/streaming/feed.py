"""Subscriptions to the alarm feed: streams over the committed batches of alarms, each with a start and a checkpoint of its own.

The first run of a subscription delivers the backlog behind its start, later runs what has been committed since: the same
stream, so there is neither a gap nor an overlap between the two, whenever it stops. Executors write the messages; the
driver sees the numbers of new batches only. A subscription that fails stops nothing but itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardline.operators.feed import sse, stream_start
from wardline.streaming import manifest
from wardline.streaming.pipeline import alarm_log

START, MESSAGE = "cursor long", "cursor long, message string"


def start_of(spark: SparkSession, root: str, name: str, since: str | None) -> int:
    """The cursor after which a subscription is served: settled when it is first asked for, whatever `since` says later."""
    at = f"{root}/feeds/{name}/start"
    try:
        found = spark.read.schema(START).json(at).first()
    except AnalysisException:
        found = None
    if found is None:
        spark.createDataFrame([(stream_start(alarm_log(spark, root), since),)], START).coalesce(1).write.json(at)
        found = spark.read.schema(START).json(at).first()
    return found.cursor


def subscribe(spark: SparkSession, root: str, name: str, since: str | None = None, deliver: Callable[[Iterator[Row]], None] | None = None) -> DataStreamWriter:
    """A stream that writes the messages of alarms behind `since` to the subscription's folder.

    deliver: runs on executors for each partition of new messages, in order of cursors within and along partitions. A batch
    that failed half way is delivered again, so receivers go by the cursor.
    """
    start = start_of(spark, root, name, since)
    news = spark.readStream.schema(manifest.ENTRY).json(f"{root}/commits/alarms/entry=*")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        ids = sorted(r.batch_id for r in batch.select("batch_id").distinct().collect())  # a number for each new batch
        if not ids:
            return
        before = manifest.entry(own, root, "alarms", ids[0] - 1)  # none if it was truncated: all before it was delivered
        low = before.head if before else 0
        high = manifest.entry(own, root, "alarms", ids[-1]).head
        alarms = alarm_log(own, root, after_batch=ids[0] - 1)
        wanted = alarms.where((F.col("cursor") > max(start, low)) & (F.col("cursor") <= high))
        place = manifest.publish(sse(wanted).repartitionByRange("cursor").sortWithinPartitions("cursor"), root, f"feeds/{name}", batch_id)
        if deliver:
            own.read.schema(MESSAGE).parquet(place).repartitionByRange("cursor").sortWithinPartitions("cursor").foreachPartition(deliver)

    return news.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/feeds/{name}/checkpoint")


def delivered(spark: SparkSession, root: str, name: str) -> DataFrame:
    """cursor, message: what a subscription has been given so far."""
    return spark.read.schema(MESSAGE).parquet(f"{root}/feeds/{name}/batch_id=*")
