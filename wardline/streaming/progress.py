"""Counters of running streams: observed in the batches themselves, kept by a listener as a table of snapshots."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.window import Window

from wardline.config import DEFAULT, Config
from wardline.operators.validate import validated

INGEST = "ingest"
SNAPSHOT = "query string, run string, batch_id long, at_ms long, input_rows long, name string, value long"


def counted_ingest(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Validated raw events as a stream that counts itself: accepted, rejected, and seconds of delay added up."""
    ok = F.col("reason").isNull()
    return validated(raw, config).observe(INGEST, F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.coalesce(F.sum(F.when(ok, F.col("received_ms") - F.col("t_ms"))), F.lit(0)).alias("delay_ms"))


class ProgressLog(StreamingQueryListener):
    """Appends what each batch observed to a table at `path`: one row for each counter, an idle batch none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.ended, self.lock = spark, path, set(), threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at_ms = round(time.time() * 1000)
        rows = [(str(p.id), str(p.runId), p.batchId, at_ms, p.numInputRows, f"{group}.{name}", int(value)) for group, row in p.observedMetrics.items() for name, value in row.asDict().items() if value is not None]
        if rows and p.numInputRows:
            with self.lock:
                self.spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the rows of an ended query are written."""
        end = time.time() + seconds
        while str(query.runId) not in self.ended:
            if time.time() > end:
                raise TimeoutError("the listener has not seen the query's end")
            time.sleep(0.05)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(path)


def counters(rows: DataFrame) -> DataFrame:
    """Counters as they stood after each batch, for metrics.counter_deltas: query, batch_id, at_ms, name, value. A batch that was repeated counts once."""
    once = rows.groupBy("query", "batch_id", "name").agg(F.max_by("at_ms", "at_ms").alias("at_ms"), F.max_by("value", "at_ms").alias("n"))
    return once.withColumn("value", F.sum("n").over(Window.partitionBy("query", "name").orderBy("batch_id"))).select("query", "batch_id", "at_ms", "name", "value")


def readiness(query: StreamingQuery, config: Config = DEFAULT) -> dict:
    """Whether a stream is live (runs without an error) and ready (its last batch is not older than report_ms, or it waits for data)."""
    last, live = query.lastProgress, bool(query.isActive and query.exception() is None)
    waits = not query.status["isTriggerActive"]
    age = None if last is None else (time.time() - time.mktime(time.strptime(str(last.timestamp)[:19], "%Y-%m-%dT%H:%M:%S")) + time.timezone) * 1000
    return {"live": live, "ready": live and (waits or age is None or age <= config.report_ms), "batch_id": None if last is None else last.batchId, "input_rows_per_second": None if last is None else last.inputRowsPerSecond, "age_ms": None if age is None else round(age)}
