"""From a fall to the alarm that a subscriber received: a join of two streams, with a row also for alarms that never came."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.operators import metrics

#: A partition of the join holds its state in one store, not in four, and a batch writes what it changed, not the whole state.
STORES = {"spark.sql.streaming.join.stateFormatVersion": "3", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def stores(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in this block have the settings of STORES; a checkpoint keeps the format it began with."""
    before = {k: spark.conf.get(k, None) for k in STORES}
    for k, v in STORES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deliveries(sent: DataFrame, received: DataFrame, within_ms: int, lateness_ms: int = 60_000) -> DataFrame:
    """Streams (event_id, at_ms) -> event_id, sent_ms, received_ms.

    Received is what comes within within_ms after it was sent; else received_ms is null, which is known once both streams are
    past that time. Both sides' state ends with their watermarks. What is received twice gives two rows.
    """
    s = sent.select(F.col("event_id").alias("event_id"), F.col("at_ms").alias("sent_ms"), F.timestamp_millis("at_ms").alias("sent_at")).withWatermark("sent_at", f"{lateness_ms} milliseconds")
    r = received.select(F.col("event_id").alias("received_id"), F.col("at_ms").alias("received_ms"), F.timestamp_millis("at_ms").alias("received_at")).withWatermark("received_at", f"{lateness_ms} milliseconds")
    on = f"event_id = received_id AND received_at >= sent_at AND received_at <= sent_at + INTERVAL {within_ms / 1000:.3f} SECONDS"
    return s.join(r, F.expr(on), "left_outer").select("event_id", "sent_ms", "received_ms")


def delivery_report(rows: DataFrame, limit_ms: int = 1000) -> DataFrame:
    """One row: sent, received, lost, share of what was sent that came within the limit, p50 and p95 of the delay. The first receipt counts."""
    first = rows.groupBy("event_id").agg(F.min("sent_ms").alias("sent_ms"), F.min("received_ms").alias("received_ms"))
    delay = first.select((F.col("received_ms") - F.col("sent_ms")).alias("value"))
    counts = delay.agg(F.count(F.lit(1)).alias("sent"), F.count("value").alias("received"), F.count_if(F.col("value").isNull()).alias("lost"), F.avg(F.coalesce(F.col("value") <= limit_ms, F.lit(False)).cast("double")).alias("share"))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(metrics.quantiles(delay).withColumn("one", F.lit(1))), "one").select("sent", "received", "lost", "share", "p50", "p95")
