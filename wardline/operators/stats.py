"""One-row summaries: the state of the engine as a nested struct, and comparisons of two states."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators import metrics, schedule


def stats(events: DataFrame, rejects: DataFrame, alarms: DataFrame, waiting: DataFrame) -> DataFrame:
    """One row of structs: gauges, accepted by type, rejected by reason, depth by tier, latency quantiles."""
    one = lambda df: df.withColumn("one", F.lit(1))
    pairs = lambda df, key, value: df.agg(F.array_sort(F.collect_list(F.struct(key, value))).alias("x"))  # noqa: E731  keys are types, reasons, tiers
    gauges = one(metrics.gauges(events, alarms).select(F.struct("*").alias("gauges")))
    accepted = one(pairs(metrics.counters(events, "type"), "type", "n").withColumnRenamed("x", "accepted"))
    rejected = one(pairs(metrics.counters(rejects, "reason"), "reason", "n").withColumnRenamed("x", "rejected"))
    depth = one(pairs(schedule.depths(waiting), "tier", "depth").withColumnRenamed("x", "depth"))
    delays = events.select((F.col("received_ms") - F.col("t_ms")).alias("value"))
    latency = one(metrics.quantiles(delays).select(F.struct("*").alias("latency")))
    out = gauges
    for part in (accepted, rejected, depth, latency):
        out = out.join(F.broadcast(part), "one")  # one row each
    return out.drop("one")


def as_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct("*")).alias("json"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two states has, with `side`: empty if they are equal as multisets."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def received_sla(sent: DataFrame, received: DataFrame, limit_ms: int = 1000) -> DataFrame:
    """sent and received (event_id, at_ms) -> one row: alarms received, share within the limit, p50 and p95 of the delay."""
    first = received.groupBy("event_id").agg(F.min("at_ms").alias("received_ms"))
    delay = sent.groupBy("event_id").agg(F.min("at_ms").alias("sent_ms")).join(first, "event_id").select((F.col("received_ms") - F.col("sent_ms")).alias("value"))
    share = metrics.share_within(delay, limit_ms).withColumn("one", F.lit(1))
    return share.join(F.broadcast(metrics.quantiles(delay).withColumn("one", F.lit(1))), "one").select("total", "share", "p50", "p95")


def ready(query) -> bool:
    """Whether a streaming query runs and has no error."""
    return bool(query.isActive and query.exception() is None)
