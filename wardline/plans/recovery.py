"""Named queries over streams, their state, snapshots and replay, each with DuckDB SQL that gives the same rows.

Events are landed in parts by arrival, and every stream is stopped and started again between the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.config import DEFAULT
from wardline.operators import dedup, integrals, metrics, occupancy, rings, stats, validate
from wardline.operators.feed import newest
from wardline.plans.queries import QUERIES, SQL, _CHECKED, _COVER, _HEALTH, _POINTS, _REGISTRY, _occupancy_sql, as_of, checked, events, on_alarms, on_sensor, query
from wardline.sources import segments, sensors
from wardline.sources.staging import scratch, stage
from wardline.streaming import feed, latency, manifest, pipeline, progress, snapshots, state

#: Arrival of one part of the events, and the parts: events of one hour come up to 20 minutes late.
PART_MS, PARTS = 1_200_000, range(4)


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as the log has them."""
    return stage(events(spark, sf_dir).drop("event_id", "cp"), "sensor-log")


def part_of(column: str = "received_ms") -> Column:
    return F.least(F.greatest(F.floor((F.col(column) - sensors.T0) / PART_MS), F.lit(0)), F.lit(max(PARTS)))


def part_sql(column: str = "received_ms") -> str:
    return f"least(greatest(({column} - {sensors.T0}) // {PART_MS}, 0), {max(PARTS)})"


def parts(log: DataFrame, column: str = "received_ms") -> Iterator[tuple[int, DataFrame]]:
    for i in PARTS:
        yield i, log.where(part_of(column) == i)


# ---- state that expires -----------------------------------------------------------------------------------------

#: Copies come up to 20 minutes late, so an alarm may be forgotten after that without a change of results.
SHORT, LATENESS_MS = replace(DEFAULT, past_limit_ms=PART_MS), 60_000


@query("open_alarm_state", on_alarms(f"""
SELECT device_id, event_id, ts_ms, duplicates_collapsed, seq_min, seq_max FROM (
  SELECT *, max((ts_ms >= cut)::INT) OVER (PARTITION BY device_id ORDER BY cursor ROWS UNBOUNDED PRECEDING) AS alive FROM alarms JOIN (
    SELECT device_id, greatest(max(received_ms), (SELECT max(received_ms) FROM sensor WHERE type = 'fall_warn') - {LATENESS_MS}) - {PART_MS + 1000} AS cut FROM sensor WHERE type = 'fall_warn' GROUP BY 1) USING (device_id))
WHERE alive = 1"""))
def open_alarm_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms that the stream's state still holds at its end: those of devices that fell silent have been dropped by timers."""
    root = scratch(spark, "expiring")
    for i, part in parts(log_of(spark, sf_dir)):
        pipeline.add_events(part, root, i)
        pipeline.run(pipeline.write_alarms(state.expiring_alarm_changes(pipeline.read_events(spark, root), SHORT, lateness_ms=LATENESS_MS), root, f"{root}/checkpoint"))
    found = dedup.shown(state.open_alarms(spark, f"{root}/checkpoint"))
    return found.select("device_id", "event_id", "ts_ms", "duplicates_collapsed", "seq_min", "seq_max")


@query("streamed_occupancy_5m", _occupancy_sql(300_000))
def streamed_occupancy_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy from the timelines in a stream's state, after presence events that came in no order."""
    root, log = scratch(spark, "timelines"), log_of(spark, sf_dir)
    for i in range(3):
        pipeline.add_events(log.where(F.pmod(F.xxhash64("ord"), F.lit(3)) == i), root, i)
        pipeline.run(state.write_rooms(state.room_changes(pipeline.read_events(spark, root), lateness_ms=4 * PART_MS), root, f"{root}/checkpoint"))
    return occupancy.from_points(state.room_points(spark, f"{root}/checkpoint"), 300_000, as_of(log))


# ---- partial state that merges ------------------------------------------------------------------------------------


@query("device_health_from_rings", on_sensor(_HEALTH.format(key="reg.device_id") + " FROM reg LEFT JOIN cover USING (device_id)", _REGISTRY, _COVER))
def device_health_from_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health as of the end, from rings of ten minutes of arrival each, without a look at the events."""
    log = log_of(spark, sf_dir)
    kept = stage(rings.rings(log, 600_000), "rings")
    return rings.health_from_rings(rings.merge(kept), as_of(log))


_BEFORE, _LOOKED = (0, 600_000, 1_800_000), (60_000, 300_000, 3_600_000)


@query("occupancy_lookups", on_sensor(f"""
SELECT room_id, as_of_ms, window_ms, sum(CASE WHEN in_room THEN greatest(0, least(upto, as_of_ms) - greatest(t_ms, as_of_ms - window_ms)) ELSE 0 END)::BIGINT AS occupied_ms
FROM (SELECT *, coalesce(lead(t_ms) OVER (PARTITION BY room_id ORDER BY t_ms), 9000000000000000) AS upto FROM points), (SELECT now - unnest([{", ".join(map(str, _BEFORE))}]) AS as_of_ms FROM now), (SELECT unnest([{", ".join(map(str, _LOOKED))}])::BIGINT AS window_ms)
WHERE t_ms <= as_of_ms GROUP BY ALL""", _POINTS))
def occupancy_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied time as of three times over three windows, each by two look-ups in a table of prefix sums (of ten minutes)."""
    log, path = log_of(spark, sf_dir), scratch(spark, "integrals")
    integrals.write_integrals(integrals.prefix_integrals(occupancy.timeline(log), 600_000), path)
    now = as_of(log)
    return integrals.occupied_ms(spark.read.parquet(path), [(now - before, w) for before in _BEFORE for w in _LOOKED], 600_000)


# ---- the log as segments, snapshots and recovery ------------------------------------------------------------------


def segmented(log: DataFrame, path: str) -> None:
    """The log in segments by arrival. After each stands a line that a crash cut off, and one that is no event."""
    spark = log.sparkSession
    for i, part in parts(log):
        segments.write_segment(part, path, 2 * i)
        spark.createDataFrame([('{"device_id":"dev_1","ty',), ('{"kind":"mark"} tail',), ("[1]",)], "value string").coalesce(1).write.text(f"{path}/segment={2 * i + 1:08d}")


@query("replayed_from_position", on_alarms("SELECT * FROM alarms"))
def replayed_from_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of what was read before a stored position, in the midst of a file, and of a replay from there on."""
    path = scratch(spark, "segments")
    segmented(log_of(spark, sf_dir), path)
    rows = segments.log_lines(spark, path)
    middle = rows.where("file LIKE 'segment=00000002/%'").select(F.max(F.struct("file", "at")).alias("p")).first().p
    stop = segments.Position(middle.file, middle.at) if middle else segments.Position()
    early = segments.events_of(segments.log_lines(spark, path, stop=stop, range_bytes=1 << 18))
    late, _ = segments.replayed(spark, path, stop)
    return dedup.alarm_log(early.unionByName(late))


@query("replay_summary", on_sensor(f"SELECT i AS part, (SELECT count(*) FROM sensor WHERE {part_sql()} >= i) AS events, (4 - i)::BIGINT AS other, (2 * (4 - i))::BIGINT AS skipped FROM range(4) t(i)"))
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay from the start of each part finds: events, other JSON, torn lines."""
    path, out = scratch(spark, "segments"), None
    segmented(log_of(spark, sf_dir), path)
    for i in PARTS:
        row = segments.replayed(spark, path, segments.Position(f"segment={2 * i:08d}/"))[1].withColumn("part", F.lit(i).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


@query("recovered_alarms", on_alarms("SELECT * FROM alarms"))
def recovered_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms after a crash: the newest snapshot is broken, the one before it and the log behind its position give them all."""
    return snapshots.alarms_of(crashed(spark, sf_dir)[0])


def crashed(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    root, path, log = scratch(spark, "snapshots"), scratch(spark, "segments"), log_of(spark, sf_dir)
    for i, part in parts(log):
        segments.write_segment(part, path, i)
        if i < 3:
            snapshots.advance(spark, root, path)
    spark.createDataFrame([("{ truncated",)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/generation={3:08d}/manifest")
    return snapshots.recover(spark, root, path)


@query("recovery_report", on_alarms(f"""
SELECT 2::BIGINT AS generation, (SELECT count(*) FROM sensor WHERE {part_sql()} >= 2) AS replayed, 0::BIGINT AS skipped, count(*) AS alarms, count(DISTINCT event_id) AS ids, min(cursor) AS first, max(cursor) AS last,
  sum(duplicates_collapsed)::BIGINT AS duplicates_collapsed, 0::BIGINT AS differing, (SELECT count(DISTINCT device_id) FROM sensor) AS devices, (SELECT count(DISTINCT room_id) FROM sensor WHERE type = 'presence') AS rooms FROM alarms"""))
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restart must leave as it was: the alarms with their cursors, devices and rooms; `differing` counts alarms that are not the same before and after."""
    kept, summary = crashed(spark, sf_dir)
    found = stage(snapshots.alarms_of(kept), "recovered")
    differing = stats.differences(dedup.alarm_log(log_of(spark, sf_dir)), found).agg(F.count(F.lit(1)).alias("differing"))
    counts = found.agg(F.count(F.lit(1)).alias("alarms"), F.countDistinct("event_id").alias("ids"), F.min("cursor").alias("first"), F.max("cursor").alias("last"), F.sum("duplicates_collapsed").alias("duplicates_collapsed"))
    devices, rooms = kept["rings"].agg(F.countDistinct("device_id").alias("devices")), kept["points"].agg(F.countDistinct("room_id").alias("rooms"))
    out = summary.drop("file", "at").withColumn("one", F.lit(1))
    for row in (counts, differing, devices, rooms):
        out = out.join(F.broadcast(row.withColumn("one", F.lit(1))), "one")  # one row each
    return out.drop("one")


# ---- deliveries ------------------------------------------------------------------------------------------------

WITHIN_MS = 1_500_000
#: Every seventh fall's alarm is lost on its way, and so is what only a jitter copy names.
_DELIVERED = f"""
sent AS (SELECT 'fall_' || device_id || '_' || t_ms AS event_id, min(t_ms) AS sent_ms FROM sensor WHERE type = 'fall_warn' GROUP BY 1),
received AS (SELECT 'fall_' || device_id || '_' || t_ms AS event_id, min(received_ms) AS received_ms FROM sensor WHERE type = 'fall_warn' AND cp = 0 AND event_id % 7 <> 0 GROUP BY 1),
delivered AS (SELECT event_id, sent_ms, received_ms FROM sent LEFT JOIN received USING (event_id))"""


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "deliveries")
    falls = stage(events(spark, sf_dir).where("type = 'fall_warn'").withColumn("fall", F.concat(F.lit("fall_"), "device_id", F.lit("_"), F.col("t_ms").cast("string"))), "falls")
    sent = falls.groupBy(F.col("fall").alias("event_id")).agg(F.min("t_ms").alias("at_ms"))
    received = falls.where("cp = 0 AND event_id % 7 <> 0").groupBy(F.col("fall").alias("event_id")).agg(F.min("received_ms").alias("at_ms"))
    end = spark.createDataFrame([("end", sensors.T0 + 86_400_000)], "event_id string, at_ms long")  # later than all, so that the watermarks pass all
    for i in range(max(PARTS) + 2):
        for name, rows in (("sent", sent), ("received", received)):
            (rows.where(part_of("at_ms") == i) if i in PARTS else end).select("event_id", "at_ms").write.parquet(f"{root}/{name}/part={i}")
        read = {name: spark.readStream.schema("event_id string, at_ms long").parquet(f"{root}/{name}/part=*") for name in ("sent", "received")}
        joined = latency.deliveries(read["sent"], read["received"], WITHIN_MS)
        with latency.stores(spark):
            pipeline.run(joined.writeStream.format("parquet").option("path", f"{root}/joined").outputMode("append").option("checkpointLocation", f"{root}/checkpoint"))
    return spark.read.schema("event_id string, sent_ms long, received_ms long").parquet(f"{root}/joined").where("event_id <> 'end'")


@query("alarm_deliveries", on_sensor("SELECT * FROM delivered", _DELIVERED))
def alarm_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fall with the time its alarm was received, null if it never was, from a join of two streams."""
    return delivered(spark, sf_dir)


@query("delivery_report", on_sensor("""
SELECT count(*) AS sent, count(received_ms) AS received, count(*) - count(received_ms) AS lost, avg(coalesce(received_ms - sent_ms <= 1000, false)::INT::DOUBLE) AS share,
  quantile_disc(received_ms - sent_ms, 0.5)::DOUBLE AS p50, quantile_disc(received_ms - sent_ms, 0.95)::DOUBLE AS p95 FROM delivered""", _DELIVERED))
def delivery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = latency.delivery_report(delivered(spark, sf_dir))
    return row.select("sent", "received", "lost", "share", F.col("p50").cast("double").alias("p50"), F.col("p95").cast("double").alias("p95"))


# ---- stateless and windowed streams ------------------------------------------------------------------------------


def streamed(spark: SparkSession, sf_dir: str, name: str, query_of, mode: str) -> DataFrame:
    """What a stream over the log has written, batch after batch, when the log came in parts."""
    root = scratch(spark, name)
    for i, part in parts(log_of(spark, sf_dir)):
        pipeline.add_events(part, root, i)
        rows = query_of(pipeline.read_events(spark, root))
        pipeline.run(rows.writeStream.foreachBatch(lambda batch, n: manifest.publish(batch, root, "out", n)).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{root}/out/batch_id=*")


@query("exact_copies_dropped", on_sensor("SELECT DISTINCT device_id, t_ms FROM sensor WHERE type = 'fall_warn'"))
def exact_copies_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings with the same device and time, once each, whichever batch they came in."""
    return streamed(spark, sf_dir, "exact", lambda ev: pipeline.exact_copies_dropped(ev).select("device_id", "t_ms"), "append")


@query("streamed_availability", on_sensor("""SELECT device_id, end_s, count(*) AS heartbeats FROM (
  SELECT device_id, unnest(range((sec // 60 + 1) * 60, (sec // 60 + 1) * 60 + 300, 60)) AS end_s FROM (SELECT DISTINCT device_id, t_ms // 1000 AS sec FROM sensor WHERE type = 'heartbeat')) GROUP BY ALL"""))
def streamed_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeat seconds in sliding windows as the stream last gave them."""
    shape = lambda ev: pipeline.availability(ev).select("device_id", F.unix_seconds("window.end").alias("end_s"), "heartbeats")
    return streamed(spark, sf_dir, "availability", shape, "update").groupBy("device_id", "end_s").agg(F.max("heartbeats").alias("heartbeats"))


@query("alarm_newest", on_alarms("SELECT event_id, cursor FROM alarms ORDER BY cursor DESC LIMIT 100"))
def alarm_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the newest 100."""
    return newest(dedup.alarm_log(log_of(spark, sf_dir))).select("event_id", "cursor")


@query("metric_keys", on_sensor("""SELECT 'events_accepted_total' AS key, count(*)::DOUBLE AS value FROM sensor
UNION ALL SELECT 'events_accepted_by_type_total|type="' || type || '"', count(*)::DOUBLE FROM sensor GROUP BY type
UNION ALL SELECT 'events_rejected_by_reason_total|reason="' || reason || '"', count(*)::DOUBLE FROM checked WHERE reason IS NOT NULL GROUP BY reason""", _CHECKED))
def metric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by their keys."""
    ev = log_of(spark, sf_dir)
    total = ev.agg(F.count(F.lit(1)).alias("n"))
    rows = metrics.series(total, "events_accepted_total", "n").unionByName(metrics.series(metrics.counters(ev, "type"), "events_accepted_by_type_total", "n", "type"))
    rejected = metrics.counters(validate.rejects(checked(spark, sf_dir)), "reason")
    return metrics.keyed(rows.unionByName(metrics.series(rejected, "events_rejected_by_reason_total", "n", "reason")))


# ---- progress, feed and commits ----------------------------------------------------------------------------------


@query("ingest_progress", on_sensor(f"""
SELECT batch_id, name, (sum(n) OVER (PARTITION BY name ORDER BY batch_id))::BIGINT AS value FROM (
  SELECT {part_sql()} AS batch_id, unnest(['ingest.accepted', 'ingest.rejected', 'ingest.delay_ms']) AS name,
    unnest([count(*) FILTER (reason IS NULL), count(*) FILTER (reason IS NOT NULL), coalesce(sum(received_ms - t_ms) FILTER (reason IS NULL), 0)]) AS n FROM checked GROUP BY 1)""", _CHECKED))
def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an ingest stream as they stood after each of its batches, as a listener saw them."""
    root, raw = scratch(spark, "progress"), stage(sensors.raw_events(spark, sf_dir), "landed")
    listener = progress.ProgressLog(spark, f"{root}/progress")
    spark.streams.addListener(listener)
    try:
        for i, part in parts(raw):
            part.write.parquet(f"{root}/landing/part={i}")
            stream = spark.readStream.schema(raw.schema).parquet(f"{root}/landing/part=*")
            q = progress.counted_ingest(stream).select("ord", "reason").writeStream.format("parquet").option("path", f"{root}/checked").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination(600)
            if q.exception():
                raise q.exception()
            listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    return progress.counters(progress.snapshots(spark, f"{root}/progress")).select("batch_id", "name", "value")


@query("resumed_feed", on_alarms("SELECT 'all' AS subscriber, cursor, event_id FROM alarms UNION ALL SELECT 'late', cursor, event_id FROM alarms WHERE cursor > 25"))
def resumed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two subscribers were given: one from the first alarm on, stopped and resumed as alarms come, one that joins later at a cursor."""
    root = scratch(spark, "feed")
    for i, part in parts(log_of(spark, sf_dir)):
        pipeline.add_events(part, root, i)
        pipeline.run(pipeline.write_alarms(pipeline.alarm_changes(pipeline.read_events(spark, root)), root, f"{root}/checkpoint"))
        if i != 1:  # away while the second part comes
            pipeline.run(feed.subscribe(spark, root, "all"))
        if i >= 2:
            pipeline.run(feed.subscribe(spark, root, "late", "25" if i == 2 else "9999"))
    given = [feed.delivered(spark, root, name).withColumn("subscriber", F.lit(name)) for name in ("all", "late")]
    data = F.regexp_extract("message", r"(?s)\ndata: (.*)\n\n$", 1)
    return given[0].unionByName(given[1]).select("subscriber", "cursor", F.get_json_object(data, "$.event_id").alias("event_id"))


@query("committed_events", on_sensor(f"SELECT {part_sql()} AS batch_id, type, count(*) AS n FROM sensor WHERE {part_sql()} BETWEEN 1 AND 2 GROUP BY ALL"))
def committed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see of a log whose first batch was truncated and whose last one is in its place but not committed."""
    root = scratch(spark, "commits")
    for i, part in parts(log_of(spark, sf_dir)):
        if i < max(PARTS):
            pipeline.add_events(part, root, i)
        else:
            manifest.publish(part, root, "events", i)
    manifest.truncate(spark, root, "events", 1)
    return pipeline.event_log(spark, root).groupBy(part_of().alias("batch_id"), "type").agg(F.count(F.lit(1)).alias("n"))
