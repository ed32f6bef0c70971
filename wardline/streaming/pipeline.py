"""Structured Streaming: raw events to the event log and rejects, warnings to alarms, and the feed of alarms.

Every table is a folder of Parquet with one subfolder for each micro-batch, put in its place at once and named by an entry
of the table's manifest (`manifest`), which readers follow; a batch that is repeated after a failure is not written again.
Alarms are committed only after the events they come from. Progress lives in checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wardline.config import DEFAULT, Config
from wardline.functions.times import to_iso
from wardline.operators.validate import accepted, rejects, validated
from wardline.schemas import EVENTS, RAW, REJECTS
from wardline.sources.staging import number_rows
from wardline.streaming import manifest


def read_raw(spark: SparkSession, landing: str, config: Config = DEFAULT) -> DataFrame:
    """A stream of JSON files with the columns of schemas.RAW; the bytes that a trigger takes are the backpressure: what
    lands meanwhile waits in its folder, and nothing is shed."""
    return spark.readStream.schema(RAW).option("maxBytesPerTrigger", config.wal_segment_bytes).json(landing)


def ingest(raw: DataFrame, root: str, checkpoint: str, config: Config = DEFAULT) -> DataStreamWriter:
    """Validate raw events; accepted ones go to root/events, others to root/rejects with their text and reason."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not manifest.begin(spark, root, "events", batch_id):
            return
        checked = validated(batch, config).persist()
        manifest.publish(rejects(checked), root, "rejects", batch_id)
        add_events(accepted(checked), root, batch_id)
        checked.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def add_events(events: DataFrame, root: str, batch_id: int) -> None:
    """One more batch of the event log; that of its rejects is committed with it."""
    spark = events.sparkSession
    place = manifest.publish(events, root, "events", batch_id)
    manifest.commit(spark, root, "rejects", batch_id, rows=0)
    manifest.commit(spark, root, "events", batch_id, rows=spark.read.schema(EVENTS).parquet(place).count())


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The event log as a stream."""
    return spark.readStream.schema(EVENTS).parquet(f"{root}/events/batch_id=*")


def event_log(spark: SparkSession, root: str) -> DataFrame:
    """The event log as a table: its committed batches."""
    return manifest.committed(spark, root, "events", EVENTS)


def reject_log(spark: SparkSession, root: str) -> DataFrame:
    return manifest.committed(spark, root, "rejects", REJECTS)


ALARM_STATE = "ord long, t0 long, room_id string, ts_ms long, confidence double, dups int, q0 long, q1 long"
ALARM_CHANGE = f"device_id string, kind string, change_ord long, {ALARM_STATE}"
CHANGE = Row(*[x.split()[0] for x in ALARM_CHANGE.split(", ")])


class FallDedup(StatefulProcessor):
    """Alarms of one device that are still open, in order of creation; warnings are folded in order of arrival.

    Alarms at the head of the list that no accepted warning can reach any more are forgotten. A device has few warnings in a
    batch, so they come as plain rows: a data frame for each device would take longer than the fold.
    """

    def __init__(self, window_ms: int, slack: int | None, past_limit_ms: int) -> None:
        self.window_ms, self.slack, self.past_limit_ms = window_ms, slack, past_limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", ALARM_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self.folded(key[0], rows)[2]

    def folded(self, device: str, rows: Iterator[Row]) -> tuple[int | None, int | None, list[Row]]:
        """Times of the oldest open alarm before and after the warnings (None: there is none), and the changes."""
        alarms = [list(a) for a in self.open.get()]
        before = alarms[0][3] if alarms else None
        out, newest = [], 0
        for r in sorted(rows, key=lambda r: r.ord):
            newest = max(newest, r.received_ms)
            found = next((a for a in alarms if self.touches(a, r.t_ms, r.seq)), None)
            if found is None:
                found = [r.ord, r.t_ms, r.room_id, r.t_ms, r.confidence, 0, r.seq, r.seq]
                alarms.append(found)
                out.append(CHANGE(device, "created", r.ord, *found))
                continue
            found[3] = min(found[3], r.t_ms)
            found[4] = max((x for x in (found[4], r.confidence) if x is not None), default=None)
            found[5] += 1
            found[6] = min((x for x in (found[6], r.seq) if x is not None), default=None)
            found[7] = max((x for x in (found[7], r.seq) if x is not None), default=None)
            out.append(CHANGE(device, "amended", r.ord, *found))
        cutoff = newest - self.past_limit_ms - self.window_ms
        first = next((i for i, a in enumerate(alarms) if a[3] >= cutoff), len(alarms))
        self.hold([tuple(a) for a in alarms[first:]])
        return before, alarms[first][3] if first < len(alarms) else None, out

    def hold(self, alarms: list[tuple]) -> None:
        self.open.put(alarms) if alarms else self.open.clear()

    def touches(self, a: list, t: int, q: int | None) -> bool:
        if abs(t - a[3]) > self.window_ms:
            return False
        return self.slack is None or q is None or a[6] is None or a[6] - self.slack <= q <= a[7] + self.slack

    def close(self) -> None:
        pass


def alarm_changes(events: DataFrame, config: Config = DEFAULT, slack: int | None = 2) -> DataFrame:
    """A stream of created and amended alarms; needs the RocksDB state store."""
    falls = events.where("type = 'fall_warn'").select("device_id", "room_id", "ord", "received_ms", "t_ms", "seq", "confidence")
    return falls.groupBy("device_id").transformWithState(
        FallDedup(config.dedup_window_ms, slack, config.past_limit_ms), outputStructType=ALARM_CHANGE, outputMode="Update", timeMode="None"
    )


ALARM_ROW = f"device_id string, {ALARM_STATE}, cursor long"


def write_alarms(changes: DataFrame, root: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Created alarms get the next dense cursors and go to root/alarms; amendments to root/amendments.

    `publish` is called with the new alarms of a batch after they are committed; corrections are never published.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not manifest.begin(spark, root, "alarms", batch_id):
            return
        kept = batch.persist()
        manifest.publish(kept.where("kind = 'amended'"), root, "amendments", batch_id)
        head = head_before(spark, root, batch_id)
        new = number_rows(kept.where("kind = 'created'").drop("kind", "change_ord"), F.col("ord"), name="cursor", first=head + 1)
        place = manifest.publish(new, root, "alarms", batch_id)
        written = spark.read.schema(ALARM_ROW).parquet(place)
        rows, last = written.agg(F.count(F.lit(1)), F.coalesce(F.max("cursor"), F.lit(head))).first()
        needs = manifest.await_batches(spark, root, "events")
        manifest.commit(spark, root, "amendments", batch_id, rows=0, needs=needs)
        manifest.commit(spark, root, "alarms", batch_id, rows=rows, head=last, needs=needs)
        kept.unpersist()
        if publish:
            publish(written.orderBy("cursor"), batch_id)

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)


def head_before(spark: SparkSession, root: str, batch_id: int) -> int:
    """The last cursor given before a batch, from the entry of the batch before it, whatever the length of the history."""
    found = manifest.entry(spark, root, "alarms", batch_id - 1) if batch_id else None
    if batch_id and found is None:
        raise RuntimeError(f"alarms, batch {batch_id}: the batch before it has no entry")
    return found.head if found else 0


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(writer: DataStreamWriter, seconds: int = 600) -> None:
    """Run a stream until nothing is left; its error is raised here."""
    use_rocksdb(SparkSession.active())
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} s")


def start(spark: SparkSession, landing: str, config: Config = DEFAULT) -> dict[str, StreamingQuery]:
    """Run ingest and alarms side by side until they are stopped, with a trigger every fsync_ms and tables in data_dir."""
    use_rocksdb(spark)
    root, every = config.data_dir, {"processingTime": f"{config.fsync_ms} milliseconds"}
    queries = {"ingest": ingest(read_raw(spark, landing, config), root, f"{root}/checkpoints/ingest", config).queryName("ingest").trigger(**every).start()}
    manifest.await_first(spark, root, "events")
    changes = alarm_changes(read_events(spark, root), config, config.dedup_seq_slack)
    queries["alarms"] = write_alarms(changes, root, f"{root}/checkpoints/alarms").queryName("alarms").trigger(**every).start()
    return queries


def alarm_log(spark: SparkSession, root: str, after_batch: int = -1) -> DataFrame:
    """Alarms as they stand (of the batches beyond after_batch): each creation with its latest amendment (schemas.ALARMS)."""
    rows = manifest.committed(spark, root, "alarms", ALARM_ROW, after_batch)
    made = rows.select("device_id", "ord", "t0", "room_id", "cursor", F.struct(F.lit(-1).cast("long").alias("change_ord"), "ts_ms", "confidence", "dups", "q0", "q1").alias("s"))
    changed = manifest.committed(spark, root, "amendments", ALARM_CHANGE, after_batch).select("device_id", "ord", F.struct("change_ord", "ts_ms", "confidence", "dups", "q0", "q1").alias("s"))
    last = changed.groupBy("device_id", "ord").agg(F.max_by("s", "s.change_ord").alias("latest"))
    d = made.join(last, ["device_id", "ord"], "left").withColumn("s", F.coalesce("latest", "s"))
    return d.select(
        F.concat(F.lit("fall_"), "device_id", F.lit("_"), F.col("t0").cast("string")).alias("event_id"), "device_id", "room_id", to_iso(F.col("s.ts_ms")).alias("ts"), F.col("s.ts_ms").alias("ts_ms"),
        F.col("s.confidence").alias("confidence"), "cursor", F.col("s.dups").alias("duplicates_collapsed"), F.col("s.q0").alias("seq_min"), F.col("s.q1").alias("seq_max"),
    )


def exact_copies_dropped(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """For a window of 0 ms: the first of each (device_id, t_ms), with a watermark wide enough for every accepted event."""
    wide = config.future_limit_ms + config.past_limit_ms + 1000
    at = events.where("type = 'fall_warn'").withColumn("event_time", F.timestamp_millis("t_ms")).withWatermark("event_time", f"{wide} milliseconds")
    return at.dropDuplicatesWithinWatermark(["device_id", "t_ms"])


def availability(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", config: Config = DEFAULT) -> DataFrame:
    """Count of distinct heartbeat seconds by device in sliding windows of event time; a state holds the seconds of its window at most."""
    wide = config.future_limit_ms + config.past_limit_ms + 1000
    at = events.where("type = 'heartbeat'").withColumn("event_time", F.timestamp_millis("t_ms")).withWatermark("event_time", f"{wide} milliseconds")
    return at.groupBy("device_id", F.window("event_time", window, slide)).agg(F.size(F.collect_set(F.floor(F.col("t_ms") / 1000))).cast("long").alias("heartbeats"))


def mirror(alarms: DataFrame, path: str) -> None:
    """Append the alarms whose event_id the mirror table at path lacks; call it on each new batch, or once on the whole log to reconcile."""
    from pyspark.errors import AnalysisException

    from wardline.operators.feed import missing_from_mirror

    spark = alarms.sparkSession
    try:
        have = spark.read.parquet(path)
    except AnalysisException:
        have = spark.createDataFrame([], "event_id string")
    missing_from_mirror(alarms, have).write.mode("append").parquet(path)
