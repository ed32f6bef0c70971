"""State of streams that expires by event-time timers, and reading it back as tables.

The clock is the arrival of events: a watermark over received_ms, so that what a device buffered offline is judged by when it
came. Timers drop what no accepted event can reach any more, also for devices and rooms that never send again. State
tables are read by Spark's own state source, at any batch that the checkpoint still has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from wardline.config import DEFAULT, Config
from wardline.streaming import manifest
from wardline.streaming.pipeline import ALARM_CHANGE, ALARM_STATE, FallDedup


def arrived(events: DataFrame, lateness_ms: int = 60_000) -> DataFrame:
    """The stream with the arrival clock as its watermark. lateness_ms: how far batches may be out of the order of arrival;
    what is later than that is dropped by Spark, so it must cover the disorder of the source."""
    return events.withColumn("arrival", F.timestamp_millis("received_ms")).withWatermark("arrival", f"{lateness_ms} milliseconds")


class ExpiringFallDedup(FallDedup):
    """The fold of fall warnings; each device's one timer stands at the moment at which its oldest open alarm is out of reach."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, after, out = self.folded(key[0], rows)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(self.due(before))
            self.arm(after)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        alarms = list(self.open.get())
        cutoff = timerValues.getCurrentWatermarkInMs() - self.past_limit_ms - self.window_ms
        first = next((i for i, a in enumerate(alarms) if a[3] >= cutoff), len(alarms))  # a younger one keeps all after it
        self.hold([tuple(a) for a in alarms[first:]])
        self.arm(alarms[first][3] if first < len(alarms) else None)  # Spark drops the one that expired
        yield from ()

    def due(self, time_ms: int) -> int:
        return time_ms + self.past_limit_ms + self.window_ms + 1

    def arm(self, time_ms: int | None) -> None:
        if time_ms is not None:
            self.handle.registerTimer(self.due(time_ms))


def expiring_alarm_changes(events: DataFrame, config: Config = DEFAULT, slack: int | None = 2, lateness_ms: int = 60_000) -> DataFrame:
    """As pipeline.alarm_changes, with timers."""
    falls = arrived(events.where("type = 'fall_warn'"), lateness_ms).select("arrival", "device_id", "room_id", "ord", "received_ms", "t_ms", "seq", "confidence")
    return falls.groupBy("device_id").transformWithState(
        ExpiringFallDedup(config.dedup_window_ms, slack, config.past_limit_ms), outputStructType=ALARM_CHANGE, outputMode="Update", timeMode="EventTime"
    )


ROOM_CHANGE = "room_id string, t_ms long, in_room boolean, points int"
POINT = "in_room boolean, ord long"


class RoomTimelines(StatefulProcessor):
    """Points of presence by time for each room, in a map: a late point goes to its own place, the last arrival wins among equal
    times. Points before the retention cutoff go, but for the last of them, which is the state carried into every window.

    Gives the room's latest point and how many are kept after each batch that touches it.
    """

    def __init__(self, retention_ms: int) -> None:
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", "t_ms long", POINT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t_ms", "ord"]).drop_duplicates("t_ms", keep="last")
        for t, v, n in zip(new["t_ms"].tolist(), new["in_room"].tolist(), new["ord"].tolist(), strict=True):
            if not self.points.containsKey((t,)) or self.points.getValue((t,))[1] < n:
                self.points.updateValue((t,), (v, n))
        yield self.summary(key[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.summary(key[0], timerValues)

    def summary(self, room: str, timerValues) -> pd.DataFrame:
        times = sorted(t for (t,) in self.points.keys())
        cutoff = max(0, timerValues.getCurrentWatermarkInMs()) - self.retention_ms
        before = [t for t in times if t <= cutoff]
        for t in before[:-1]:
            self.points.removeKey((t,))
        kept = times[max(0, len(before) - 1) :]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if len(kept) > 1:  # until the second point is out of reach, the first one is needed
            self.handle.registerTimer(kept[1] + self.retention_ms + 1)
        return pd.DataFrame({"room_id": [room], "t_ms": [kept[-1]], "in_room": [self.points.getValue((kept[-1],))[0]], "points": [len(kept)]})


def room_changes(events: DataFrame, config: Config = DEFAULT, lateness_ms: int = 60_000) -> DataFrame:
    """A stream of each touched room's latest state; its timeline stays in the state table `points`."""
    presence = arrived(events.where("type = 'presence'"), lateness_ms).select("arrival", "room_id", "t_ms", "in_room", "ord")
    return presence.groupBy("room_id").transformWithStateInPandas(
        RoomTimelines(config.max_occupancy_window_ms + config.retention_grace_ms), outputStructType=ROOM_CHANGE, outputMode="Update", timeMode="EventTime"
    )


def state_table(spark: SparkSession, checkpoint: str, name: str, batch_id: int | None = None) -> DataFrame:
    """A state variable as Spark's state source gives it: key and value structs of each entry."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    return (reader if batch_id is None else reader.option("batchId", batch_id)).load(checkpoint)


def open_alarms(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Alarms that warnings may still join: device_id and the fields of pipeline.ALARM_STATE."""
    d = state_table(spark, checkpoint, "open", batch_id)
    return d.select("key.device_id", *[f"list_element.{c.split()[0]}" for c in ALARM_STATE.split(", ")])


def room_points(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """room_id, t_ms, in_room, ord: the kept timelines, which operators.occupancy.from_points reads."""
    d = state_table(spark, checkpoint, "points", batch_id)
    return d.select("key.room_id", "user_map_key.t_ms", "user_map_value.in_room", "user_map_value.ord")


def write_rooms(changes: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """The latest state of rooms that a batch touched goes to root/rooms."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if manifest.begin(spark, root, "rooms", batch_id):
            place = manifest.publish(batch, root, "rooms", batch_id)
            manifest.commit(spark, root, "rooms", batch_id, rows=spark.read.schema(ROOM_CHANGE).parquet(place).count())

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
