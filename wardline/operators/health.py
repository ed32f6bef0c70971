"""Device health as of a time: registry, latest room, and heartbeat coverage of the last 300 seconds.

Coverage counts distinct seconds, but a later heartbeat that falls on the same second modulo 300 hides an earlier
one, also if its clock runs ahead; the greatest second of each of the 300 slots decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.config import DEFAULT, Config
from wardline.functions.times import second_of, to_iso

#: Slots of the heartbeat ring: fixed, whatever the window.
SLOTS = 300


def registry(events: DataFrame) -> DataFrame:
    """A row for each device that sent any event: latest room, last_seen_ms, last_heartbeat_ms (future ones included)."""
    beat = F.when(F.col("type") == "heartbeat", F.col("t_ms"))
    return events.groupBy("device_id").agg(F.max_by("room_id", F.struct("t_ms", "ord")).alias("room_id"), F.max("t_ms").alias("last_seen_ms"), F.max(beat).alias("last_heartbeat_ms"))


def coverage(events: DataFrame, as_of_ms: int, window_s: int = 300) -> DataFrame:
    """device_id, heartbeats: at most 300 slots of a device leave a task before they are counted."""
    now_s = as_of_ms // 1000
    sec = second_of(F.col("t_ms"))
    slots = events.where("type = 'heartbeat'").groupBy("device_id", F.pmod(sec, F.lit(SLOTS)).alias("slot")).agg(F.max(sec).alias("sec"))
    return slots.where((F.col("sec") > now_s - window_s) & (F.col("sec") <= now_s)).groupBy("device_id").agg(F.count(F.lit(1)).alias("heartbeats"))


def health_parts(events: DataFrame, as_of_ms: int, window_s: int = 300) -> DataFrame:
    """A row for each device: said (t_ms, ord, room_id), last_seen_ms, last_heartbeat_ms, heartbeats. One pass: by device and
    slot first (slot null: no heartbeat), where at most 301 rows of a device leave a task, then by device."""
    now_s, sec = as_of_ms // 1000, second_of(F.col("t_ms"))
    beat = F.col("type") == "heartbeat"
    slots = events.groupBy("device_id", F.when(beat, F.pmod(sec, F.lit(SLOTS))).alias("slot")).agg(F.max(F.struct("t_ms", "ord", "room_id")).alias("said"), F.max(F.when(beat, F.col("t_ms"))).alias("beat_ms"))
    last = second_of(F.col("beat_ms"))  # the greatest second of the slot
    return slots.groupBy("device_id").agg(
        F.max("said").alias("said"), F.max("said.t_ms").alias("last_seen_ms"), F.max("beat_ms").alias("last_heartbeat_ms"), F.count_if((last > now_s - window_s) & (last <= now_s)).alias("heartbeats")
    )


def device_health(events: DataFrame, as_of_ms: int, keys: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Health of all devices, or of those in keys (device_id), unknown ones included."""
    window = config.heartbeat_window_seconds
    if keys is not None:
        events = events.join(F.broadcast(keys.select("device_id").distinct()) if keys.isLocal() else keys.select("device_id").distinct(), "device_id", "left_semi")
    known = health_parts(events, as_of_ms, window).withColumn("known", F.lit(True))
    d = known if keys is None else keys.select("device_id").distinct().join(known, "device_id", "left")
    beats = F.coalesce("heartbeats", F.lit(0)).cast("int")
    return d.select(
        "device_id", F.coalesce("known", F.lit(False)).alias("known"), F.col("said.room_id").alias("room_id"),
        to_iso(F.col("last_heartbeat_ms")).alias("last_heartbeat_ts"), to_iso(F.col("last_seen_ms")).alias("last_seen_ts"),
        F.round(beats / F.lit(float(window)), 6).alias("availability_5m"), beats.alias("heartbeats_5m"), F.lit(window).alias("expected_5m"),
    )


def availability_sliding(events: DataFrame, window_s: int = 300, every_s: int = 60) -> DataFrame:
    """Distinct heartbeat seconds by device in windows of window_s that end every every_s: device_id, end_s, heartbeats."""
    sec = events.where("type = 'heartbeat'").select("device_id", second_of(F.col("t_ms")).alias("sec")).distinct()
    first = (F.floor(F.col("sec") / every_s) + 1) * every_s
    ends = F.sequence(first, first + F.lit(window_s - every_s), F.lit(every_s))
    return sec.select("device_id", F.explode(ends).alias("end_s")).groupBy("device_id", "end_s").agg(F.count(F.lit(1)).alias("heartbeats"))
