"""Heartbeat rings: partial coverage by device and period that merges to the health of any later time, without the log.

A ring holds 300 slots, of each the greatest second that fell on it (`health.SLOTS`). Rings of different periods,
or of the same period in parts, merge by the greatest second of each slot, in any order, as often as one likes. A period is one
of arrival, so its ring is complete when the period is over, however late its events are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.config import DEFAULT, Config
from wardline.functions.times import second_of, to_iso
from wardline.operators.health import SLOTS

HOUR_MS = 3_600_000
#: Bytes of a bitmap of all slots.
BITMAP_BYTES = (SLOTS + 7) // 8


def _merged(seconds: DataFrame, *keys: str) -> DataFrame:
    """(keys, sec) -> one row for each key: `ring`, the greatest second of each slot that has one, in order of slots."""
    slots = seconds.groupBy(*keys, F.pmod("sec", F.lit(SLOTS)).alias("slot")).agg(F.max("sec").alias("sec"))
    return slots.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "sec"))), lambda x: x["sec"]).alias("ring"))  # 300 slots at most


def rings(events: DataFrame, period_ms: int = HOUR_MS) -> DataFrame:
    """device_id, period (of arrival), ring, and the registry of the period: room_id with the time it was said, last_seen_ms, last_heartbeat_ms."""
    d = events.withColumn("period", F.floor(F.col("received_ms") / period_ms))
    beats = _merged(d.where("type = 'heartbeat'").select("device_id", "period", second_of(F.col("t_ms")).alias("sec")), "device_id", "period")
    said, beat = F.struct("t_ms", "ord", "room_id"), F.when(F.col("type") == "heartbeat", F.col("t_ms"))
    seen = d.groupBy("device_id", "period").agg(F.max(said).alias("said"), F.max("t_ms").alias("last_seen_ms"), F.max(beat).alias("last_heartbeat_ms"))
    return seen.join(beats, ["device_id", "period"], "left")


def merge(parts: DataFrame) -> DataFrame:
    """Rings of any periods -> one for each device, with period null."""
    beats = _merged(parts.select("device_id", F.explode("ring").alias("sec")), "device_id")
    seen = parts.groupBy("device_id").agg(F.max("said").alias("said"), F.max("last_seen_ms").alias("last_seen_ms"), F.max("last_heartbeat_ms").alias("last_heartbeat_ms"))
    return seen.join(beats, "device_id", "left").select("device_id", F.lit(None).cast("long").alias("period"), "said", "last_seen_ms", "last_heartbeat_ms", "ring")


def health_from_rings(merged: DataFrame, as_of_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Health of all devices as `health.device_health` gives it, from one merged ring for each."""
    window, now_s = config.heartbeat_window_seconds, as_of_ms // 1000
    beats = F.size(F.filter(F.coalesce("ring", F.array().cast("array<bigint>")), lambda s: (s > now_s - window) & (s <= now_s))).cast("int")
    return merged.select(
        "device_id", F.lit(True).alias("known"), F.col("said.room_id").alias("room_id"), to_iso(F.col("last_heartbeat_ms")).alias("last_heartbeat_ts"), to_iso(F.col("last_seen_ms")).alias("last_seen_ts"),
        F.round(beats / F.lit(float(window)), 6).alias("availability_5m"), beats.alias("heartbeats_5m"), F.lit(window).alias("expected_5m"),
    )


def newest(ring: Column) -> Column:
    return F.array_max(ring)


def bitmap(ring: Column) -> Column:
    """The ring as base64 of a bitmap: bit i of the little-endian bits is set if second newest - i is in it. Older seconds are lost."""
    ages = F.filter(F.transform(ring, lambda s: newest(ring) - s), lambda a: a < SLOTS)
    byte = lambda i: F.aggregate(F.filter(ages, lambda a: F.shiftright(a, 3) == i), F.lit(0).cast("long"), lambda acc, a: acc + F.element_at(F.array(*[F.lit(1 << b).cast("long") for b in range(8)]), (a.bitwiseAND(F.lit(7)) + 1).cast("int")))
    return F.base64(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BITMAP_BYTES - 1)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")))


def seconds_of(newest_second: Column, bits: Column) -> Column:
    """The seconds of a bitmap, from the newest on."""
    digits = F.hex(F.unbase64(bits))
    byte = lambda age: F.conv(F.substring(digits, (F.shiftright(age, 3) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    ages = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda age: F.pmod(F.call_function("shiftright", byte(age), age.bitwiseAND(F.lit(7))), F.lit(2)) == 1)
    return F.transform(ages, lambda age: newest_second - age)
