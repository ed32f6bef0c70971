"""Synthetic fleets: weighted event types, jitter copies of falls, offline replay, clock skew and bursts.

Everything is derived from row numbers by hashes, so a workload of any size is made in parallel and is the same in
each run. The truth (events sent, distinct falls) follows from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Weights of event types, in the order they are drawn.
WEIGHTS = {"heartbeat": 50, "motion": 15, "presence": 4, "sleep_state": 3, "net_status": 3, "fall_warn": 1}
DEVICES_PER_ROOM, MAX_COPIES = 2, 3


@dataclass(frozen=True)
class Scenario:
    """What happens in a run: events of each second and device, and disturbances."""

    seconds: int = 60
    devices: int = 50
    per_second: float = 0.2
    bursts: bool = False
    offline: bool = False
    skew: bool = False

    #: Bursts of ten times the rate from these seconds on, for 30 s; a fifth of the devices go
    #: offline at 30 s for 60 s; skewed clocks are 30 s ahead or behind.
    BURST_AT = (15, 90)
    BURST_FACTOR, BURST_S = 10, 30
    OFFLINE_AT, OFFLINE_S, OFFLINE_SHARE = 30, 60, 5
    SKEW_MS = 30_000


SCENARIOS = {
    "smoke": Scenario(30), "baseline": Scenario(60), "burst": Scenario(180, bursts=True), "offline": Scenario(120, offline=True),
    "adversarial": Scenario(240, bursts=True, offline=True, skew=True),
}


def _draw(n: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(n))


def generate(spark: SparkSession, scenario: Scenario, t0_ms: int = 1_704_067_200_000, seed: int = 1) -> DataFrame:
    """ord, received_ms, device_id, room_id, type, t_ms, seq and payloads, jitter copies included."""
    s = scenario
    most = s.BURST_FACTOR if s.bursts else 1
    slots = max(1, round(s.per_second * 100)) * most
    grid = spark.range(s.seconds * s.devices * slots).select(
        F.floor(F.col("id") / (s.devices * slots)).alias("second"), F.pmod(F.floor(F.col("id") / slots), F.lit(s.devices)).alias("device"), F.pmod("id", F.lit(slots)).alias("slot"), "id"
    )
    burst = F.lit(False)
    for at in s.BURST_AT if s.bursts else ():
        burst = burst | F.col("second").between(at, at + s.BURST_S - 1)
    share = F.when(burst, slots).otherwise(slots // most)
    sent = grid.where((F.col("slot") < share) & (_draw(100, F.lit(seed), "id", F.lit("sent")) == 0))
    pick, edge, kind = _draw(sum(WEIGHTS.values()), F.lit(seed), "id", F.lit("type")), 0, F.lit(None).cast("string")
    for name, w in reversed(WEIGHTS.items()):
        edge = sum(list(WEIGHTS.values())[: list(WEIGHTS).index(name) + 1])
        kind = F.when(pick < edge, name).otherwise(kind)
    e = sent.withColumn("type", kind).withColumn("at_ms", t0_ms + F.col("second") * 1000 + _draw(1000, F.lit(seed), "id", F.lit("ms")))
    e = e.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("type") == "fall_warn", _draw(MAX_COPIES, F.lit(seed), "id", F.lit("copies"))).otherwise(F.lit(0)).cast("long"))))
    skew = (_draw(2, F.lit(seed), "device", F.lit("sign")) * 2 - 1) * s.SKEW_MS if s.skew else F.lit(0)
    away = (_draw(s.OFFLINE_SHARE, F.lit(seed), "device", F.lit("away")) == 0) & F.col("second").between(s.OFFLINE_AT, s.OFFLINE_AT + s.OFFLINE_S - 1) if s.offline else F.lit(False)
    back = t0_ms + (s.OFFLINE_AT + s.OFFLINE_S) * 1000
    value = lambda n, name: _draw(n, F.lit(seed), "id", F.lit(name))
    only = lambda name, x: F.when(F.col("type") == name, x)
    return e.select(
        (F.col("id") * 4 + F.col("copy")).alias("ord"), F.when(away, F.greatest(F.lit(back), F.col("at_ms"))).otherwise(F.col("at_ms")).alias("received_ms"),
        F.concat(F.lit("dev_"), F.col("device").cast("string")).alias("device_id"), F.concat(F.lit("room_"), F.floor(F.col("device") / DEVICES_PER_ROOM).cast("string")).alias("room_id"), "type",
        (F.col("at_ms") + skew).cast("long").alias("t_ms"), (F.col("id") * 4 + F.col("copy")).alias("seq"), only("presence", value(10, "in") < 6).alias("in_room"), only("motion", value(101, "mag") / 100.0).alias("magnitude"),
        only("sleep_state", F.element_at(F.array(F.lit("asleep"), F.lit("awake"), F.lit("unknown")), (value(3, "state") + 1).cast("int"))).alias("state"),
        only("fall_warn", (70 + value(30, "conf")) / 100.0).alias("confidence"), only("net_status", (-90 + value(41, "rssi")).cast("double")).alias("rssi"), F.col("id").alias("origin"),
    )


def truth(generated: DataFrame) -> DataFrame:
    """One row: total events (copies included) and distinct falls."""
    return generated.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.when(F.col("type") == "fall_warn", F.col("origin"))).alias("distinct_falls"))
