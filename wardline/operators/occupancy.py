"""Room occupancy as of a time: the integral of a step function over the last window.

A room's state is what the last presence event says; before the first it is empty. What is older than any window comes
down to one point for each room by an aggregation with map-side combine; only the points after it are
ordered, so the cost of the window function follows the retention, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from wardline.config import DEFAULT, Config


def timeline(events: DataFrame) -> DataFrame:
    """room_id, t_ms, in_room: one point for each time, the last arrival wins."""
    return events.where("type = 'presence'").groupBy("room_id", "t_ms").agg(F.max_by("in_room", "ord").alias("in_room"))


def pruned(points: DataFrame, as_of_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Points after the retention cutoff, and the last one before it."""
    cutoff = as_of_ms - config.max_occupancy_window_ms - config.retention_grace_ms
    last = points.where(F.col("t_ms") <= cutoff).groupBy("room_id").agg(F.max_by(F.struct(*points.columns), "t_ms").alias("p"))
    return points.where(F.col("t_ms") > cutoff).unionByName(last.select("p.*"))


def current_state(events: DataFrame) -> DataFrame:
    """room_id, in_room, t_ms: the latest point, also if its time is ahead."""
    at = F.struct("t_ms", "ord")
    return events.where("type = 'presence'").groupBy("room_id").agg(F.max_by("in_room", at).alias("in_room"), F.max("t_ms").alias("t_ms"))


def occupied(events: DataFrame, window_ms: int, as_of_ms: int, config: Config = DEFAULT) -> DataFrame:
    """room_id, in_room, occupied_ms, transitions for each room with a presence event.

    One pass: everything up to the retention cutoff (and the window's start) is one point for each room, its last; only the
    points after it are told apart and ordered.
    """
    start = as_of_ms - max(window_ms, 0)
    cutoff = as_of_ms - config.max_occupancy_window_ms - config.retention_grace_ms
    old = F.col("t_ms") <= min(start, cutoff)
    last = F.max(F.struct("t_ms", "ord", "in_room")).alias("p")
    points = events.where("type = 'presence'").groupBy("room_id", F.when(~old, F.col("t_ms")).alias("__t")).agg(last).select("room_id", "p.t_ms", "p.in_room")
    t, order = F.col("t_ms"), Window.partitionBy("room_id").orderBy("t_ms")
    end = F.least(F.coalesce(F.lead("t_ms").over(order), F.lit(as_of_ms)), F.lit(as_of_ms))
    d = points.withColumn("lasts", F.when(F.col("in_room"), F.greatest(end - F.greatest(t, F.lit(start)), F.lit(0))).otherwise(0))
    after = F.count_if(t > cutoff) + F.max((t <= cutoff).cast("int"))
    return d.groupBy("room_id").agg(F.max_by("in_room", "t_ms").alias("in_room"), F.sum("lasts").cast("long").alias("occupied_ms"), after.cast("int").alias("transitions"))


def from_points(points: DataFrame, window_ms: int, as_of_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Occupancy of all rooms from timelines (room_id, t_ms, in_room, ord) that a stream or a snapshot has kept."""
    return room_occupancy(points.withColumn("type", F.lit("presence")), window_ms, as_of_ms, config=config)


def room_occupancy(events: DataFrame, window_ms: int, as_of_ms: int, keys: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Occupancy of all rooms, or of those in keys (room_id), unknown ones included."""
    found = occupied(events, window_ms, as_of_ms, config).withColumn("known", F.lit(True))
    d = found if keys is None else keys.select("room_id").distinct().join(found, "room_id", "left")
    ms = F.coalesce("occupied_ms", F.lit(0)).cast("long")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ms / F.lit(float(window_ms)))) if window_ms > 0 else F.lit(0.0)
    return d.select(
        "room_id", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("in_room", F.lit(False)).alias("in_room"), F.round(share, 6).alias("occupied_pct"),
        F.round(ms / F.lit(1000.0), 3).alias("occupied_seconds"), F.bround(F.lit(window_ms / 1000.0), 0).cast("int").alias("window_seconds"),
        F.coalesce("transitions", F.lit(0)).alias("transitions"), ms.alias("occupied_ms"),
    )
