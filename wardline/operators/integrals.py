"""Occupied time as prefix sums, so that a window costs two look-ups, whatever its length.

Each point of a room's timeline has `before_ms`, the occupied time up to it. Hours are summed up first and then added up
along a room, one row for each room and hour, so no task orders a room's whole history. Each hour of a room begins with a
boundary row, also if nothing happened in it, so a look-up at a time reads the rows of that hour only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

HOUR_MS = 3_600_000


def prefix_integrals(points: DataFrame, hour_ms: int = HOUR_MS) -> DataFrame:
    """points (room_id, t_ms, in_room; one for each time) -> room_id, hour, t_ms, in_room, before_ms.

    A boundary row stands at the start of each hour after a room's first, up to the table's last hour.
    """
    p = points.select("room_id", "t_ms", "in_room", F.floor(F.col("t_ms") / hour_ms).alias("hour"))
    inside = Window.partitionBy("room_id", "hour").orderBy("t_ms")
    end = F.coalesce(F.lead("t_ms").over(inside), (F.col("hour") + 1) * hour_ms)
    p = p.withColumn("lasts", F.when(F.col("in_room"), end - F.col("t_ms")).otherwise(0).cast("long"))
    own = p.groupBy("room_id", "hour").agg(F.sum("lasts").alias("own_ms"), F.min("t_ms").alias("first_ms"), F.max_by("in_room", "t_ms").alias("leaves"))
    last = own.agg(F.max("hour").alias("last_hour"), F.lit(1).alias("one"))
    along = Window.partitionBy("room_id").orderBy("hour")  # a row for each room and hour that has a point
    own = own.withColumn("enters", F.coalesce(F.lag("leaves").over(along), F.lit(False)))
    own = own.withColumn("next_hour", F.lead("hour").over(along)).withColumn("one", F.lit(1)).join(F.broadcast(last), "one")  # one row
    own = own.withColumn("quiet", F.coalesce("next_hour", F.col("last_hour") + 1) - F.col("hour") - 1)
    head = F.when(F.col("enters"), F.col("first_ms") - F.col("hour") * hour_ms).otherwise(0)
    total = F.col("own_ms") + head + F.when(F.col("leaves"), F.col("quiet") * hour_ms).otherwise(0)
    own = own.withColumn("base_ms", F.coalesce(F.sum(total).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("head_ms", head)
    own = own.withColumn("opens", (F.row_number().over(along) > 1) & (F.col("first_ms") > F.col("hour") * hour_ms))
    # boundaries: the start of the hour itself, unless it is the room's first or a point stands there, and of the quiet hours after it
    start = F.when(F.col("opens"), F.struct("hour", F.col("enters").alias("in_room"), F.col("base_ms").alias("before_ms")))
    quiet = F.transform(
        F.when(F.col("quiet") > 0, F.sequence(F.lit(1).cast("long"), F.col("quiet"))).otherwise(F.array().cast("array<bigint>")),
        lambda k: F.struct((F.col("hour") + k).alias("hour"), F.col("leaves").alias("in_room"), (F.col("base_ms") + F.col("head_ms") + F.col("own_ms") + F.when(F.col("leaves"), (k - 1) * hour_ms).otherwise(0)).alias("before_ms")),
    )
    edges = own.select("room_id", F.inline(F.concat(F.filter(F.array(start), lambda x: x.isNotNull()), quiet)))
    edges = edges.select("room_id", "hour", (F.col("hour") * hour_ms).alias("t_ms"), "in_room", F.col("before_ms").cast("long").alias("before_ms"))
    rows = p.join(own.select("room_id", "hour", "base_ms", "head_ms"), ["room_id", "hour"])
    so_far = F.coalesce(F.sum("lasts").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("room_id", "hour", "t_ms", "in_room", (F.col("base_ms") + F.col("head_ms") + so_far).cast("long").alias("before_ms")).unionByName(edges)


def write_integrals(table: DataFrame, path: str) -> None:
    """A folder for each hour, which look-ups prune to."""
    table.write.mode("overwrite").partitionBy("hour").parquet(path)


def integral_at(table: DataFrame, at_ms: int, last_hour: int, hour_ms: int = HOUR_MS) -> DataFrame:
    """room_id, occupied time up to at_ms, for rooms that have a point by then: a look-up in one hour's rows."""
    hour = min(at_ms // hour_ms, last_hour)
    row = F.max_by(F.struct("before_ms", "in_room", "t_ms"), "t_ms")
    found = table.where((F.col("hour") == hour) & (F.col("t_ms") <= at_ms)).groupBy("room_id").agg(row.alias("p"))
    return found.select("room_id", (F.col("p.before_ms") + F.when(F.col("p.in_room"), at_ms - F.col("p.t_ms")).otherwise(0)).alias("until_ms"))


def occupied_ms(table: DataFrame, windows: Sequence[tuple[int, int]], hour_ms: int = HOUR_MS) -> DataFrame:
    """windows: (as_of_ms, window_ms). room_id, as_of_ms, window_ms, occupied_ms of rooms with a point by as_of_ms: two look-ups for each."""
    last_hour: int = table.agg(F.max("hour")).first()[0] or 0
    out = None
    for now, window in windows:
        until, since = integral_at(table, now, last_hour, hour_ms), integral_at(table, now - max(0, window), last_hour, hour_ms).withColumnRenamed("until_ms", "since_ms")
        rows = until.join(since, "room_id", "left").select("room_id", F.lit(now).cast("long").alias("as_of_ms"), F.lit(window).cast("long").alias("window_ms"), _less("until_ms", "since_ms").alias("occupied_ms"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no window")
    return out


def _less(a: str, b: str) -> Column:
    return (F.col(a) - F.coalesce(F.col(b), F.lit(0))).cast("long")
