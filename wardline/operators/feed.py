"""Reading the alarm log: by cursor, by time, in pages, and what a mirror lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.functions.params import page_limit, since_or_fail
from wardline.operators.dedup import public


def since_cursor(alarms: DataFrame, cursor: int, limit: int = 200_000) -> DataFrame:
    return alarms.where(F.col("cursor") > max(0, cursor)).orderBy("cursor").limit(limit)


def since_ts(alarms: DataFrame, ms: int, limit: int = 200_000) -> DataFrame:
    """Alarms later than ms, in cursor order."""
    return alarms.where(F.col("ts_ms") > ms).orderBy("cursor").limit(limit)


def since(alarms: DataFrame, raw: str | None, limit: int | str | None = None) -> DataFrame:
    kind, value = since_or_fail(alarms.sparkSession, raw)
    return (since_cursor if kind == "cursor" else since_ts)(alarms, value, page_limit(limit))


def in_room(page: DataFrame, room_id: str | None) -> DataFrame:
    """The room filter works on a page that is cut already, so a page may come out short."""
    return page if room_id is None else page.where(F.col("room_id") == room_id)


def newest(alarms: DataFrame, limit: int = 100) -> DataFrame:
    """The newest alarms first, as a list of the mirror shows them."""
    return alarms.orderBy(F.desc("cursor")).limit(limit)


def alarm_page(alarms: DataFrame, raw_since: str | None = None, limit: int | str | None = None, room_id: str | None = None) -> DataFrame:
    """One row: alarms (public fields, in cursor order), count, cursor (the log's head), page_cursor (to resume from), since."""
    page = public(in_room(since(alarms, raw_since, limit), room_id))
    rows = page.agg(F.array_sort(F.collect_list(F.struct("cursor", *[c for c in page.columns if c != "cursor"]))).alias("alarms"), F.count(F.lit(1)).alias("count"), F.max("cursor").alias("page_cursor"))
    head = alarms.agg(F.coalesce(F.max("cursor"), F.lit(0)).alias("cursor"))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(head.withColumn("one", F.lit(1))), "one").select("alarms", "count", "cursor", "page_cursor", F.lit(raw_since).alias("since"))


def stream_start(alarms: DataFrame, raw_since: str | None) -> int:
    """The cursor after which a subscriber is served: a time means the first alarm later than it, and all that follow."""
    kind, value = since_or_fail(alarms.sparkSession, raw_since)
    if kind == "cursor":
        return value
    first, head = alarms.agg(F.min(F.when(F.col("ts_ms") > value, F.col("cursor"))), F.max("cursor")).first()
    return first - 1 if first is not None else head or 0


def missing_from_mirror(alarms: DataFrame, mirror: DataFrame) -> DataFrame:
    """Alarms whose event_id the mirror lacks; of equal ids the first by cursor."""
    first = alarms.groupBy("event_id").agg(F.min("cursor").alias("cursor"))
    new = first.join(mirror.select("event_id"), "event_id", "left_anti")
    return alarms.join(new, ["event_id", "cursor"], "left_semi")


def sse(alarms: DataFrame) -> DataFrame:
    """cursor and `message`: the text of a server-sent event for each alarm."""
    data = F.to_json(F.struct(*public(alarms).columns), {"ignoreNullFields": "false"})
    return alarms.select("cursor", F.concat(F.lit("id: "), F.col("cursor").cast("string"), F.lit("\nevent: alarm\ndata: "), data, F.lit("\n\n")).alias("message"))


def sse_backlog(alarms: DataFrame, raw_since: str | None) -> DataFrame:
    """What a subscriber receives at first: part 0, the events after its start, and part 1, the cursor from which it is served live."""
    start = stream_start(alarms, raw_since)
    later = alarms.where(F.col("cursor") > start)
    head = later.agg(F.coalesce(F.max("cursor"), F.lit(start)).cast("long").alias("cursor"))
    live = head.select(F.lit(1).alias("part"), "cursor", F.format_string(": connected cursor=%d\n\n", "cursor").alias("message"))
    return sse(later).select(F.lit(0).alias("part"), "cursor", "message").unionByName(live)
