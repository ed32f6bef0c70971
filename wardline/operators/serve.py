"""Rows as the JSON documents that are served: a fixed list of fields for each kind, whatever else a row has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.schemas import PUBLIC_ALARM, PUBLIC_HEALTH, PUBLIC_ROOM

FIELDS = {"device": PUBLIC_HEALTH, "room": PUBLIC_ROOM, "alarm": PUBLIC_ALARM}
#: Fields that a device that was never seen goes without; other fields without a value are null.
ABSENT_IF_UNKNOWN = ("room_id", "last_seen_ts")


def documents(rows: DataFrame, kind: str) -> DataFrame:
    """id and json of each row of a kind: device, room or alarm."""
    fields = FIELDS[kind]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if kind == "device":
        less = F.to_json(F.struct(*[c for c in fields if c not in ABSENT_IF_UNKNOWN]), {"ignoreNullFields": "false"})
        text = F.when(F.col("known"), text).otherwise(less)
    return rows.select(F.col(fields[0]).alias("id"), text.alias("json"))


def page(pages: DataFrame) -> DataFrame:
    """One JSON document of `feed.alarm_page`: alarms, count, cursor, since."""
    shown = F.transform("alarms", lambda a: F.struct(*[a[c].alias(c) for c in PUBLIC_ALARM]))
    return pages.select(F.to_json(F.struct(shown.alias("alarms"), "count", "cursor", "since"), {"ignoreNullFields": "false"}).alias("json"))
