"""Sensor events derived from the `events` test table by integer rules that any SQL engine repeats exactly.

Thirty days are compressed to one hour, users become devices (two to a room), the five event types become six,
and fall warnings get one to three jitter copies. `ord`, the arrival key, orders by received_ms, then event_id,
then copy, without numbering all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

T0, COMPRESS = 1_704_067_200_000, 720

TYPE = "CASE event_type WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'presence' WHEN 'error' THEN 'fall_warn' WHEN 'purchase' THEN 'motion' ELSE CASE WHEN event_id % 2 = 0 THEN 'sleep_state' ELSE 'net_status' END END"
STATE = "CASE event_id % 3 WHEN 0 THEN 'asleep' WHEN 1 THEN 'awake' ELSE 'unknown' END"
TIER = "CASE WHEN type = 'fall_warn' THEN 0 WHEN type IN ('presence', 'sleep_state', 'net_status') THEN 1 ELSE 2 END"
LATE = "CASE WHEN event_id % 5 = 0 THEN (event_id % 1200) * 1000 ELSE event_id % 1000 END"
ORD = f"(received_ms - {T0}) * 1073741824 + event_id * 4 + cp"


def _typed(integer_division: str, copies: str, micros: str) -> str:
    """The derivation as SQL; what differs between engines comes as arguments."""
    return f"""
    SELECT {ORD} AS ord, received_ms, device_id, room_id, type, t_ms, seq,
           CASE WHEN type = 'presence' THEN (event_id * 7) % 10 < 6 END AS in_room,
           CASE WHEN type = 'motion' THEN (event_id % 101) / CAST(100 AS DOUBLE) END AS magnitude,
           CASE WHEN type = 'sleep_state' THEN {STATE} END AS state,
           CASE WHEN type = 'fall_warn' THEN (70 + event_id % 30) / CAST(100 AS DOUBLE) END AS confidence,
           CASE WHEN type = 'net_status' THEN CAST(-90 + event_id % 41 AS DOUBLE) END AS rssi,
           {TIER} AS tier, event_id, cp
    FROM (
      SELECT *, t_ms + {LATE} AS received_ms FROM (
        SELECT event_id, cp, type, 'dev_' || user_id AS device_id, 'room_' || (user_id {integer_division} 2) AS room_id,
               base_ms - CASE WHEN event_id % 5 = 0 THEN cp * 400 ELSE 0 END AS t_ms,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id, cp) AS BIGINT) AS seq
        FROM (
          SELECT event_id, user_id, {TYPE} AS type, {T0} + ({micros} {integer_division} 1000 - {T0}) {integer_division} {COMPRESS} AS base_ms,
                 {copies} AS cp
          FROM source_events)))"""


SPARK_SQL = _typed("DIV", "explode(sequence(CAST(0 AS BIGINT), CASE WHEN event_type = 'error' THEN event_id % 3 ELSE CAST(0 AS BIGINT) END))", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
DUCK_SQL = _typed("//", "unnest(range(0, CASE WHEN event_type = 'error' THEN event_id % 3 ELSE 0 END + 1))", "epoch_us(ts)").replace("source_events", "events")


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted events in the schema of `schemas.EVENTS`, with event_id and cp of their origin."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return spark.sql(SPARK_SQL.replace("source_events", "{source_events}"), source_events=source)


#: Text of a raw event: what a device would send. The same concatenation in both engines.
RAW = """
'{"device_id":"' || device_id || '","room_id":"' || room_id || '","type":"' || type || '","ts":' || ISO || ',"seq":' || CAST(seq AS STRING)
|| CASE type WHEN 'presence' THEN ',"in_room":' || CASE WHEN in_room THEN 'true' ELSE 'false' END
             WHEN 'motion' THEN ',"magnitude":0.' || lpad(CAST(event_id % 100 AS STRING), 2, '0')
             WHEN 'sleep_state' THEN ',"state":"' || state || '"'
             WHEN 'fall_warn' THEN ',"confidence":0.' || CAST(70 + event_id % 30 AS STRING)
             WHEN 'net_status' THEN ',"rssi":' || CAST(-90 + event_id % 41 AS STRING) ELSE '' END || '}'
"""
#: Variants of every 97th event that break one rule each, by number; {x} marks the received time.
BROKEN = (
    "'[1]'", "'{\"room_id\":\"r\"}'", "'{\"device_id\":\"\"}'", "'{\"device_id\":\"d\",\"room_id\":7}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"fall\"}'", "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"motion\",\"ts\":true}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"heartbeat\",\"ts\":' || CAST(received_ms + 3600001 AS STRING) || '}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"heartbeat\",\"ts\":' || CAST(received_ms + 3600000 AS STRING) || '}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"heartbeat\",\"ts\":' || CAST(received_ms - 3600001 AS STRING) || '}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"heartbeat\",\"ts\":' || CAST(received_ms - 3600000 AS STRING) || '}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"heartbeat\",\"ts\":' || CAST(received_ms AS STRING) || ',\"seq\":1.0}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"presence\",\"ts\":' || CAST(received_ms AS STRING) || ',\"in_room\":1}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"motion\",\"ts\":' || CAST(received_ms AS STRING) || ',\"magnitude\":\"0.5\"}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"sleep_state\",\"ts\":' || CAST(received_ms AS STRING) || ',\"state\":\"dozing\"}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"fall_warn\",\"ts\":' || CAST(received_ms AS STRING) || ',\"confidence\":true}'",
    "'{\"device_id\":\"d\",\"room_id\":\"r\",\"type\":\"net_status\",\"ts\":' || CAST(received_ms AS STRING) || '}'",
)


def _raw(events: str, integer_division: str, iso: str) -> str:
    broken = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(BROKEN))
    return f"""
    SELECT ord * 2 AS ord, received_ms, {RAW.replace("ISO", iso)} AS raw FROM {events}
    UNION ALL
    SELECT ord * 2 + 1 AS ord, received_ms, CASE (event_id {integer_division} 97) % {len(BROKEN)} {broken} END AS raw FROM {events} WHERE event_id % 97 = 0 AND cp = 0"""


#: Even events carry ISO text, odd ones epoch milliseconds.
DUCK_ISO = "CASE WHEN event_id % 2 = 0 THEN '\"' || strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z\"' ELSE CAST(t_ms AS STRING) END"
DUCK_RAW_SQL = _raw("sensor", "//", DUCK_ISO)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, received_ms, raw: the events as JSON text, and broken variants of some."""
    from wardline.functions.times import to_iso

    sensor = sensor_events(spark, sf_dir).withColumn("iso", to_iso(F.col("t_ms")))
    iso = "CASE WHEN event_id % 2 = 0 THEN '\"' || iso || '\"' ELSE CAST(t_ms AS STRING) END"
    text = _raw("SENSOR", "DIV", iso).replace("{", "{{").replace("}", "}}").replace("SENSOR", "{sensor}")
    return spark.sql(text, sensor=sensor)
