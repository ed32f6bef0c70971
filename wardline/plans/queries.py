"""Named queries over the derived sensor events, each with DuckDB SQL that gives the same rows.

Every query reads its whole tables; `as_of` is the greatest event time. Limits stand only where paging is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.config import DEFAULT
from wardline.functions import params, times
from wardline.operators import dedup, feed, health, metrics, occupancy, schedule, serve, stats, validate
from wardline.sources import bodies, log, sensors
from wardline.sources.staging import scratch, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


events = sensors.sensor_events


def as_of(ev: DataFrame) -> int:
    return ev.agg(F.max("t_ms")).first()[0] or 0


def on_sensor(sql: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}sensor AS ({sensors.DUCK_SQL}), now AS (SELECT max(t_ms) AS now FROM sensor){''.join(', ' + c for c in ctes)} {sql}"


ISO = lambda x: f"strftime(make_timestamp({x} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"

# ---- ingest -------------------------------------------------------------------------------------------------

_J = "json_type(raw, '$.{}')"
_NUM = "('BIGINT', 'UBIGINT', 'DOUBLE')"
_CHECKED = f"""
raws AS ({sensors.DUCK_RAW_SQL}),
parsed AS (
  SELECT *, CASE WHEN json_type(raw, '$.device_id') = 'VARCHAR' THEN raw ->> '$.device_id' END AS device_id,
         CASE WHEN json_type(raw, '$.room_id') = 'VARCHAR' THEN raw ->> '$.room_id' END AS room_id,
         CASE WHEN json_type(raw, '$.type') = 'VARCHAR' THEN raw ->> '$.type' END AS type,
         CASE WHEN json_type(raw, '$.ts') = 'VARCHAR' THEN epoch_us(try_strptime(raw ->> '$.ts', '%Y-%m-%dT%H:%M:%S.%gZ')) // 1000
              WHEN json_type(raw, '$.ts') IN {_NUM} THEN CASE WHEN (raw ->> '$.ts')::DOUBLE < 1e12 THEN ((raw ->> '$.ts')::DOUBLE * 1000)::BIGINT ELSE (raw ->> '$.ts')::DOUBLE::BIGINT END END AS t_ms
  FROM raws),
checked AS (
  SELECT *, CASE WHEN json_type(raw) <> 'OBJECT' THEN 'malformed'
    WHEN coalesce(device_id, '') = '' THEN 'missing_device_id' WHEN coalesce(room_id, '') = '' THEN 'missing_room_id'
    WHEN coalesce(type, '') NOT IN ('heartbeat', 'presence', 'motion', 'sleep_state', 'fall_warn', 'net_status') THEN 'bad_type'
    WHEN t_ms IS NULL THEN 'bad_ts' WHEN t_ms > received_ms + 3600000 THEN 'ts_too_future' WHEN t_ms < received_ms - 3600000 THEN 'ts_too_old'
    WHEN coalesce(json_type(raw, '$.seq'), 'NULL') NOT IN ('NULL', 'BIGINT', 'UBIGINT') THEN 'bad_seq'
    WHEN type = 'presence' AND coalesce(json_type(raw, '$.in_room'), '') <> 'BOOLEAN' THEN 'bad_in_room'
    WHEN type = 'motion' AND coalesce(json_type(raw, '$.magnitude'), '') NOT IN {_NUM} THEN 'bad_magnitude'
    WHEN type = 'sleep_state' AND coalesce(raw ->> '$.state', '') NOT IN ('asleep', 'awake', 'unknown') THEN 'bad_state'
    WHEN type = 'fall_warn' AND coalesce(json_type(raw, '$.confidence'), '') NOT IN {_NUM} THEN 'bad_confidence'
    WHEN type = 'net_status' AND coalesce(json_type(raw, '$.rssi'), '') NOT IN {_NUM} THEN 'bad_rssi' END AS reason
  FROM parsed)"""


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events as they would lie in a landing table."""
    return stage(sensors.raw_events(spark, sf_dir), "landed")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validated(landed(spark, sf_dir))


@query("ingest_reason_counts", on_sensor("SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason", _CHECKED))
def ingest_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(validate.rejects(checked(spark, sf_dir)), "reason")


@query("accepted_by_type", on_sensor("SELECT type, count(*) AS n FROM checked WHERE reason IS NULL GROUP BY type", _CHECKED))
def accepted_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(validate.accepted(checked(spark, sf_dir)), "type")


@query("accepted_events", on_sensor("""SELECT ord, received_ms, device_id, room_id, type, t_ms, (raw ->> '$.seq')::BIGINT AS seq,
  CASE WHEN type = 'presence' THEN (raw ->> '$.in_room')::BOOLEAN END AS in_room, CASE WHEN type = 'motion' THEN (raw ->> '$.magnitude')::DOUBLE END AS magnitude,
  CASE WHEN type = 'sleep_state' THEN raw ->> '$.state' END AS state, CASE WHEN type = 'fall_warn' THEN (raw ->> '$.confidence')::DOUBLE END AS confidence,
  CASE WHEN type = 'net_status' THEN (raw ->> '$.rssi')::DOUBLE END AS rssi,
  CASE WHEN type = 'fall_warn' THEN 0 WHEN type IN ('presence', 'sleep_state', 'net_status') THEN 1 ELSE 2 END AS tier FROM checked WHERE reason IS NULL""", _CHECKED))
def accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accepted(checked(spark, sf_dir))


@query("acceptance_bounds", on_sensor("SELECT t_ms - received_ms AS offset_ms, count(*) AS n, count(*) FILTER (reason IS NULL) AS accepted FROM checked WHERE abs(t_ms - received_ms) >= 3600000 GROUP BY ALL", _CHECKED))
def acceptance_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checked(spark, sf_dir).withColumn("offset_ms", F.col("t_ms") - F.col("received_ms")).where(F.abs("offset_ms") >= DEFAULT.past_limit_ms)
    return c.groupBy("offset_ms").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("accepted"))


_BODIES = """
joined AS (SELECT received_ms // 1000 AS body_id, list(raw ORDER BY ord) AS raws, list(reason ORDER BY ord) AS reasons FROM checked GROUP BY 1),
formed AS (SELECT *, CASE body_id % 50 WHEN 7 THEN 'invalid_json' WHEN 9 THEN 'empty_body' END AS body_reason FROM joined),
counted AS (SELECT body_id, body_reason, len(list_filter(reasons, lambda x: x IS NULL)) AS a, len(list_filter(reasons, lambda x: x IS NOT NULL)) AS r, list_filter(reasons, lambda x: x IS NOT NULL)[1] AS first FROM formed)"""


@query("ingest_body_status", on_sensor("""
SELECT body_id, CASE WHEN body_reason IS NOT NULL OR (a = 0 AND r = 1) THEN 400 ELSE 202 END::INT AS status, NOT (body_reason IS NOT NULL OR (a = 0 AND r = 1)) AS ok,
  CASE WHEN body_reason IS NULL THEN a ELSE 0 END AS accepted, CASE WHEN body_reason IS NULL THEN r ELSE 0 END AS rejected, coalesce(body_reason, first) AS reason FROM counted""", _CHECKED, _BODIES))
def ingest_body_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a second form a body: an array if the second is even, else lines; some bodies are broken or empty."""
    raw = landed(spark, sf_dir)
    lists = raw.groupBy(F.floor(F.col("received_ms") / 1000).alias("body_id")).agg(F.max("received_ms").alias("received_ms"), F.array_sort(F.collect_list(F.struct("ord", "raw", F.col("received_ms").alias("rx")))).alias("x"))
    lines, items = F.array_join(F.col("x.raw"), "\n"), F.concat(F.lit("["), F.array_join(F.col("x.raw"), ","), F.lit("]"))
    body = F.when(F.pmod("body_id", F.lit(50)) == 7, F.concat(lines, F.lit("\n{bad"))).when(F.pmod("body_id", F.lit(50)) == 9, "  ").when(F.col("body_id") % 2 == 0, items).otherwise(lines)
    times_of = lists.select("body_id", F.posexplode("x.rx").alias("pos", "rx"))
    rows = bodies.parsed(lists.select("body_id", "received_ms", body.alias("body")))
    timed = rows.join(times_of, ["body_id", "pos"], "left").withColumn("received_ms", F.coalesce("rx", "received_ms")).withColumn("ord", F.col("pos").cast("long"))
    return bodies.statuses(validate.validated(timed))


# ---- scalar functions ---------------------------------------------------------------------------------------


@query("ts_parse_roundtrip", on_sensor(f"SELECT ord, {ISO('t_ms')} AS iso, t_ms AS from_iso, t_ms AS from_number, t_ms // 86400000 AS day FROM sensor"))
def ts_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso, t = times.to_iso(F.col("t_ms")), F.col("t_ms")
    d = events(spark, sf_dir).select("ord", iso.alias("iso"), "t_ms")
    date = F.date_from_unix_date(F.floor(t / 86_400_000).cast("int"))
    return d.select("ord", "iso", times.iso_ms(F.col("iso")).alias("from_iso"), times.number_ms(t.cast("double")).alias("from_number"), times.days_from_civil(F.year(date), F.month(date), F.day(date)).cast("long").alias("day"))


#: Parameters made from events by rules, and their meaning by arithmetic on the same numbers. Literal cases are in the tests.
_N = "event_id % 97"


@query("window_parse", on_sensor(f"""
SELECT ord, CASE WHEN n = 0 AND kind < 5 OR kind = 6 THEN NULL ELSE least(3600000, CASE kind WHEN 0 THEN n * 1000 WHEN 1 THEN n * 60000 WHEN 2 THEN n WHEN 3 THEN n * 3600000 WHEN 4 THEN n * 1000 WHEN 5 THEN 500 + 1000 * n END) END AS ms
FROM (SELECT ord, {_N} AS n, event_id % 7 AS kind FROM sensor)"""))
def window_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window parameter for each event, of every unit, and some that are none."""
    raw = "CASE event_id % 7 WHEN 0 THEN n || 's' WHEN 1 THEN ' ' || n || 'M ' WHEN 2 THEN n || ' ms' WHEN 3 THEN n || 'h' WHEN 4 THEN '' || n WHEN 5 THEN n || '.5s' ELSE n || ' days' END"
    d = events(spark, sf_dir).selectExpr("ord", "event_id", f"{_N} AS n").selectExpr("ord", f"{raw} AS raw")
    return d.select("ord", params.window_ms(F.col("raw"), DEFAULT.max_occupancy_window_ms).alias("ms"))


@query("since_parse", on_sensor("""
SELECT ord, CASE kind WHEN 0 THEN 'cursor' WHEN 4 THEN 'invalid' WHEN 5 THEN 'cursor' ELSE 'ts' END AS kind, CASE kind WHEN 0 THEN event_id WHEN 4 THEN NULL WHEN 5 THEN 0 WHEN 3 THEN t_ms // 86400000 * 86400000 ELSE t_ms END AS value
FROM (SELECT *, event_id % 6 AS kind FROM sensor)"""))
def since_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter for each event: a cursor, a time as number, text or date, nothing, and some that are none."""
    d = events(spark, sf_dir).withColumn("iso", times.to_iso(F.col("t_ms")))
    raw = "CASE event_id % 6 WHEN 0 THEN '' || event_id WHEN 1 THEN ' ' || t_ms || ' ' WHEN 2 THEN iso WHEN 3 THEN left(iso, 10) WHEN 4 THEN '-' || event_id ELSE '  ' END"
    d = d.selectExpr("ord", f"{raw} AS raw").withColumn("s", params.since(F.col("raw")))
    return d.select("ord", "s.kind", "s.value")


# ---- devices ------------------------------------------------------------------------------------------------

_REGISTRY = "reg AS (SELECT device_id, arg_max(room_id, (t_ms, ord)) AS room_id, max(t_ms) AS last_seen_ms, max(t_ms) FILTER (type = 'heartbeat') AS last_heartbeat_ms FROM sensor GROUP BY device_id)"
_COVER = """cover AS (SELECT device_id, count(*) AS n FROM (SELECT device_id, (t_ms // 1000) % 300 AS slot, max(t_ms // 1000) AS sec FROM sensor WHERE type = 'heartbeat' GROUP BY ALL), now
  WHERE sec > now // 1000 - 300 AND sec <= now // 1000 GROUP BY device_id)"""
_HEALTH = f"""SELECT {{key}} AS device_id, reg.device_id IS NOT NULL AS known, room_id, {ISO("last_heartbeat_ms")} AS last_heartbeat_ts, {ISO("last_seen_ms")} AS last_seen_ts,
  round(coalesce(n, 0) / 300.0::DOUBLE, 6) AS availability_5m, coalesce(n, 0)::INT AS heartbeats_5m, 300::INT AS expected_5m"""


@query("device_registry", on_sensor("SELECT * FROM reg", _REGISTRY))
def device_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.registry(events(spark, sf_dir))


@query("device_latest_room", on_sensor("SELECT device_id, room_id FROM reg", _REGISTRY))
def device_latest_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.registry(events(spark, sf_dir)).select("device_id", "room_id")


@query("device_last_heartbeat", on_sensor("SELECT device_id, last_heartbeat_ms FROM reg WHERE last_heartbeat_ms IS NOT NULL", _REGISTRY))
def device_last_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.registry(events(spark, sf_dir)).where("last_heartbeat_ms IS NOT NULL").select("device_id", "last_heartbeat_ms")


@query("device_health_5m", on_sensor(_HEALTH.format(key="reg.device_id") + " FROM reg LEFT JOIN cover USING (device_id)", _REGISTRY, _COVER))
def device_health_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return health.device_health(ev, as_of(ev))


@query("device_health_lookup", on_sensor(_HEALTH.format(key="k.device_id") + " FROM (SELECT 'dev_' || i AS device_id FROM range(0, 40) t(i)) k LEFT JOIN reg ON reg.device_id = k.device_id LEFT JOIN cover ON cover.device_id = k.device_id", _REGISTRY, _COVER))
def device_health_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a look-up of stated ids, known or not."""
    ev = events(spark, sf_dir)
    keys = spark.range(40).select(F.concat(F.lit("dev_"), F.col("id").cast("string")).alias("device_id"))
    return health.device_health(ev, as_of(ev), keys)


@query("availability_sliding_5m", on_sensor("""SELECT device_id, end_s, count(*) AS heartbeats FROM (
  SELECT device_id, unnest(range((sec // 60 + 1) * 60, (sec // 60 + 1) * 60 + 300, 60)) AS end_s FROM (SELECT DISTINCT device_id, t_ms // 1000 AS sec FROM sensor WHERE type = 'heartbeat')) GROUP BY ALL"""))
def availability_sliding_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.availability_sliding(events(spark, sf_dir))


# ---- rooms --------------------------------------------------------------------------------------------------

_POINTS = "points AS (SELECT room_id, t_ms, arg_max(in_room, ord) AS in_room FROM sensor WHERE type = 'presence' GROUP BY ALL)"


def _occupancy_sql(window_ms: int) -> str:
    return on_sensor(f"""
SELECT room_id, true AS known, arg_max(in_room, t_ms) AS in_room,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, sum(occ)::DOUBLE / {window_ms})), 6) AS occupied_pct, round(sum(occ)::DOUBLE / 1000.0, 3) AS occupied_seconds, {window_ms // 1000}::INT AS window_seconds,
  (count(*) FILTER (t_ms > now - 3900000) + max(CASE WHEN t_ms <= now - 3900000 THEN 1 ELSE 0 END))::INT AS transitions, sum(occ)::BIGINT AS occupied_ms
FROM (SELECT *, CASE WHEN in_room THEN greatest(0, least(coalesce(lead(t_ms) OVER (PARTITION BY room_id ORDER BY t_ms), now), now) - greatest(t_ms, now - {window_ms})) ELSE 0 END AS occ FROM points, now)
GROUP BY room_id""", _POINTS)


def _occupancy(raw: str, window_ms: int) -> None:
    @query(f"room_occupancy_{raw}", _occupancy_sql(window_ms))
    def room_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = events(spark, sf_dir)
        return occupancy.room_occupancy(ev, params.window_or_fail(spark, raw, DEFAULT.max_occupancy_window_ms), as_of(ev))


for _raw, _ms in (("1m", 60_000), ("5m", 300_000), ("1h", 3_600_000)):
    _occupancy(_raw, _ms)


@query("room_timeline", on_sensor("SELECT * FROM points", _POINTS))
def room_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.timeline(events(spark, sf_dir))


@query("room_current_state", on_sensor("SELECT room_id, arg_max(in_room, t_ms) AS in_room, max(t_ms) AS t_ms FROM points GROUP BY room_id", _POINTS))
def room_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.current_state(events(spark, sf_dir))


#: The data span an hour, so retention is asked for as of half an hour past the end: only then points are pruned.
@query("room_pruned_transitions", on_sensor("""SELECT room_id, count(*) AS transitions FROM (
  SELECT *, max(t_ms) FILTER (t_ms <= now + 1800000 - 3900000) OVER (PARTITION BY room_id) AS last FROM points, now) WHERE t_ms > now + 1800000 - 3900000 OR t_ms = last GROUP BY room_id""", _POINTS))
def room_pruned_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    kept = occupancy.pruned(occupancy.timeline(ev), as_of(ev) + 1_800_000)
    return kept.groupBy("room_id").agg(F.count(F.lit(1)).alias("transitions"))


# ---- alarms -------------------------------------------------------------------------------------------------


def _alarms_sql(window_ms: int, slack: int | None) -> str:
    guard = "" if slack is None else f" AND (q IS NULL OR a.q0 IS NULL OR q BETWEEN a.q0 - {slack} AND a.q1 + {slack})"
    fields = "STRUCT(ord BIGINT, t0 BIGINT, room_id VARCHAR, ts_ms BIGINT, confidence DOUBLE, dups INT, q0 BIGINT, q1 BIGINT)[]"
    return f"""
falls AS (SELECT device_id, room_id, ord, t_ms AS t, seq AS q, confidence AS c, row_number() OVER (PARTITION BY device_id ORDER BY ord) AS rn FROM sensor WHERE type = 'fall_warn'),
fold AS (
  SELECT DISTINCT device_id, 0::BIGINT AS rn, []::{fields} AS al FROM falls
  UNION ALL
  SELECT device_id, rn, CASE WHEN coalesce(m, 0) = 0 THEN list_append(al, {{'ord': ord, 't0': t, 'room_id': room_id, 'ts_ms': t, 'confidence': c, 'dups': 0::INT, 'q0': q, 'q1': q}})
    ELSE list_transform(al, lambda a, i: CASE WHEN i = m THEN {{'ord': a.ord, 't0': a.t0, 'room_id': a.room_id, 'ts_ms': least(a.ts_ms, t), 'confidence': greatest(a.confidence, c), 'dups': a.dups + 1, 'q0': least(a.q0, q), 'q1': greatest(a.q1, q)}} ELSE a END) END AS al
  FROM (SELECT f.*, z.al, list_position(list_transform(z.al, lambda a: abs(f.t - a.ts_ms) <= {window_ms}{guard.replace("q IS", "f.q IS").replace("q BETWEEN", "f.q BETWEEN")}), true) AS m
        FROM fold z JOIN falls f ON f.device_id = z.device_id AND f.rn = z.rn + 1)),
alarms AS (
  SELECT 'fall_' || device_id || '_' || t0 AS event_id, device_id, room_id, {ISO("ts_ms")} AS ts, ts_ms, confidence, row_number() OVER (ORDER BY ord) AS cursor, dups AS duplicates_collapsed, q0 AS seq_min, q1 AS seq_max
  FROM (SELECT device_id, unnest(arg_max(al, rn), recursive := true) FROM fold GROUP BY device_id))"""


def on_alarms(sql: str, window_ms: int = 1000, slack: int | None = 2, *ctes: str) -> str:
    return on_sensor(sql, _alarms_sql(window_ms, slack), *ctes, recursive=True)


def alarms(spark: SparkSession, sf_dir: str, window_ms: int = 1000, slack: int | None = 2) -> DataFrame:
    return dedup.alarm_log(events(spark, sf_dir), window_ms, slack)


def _fall_dedup(name: str, window_ms: int, slack: int | None) -> None:
    @query(f"fall_dedup_{name}", on_alarms("SELECT * FROM alarms", window_ms, slack))
    def fall_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
        return alarms(spark, sf_dir, window_ms, slack)


for _name, _window, _slack in (("0ms", 0, 2), ("1s", 1000, 2), ("60s", 60_000, 2), ("60s_noguard", 60_000, None)):
    _fall_dedup(_name, _window, _slack)


@query("fall_session_window", on_sensor("""SELECT device_id, min(t_ms) AS start_ms, count(*) AS copies FROM (
  SELECT *, sum(gap) OVER (PARTITION BY device_id ORDER BY t_ms, ord ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY device_id ORDER BY t_ms, ord) > 1000 THEN 1 ELSE 0 END AS gap FROM sensor WHERE type = 'fall_warn')) GROUP BY device_id, island"""))
def fall_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.session_alarms(events(spark, sf_dir), DEFAULT.dedup_window_ms)


_PUBLIC = "event_id, device_id, room_id, ts, confidence, cursor, duplicates_collapsed"


@query("alarm_feed_since_cursor", on_alarms(f"SELECT {_PUBLIC} FROM alarms WHERE cursor > 100 ORDER BY cursor LIMIT 50"))
def alarm_feed_since_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.public(feed.since_cursor(alarms(spark, sf_dir), 100, 50))


#: Half an hour into the data.
MIDDLE_MS = sensors.T0 + 1_800_000


@query("alarm_feed_since_ts", on_alarms(f"SELECT {_PUBLIC} FROM alarms WHERE ts_ms > {MIDDLE_MS} ORDER BY cursor LIMIT 200"))
def alarm_feed_since_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.public(feed.since_ts(alarms(spark, sf_dir), MIDDLE_MS, 200))


@query("alarm_feed_room_after_limit", on_alarms(f"SELECT {_PUBLIC} FROM (SELECT * FROM alarms WHERE cursor > 0 ORDER BY cursor LIMIT 150) WHERE room_id = 'room_3'"))
def alarm_feed_room_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.public(feed.in_room(feed.since_cursor(alarms(spark, sf_dir), 0, 150), "room_3"))


@query("alarm_page", on_alarms("SELECT string_agg(event_id, ',' ORDER BY cursor) AS ids, count(*) AS count, (SELECT max(cursor) FROM alarms) AS cursor, max(cursor) AS page_cursor, '20' AS since FROM (SELECT * FROM alarms WHERE cursor > 20 ORDER BY cursor LIMIT 30)"))
def alarm_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = feed.alarm_page(dedup.alarm_log(events(spark, sf_dir)), "20", "30")
    return page.select(F.array_join("alarms.event_id", ",").alias("ids"), "count", "cursor", "page_cursor", "since")


@query("alarm_mirror_antijoin", on_alarms("SELECT event_id, min(cursor) AS cursor FROM alarms WHERE event_id NOT IN (SELECT event_id FROM alarms WHERE cursor % 3 = 0) GROUP BY event_id"))
def alarm_mirror_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alarms(spark, sf_dir)
    return feed.missing_from_mirror(found, found.where("cursor % 3 = 0")).select("event_id", "cursor")


@query("cursor_density_check", on_alarms("SELECT count(*) AS n, count(DISTINCT cursor) AS cursors, min(cursor) AS first, max(cursor) AS last, count(DISTINCT event_id) AS ids FROM alarms"))
def cursor_density_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cursor").alias("cursors"), F.min("cursor").alias("first"), F.max("cursor").alias("last"), F.countDistinct("event_id").alias("ids"))


@query("dedup_scorecard", on_alarms("SELECT a AS alarms, f AS distinct_falls, a - f AS delta, CASE WHEN a > f THEN 'leaking' WHEN a < f THEN 'missing' ELSE 'ok' END AS verdict FROM (SELECT (SELECT count(*) FROM alarms) AS a, (SELECT count(DISTINCT event_id) FROM sensor WHERE type = 'fall_warn') AS f)"))
def dedup_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    found = dedup.fold_falls(ev).agg(F.count(F.lit(1)).alias("alarms"), F.lit(1).alias("one"))
    real = ev.where("type = 'fall_warn'").agg(F.countDistinct("event_id").alias("distinct_falls"), F.lit(1).alias("one"))
    return found.join(real, "one").select("alarms", "distinct_falls", (F.col("alarms") - F.col("distinct_falls")).alias("delta"), metrics.scorecard(F.col("alarms"), F.col("distinct_falls")).alias("verdict"))


@query("fleet_gauges", on_alarms("SELECT (SELECT count(DISTINCT device_id) FROM sensor) AS devices, (SELECT count(DISTINCT room_id) FROM sensor WHERE type = 'presence') AS rooms, (SELECT count(*) FROM sensor) AS events, count(*) AS alarms, sum(duplicates_collapsed)::BIGINT AS duplicates_collapsed FROM alarms"))
def fleet_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return metrics.gauges(ev, dedup.fold_falls(ev))


# ---- metrics and scheduling ---------------------------------------------------------------------------------

_LATENCY = "lat AS (SELECT ord, received_ms - t_ms AS value FROM sensor)"


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("ord", (F.col("received_ms") - F.col("t_ms")).alias("value"))


#: Bounds of latency buckets, written out so that the query's own can't vouch for themselves.
_BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def _histogram_sql(rows: str) -> str:
    bars = [f"SELECT {i}::INT AS i, '{b}' AS le, count(*) FILTER (value <= {b}) AS n, sum(value)::BIGINT AS sum, count(*) AS count FROM {rows}" for i, b in enumerate(_BOUNDS)]
    return " UNION ALL ".join([*bars, f"SELECT {len(_BOUNDS)}::INT, '+Inf', count(*), sum(value)::BIGINT, count(*) FROM {rows}"])


@query("latency_histogram", on_sensor(_histogram_sql("lat"), _LATENCY))
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(latencies(spark, sf_dir))


_QUANTILES = ", ".join(f"quantile_disc(value, {q})::DOUBLE AS p{round(q * 100)}" for q in metrics.QUANTILES)


@query("latency_quantiles", on_sensor(f"SELECT {_QUANTILES} FROM lat", _LATENCY))
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quantiles(latencies(spark, sf_dir)).select(*[F.col(f"p{round(q * 100)}").cast("double").alias(f"p{round(q * 100)}") for q in metrics.QUANTILES])


@query("latency_last_n_quantiles", on_sensor(f"SELECT {_QUANTILES} FROM (SELECT * FROM lat ORDER BY ord DESC LIMIT {metrics.RING})", _LATENCY))
def latency_last_n_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the newest 20,000 observations."""
    return metrics.quantiles(metrics.last_n(latencies(spark, sf_dir))).select(*[F.col(f"p{round(q * 100)}").cast("double").alias(f"p{round(q * 100)}") for q in metrics.QUANTILES])


@query("sla_share", on_sensor("SELECT count(*) FILTER (value <= 1000) AS within, count(value) AS total, avg(CASE WHEN value <= 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM lat", _LATENCY))
def sla_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.share_within(latencies(spark, sf_dir), 1000)


@query("ingest_rate_30s", on_sensor("SELECT received_ms // 30000 * 30000 AS start_ms, count(*) AS events, count(*) / 30.0::DOUBLE AS per_second FROM sensor GROUP BY 1"))
def ingest_rate_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(events(spark, sf_dir))


@query("tier_depth", on_sensor("SELECT tier, count(*) AS depth FROM sensor GROUP BY tier"))
def tier_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.depths(events(spark, sf_dir))


DRAIN = 5000


@query("tier_schedule", on_sensor(f"""
SELECT ord, tier, position::INT AS position FROM (
  SELECT ord, tier, CASE tier WHEN 0 THEN CASE WHEN k <= a0 THEN k END
    WHEN 1 THEN CASE WHEN k <= a1 THEN a0 + k WHEN k <= a1 + least(n1 - a1, r - a1 - a2) THEN a0 + a2 + k END
    ELSE CASE WHEN k <= a2 THEN a0 + a1 + k END END AS position
  FROM (SELECT *, least(n2, r - a1) AS a2 FROM (SELECT *, least(n1, r - r // 4) AS a1 FROM (SELECT *, {DRAIN} - a0 AS r FROM (SELECT *, least(n0, {DRAIN}) AS a0 FROM (
    SELECT ord, tier, row_number() OVER (PARTITION BY tier ORDER BY ord) AS k, count(*) FILTER (tier = 0) OVER () AS n0, count(*) FILTER (tier = 1) OVER () AS n1, count(*) FILTER (tier = 2) OVER () AS n2 FROM sensor))))))
WHERE position IS NOT NULL"""))
def tier_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a drain of a stated size."""
    return schedule.drained(events(spark, sf_dir), DRAIN).select("ord", "tier", F.col("position").cast("int").alias("position"))


_EVERY_64TH = "nth AS (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY ord) AS k FROM lat) WHERE k % 64 = 0)"


@query("latency_sampled_histogram", on_sensor(_histogram_sql("nth"), _LATENCY, _EVERY_64TH))
def latency_sampled_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a sample: every 64th event in order of arrival."""
    return metrics.histogram(metrics.sampled(latencies(spark, sf_dir)))


def _lines_sql(part: int, rows: str, name: str, text: str) -> str:
    return f"""
SELECT {part} AS part, (row_number() OVER (ORDER BY i, k) - 1)::INT AS i, line FROM (
  SELECT i, k, line FROM (SELECT -1 AS i, 0 AS k, '# HELP {name} {text}' AS line UNION ALL SELECT -1, 1, '# TYPE {name} histogram'
    UNION ALL SELECT i, 2, '{name}_bucket{{le="' || le || '"}} ' || n FROM ({rows}) UNION ALL SELECT i, 3, '{name}_sum ' || printf('%g', sum::DOUBLE) FROM ({rows}) WHERE le = '+Inf'
    UNION ALL SELECT i, 4, '{name}_count ' || count FROM ({rows}) WHERE le = '+Inf'))"""


_SERIES = """
counted AS (
  SELECT 'events_accepted_total' AS name, NULL AS labels, count(*) AS value FROM sensor
  UNION ALL SELECT 'events_accepted_by_type_total', 'type="' || type || '"', count(*) FROM sensor GROUP BY type
  UNION ALL SELECT 'alarms_created_total', NULL, count(*) FROM alarms UNION ALL SELECT 'alarms_duplicates_collapsed_total', NULL, sum(duplicates_collapsed) FROM alarms),
gauged AS (
  SELECT 'devices_tracked' AS name, count(DISTINCT device_id) AS value FROM sensor UNION ALL SELECT 'rooms_tracked', count(DISTINCT room_id) FROM sensor WHERE type = 'presence'
  UNION ALL SELECT 'alarms_total', count(*) FROM alarms)"""


@query("prometheus_render", on_alarms(f"""
SELECT 0 AS part, (row_number() OVER (ORDER BY name, labels NULLS FIRST) - 1)::INT AS i, name || coalesce('{{' || labels || '}}', '') || ' ' || printf('%g', value::DOUBLE) AS line FROM counted
UNION ALL SELECT 1, (row_number() OVER (ORDER BY name) - 1)::INT, name || ' ' || printf('%g', value::DOUBLE) FROM gauged
UNION ALL {_lines_sql(2, _histogram_sql("falls_lat"), "alarm_publish_latency_ms", "Milliseconds from event acceptance to alarm publication on the feed")}
UNION ALL {_lines_sql(3, _histogram_sql("nth"), "ingest_apply_latency_ms", "Milliseconds from event acceptance to aggregation state update")}
""", 1000, 2, _LATENCY, _EVERY_64TH, "falls_lat AS (SELECT received_ms - t_ms AS value FROM sensor WHERE type = 'fall_warn')", _SERIES))
def prometheus_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, gauges and both histograms; here the latency of a warning stands for that of its alarm."""
    ev = events(spark, sf_dir)
    found = stage(dedup.fold_falls(ev).select("duplicates_collapsed"), "folded")
    one = lambda df, name: df.withColumn("value", F.col(name).cast("long"))
    gauges = stage(metrics.gauges(ev, found), "gauges")
    counted = metrics.series(one(gauges, "events"), "events_accepted_total", "value").unionByName(metrics.series(metrics.counters(ev, "type"), "events_accepted_by_type_total", "n", "type"))
    counted = counted.unionByName(metrics.series(gauges, "alarms_created_total", "alarms")).unionByName(metrics.series(gauges, "alarms_duplicates_collapsed_total", "duplicates_collapsed"))
    gauged = metrics.series(gauges, "devices_tracked", "devices").unionByName(metrics.series(gauges, "rooms_tracked", "rooms")).unionByName(metrics.series(gauges, "alarms_total", "alarms"))
    value = ev.select("ord", "type", (F.col("received_ms") - F.col("t_ms")).alias("value"))
    shown = {"alarm_publish_latency_ms": metrics.histogram(value.where("type = 'fall_warn'")), "ingest_apply_latency_ms": metrics.histogram(metrics.sampled(value))}
    return metrics.prometheus(counted, gauged, shown)


# ---- summaries, logs and streams ----------------------------------------------------------------------------


@query("stats_summary", on_alarms("""
SELECT (SELECT count(DISTINCT device_id) FROM sensor) AS devices, (SELECT count(DISTINCT room_id) FROM sensor WHERE type = 'presence') AS rooms, (SELECT count(*) FROM sensor) AS events,
  (SELECT count(*) FROM alarms) AS alarms, (SELECT string_agg(type || ':' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM sensor GROUP BY type)) AS accepted,
  (SELECT string_agg(tier || ':' || n, ',' ORDER BY tier) FROM (SELECT tier, count(*) AS n FROM sensor GROUP BY tier)) AS depth, (SELECT quantile_disc(received_ms - t_ms, 0.95) FROM sensor)::DOUBLE AS p95,
  (SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason)) AS rejected""", 1000, 2, _CHECKED))
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    row = stats.stats(ev, validate.rejects(checked(spark, sf_dir)), dedup.fold_falls(ev), ev)
    pairs = lambda name, key, value: F.array_join(F.transform(name, lambda x: F.concat_ws(":", x[key].cast("string"), x[value].cast("string"))), ",").alias(name)
    return row.select("gauges.devices", "gauges.rooms", "gauges.events", "gauges.alarms", pairs("accepted", "type", "n"), pairs("depth", "tier", "depth"), pairs("rejected", "reason", "n"), F.col("latency.p95").cast("double").alias("p95"))


@query("alarm_sse", on_alarms("""
SELECT cursor, 'id: ' || cursor || chr(10) || 'event: alarm' || chr(10) || 'data: {"event_id":"' || event_id || '","device_id":"' || device_id || '","room_id":"' || room_id || '","ts":"' || ts || '","confidence":' || confidence
  || ',"cursor":' || cursor || ',"duplicates_collapsed":' || duplicates_collapsed || '}' || chr(10) || chr(10) AS message FROM alarms WHERE cursor > 40
UNION ALL SELECT max(cursor), ': connected cursor=' || max(cursor) || chr(10) || chr(10) FROM alarms"""))
def alarm_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.sse_backlog(stage(alarms(spark, sf_dir), "alarms"), "40").select("cursor", "message")


#: What readers of each kind of row may see, written out so that the library's own lists can't vouch for themselves.
_SERVED = {
    "device": ("device_id,known,room_id,last_heartbeat_ts,last_seen_ts,availability_5m,heartbeats_5m,expected_5m", "SELECT device_id FROM sensor GROUP BY 1"),
    "room": ("room_id,known,in_room,occupied_pct,occupied_seconds,window_seconds,transitions", "SELECT room_id FROM sensor WHERE type = 'presence' GROUP BY 1"),
    "alarm": ("event_id,device_id,room_id,ts,confidence,cursor,duplicates_collapsed", "SELECT event_id FROM alarms"),
}


@query("served_documents", on_alarms(" UNION ALL ".join(f"SELECT '{kind}' AS kind, id, '{fields}' AS fields FROM ({rows}) t(id)" for kind, (fields, rows) in _SERVED.items())))
def served_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the fields of every JSON document that is served, in their order."""
    ev = events(spark, sf_dir)
    rows = {"device": health.device_health(ev, as_of(ev)), "room": occupancy.room_occupancy(ev, 300_000, as_of(ev)), "alarm": dedup.alarm_log(ev)}
    out = [serve.documents(df, kind).select(F.lit(kind).alias("kind"), "id", F.array_join(F.json_object_keys("json"), ",").alias("fields")) for kind, df in rows.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("replayed_alarms", on_alarms("SELECT * FROM alarms"))
def replayed_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms after the log was exported as lines and replayed."""
    path = scratch(spark, "lines")
    log.export_lines(events(spark, sf_dir).drop("event_id", "cp"), path)
    return dedup.alarm_log(log.replay(spark, path)[0])


@query("streamed_alarms", on_alarms("SELECT * FROM alarms"))
def streamed_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alarms from a stateful stream over the event log, run until nothing is left."""
    from wardline.streaming import pipeline

    root = scratch(spark, "stream")
    pipeline.add_events(events(spark, sf_dir).drop("event_id", "cp"), root, 0)
    pipeline.run(pipeline.write_alarms(pipeline.alarm_changes(pipeline.read_events(spark, root)), root, f"{root}/checkpoint"))
    return pipeline.alarm_log(spark, root)


@query("mirrored_alarms", on_alarms("SELECT event_id, min(cursor) AS cursor FROM alarms GROUP BY event_id"))
def mirrored_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mirror table that was filled with a part of the alarms, then reconciled twice with the whole log."""
    from wardline.streaming import pipeline

    path, found = scratch(spark, "mirror"), stage(alarms(spark, sf_dir), "alarms")
    for part in (found.where("cursor % 2 = 0 AND cursor < 100"), found, found):
        pipeline.mirror(part, path)
    return spark.read.parquet(path).groupBy("event_id").agg(F.min("cursor").alias("cursor"))
