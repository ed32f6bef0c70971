"""Tables of the engine. Times are epoch milliseconds in BIGINT columns; `ord` orders events by arrival."""

#: Event types with their scheduling tiers (0 is most urgent), and the states of sleep.
TIERS = {"fall_warn": 0, "presence": 1, "sleep_state": 1, "net_status": 1, "motion": 2, "heartbeat": 2}
SLEEP_STATES = ("asleep", "awake", "unknown")

#: A row for each event of each request body, before validation.
RAW = "ord BIGINT, received_ms BIGINT, body_id BIGINT, pos INT, raw STRING"
EVENTS = (
    "ord BIGINT, received_ms BIGINT, device_id STRING, room_id STRING, type STRING, t_ms BIGINT, seq BIGINT, "
    "in_room BOOLEAN, magnitude DOUBLE, state STRING, confidence DOUBLE, rssi DOUBLE, tier INT"
)
REJECTS = "ord BIGINT, received_ms BIGINT, raw STRING, reason STRING"
ALARMS = (
    "event_id STRING, device_id STRING, room_id STRING, ts STRING, ts_ms BIGINT, confidence DOUBLE, cursor BIGINT, "
    "duplicates_collapsed INT, seq_min BIGINT, seq_max BIGINT"
)
#: Fields that readers see, of an alarm, of a device's health and of a room's occupancy.
PUBLIC_ALARM = ("event_id", "device_id", "room_id", "ts", "confidence", "cursor", "duplicates_collapsed")
PUBLIC_HEALTH = ("device_id", "known", "room_id", "last_heartbeat_ts", "last_seen_ts", "availability_5m", "heartbeats_5m", "expected_5m")
PUBLIC_ROOM = ("room_id", "known", "in_room", "occupied_pct", "occupied_seconds", "window_seconds", "transitions")
