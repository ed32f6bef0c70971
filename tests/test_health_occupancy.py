from dataclasses import replace

import random

import pytest

from helpers import NOW, event, frame, presence
from wardline.config import Config
from wardline.operators import health, occupancy

MIN, HOUR = 60_000, 3_600_000


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    "points, window, seconds, share, state",
    [
        ([(-MIN, True), (-30_000, False)], MIN, 30.0, 0.5, False),
        ([(-MIN + i * 1000, True) for i in range(10)], MIN, 60.0, 1.0, True),
        ([(-HOUR, True)], MIN, 60.0, 1.0, True),
        ([(-10_000, False)], MIN, 0.0, 0.0, False),
        ([(-10_000, False), (-40 * MIN, True), (-20 * MIN, False)], HOUR, 1200.0, 0.333333, False),
        ([(-30_000, True), (-30_000, False)], MIN, 0.0, 0.0, False),
        ([(-5 * HOUR, True)], HOUR, 3600.0, 1.0, True),
        ([(-MIN, True), (5_000, False)], MIN, 60.0, 1.0, False),  # a point ahead of the clock is the current state only
        ([(-MIN, True)], 0, 0.0, 0.0, True),
    ],
)
def test_occupancy(spark, points, window, seconds, share, state):
    row = one(occupancy.room_occupancy(presence(spark, points), window, NOW))
    assert (row.occupied_seconds, row.occupied_pct, row.in_room, row.known) == (seconds, share, state, True)


def test_same_time_is_one_point_and_unknown_rooms(spark):
    ev = presence(spark, [(-30_000, True), (-30_000, False)])
    assert one(occupancy.timeline(ev)).in_room is False
    keys = spark.createDataFrame([("room_1",), ("nowhere",)], "room_id string")
    rows = {r.room_id: r for r in occupancy.room_occupancy(ev, 2500, NOW, keys).collect()}
    assert rows["room_1"].transitions == 1 and rows["room_1"].window_seconds == 2
    assert (rows["nowhere"].known, rows["nowhere"].in_room, rows["nowhere"].occupied_pct, rows["nowhere"].transitions) == (False, False, 0.0, 0)


def test_prune_keeps_the_carry_in(spark):
    ev = presence(spark, [(-5 * HOUR, False), (-4 * HOUR, True), (-10_000, True)])
    kept = occupancy.pruned(occupancy.timeline(ev), NOW)
    assert sorted(r.t_ms - NOW for r in kept.collect()) == [-4 * HOUR, -10_000]
    assert one(occupancy.room_occupancy(ev, HOUR, NOW)).transitions == 2


def test_occupancy_equals_integration_by_steps(spark):
    rng = random.Random(3)
    rooms, rows = {}, []
    for r in range(60):
        points = [(rng.randrange(-400, 30), rng.random() < 0.5) for _ in range(rng.randrange(1, 12))]
        rooms[f"room_{r}"] = points
        rows += [event(len(rows) + i, "presence", NOW + t, room=f"room_{r}", in_room=v) for i, (t, v) in enumerate(points)]
    for window in (1, 50, 300):
        got = {r.room_id: r.occupied_ms for r in occupancy.room_occupancy(frame(spark, rows), window, NOW).collect()}
        for room, points in rooms.items():
            last = dict(sorted(dict(points).items()))
            want = sum(1 for ms in range(-window, 0) if next((v for t, v in sorted(last.items(), reverse=True) if t <= ms), False))
            assert got[room] == want, (room, points, window)


def beats(spark, offsets_s, extra=()):
    return frame(spark, [event(i, "heartbeat", NOW // 1000 * 1000 + s * 1000) for i, s in enumerate(offsets_s)] + list(extra))


@pytest.mark.parametrize("seconds, beats_, share", [([-i for i in range(150)], 150, 0.5), ([-5] * 20, 1, 0.003333), ([-600 - i for i in range(300)], 0, 0.0), ([-299], 1, 0.003333), ([-300], 0, 0.0)])
def test_coverage(spark, seconds, beats_, share):
    row = one(health.device_health(beats(spark, seconds), NOW))
    assert (row.heartbeats_5m, row.availability_5m, row.expected_5m) == (beats_, share, 300)
    assert row.last_heartbeat_ts is not None


def test_coverage_equals_a_ring(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for d in range(40):
        ring = [-1] * 300
        for _ in range(rng.randrange(1, 60)):
            sec = NOW // 1000 + rng.randrange(-500, 200)
            rows.append(event(len(rows), "heartbeat", sec * 1000 + rng.randrange(1000), device=f"dev_{d}"))
            ring[sec % 300] = max(ring[sec % 300], sec)
        want[f"dev_{d}"] = sum(NOW // 1000 - 300 < s <= NOW // 1000 for s in ring)
    assert {r.device_id: r.heartbeats_5m for r in health.device_health(frame(spark, rows), NOW).collect()} == want


def test_registry(spark):
    ev = frame(spark, [event(0, "motion", NOW, room="a"), event(1, "heartbeat", NOW - 5, room="b"), event(2, "net_status", NOW, room="c"), event(3, "motion", NOW - 9, room="d", device="dev_2")])
    rows = {r.device_id: r for r in health.registry(ev).collect()}
    assert rows["dev_1"].room_id == "c" and rows["dev_1"].last_heartbeat_ms == NOW - 5 and rows["dev_2"].last_heartbeat_ms is None
    keys = spark.createDataFrame([("dev_2",), ("other",)], "device_id string")
    found = {r.device_id: r for r in health.device_health(ev, NOW, keys).collect()}
    assert set(found) == {"dev_2", "other"} and not found["other"].known and found["other"].room_id is None
    assert found["dev_2"].last_seen_ts == "2026-05-23T18:53:49.114Z"


def test_config():
    c = Config.from_env({"DEDUP_WINDOW_MS": "77", "QUEUE_HIGH_WATER": "x", "DATA_DIR": "", "PAST_LIMIT_MS": ""})
    assert (c.dedup_window_ms, c.fsync_ms, c.data_dir, c.past_limit_ms) == (77, 200, "data", 3_600_000)
    assert replace(c, dedup_seq_slack=9).dedup_seq_slack == 9 and c.dedup_seq_slack == 2
