"""Segments and positions, snapshots and their fallback, manifests, state that expires, feeds, deliveries and progress."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import EVENTS, NOW, event, falls, frame, presence
from test_streaming import fall, land, rocks, run  # noqa: F401
from wardline.config import DEFAULT
from wardline.operators import dedup, health, integrals, occupancy, rings, stats
from wardline.sources import segments
from wardline.streaming import feed, latency, manifest, pipeline, progress, snapshots, state


def same(a, b):
    return stats.differences(a, b.select(*a.columns)).isEmpty()


# ---- segments -----------------------------------------------------------------------------------------------------


def written(path, *bodies):
    path.mkdir()
    for i, body in enumerate(bodies):
        (path / f"segment={i:08d}").mkdir()
        (path / f"segment={i:08d}" / "part-0.json").write_bytes(body)
    return str(path)


def test_ranges_take_each_line_once(spark, tmp_path):
    rng = random.Random(4)
    bodies = [b"".join(bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40))) + b"\n" for _ in range(60)), b"", b"x\n\ny", b"\n" * 5 + b"tail"]
    path = written(tmp_path / "log", *bodies)
    (tmp_path / "log" / "segment=00000001" / ".hidden").write_bytes(b"no\n")
    want, at = [], 0
    for i, body in enumerate(bodies):
        at = 0
        for line in body.split(b"\n")[: -1 if body.endswith(b"\n") or not body else None]:
            want.append((f"segment={i:08d}/part-0.json", at, line.decode()))
            at += len(line) + 1
    for size in (1, 7, 1000):
        got = [(r.file, r.at, r.line) for r in segments.log_lines(spark, path, range_bytes=size if size > 1 else 3).collect()]
        assert sorted(got) == sorted(want)
    for cut in (0, 1, 17, len(want) - 1, len(want)):
        stop = segments.Position(*(want[cut][:2] if cut < len(want) else ("~", 0)))
        before, after = segments.log_lines(spark, path, stop=stop, range_bytes=11), segments.log_lines(spark, path, stop, range_bytes=11)
        assert before.count() == cut and after.count() == len(want) - cut


def test_replay_is_strict(spark, tmp_path):
    good = json.dumps({"ord": 1, "received_ms": NOW, "device_id": "d", "room_id": "r", "type": "heartbeat", "t_ms": NOW})
    body = "\n".join([good, good + " xyz", good[:20], "[1]", "  ", '{"type":"x"}', good + "}", "{'device_id':'d'}"]).encode() + b"\n\xff\xfe\n" + good.encode()
    path = written(tmp_path / "log", body, b'{"device_id":"d","ty')
    events, summary = segments.replayed(spark, path)
    assert events.count() == 2 and summary.first().asDict() == {"events": 2, "other": 2, "skipped": 6}
    assert segments.replayed(spark, str(tmp_path / "none"))[1].first().asDict() == {"events": 0, "other": 0, "skipped": 0}
    from wardline.sources import log

    (tmp_path / "plain").write_text("\n".join([good, good + " xyz", "[1]"]))
    events, skipped = log.replay(spark, str(tmp_path / "plain"))
    assert events.count() == 1 and skipped.count() == 2


def test_stream_waits_for_the_end_of_a_line(rocks, tmp_path):  # noqa: F811
    path = written(tmp_path / "log", b"a\nb\npart")
    file = tmp_path / "log" / "segment=00000000" / "part-0.json"

    def go():
        run(segments.log_stream(rocks, path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
        return sorted(r.line for r in rocks.read.parquet(str(tmp_path / "out")).collect())

    assert go() == ["a", "b"]
    file.write_bytes(b"a\nb\npartial\nc")
    assert go() == ["a", "b", "partial"]
    (tmp_path / "log" / "segment=00000001").mkdir()
    (tmp_path / "log" / "segment=00000001" / "part-0.json").write_bytes(b"d\n")
    assert go() == ["a", "b", "c", "d", "partial"]  # a later file: the line is torn, and counted by those who parse it
    late = segments.log_stream(rocks, path, segments.Position("segment=00000001/", 0))
    run(late.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c2")))
    assert [r.line for r in rocks.table("late").collect()] == ["d"]


def test_truncated_segments(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(4):
        segments.write_segment(falls(spark, [(i, 1)]), path, i)
    assert segments.drop_segments_before(spark, path, segments.Position("segment=00000002/part-0", 5)) == 2
    assert segments.replayed(spark, path)[0].count() == 2


# ---- folding on, rings, integrals -----------------------------------------------------------------------------------


def random_events(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["fall_warn", "fall_warn", "presence", "heartbeat", "motion"])
        t = NOW + rng.randrange(-3_000_000, 60_000)
        rows.append(event(i, kind, t, device=f"d{rng.randrange(4)}", room=f"r{rng.randrange(3)}", seq=rng.choice([None, rng.randrange(9)]), in_room=rng.random() < 0.5 if kind == "presence" else None, confidence=rng.choice([None, rng.random()])))
    return frame(spark, rows)


@pytest.mark.parametrize("slack", [2, None])
def test_fold_goes_on_from_any_point(spark, slack):
    log = random_events(spark, 400, 8).persist()
    whole = dedup.fold_state(log, 60_000, slack)
    for cut in (0, 150, 390):
        early = dedup.fold_state(log.where(f"ord < {cut}"), 60_000, slack)
        assert same(dedup.fold_onto(early, log.where(f"ord >= {cut}"), 60_000, slack), whole)
    assert same(dedup.shown(whole), dedup.fold_falls(log, 60_000, slack))


def test_rings_merge_in_any_order(spark):
    """Future heartbeats hide the second that shares their slot, and no other."""
    rng = random.Random(5)
    rows = [event(i, "heartbeat", NOW + 1000 * rng.choice([-rng.randrange(700), rng.randrange(300, 3000)]), device=f"d{i % 3}") for i in range(900)]
    rows += [event(900 + i, "motion", NOW + i, device=f"d{i}", room=f"room_{i}") for i in range(5)]
    log = frame(spark, [(*r[:1], NOW + 1000 * r[0], *r[2:]) for r in rows]).persist()
    parts = rings.rings(log, 60_000).persist()
    for now in (NOW, NOW + 250_000, NOW - 100_000):
        want = health.device_health(log, now)
        assert same(want, rings.health_from_rings(rings.merge(parts), now))
        again = rings.merge(rings.merge(parts.where("period % 2 = 0")).unionByName(rings.merge(parts)).unionByName(parts))
        assert same(want, rings.health_from_rings(again, now))
    row = rings.rings(log.where("t_ms <= %d" % NOW), 10**12).where("ring IS NOT NULL").withColumn("bits", rings.bitmap(F.col("ring"))).withColumn("back", rings.seconds_of(rings.newest(F.col("ring")), F.col("bits")))
    for r in row.collect():
        assert sorted(r.back) == sorted(s for s in r.ring if s > max(r.ring) - 300) and len(r.bits) == 52


def test_integrals_equal_brute_force(spark):
    rng = random.Random(6)
    points = {(f"r{rng.randrange(4)}", NOW + rng.choice([rng.randrange(-9_000_000, 0), -3_600_000 * rng.randrange(3) - NOW % 3_600_000])): rng.random() < 0.5 for _ in range(120)}
    table = integrals.prefix_integrals(spark.createDataFrame([(r, t, v) for (r, t), v in points.items()], "room_id string, t_ms long, in_room boolean")).persist()
    asked = [(NOW - back, w) for back in (0, 1_000_000, 5_000_000, -4_000_000, 8_900_000) for w in (60_000, 3_600_000, 20_000_000, 0)]
    got = {(r.room_id, r.as_of_ms, r.window_ms): r.occupied_ms for r in integrals.occupied_ms(table, asked).collect()}
    want = {}
    for room in {r for r, _ in points}:
        own = sorted((t, v) for (r, t), v in points.items() if r == room)
        for now, w in asked:
            if own[0][0] > now:
                continue
            ends = [t for t, _ in own[1:]] + [10**18]
            want[room, now, w] = sum(max(0, min(e, now) - max(t, now - w)) for (t, v), e in zip(own, ends, strict=True) if v)
    assert got == want
    assert integrals.prefix_integrals(table.select("room_id", "t_ms", "in_room").where("false")).count() == 0


# ---- snapshots ----------------------------------------------------------------------------------------------------


def test_generations_fall_back(spark, tmp_path):
    root, path, log = str(tmp_path / "s"), str(tmp_path / "log"), random_events(spark, 300, 9).persist()
    assert snapshots.load(spark, root) is None
    segments.write_segment(log.where("ord < 100"), path, 0)
    kept, summary = snapshots.recover(spark, root, path)
    assert summary.first().generation is None and summary.first().replayed == 100  # the log alone is enough
    for i, cut in enumerate((100, 200, 250)):
        kept, summary = snapshots.recover(spark, root, path)
        at = summary.first()
        snapshots.save(spark, root, kept, segments.Position(at.file, at.at))
        segments.write_segment(log.where(f"ord >= {cut} AND ord < {(200, 250, 300)[i]}"), path, i + 1)
    assert snapshots.generations(spark, root) == [3, 2]
    want = dedup.alarm_log(log)
    kept, summary = snapshots.recover(spark, root, path)
    assert summary.first().generation == 3 and summary.first().replayed == 50 and same(want, snapshots.alarms_of(kept))
    data = next((tmp_path / "s" / "generation=00000003" / "alarms").glob("*.parquet"))
    data.write_bytes(data.read_bytes()[:-100])  # cut
    kept, summary = snapshots.recover(spark, root, path)
    assert summary.first().generation == 2 and summary.first().replayed == 100 and same(want, snapshots.alarms_of(kept))
    assert same(health.device_health(log, NOW), rings.health_from_rings(rings.merge(kept["rings"]), NOW))
    thin = snapshots.pruned(kept, NOW)
    assert same(occupancy.room_occupancy(log, 300_000, NOW), occupancy.from_points(thin["points"], 300_000, NOW))
    manifest_file = next((tmp_path / "s" / "generation=00000002" / "manifest").glob("*.json"))
    manifest_file.write_text(manifest_file.read_text().replace('"version":1', '"version":2'))
    assert snapshots.load(spark, root) is None
    kept, summary = snapshots.recover(spark, root, path)
    assert summary.first().replayed == 300 and same(want, snapshots.alarms_of(kept))


# ---- manifests ------------------------------------------------------------------------------------------------------


def test_readers_see_committed_batches_only(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        pipeline.add_events(falls(spark, [(i, i)]), root, i)
    manifest.publish(falls(spark, [(9, 9)]), root, "events", 3)  # in its place, not committed
    assert pipeline.event_log(spark, root).count() == 3
    with pytest.raises(TimeoutError):
        manifest.await_batches(spark, root, "events", seconds=0.2)
    manifest.publish(falls(spark, [(1, 1), (2, 2)]), root, "events", 0)  # what is there stays
    assert pipeline.event_log(spark, root).count() == 3
    assert manifest.truncate(spark, root, "events", 2) == 2 and pipeline.event_log(spark, root).count() == 1
    assert manifest.committed(spark, root, "nothing", "x long").count() == 0


def test_another_checkpoint_is_refused(rocks, tmp_path):  # noqa: F811
    landing, root = tmp_path / "landing", str(tmp_path / "t")
    landing.mkdir()
    land(landing, "a.json", [fall(0, 0, 2), fall(1, 5000, 3)])
    run(pipeline.ingest(pipeline.read_raw(rocks, str(landing)), root, str(tmp_path / "c1")))
    run(pipeline.write_alarms(pipeline.alarm_changes(pipeline.read_events(rocks, root)), root, str(tmp_path / "c2")))
    with pytest.raises(Exception, match="written by"):
        run(pipeline.write_alarms(pipeline.alarm_changes(pipeline.read_events(rocks, root)), root, str(tmp_path / "c3")))
    assert manifest.entry(rocks, root, "alarms", 0).needs == 0
    got = [r.cursor for r in pipeline.alarm_log(rocks, root).collect()]
    assert sorted(got) == [1, 2]


# ---- streams ------------------------------------------------------------------------------------------------------


def test_silent_devices_lose_their_state(rocks, tmp_path):  # noqa: F811
    root = str(tmp_path / "t")
    config = DEFAULT.__class__(past_limit_ms=10_000)

    def land_falls(i, rows):
        part = frame(rocks, [event(o, "fall_warn", NOW + t, device=d, seq=s) for o, t, d, s in rows])
        pipeline.add_events(part.withColumn("received_ms", F.col("t_ms") + 1), root, i)
        run(pipeline.write_alarms(state.expiring_alarm_changes(pipeline.read_events(rocks, root), config, lateness_ms=0), root, str(tmp_path / "c")))
        return sorted((r.device_id, r.ts_ms - NOW) for r in state.open_alarms(rocks, str(tmp_path / "c")).collect())

    assert land_falls(0, [(0, 0, "a", 1), (1, 5000, "a", 9), (2, 100, "b", 1)]) == [("a", 0), ("a", 5000), ("b", 100)]
    assert land_falls(1, [(3, 12_000, "c", 1)]) == [("a", 5000), ("c", 12_000)]
    assert land_falls(2, [(4, 30_000, "c", 1), (5, 30_500, "c", 2)]) == [("c", 30_000)]
    assert [r.duplicates_collapsed for r in pipeline.alarm_log(rocks, root).orderBy("cursor").collect()] == [0, 0, 0, 0, 1]


def test_timelines_are_repaired_and_pruned(rocks, tmp_path):  # noqa: F811
    root, rng = str(tmp_path / "t"), random.Random(7)
    points = [(rng.randrange(-3000, 0) * 1000, rng.random() < 0.5) for _ in range(150)]
    log = presence(rocks, points).persist()
    for i in range(3):
        pipeline.add_events(log.where(f"ord % 3 = {i}"), root, i)
        run(state.write_rooms(state.room_changes(pipeline.read_events(rocks, root), lateness_ms=10_000), root, str(tmp_path / "c")))
    kept = state.room_points(rocks, str(tmp_path / "c"))
    for w in (60_000, 3_600_000):
        assert same(occupancy.room_occupancy(log, w, NOW), occupancy.from_points(kept, w, NOW))
    late = presence(rocks, [(8_000_000, True)]).withColumn("received_ms", F.lit(NOW + 8_000_000)).withColumn("room_id", F.lit("other"))
    pipeline.add_events(late, root, 3)
    run(state.write_rooms(state.room_changes(pipeline.read_events(rocks, root), lateness_ms=10_000), root, str(tmp_path / "c")))
    left = {r.room_id: r.n for r in state.room_points(rocks, str(tmp_path / "c")).groupBy("room_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert left == {"room_1": 1, "other": 1}  # a silent room keeps the state it is in


def test_feed_resumes_without_gap(rocks, tmp_path):  # noqa: F811
    root = str(tmp_path / "t")
    seen = tmp_path / "sent"
    seen.mkdir()

    def deliver(rows):
        import uuid

        (seen / uuid.uuid4().hex).write_text("".join(f"{r.cursor}\n" for r in rows))

    for i in range(4):
        pipeline.add_events(frame(rocks, [event(10 * i + j, "fall_warn", NOW + 100_000 * i + 10_000 * j, seq=1) for j in range(5)]), root, i)
        run(pipeline.write_alarms(pipeline.alarm_changes(pipeline.read_events(rocks, root)), root, str(tmp_path / "c")))
        if i in (1, 3):
            run(feed.subscribe(rocks, root, "a", deliver=deliver))
    run(feed.subscribe(rocks, root, "a"))  # nothing new
    run(feed.subscribe(rocks, root, "b", str(NOW + 99_999)))
    assert [r.cursor for r in feed.delivered(rocks, root, "a").orderBy("cursor").collect()] == list(range(1, 21))
    assert [r.cursor for r in feed.delivered(rocks, root, "b").orderBy("cursor").collect()] == list(range(6, 21))
    assert sorted(int(x) for f in seen.iterdir() for x in f.read_text().split()) == list(range(1, 21))
    assert feed.start_of(rocks, root, "b", "0") == 5  # settled once


def test_deliveries(rocks, tmp_path):  # noqa: F811
    """Received in time, twice, too late, and never."""
    sent = [("a", 0), ("b", 1000), ("c", 2000), ("d", 3000), ("end", 10_000_000)]
    got = [("a", 500), ("a", 900), ("b", 7001), ("c", 2000), ("x", 50), ("end", 10_000_000)]
    streams = []
    for name, rows in (("sent", sent), ("got", got)):
        rocks.createDataFrame([(e, NOW + t) for e, t in rows], "event_id string, at_ms long").write.parquet(str(tmp_path / name))
        streams.append(rocks.readStream.schema("event_id string, at_ms long").parquet(str(tmp_path / name)))
    run(latency.deliveries(*streams, 6000, lateness_ms=1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    rows = rocks.read.parquet(str(tmp_path / "out")).where("event_id <> 'end'")
    assert sorted((r.event_id, r.received_ms and r.received_ms - NOW) for r in rows.collect()) == [("a", 500), ("a", 900), ("b", None), ("c", 2000), ("d", None)]
    assert latency.delivery_report(rows, 400).first().asDict() == {"sent": 4, "received": 2, "lost": 2, "share": 0.25, "p50": 0, "p95": 500}


def test_progress_is_observed(rocks, tmp_path):  # noqa: F811
    landing = tmp_path / "landing"
    landing.mkdir()
    listener = progress.ProgressLog(rocks, str(tmp_path / "progress"))
    rocks.streams.addListener(listener)
    try:
        for i in range(2):
            land(landing, f"{i}.json", [fall(0, 0, 2), fall(1, 0, 3), {"ord": 2, "raw": {"device_id": ""}}][: 3 - i])
            q = progress.counted_ingest(pipeline.read_raw(rocks, str(landing))).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            listener.wait(q)
    finally:
        rocks.streams.removeListener(listener)
    rows = progress.counters(progress.snapshots(rocks, str(tmp_path / "progress")))
    got = {(r.batch_id, r.name): r.value for r in rows.collect()}
    assert [got[b, f"ingest.{n}"] for n in ("accepted", "rejected") for b in (0, 1)] == [2, 4, 1, 1]
    from wardline.operators.metrics import counter_deltas

    rates = {r.name: r.per_second for r in counter_deltas(rows.drop("query", "batch_id")).collect()}
    assert rates["ingest.accepted"] > 0 and "ingest.rejected" not in rates
    assert progress.readiness(q)["live"] is False and progress.readiness(q)["batch_id"] == 1


def test_schemas_agree():
    from wardline.schemas import EVENTS as OWN

    assert [c.split()[0] for c in OWN.split(", ")] == [c.split()[0] for c in EVENTS.split(", ")]


def test_snapshots_when_due(spark, tmp_path):
    root, path = str(tmp_path / "s"), str(tmp_path / "log")
    segments.write_segment(presence(spark, [(-8_000_000, True), (-7_000_000, False), (-1000, True)]), path, 0)
    assert snapshots.advance_if_due(spark, root, path, NOW) == 1
    assert snapshots.advance_if_due(spark, root, path, NOW + DEFAULT.snapshot_ms - 1) is None
    assert snapshots.advance_if_due(spark, root, path, NOW + DEFAULT.snapshot_ms) == 2
    assert snapshots.load(spark, root).tables["points"].count() == 2  # what no query can reach is gone


def test_served_documents(spark):
    from wardline.operators import feed as pages, serve

    log = frame(spark, [event(0, "heartbeat", NOW), event(1, "fall_warn", NOW, seq=1)])
    keys = spark.createDataFrame([("dev_1",), ("none",)], "device_id string")
    got = {r.id: json.loads(r.json) for r in serve.documents(health.device_health(log, NOW, keys), "device").collect()}
    assert got["none"] == {"device_id": "none", "known": False, "last_heartbeat_ts": None, "availability_5m": 0.0, "heartbeats_5m": 0, "expected_5m": 300}
    assert list(got["dev_1"])[:3] == ["device_id", "known", "room_id"] and got["dev_1"]["heartbeats_5m"] == 1
    page = json.loads(serve.page(pages.alarm_page(dedup.alarm_log(log))).first().json)
    assert (page["count"], page["cursor"], page["since"]) == (1, 1, None) and page["alarms"][0]["confidence"] is None and "seq_min" not in page["alarms"][0]


def test_streams_run_until_stopped(rocks, tmp_path):  # noqa: F811
    import time

    landing = tmp_path / "landing"
    landing.mkdir()
    land(landing, "a.json", [fall(0, 0, 2), fall(1, 0, 3), fall(2, 9000, 1, "d2")])
    queries = pipeline.start(rocks, str(landing), DEFAULT.__class__(data_dir=str(tmp_path / "data"), fsync_ms=500))
    try:
        end = time.time() + 120
        while time.time() < end and manifest.entry(rocks, str(tmp_path / "data"), "alarms", 0) is None:
            time.sleep(0.2)
        assert all(progress.readiness(q)["live"] for q in queries.values())
    finally:
        for q in queries.values():
            q.stop()
    assert sorted(r.cursor for r in pipeline.alarm_log(rocks, str(tmp_path / "data")).collect()) == [1, 2]
