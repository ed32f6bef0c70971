"""Streams over folders, run until nothing is left, with a restart between two landings."""

import json

import pytest
from pyspark.sql import functions as F

import workload
from helpers import NOW
from wardline.operators import dedup
from wardline.streaming import pipeline


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    if q.exception():
        raise q.exception()


def land(path, name, events):
    lines = [json.dumps({"ord": e["ord"], "received_ms": NOW + e["ord"], "body_id": 0, "pos": 0, "raw": json.dumps(e["raw"])}) for e in events]
    (path / name).write_text("\n".join(lines))


def fall(ord_, t, seq, device="d1"):
    return {"ord": ord_, "raw": {"device_id": device, "room_id": "r", "type": "fall_warn", "ts": NOW + t, "seq": seq, "confidence": 0.5}}


def test_end_to_end_with_restart(rocks, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "tables")
    landing.mkdir()
    published = []

    def go():
        run(pipeline.ingest(pipeline.read_raw(rocks, str(landing)), root, str(tmp_path / "c1")))
        run(pipeline.write_alarms(pipeline.alarm_changes(pipeline.read_events(rocks, root)), root, str(tmp_path / "c2"), lambda new, _: published.extend(r.cursor for r in new.select("cursor").collect())))

    land(landing, "a.json", [fall(0, 0, 2), fall(1, 0, 3), fall(2, 0, 1), fall(3, 5000, 9, "d2"), {"ord": 4, "raw": {"device_id": ""}}])
    go()
    land(landing, "b.json", [fall(5, -600, 4), fall(6, 1001, 8), fall(7, 5000, 10, "d2"), fall(8, 0, 1, "d3")])
    go()
    go()  # nothing new: nothing is doubled
    events = pipeline.event_log(rocks, root)
    assert events.count() == 8 and rocks.read.parquet(f"{root}/rejects").count() == 1
    got = [r.asDict() for r in pipeline.alarm_log(rocks, root).orderBy("cursor").collect()]
    want = [r.asDict() for r in dedup.alarm_log(events).orderBy("cursor").collect()]
    assert got == want and [a["cursor"] for a in got] == [1, 2, 3, 4]
    assert published == [1, 2, 3, 4] and got[0]["ts_ms"] == NOW - 600 and got[0]["duplicates_collapsed"] == 3
    for _ in range(2):
        pipeline.mirror(pipeline.alarm_log(rocks, root), str(tmp_path / "mirror"))
    assert rocks.read.parquet(str(tmp_path / "mirror")).count() == 4


def test_stateless_streams(rocks, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "tables")
    landing.mkdir()
    land(landing, "a.json", [fall(0, 0, 2), fall(1, 0, 3), fall(2, 1, 1)])
    run(pipeline.ingest(pipeline.read_raw(rocks, str(landing)), root, str(tmp_path / "c1")))
    run(pipeline.exact_copies_dropped(pipeline.read_events(rocks, root)).writeStream.format("memory").queryName("copies").option("checkpointLocation", str(tmp_path / "c2")))
    assert rocks.table("copies").count() == 2


def test_availability_is_exact(rocks, tmp_path):
    beats = [(f"d{d}", "heartbeat", NOW // 300_000 * 300_000 + 1000 * s + again) for d in range(20) for s in range(300 - d) for again in (0, 500)]
    rocks.createDataFrame(beats, "device_id string, type string, t_ms long").write.parquet(str(tmp_path / "events"))
    stream = rocks.readStream.schema("device_id string, type string, t_ms long").parquet(str(tmp_path / "events"))
    run(pipeline.availability(stream, slide="5 minutes").writeStream.format("memory").outputMode("update").queryName("beats").option("checkpointLocation", str(tmp_path / "c")))
    assert {r.device_id: r.heartbeats for r in rocks.table("beats").collect()} == {f"d{d}": 300 - d for d in range(20)}


@pytest.mark.parametrize("name", ["smoke", "adversarial"])
def test_workload_counts_equal_truth(spark, name):
    events = workload.generate(spark, workload.SCENARIOS[name].__class__(**vars(workload.SCENARIOS[name]) | {"devices": 400, "per_second": 0.1})).persist()
    truth = workload.truth(events).first()
    assert truth.total == events.count() > truth.distinct_falls > 0
    assert dedup.fold_falls(events, 0).count() == truth.distinct_falls
    late = events.where("received_ms - t_ms > 40000").count()
    assert (late > 0) == workload.SCENARIOS[name].offline
    assert events.where(F.col("type") == "heartbeat").count() > 0.5 * truth.total * 0.8
