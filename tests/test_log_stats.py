from pyspark.sql import functions as F

from helpers import NOW, event, falls, frame
from wardline.operators import dedup, stats
from wardline.sources import log


def rows(spark):
    return frame(spark, [event(0, "heartbeat", NOW), event(1, "presence", NOW, in_room=True), event(2, "fall_warn", NOW, seq=1, confidence=0.5)])


def test_parquet_log(spark, tmp_path):
    log.write_log(rows(spark), str(tmp_path / "log"))
    back = log.read_log(spark, str(tmp_path / "log"))
    assert stats.differences(back.drop("event_type", "hour"), rows(spark)).isEmpty()
    one = log.of_type(back, "presence")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(event_type" in one._jdf.queryExecution().executedPlan().toString()
    assert log.truncate_before(back, NOW // log.HOUR_MS + 1).isEmpty()
    log.write_log(rows(spark).withColumn("received_ms", F.col("received_ms") + 2 * log.HOUR_MS), str(tmp_path / "log"))
    assert log.drop_before(spark, str(tmp_path / "log"), NOW // log.HOUR_MS + 1) == 3
    left = log.read_log(spark, str(tmp_path / "log"))
    assert left.count() == 3 and left.where(F.col("hour") <= NOW // log.HOUR_MS).isEmpty() and log.drop_before(spark, str(tmp_path / "nowhere"), 9) == 0


def test_replay_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "lines"
    log.export_lines(rows(spark), str(path))
    (path / "torn.json").write_text('{"device_id":"d","type":"heartbeat","t_ms":5}\n{"device_id":"d","ty\n\n[1]\n{"type":"x"}\n')
    events, skipped = log.replay(spark, str(path))
    assert events.count() == 4 and skipped.count() == 3
    assert dedup.fold_falls(events).count() == 1


def test_stats(spark):
    ev = rows(spark).unionByName(falls(spark, [(0, 1, "dev_2"), (0, 2, "dev_2")]))
    rejects = spark.createDataFrame([("bad_ts",), ("bad_ts",)], "reason string")
    row = stats.stats(ev, rejects, dedup.fold_falls(ev), ev).first()
    assert (row.gauges.devices, row.gauges.alarms, row.gauges.duplicates_collapsed) == (2, 2, 1)
    assert [tuple(x) for x in row.rejected] == [("bad_ts", 2)] and ("heartbeat", 1) in [tuple(x) for x in row.accepted]
    assert stats.as_json(stats.stats(ev, rejects, dedup.fold_falls(ev), ev)).first().json.startswith('{"gauges":{"devices":2')
    sent = spark.createDataFrame([("a", 0), ("b", 0)], "event_id string, at_ms long")
    got = spark.createDataFrame([("a", 500), ("a", 900), ("b", 1500)], "event_id string, at_ms long")
    sla = stats.received_sla(sent, got).first()
    assert (sla.total, sla.share, sla.p50, sla.p95) == (2, 0.5, 500, 1500)
