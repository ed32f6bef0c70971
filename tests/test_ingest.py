import json

import pytest
from pyspark.sql import functions as F

from helpers import NOW
from wardline.functions import params, times
from wardline.operators import metrics, schedule, validate
from wardline.sources import bodies

GOOD = {"device_id": "d", "room_id": "r", "type": "heartbeat", "ts": NOW}


def reasons(spark, raws):
    rows = [(i, NOW, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(raws)]
    checked = validate.validated(spark.createDataFrame(rows, "ord long, received_ms long, raw string"))
    return checked.orderBy("ord").collect()


def test_reasons(spark):
    cases = [
        (GOOD, None), (GOOD | {"ts": NOW + 3_600_000}, None), (GOOD | {"ts": NOW + 3_600_001}, "ts_too_future"), (GOOD | {"ts": NOW - 3_600_000}, None), (GOOD | {"ts": NOW - 3_600_001}, "ts_too_old"),
        ("[]", "malformed"), ("12", "malformed"), ("{bad", "malformed"), (GOOD | {"device_id": ""}, "missing_device_id"), (GOOD | {"device_id": 5}, "missing_device_id"), (GOOD | {"device_id": " "}, None),
        (GOOD | {"room_id": None}, "missing_room_id"), (GOOD | {"type": "fall"}, "bad_type"), (GOOD | {"type": 1}, "bad_type"), (GOOD | {"ts": None}, "bad_ts"), (GOOD | {"ts": True}, "bad_ts"), (GOOD | {"ts": "soon"}, "bad_ts"),
        (GOOD | {"seq": None}, None), (GOOD | {"seq": 3}, None), (GOOD | {"seq": 1.0}, "bad_seq"), (GOOD | {"seq": True}, "bad_seq"), (GOOD | {"seq": "1"}, "bad_seq"),
        (GOOD | {"type": "presence"}, "bad_in_room"), (GOOD | {"type": "presence", "in_room": 1}, "bad_in_room"), (GOOD | {"type": "presence", "in_room": False}, None),
        (GOOD | {"type": "motion", "magnitude": "0.5"}, "bad_magnitude"), (GOOD | {"type": "motion", "magnitude": 7}, None), (GOOD | {"type": "sleep_state", "state": "x"}, "bad_state"), (GOOD | {"type": "sleep_state", "state": ["asleep"]}, "bad_state"),
        (GOOD | {"type": "fall_warn", "confidence": True}, "bad_confidence"), (GOOD | {"type": "fall_warn", "confidence": 0.9, "extra": {}}, None), (GOOD | {"type": "net_status"}, "bad_rssi"), (GOOD | {"type": "net_status", "rssi": -60}, None),
        (json.dumps(GOOD) + " xyz", "malformed"), (json.dumps(GOOD) + json.dumps(GOOD), "malformed"), (json.dumps(GOOD) + ',"a"', "malformed"), (json.dumps(GOOD) + "], [1", "malformed"), (json.dumps(GOOD).replace('"', "'"), "malformed"), (json.dumps(GOOD)[:-1], "malformed"), (" " + json.dumps(GOOD) + " ", None),
        (json.dumps(GOOD)[:-1] + ',"device_id":""}', "missing_device_id"), ('{"type":"no",' + json.dumps(GOOD)[1:], None), (GOOD | {"type": "fall_warn", "confidence": float("nan")}, "malformed"), (json.dumps(GOOD | {"type": "motion"})[:-1] + ',"magnitude":1e999}', "bad_magnitude"),
        ({"type": "x"}, "missing_device_id"), (GOOD | {"ts": "2026-05-23T18:53:49.123Z"}, None), (GOOD | {"ts": NOW / 1000}, None),
    ]
    got = reasons(spark, [c for c, _ in cases])
    assert [(cases[i][0], r.reason) for i, r in enumerate(got)] == cases
    assert got[-2].t_ms == NOW and abs(got[-1].t_ms - NOW) <= 1
    assert [r.rssi for r in got if r.rssi is not None] == [-60.0]


def test_bodies(spark):
    e, bad = json.dumps(GOOD), json.dumps(GOOD | {"type": "x"})
    cases = {
        e: (202, 1, 0, None), f"[{e},{bad}]": (202, 1, 1, "bad_type"), f"{e}\n\n {bad}\r\n{e}": (202, 2, 1, "bad_type"), bad: (400, 0, 1, "bad_type"), f"[{bad},{bad}]": (202, 0, 2, "bad_type"),
        "": (400, 0, 0, "empty_body"), " \n ": (400, 0, 0, "empty_body"), "[]": (202, 0, 0, None), "{": (400, 0, 0, "invalid_json"), f"{e}\n{{": (400, 0, 0, "invalid_json"), "[1": (400, 0, 0, "invalid_json"), "[1,null]": (202, 0, 2, "malformed"),
        json.dumps(GOOD, indent=1): (400, 0, 0, "invalid_json"), f"{e} xyz": (400, 0, 0, "invalid_json"), f"[{e}] x": (400, 0, 0, "invalid_json"), f"[{e}][{e}]": (400, 0, 0, "invalid_json"), e.replace('"', "'"): (400, 0, 0, "invalid_json"),
    }
    rows = [(i, NOW, b) for i, b in enumerate(cases)]
    parsed = bodies.parsed(spark.createDataFrame(rows, "body_id long, received_ms long, body string")).withColumn("ord", F.col("pos").cast("long"))
    got = bodies.statuses(validate.validated(parsed)).orderBy("body_id").collect()
    assert {b: (r.status, r.accepted, r.rejected, r.reason) for b, r in zip(cases, got, strict=True)} == cases


def test_params(spark):
    ms = lambda raw, most=3_600_000: params.evaluate(spark, params.window_ms(F.lit(raw).cast("string"), most))
    assert [ms(x) for x in ("20m", "6s", "2.5S", "750MS", " 11 s ", "100", None, "")] == [1_200_000, 6000, 2500, 750, 11_000, 100_000, 300_000, 300_000]
    assert ms("3h") == 3_600_000 and ms("3h", 20_000_000) == 10_800_000 and ms("0.9ms") == 0
    assert [ms(x) for x in ("0", "0.0h", "-1s", "5 minutes", "1e3", "s", " ", "1.s", "5m\n6")] == [None] * 9
    since = lambda raw: tuple(params.evaluate(spark, params.since(F.lit(raw).cast("string"))))
    assert since(None) == since("\t") == ("cursor", 0) and since("8") == ("cursor", 8) and since("1600000000000") == ("ts", 1_600_000_000_000)
    assert since("2026-05-23T18:53:49.123Z") == since("20260523T185349.123Z") == since("2026-05-23 20:53:49,1239+0200") == ("ts", NOW)
    assert since("tomorrow") == since("9" * 30) == since("2026-05-23Z") == ("invalid", None)
    assert params.window_or_fail(spark, "10", 9000) == 9000 and params.since_or_fail(spark, "8") == ("cursor", 8)
    with pytest.raises(params.BadParameter, match="bad_window"):
        params.window_or_fail(spark, "x", 1)
    assert (params.page_limit("x"), params.page_limit("5"), params.page_limit(9_999_999)) == (200_000, 5, 1_000_000)


def test_times(spark):
    cases = {"2026-05-23T18:53:49.123Z": NOW, "2026-05-23T20:53:49.123+02:00": NOW, "2026-05-23 18:53:49.123456": NOW, "1969-12-31T23:59:59.999Z": -1, "2024-02-29": 1_709_164_800_000, "2023-02-29": None, "2026": None, "2026-13-45T99:99:99.999Z": None, "": None,
             "20260523T185349Z": NOW - 123, "2026-05-23T18": NOW - 3_229_123, "2026-05-23T18:53-00:30": NOW - 49_123 + 1_800_000, "2026-05-23T18:53:49.123+25:00": None, "2026-05-2318:53": None}
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", times.iso_ms(F.col("x")).alias("ms")).collect()
    assert {r.x: r.ms for r in got} == cases
    rows = spark.createDataFrame([(0,), (-1,), (NOW,), (951_782_400_000,)], "t long").select(times.to_iso(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == ["1970-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999Z", "2026-05-23T18:53:49.123Z", "2000-02-29T00:00:00.000Z"]


def test_schedule(spark):
    import random

    def plain(n0, n1, n2, most):
        t0, t1, t2 = [list(range(n)) for n in (n0, n1, n2)]
        out = [(0, t0.pop(0)) for _ in range(min(most, n0))]
        left = most - len(out)
        first = min(len(t1), left - left // 4)
        out += [(1, t1.pop(0)) for _ in range(first)]
        second = min(len(t2), left - first)
        out += [(2, t2.pop(0)) for _ in range(second)]
        return out + [(1, t1.pop(0)) for _ in range(min(len(t1), left - first - second))]

    rng = random.Random(2)
    for _ in range(300):
        n = [rng.randrange(12) for _ in range(3)]
        most = rng.randrange(20)
        a0, a1, a2, more = schedule.shares(*n, most)
        assert [0] * a0 + [1] * a1 + [2] * a2 + [1] * more == [t for t, _ in plain(*n, most)]
    waiting = spark.range(20_000).selectExpr("id AS ord", "CAST(1 + id % 2 AS int) AS tier")
    got = schedule.drained(waiting, 1000).collect()
    assert sum(r.tier == 2 for r in got) == 250 and sorted(r.position for r in got) == list(range(1, 1001))


def test_metrics(spark):
    v = spark.createDataFrame([(i, i) for i in range(1, 21)], "ord long, value long")
    q = metrics.quantiles(v).first()
    assert (q.p50, q.p95, q.p99) == (10, 19, 20)
    assert metrics.quantiles(v.where("false")).first().p50 is None
    h = {r.le: r.n for r in metrics.histogram(v).collect()}
    assert (h["1"], h["2"], h["5"], h["10"], h["25"], h["5000"], h["+Inf"]) == (1, 2, 5, 10, 20, 20, 20) and len(h) == 13
    counted = spark.createDataFrame([("b", None, 1.5e7), ("a", 'k="v"', 2.0), ("a", None, 0.25)], "name string, labels string, value double")
    text = metrics.prometheus(counted, counted.where("value < 1"), {"ingest_apply_latency_ms": metrics.histogram(v)})
    lines = [r.line for r in text.orderBy("part", "i").collect()]
    assert lines[:4] == ["a 0.25", 'a{k="v"} 2', "b 1.5e+07", "a 0.25"] and lines[4].startswith("# HELP ingest_apply_latency_ms Milli") and lines[5] == "# TYPE ingest_apply_latency_ms histogram"
    assert lines[6] == 'ingest_apply_latency_ms_bucket{le="1"} 1' and lines[-3:] == ['ingest_apply_latency_ms_bucket{le="+Inf"} 20', "ingest_apply_latency_ms_sum 210", "ingest_apply_latency_ms_count 20"]
    numbers = [0.0, 1.0, -2.5, 999999.5, 999999.4, 123456789.0, 0.0001234567, 0.00001, 100000.0, 1e21, 3.14159265]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", metrics.short(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [f"{x:g}" for x in numbers]
    assert sorted(r.ord for r in metrics.sampled(v, 6).collect()) == [6, 12, 18]
    assert metrics.share_within(v, 5).first().share == 0.25
    assert metrics.last_n(v, 3).count() == 3
    s = spark.createDataFrame([(0, "a", 0), (2000, "a", 10), (4000, "a", 10)], "at_ms long, name string, value long")
    assert [r.per_second for r in metrics.counter_deltas(s).collect()] == [5.0]
