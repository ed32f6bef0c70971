import random

import pytest

from helpers import NOW, falls, fold
from wardline.functions.params import BadParameter
from wardline.operators import dedup, feed


def log(spark, points, window=1000, slack=2):
    return dedup.alarm_log(falls(spark, points), window, slack)


@pytest.mark.parametrize(
    "points, window, alarms, dups",
    [
        ([(0, 2), (0, 3), (0, 1)], 1000, 1, 2),
        ([(0, 10), (1001, 13)], 1000, 2, 0),
        ([(0, 10), (1000, 11)], 1000, 1, 1),
        ([(-5000, 2), (-5600, 1)], 1000, 1, 1),
        ([(0, 10), (3000, 55)], 30_000, 2, 0),
        ([(0, 10), (3000, 11)], 30_000, 1, 1),
        ([(0, None), (500, 99), (900, 101)], 1000, 1, 2),
        ([(10_000, 2), (9_100, 3), (8_300, 4)], 1000, 1, 2),  # the anchor moves back and never forward
        ([(0, 1), (900, 2), (1800, 3)], 1000, 2, 1),  # so later copies don't extend it
    ],
)
def test_fold(spark, points, window, alarms, dups):
    rows = log(spark, points, window).collect()
    assert len(rows) == alarms and sum(r.duplicates_collapsed for r in rows) == dups


def test_earlier_copy_corrects_time_not_identity(spark):
    (row,) = log(spark, [(-5000, 2), (-5600, 1)]).collect()
    assert (row.ts_ms - NOW, row.cursor, row.event_id, row.confidence, row.seq_min, row.seq_max) == (-5600, 1, f"fall_dev_1_{NOW - 5000}", 0.51, 1, 2)
    assert row.ts == "2026-05-23T18:53:43.523Z"


def test_fold_equals_plain_version(spark):
    rng = random.Random(9)
    points = [(rng.randrange(0, 30_000), rng.choice([None, rng.randrange(20)]), f"dev_{rng.randrange(12)}") for _ in range(400)]
    for window, slack in ((0, 2), (300, 2), (1000, 1), (1000, None), (5000, 0)):
        want = fold(points, window, slack)
        rows = log(spark, points, window, slack).orderBy("cursor").collect()
        assert [r.cursor for r in rows] == list(range(1, len(want) + 1))
        assert [(r.device_id, r.ts_ms - NOW, r.event_id, r.duplicates_collapsed, r.seq_min, r.seq_max) for r in rows] == [(a["device"], a["ts"], f"fall_{a['device']}_{NOW + a['t0']}", a["dups"], a["q0"], a["q1"]) for a in want]


def test_feed(spark):
    alarms = log(spark, [(i * 10, 1, f"dev_{i}") for i in range(5)]).persist()
    cursors = lambda df: [r.cursor for r in df.orderBy("cursor").collect()]
    assert cursors(alarms) == [1, 2, 3, 4, 5]
    assert cursors(feed.since(alarms, "3")) == [4, 5] and cursors(feed.since(alarms, None)) == [1, 2, 3, 4, 5] and cursors(feed.since(alarms, "0", "2")) == [1, 2]
    assert cursors(feed.since(alarms, str(NOW + 20))) == [4, 5]
    assert feed.in_room(feed.since_cursor(alarms, 0, 2), "nowhere").count() == 0
    page = feed.alarm_page(alarms, "1", 2).collect()[0]
    assert (page["count"], page.cursor, page.page_cursor, [a.cursor for a in page.alarms]) == (2, 5, 3, [2, 3])
    assert "ts_ms" not in page.alarms[0].asDict()
    assert feed.stream_start(alarms, str(NOW + 20)) == 3 and feed.stream_start(alarms, str(NOW + 99)) == 5 and feed.stream_start(alarms, "2") == 2
    with pytest.raises(BadParameter, match="bad_since"):
        feed.since(alarms, "garbage")
    text = feed.sse(alarms).orderBy("cursor").first().message
    assert text.startswith('id: 1\nevent: alarm\ndata: {"event_id":"fall_dev_0_') and text.endswith("\n\n")
    first, *_, live = feed.sse_backlog(alarms, "2").orderBy("part", "cursor").collect()
    assert first.message.startswith("id: 3\n") and (live.cursor, live.message) == (5, ": connected cursor=5\n\n")
    assert feed.sse_backlog(alarms, str(NOW + 99)).collect()[0].message == ": connected cursor=5\n\n"
    mirror = alarms.where("cursor <= 2").select("event_id")
    assert cursors(feed.missing_from_mirror(alarms, mirror)) == [3, 4, 5]
    assert cursors(feed.missing_from_mirror(alarms.unionByName(alarms.withColumn("cursor", alarms.cursor + 5)), mirror)) == [3, 4, 5]


def test_sessions_chain(spark):
    ev = falls(spark, [(0, 1), (900, 2), (1800, 3), (2801, 9)])
    assert sorted(r.copies for r in dedup.session_alarms(ev, 1000).collect()) == [1, 3]
