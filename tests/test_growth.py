"""What a key of a stream and a line of the log may cost."""

from pathlib import Path

from pyspark.sql import Row, functions as F

from helpers import NOW
from wardline.plans import recovery
from wardline.sources import segments
from wardline.streaming import latency, state


class Held:
    """A list state and a handle in one; notes the calls for timers."""

    def __init__(self):
        self.rows, self.calls = [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = [tuple(r) for r in rows]

    def clear(self):
        self.rows = []

    def registerTimer(self, at):  # noqa: N802
        self.calls.append(("set", at))

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append(("drop", at))

    def listTimers(self):  # noqa: N802
        self.calls.append(("list", 0))
        return iter([at for what, at in self.calls if what == "set"])


def warning(ord_, t, seq):
    return Row(ord=ord_, received_ms=NOW + t, room_id="r", t_ms=NOW + t, seq=seq, confidence=0.5)


def test_a_timer_moves_with_the_oldest_alarm_only():
    held, fold = Held(), state.ExpiringFallDedup(1000, 2, 60_000)
    fold.init(held)
    made = list(fold.handleInputRows(("d",), iter([warning(1, 5000, 9), warning(0, 0, 1)]), None))
    assert [(r.kind, r.ord) for r in made] == [("created", 0), ("created", 1)] and held.calls == [("set", NOW + 61_001)]
    assert [r.kind for r in fold.handleInputRows(("d",), iter([warning(2, 5100, 10)]), None)] == ["amended"] and len(held.calls) == 1
    list(fold.handleInputRows(("d",), iter([warning(3, -100, 1)]), None))
    assert held.calls[1:] == [("drop", NOW + 61_001), ("set", NOW + 60_901)]


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"device_id":"d","type":"x","t_ms":1}\n')
    plan = segments.events_of(segments.log_lines(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("parseJson") == 1, plan
    assert segments.events_of(segments.log_lines(spark, str(tmp_path))).select(F.col("device_id")).first()[0] == "d"


def test_a_join_of_streams_has_one_store_for_each_partition(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(recovery, "scratch", lambda spark, name: f"file://{tmp_path}")
    before = {k: spark.conf.get(k, None) for k in getattr(latency, "STORES", {})}
    assert recovery.delivered(spark, sf).count() > 0
    stores = {p.name for p in Path(tmp_path, "checkpoint/state/0/0").iterdir() if p.is_dir()} - {"_metadata"}
    assert not any(name.startswith(("left-", "right-")) for name in stores), stores
    assert before == {k: spark.conf.get(k, None) for k in before}
