"""Fall warnings to alarms: a fold in order of arrival that collapses jitter copies.

For each device, a warning joins the first alarm (in order of creation) whose time is at most `window_ms` away and,
where both have sequence numbers, whose range of numbers is at most `slack` away; else it becomes a new alarm.
An alarm's time only moves back, its identity and room stay those of the first copy.

Warnings of a device more than window_ms apart in time, with none between them, can never touch the same alarm, as an
alarm's time is always that of one of its copies. The fold therefore runs within such islands of time, each
of which is one short array, and not over a device's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from wardline.config import DEFAULT, Config
from wardline.functions.times import to_iso
from wardline.schemas import PUBLIC_ALARM
from wardline.sources.staging import number_rows

ALARM = "array<struct<ord:bigint,t0:bigint,room_id:string,ts_ms:bigint,confidence:double,dups:int,q0:bigint,q1:bigint>>"


def islands(falls: DataFrame, window_ms: int) -> DataFrame:
    """Adds `island`: a number that changes where a device is silent for more than window_ms."""
    order = Window.partitionBy("device_id").orderBy("t_ms", "ord")
    gap = F.coalesce((F.col("t_ms") - F.lag("t_ms").over(order) > window_ms).cast("int"), F.lit(0))
    return falls.withColumn("__gap", gap).withColumn("island", F.sum("__gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__gap")


def _matches(a: Column, f: Column, window_ms: int, slack: int | None) -> Column:
    near = F.abs(f["t"] - a["ts_ms"]) <= window_ms
    if slack is None:
        return near
    return near & (f["q"].isNull() | a["q0"].isNull() | f["q"].between(a["q0"] - slack, a["q1"] + slack))


def _fold(copies: Column, window_ms: int, slack: int | None, known: Column | None = None) -> Column:
    def step(acc: Column, f: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: _matches(a, f, window_ms, slack)), True)
        new = F.struct(f["ord"].alias("ord"), f["t"].alias("t0"), f["room_id"].alias("room_id"), f["t"].alias("ts_ms"), f["confidence"].alias("confidence"), F.lit(0).alias("dups"), f["q"].alias("q0"), f["q"].alias("q1"))

        def amended(a: Column, i: Column) -> Column:
            more = F.struct(
                a["ord"].alias("ord"), a["t0"].alias("t0"), a["room_id"].alias("room_id"), F.least(a["ts_ms"], f["t"]).alias("ts_ms"),
                F.greatest(a["confidence"], f["confidence"]).alias("confidence"), (a["dups"] + 1).alias("dups"), F.least(a["q0"], f["q"]).alias("q0"), F.greatest(a["q1"], f["q"]).alias("q1"),
            )
            return F.when(i == at - 1, more).otherwise(a)

        return F.when(F.coalesce(at, F.lit(0)) == 0, F.concat(acc, F.array(new))).otherwise(F.transform(acc, amended))

    return F.aggregate(copies, F.array().cast(ALARM) if known is None else known, step)


def fold_falls(events: DataFrame, window_ms: int | None = None, slack: int | None = 2, config: Config = DEFAULT) -> DataFrame:
    """Alarms without cursors: ord and time of the first copy, and what the copies amended. slack None: no guard."""
    window_ms = config.dedup_window_ms if window_ms is None else window_ms
    falls = islands(events.where("type = 'fall_warn'").select("device_id", "room_id", "ord", "t_ms", "seq", "confidence"), window_ms)
    lists = falls.groupBy("device_id", "island").agg(F.array_sort(F.collect_list(_copy())).alias("copies"))
    return shown(lists.select("device_id", F.inline(_fold(F.col("copies"), window_ms, slack))))


def _copy() -> Column:
    return F.struct("ord", F.col("t_ms").alias("t"), F.col("seq").alias("q"), "confidence", "room_id")


def fold_onto(known: DataFrame, events: DataFrame, window_ms: int | None = None, slack: int | None = 2, config: Config = DEFAULT) -> DataFrame:
    """State of alarms (device_id and the fields of ALARM) -> their state after later events.

    An alarm stands at its own time among the new warnings, so islands bound the fold as they do without known alarms.
    Alarms of devices without a new warning pass where they are.
    """
    window_ms = config.dedup_window_ms if window_ms is None else window_ms
    falls = events.where("type = 'fall_warn'").select("device_id", "room_id", "ord", "t_ms", "seq", "confidence")
    touched = falls.select("device_id").distinct()
    fields = [c.split(":")[0] for c in ALARM.removeprefix("array<struct<").removesuffix(">>").split(",")]
    kind = ALARM.removeprefix("array<").removesuffix(">")
    own = known.join(touched, "device_id", "left_semi").select("device_id", "ord", F.col("ts_ms").alias("t_ms"), F.struct(*fields).cast(kind).alias("alarm"))
    points = falls.select("device_id", "ord", "t_ms", _copy().alias("copy")).unionByName(own, allowMissingColumns=True)
    lists = islands(points, window_ms).groupBy("device_id", "island").agg(F.array_sort(F.collect_list("alarm")).alias("alarms"), F.array_sort(F.collect_list("copy")).alias("copies"))
    folded = lists.select("device_id", F.inline(_fold(F.col("copies"), window_ms, slack, F.col("alarms"))))
    return known.join(touched, "device_id", "left_anti").select("device_id", *fields).unionByName(folded)


def fold_state(events: DataFrame, window_ms: int | None = None, slack: int | None = 2, config: Config = DEFAULT) -> DataFrame:
    """State of all alarms of events, to be continued by `fold_onto`."""
    empty = events.sparkSession.createDataFrame([], "device_id string, ord long, t0 long, room_id string, ts_ms long, confidence double, dups int, q0 long, q1 long")
    return fold_onto(empty, events, window_ms, slack, config)


def shown(state: DataFrame) -> DataFrame:
    """State of alarms as alarms without cursors."""
    return state.select(
        "ord", F.concat(F.lit("fall_"), "device_id", F.lit("_"), F.col("t0").cast("string")).alias("event_id"), "device_id", "room_id", to_iso(F.col("ts_ms")).alias("ts"), "ts_ms",
        "confidence", F.col("dups").alias("duplicates_collapsed"), F.col("q0").alias("seq_min"), F.col("q1").alias("seq_max"),
    )


def alarm_log(events: DataFrame, window_ms: int | None = None, slack: int | None = 2, config: Config = DEFAULT) -> DataFrame:
    """Alarms with dense cursors 1, 2, ... in order of creation (schemas.ALARMS)."""
    numbered = number_rows(fold_falls(events, window_ms, slack, config), F.col("ord"), name="cursor", first=1)
    return numbered.select("event_id", "device_id", "room_id", "ts", "ts_ms", "confidence", "cursor", "duplicates_collapsed", "seq_min", "seq_max")


def session_alarms(events: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions of warnings by device, a gap of exactly gap_ms included: chains, unlike the fold. device_id, start_ms, copies."""
    at = events.where("type = 'fall_warn'").withColumn("at", F.timestamp_millis("t_ms"))
    return at.groupBy("device_id", F.session_window("at", f"{gap_ms} milliseconds")).agg(F.min("t_ms").alias("start_ms"), F.count(F.lit(1)).alias("copies")).drop("session_window")


def public(alarms: DataFrame) -> DataFrame:
    return alarms.select(*PUBLIC_ALARM)
