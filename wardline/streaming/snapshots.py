"""Snapshots of the derived state in numbered generations, and recovery from the newest sound one and the log.

A generation is a folder of tables and, written last, a manifest: version, log position, and rows and a checksum of each table.
Nothing points to a generation before it is whole, and no generation is changed once it is written. Reading goes from the
newest down: one without a readable manifest, of another version, or whose tables don't add up is passed over. The newest
KEEP sound generations stay.

The state is what can't be told from the log behind the position without reading it all: alarms with their cursors and what
copies may still amend, heartbeat rings with the registry, and the timelines of rooms. Recovery reads the log from the
position on and folds it onto the state.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.config import DEFAULT, Config
from wardline.operators import dedup, occupancy, rings
from wardline.sources.segments import Position, end_of, events_of, log_lines, parsed
from wardline.sources.staging import number_rows

VERSION, KEEP = 1, 2
MANIFEST = "version int, generation long, created_ms long, position string, tables map<string,struct<rows:long,sum:long>>"


@dataclass(frozen=True)
class Snapshot:
    generation: int
    position: Position
    tables: dict[str, DataFrame]
    created_ms: int = 0


def _checks(table: DataFrame) -> tuple[int, int]:
    """Rows, and the sum of their hashes: the same whatever the order of rows and files."""
    row = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*table.columns)), F.lit(0)).alias("sum")).first()
    return row.rows, row.sum


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all generations on disk, sound or not, newest first."""
    store, path = _fs(spark, root)
    found = store.globStatus(path(f"{root}/generation=*")) or []
    return sorted((int(f.getPath().getName().split("=")[1]) for f in found), reverse=True)


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], position: Position, created_ms: int = 0) -> int:
    """Write the next generation and return its number; older ones beyond the newest KEEP sound ones go."""
    known = generations(spark, root)
    number = known[0] + 1 if known else 1
    base, sums = f"{root}/generation={number:08d}", {}
    for name, table in tables.items():
        table.write.parquet(f"{base}/{name}")
        sums[name] = _checks(spark.read.schema(table.schema).parquet(f"{base}/{name}"))
    row = [(VERSION, number, created_ms, position.text(), sums)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(f"{base}/manifest")
    prune(spark, root)
    return number


def read(spark: SparkSession, root: str, number: int) -> Snapshot | None:
    """One generation, or None if it is not sound."""
    base = f"{root}/generation={number:08d}"
    try:
        rows = spark.read.schema(MANIFEST).json(f"{base}/manifest").collect()  # one row; what can't be read gives nulls
        if len(rows) != 1 or rows[0].version != VERSION or rows[0].generation != number or rows[0].tables is None:
            return None
        tables = {name: spark.read.parquet(f"{base}/{name}") for name in rows[0].tables}
        if any(_checks(tables[name]) != tuple(want) for name, want in rows[0].tables.items()):
            return None
    except (PySparkException, Py4JJavaError):  # a folder is missing, or a file is cut
        return None
    return Snapshot(number, Position.of(rows[0].position), tables, rows[0].created_ms)


def load(spark: SparkSession, root: str) -> Snapshot | None:
    """The newest sound generation."""
    return next((s for s in (read(spark, root, n) for n in generations(spark, root)) if s), None)


def prune(spark: SparkSession, root: str) -> None:
    """Delete generations older than the newest KEEP; a broken one counts for nothing, so a sound one is never lost to it."""
    known = generations(spark, root)
    if len(known) <= KEEP:
        return
    sound, (store, path) = 0, _fs(spark, root)
    for number in known:
        if sound >= KEEP:
            store.delete(path(f"{root}/generation={number:08d}"), True)
        elif read(spark, root, number):
            sound += 1


def state_of(events: DataFrame, window_ms: int | None = None, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """The state after events, from nothing."""
    state = dedup.fold_state(events, window_ms, config=config)
    points = _points(events.where("type = 'presence'").select("room_id", "t_ms", "in_room", "ord"))
    return {"alarms": number_rows(state, F.col("ord"), name="cursor", first=1), "rings": rings.rings(events), "points": points}


def _points(rows: DataFrame) -> DataFrame:
    """One point for each room and time, the last arrival's."""
    return rows.groupBy("room_id", "t_ms").agg(F.max_by("in_room", "ord").alias("in_room"), F.max("ord").alias("ord"))


def advanced(state: dict[str, DataFrame], events: DataFrame, window_ms: int | None = None, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """The state after further events. Alarms that had a cursor keep it; new ones continue the count."""
    spark, known = events.sparkSession, state["alarms"]
    head = known.agg(F.max("cursor")).first()[0] or 0
    folded = dedup.fold_onto(known, events, window_ms, config=config)
    cursors = known.select("device_id", F.col("ord").alias("ord"), "cursor")
    both = folded.join(cursors, ["device_id", "ord"], "left")
    new = number_rows(both.where("cursor IS NULL").drop("cursor"), F.col("ord"), name="cursor", first=head + 1)
    points = _points(state["points"].unionByName(events.where("type = 'presence'").select("room_id", "t_ms", "in_room", "ord")))
    return {"alarms": both.where("cursor IS NOT NULL").unionByName(new), "rings": state["rings"].unionByName(rings.rings(events)), "points": points}


def pruned(state: dict[str, DataFrame], as_of_ms: int, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """The state without history that no query can reach: old points of rooms, and rings merged to one for each device."""
    kept = occupancy.pruned(state["points"], as_of_ms, config)
    return state | {"points": kept, "rings": rings.merge(state["rings"])}


def recover(spark: SparkSession, root: str, log: str, window_ms: int | None = None, config: Config = DEFAULT) -> tuple[dict[str, DataFrame], DataFrame]:
    """(state, summary): the newest sound snapshot with the log behind its position, or the whole log if there is none.

    summary has one row: generation (null: none), replayed, skipped (torn lines), file and at (the position reached).
    """
    found, reached = load(spark, root), end_of(log, whole_lines=False)
    rows = log_lines(spark, log, found.position if found else None, reached)
    events = events_of(rows)
    state = advanced(found.tables, events, window_ms, config) if found else state_of(events, window_ms, config)
    counts = parsed(rows).agg(F.count_if(F.col("kind") == "event").alias("replayed"), F.count_if(F.col("kind") == "torn").alias("skipped"))
    summary = counts.select(F.lit(found.generation if found else None).cast("long").alias("generation"), "replayed", "skipped", F.lit(reached.file).alias("file"), F.lit(reached.at).cast("long").alias("at"))
    return state, summary


def advance_if_due(spark: SparkSession, root: str, log: str, now_ms: int, config: Config = DEFAULT) -> int | None:
    """The next generation, with history pruned that no query can reach, if the newest sound one is snapshot_ms old or there is none."""
    found = load(spark, root)
    if found and now_ms - found.created_ms < config.snapshot_ms:
        return None
    return advance(spark, root, log, config=config, now_ms=now_ms)


def advance(spark: SparkSession, root: str, log: str, window_ms: int | None = None, config: Config = DEFAULT, now_ms: int | None = None) -> int:
    """Write the next generation: the newest sound one with the whole lines that the log has behind its position."""
    found, reached = load(spark, root), end_of(log)
    events = events_of(log_lines(spark, log, found.position if found else None, reached))
    state = advanced(found.tables, events, window_ms, config) if found else state_of(events, window_ms, config)
    return save(spark, root, state if now_ms is None else pruned(state, now_ms, config), reached, now_ms or 0)


def alarms_of(state: dict[str, DataFrame]) -> DataFrame:
    """Alarms of the state in the schema of schemas.ALARMS."""
    return dedup.shown(state["alarms"]).join(state["alarms"].select("ord", "cursor"), "ord").drop("ord").select(
        "event_id", "device_id", "room_id", "ts", "ts_ms", "confidence", "cursor", "duplicates_collapsed", "seq_min", "seq_max"
    )
