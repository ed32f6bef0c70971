"""The event log as segments of JSON lines that are read from a position, as a table or as a stream.

A position is (file, byte): everything before it has been read. Files are ordered by their path below the log, so a log is
written in folders whose names rise (`write_segment`). Large files are read in ranges of bytes by separate tasks;
a range takes the lines that begin in it. A stream's offset is a position behind a line end, so a line that is still being
written waits for its end; once a later file exists it counts as torn.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc, fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wardline.operators.validate import last_value_counts, strict_json
from wardline.schemas import EVENTS

FORMAT = "sensor_log"
LINES = "file string, at long, size long, line string"
#: Bytes of a file for one task, bytes read at once; the lines that end in these are one batch.
RANGE_BYTES, READ_BYTES = 16 << 20, 1 << 20


@dataclass(frozen=True, order=True)
class Position:
    """The place in the log before which everything has been read."""

    file: str = ""
    at: int = 0

    def text(self) -> str:
        return json.dumps({"file": self.file, "at": self.at})

    @classmethod
    def of(cls, text: str | None) -> Position:
        return cls(**json.loads(text)) if text else cls()


@dataclass(frozen=True)
class Range(InputPartition):
    """Bytes of one file; the first line that begins in them is the first after `start`, if no line begins there."""

    file: str
    start: int
    stop: int


def files_of(path: str) -> list[tuple[str, int]]:
    """Files of the log in order, with their sizes. Names that begin with a dot or an underscore are none."""
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [(f.path[len(root) :].strip("/"), f.size) for f in found if f.type == fs.FileType.File]
    return sorted((n, size) for n, size in names if not any(part[0] in "._" for part in n.split("/")))


def last_line_end(path: str, file: str, size: int, least: int = 0) -> int:
    """Where the last complete line of a file ends; `least` if there is none after it."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/{file}") as f:
        stop = size
        while stop > least:
            start = max(least, stop - READ_BYTES)
            f.seek(start)
            at = f.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return least


def ranges(files: list[tuple[str, int]], start: Position, stop: Position | None, range_bytes: int) -> list[Range]:
    out = []
    for file, size in files:
        if file < start.file or (stop and file > stop.file):
            continue
        lo, hi = start.at if file == start.file else 0, stop.at if stop and file == stop.file else size
        out += [Range(file, at, min(hi, at + range_bytes)) for at in range(lo, hi, range_bytes)]
    return out


def blocks(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of runs of whole lines that begin in the range; the last line of a file may lack its end."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/{part.file}") as f:
        at, skip = part.start, False
        if at:
            f.seek(at - 1)
            skip = f.read(1) != b"\n"
        f.seek(at)
        held: list[bytes] = []  # a line that has not ended, from `at` on
        end = at
        while at < part.stop:
            data = f.read(READ_BYTES)
            if not data:
                if held and not skip:
                    yield at, b"".join(held)
                return
            # no further than the end of the last line that begins in the range: the first line end at stop - 1 or behind it
            last = data.find(b"\n", max(0, part.stop - 1 - end)) if end + len(data) >= part.stop else -1
            cut = (last if last >= 0 else data.rfind(b"\n")) + 1
            end += len(data)
            if not cut:
                held.append(data)
                continue
            whole, held = b"".join([*held, data[:cut]]), [data[cut:]]
            first = whole.index(b"\n") + 1 if skip else 0
            skip = False
            if first < len(whole) and at + first < part.stop:
                yield at + first, whole[first:]
            at += len(whole)


def lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, bytes with the line end) of each line that begins in the range."""
    for at, block in blocks(path, part):
        for line in io.BytesIO(block):
            yield at, line
            at += len(line)


def line_batch(file: str, at: int, block: bytes) -> pa.RecordBatch:
    """The lines of a block without their ends, cut by numpy; null where a line is no UTF-8."""
    data = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    starts = np.append(0, ends[:-1])
    raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(block)])
    try:
        text = pc.utf8_rtrim(raw.cast(pa.string()), "\r\n")
    except pa.ArrowInvalid:
        text = pa.array([_decoded(x) for x in raw.to_pylist()], pa.string())
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), len(ends)), pa.array(at + starts), pa.array(ends - starts), text], ["file", "at", "size", "line"])


def _decoded(line: bytes) -> str | None:
    try:
        return line.decode().rstrip("\r\n")
    except UnicodeDecodeError:
        return None


def read_range(path: str, part: Range | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # what Spark asks for where there is nothing to read
        return
    for at, block in blocks(path, part):
        yield line_batch(part.file, at, block)


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.start = options["path"], Position.of(options.get("from"))
        self.stop = Position.of(options["to"]) if options.get("to") else None
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(files_of(self.path), self.start, self.stop, self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.start = options["path"], Position.of(options.get("from"))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"file": self.start.file, "at": self.start.at}

    def latestOffset(self) -> dict:
        files = files_of(self.path)
        if not files or files[-1][0] < self.start.file:
            return self.initialOffset()
        file, size = files[-1]
        return {"file": file, "at": last_line_end(self.path, file, size, self.start.at if file == self.start.file else 0)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(files_of(self.path), Position(**start), Position(**end), self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition)


class LogSource(DataSource):
    """Format `sensor_log`. Options: path (a URI), from and to (positions as text), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def _options(path: str, start: Position | None, **more: str) -> dict[str, str]:
    uri = path if "://" in path else f"file://{path}"
    return {"path": uri} | ({"from": start.text()} if start else {}) | more


def log_lines(spark: SparkSession, path: str, start: Position | None = None, stop: Position | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of the log between two positions: file, at, size, line (null if it is no UTF-8)."""
    spark.dataSource.register(LogSource)
    more = {"range_bytes": str(range_bytes)} | ({"to": stop.text()} if stop else {})
    return spark.read.format(FORMAT).options(**_options(path, start, **more)).load()


def log_stream(spark: SparkSession, path: str, start: Position | None = None) -> DataFrame:
    """The same as a stream that begins at a position, unless its checkpoint has one."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format(FORMAT).options(**_options(path, start)).load()


def parsed(rows: DataFrame) -> DataFrame:
    """Lines with `kind` and the fields of an event: event; other (JSON, but no event); torn (no JSON); blank.

    Limits of acceptance are not applied again. An event has a device, a type and a time.
    """
    last_value_counts(rows.sparkSession)
    # one row of a generator for each line: a filter on what it gives is not moved before it, where it would parse the line again
    once = F.struct(F.from_json("line", EVENTS).alias("e"), strict_json(F.col("line")).alias("strict"))
    d = rows.withColumn("__once", F.explode(F.array(once))).select(*rows.columns, "__once.e", F.col("__once.strict").alias("__strict"))
    sound = F.col("e.device_id").isNotNull() & F.col("e.type").isNotNull() & F.col("e.t_ms").isNotNull()
    kind = F.when(F.trim(F.coalesce("line", F.lit("x"))) == "", "blank").when(F.col("line").isNull() | ~F.col("__strict"), "torn").when(F.coalesce(sound, F.lit(False)), "event").otherwise("other")
    return d.withColumn("kind", kind).drop("__strict")


def events_of(rows: DataFrame) -> DataFrame:
    return parsed(rows).where("kind = 'event'").select("e.*")


def end_of(path: str, whole_lines: bool = True) -> Position:
    """Where the log ends just now, to bound what is read while it grows. whole_lines: a last line without an end is not
    counted in, since it may still be written; after a crash nobody will end it."""
    uri = path if "://" in path else f"file://{path}"
    files = files_of(uri)
    if not files:
        return Position()
    file, size = files[-1]
    return Position(file, last_line_end(uri, file, size) if whole_lines else size)


def replayed(spark: SparkSession, path: str, start: Position | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, summary) of a replay; summary has one row: events, other, skipped (torn lines)."""
    rows = parsed(log_lines(spark, path, start))
    summary = rows.agg(*[F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("event", "events"), ("other", "other"), ("torn", "skipped"))])
    return rows.where("kind = 'event'").select("e.*"), summary


def write_segment(events: DataFrame, path: str, number: int) -> None:
    """One more segment: a folder of JSON lines, ordered by its number."""
    events.write.json(f"{path}/segment={number:08d}")


def drop_segments_before(spark: SparkSession, path: str, position: Position) -> int:
    """Delete the segments that lie wholly before a position; returns how many."""
    first = position.file.split("/")[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segment=*"))
    old = [f.getPath() for f in found or [] if f.getPath().getName() < first]
    for folder in old:
        store.delete(folder, True)
    return len(old)
