"""The event log as JSON lines or Parquet: write, replay, drop old parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.operators.validate import last_value_counts, strict_json
from wardline.schemas import EVENTS

HOUR_MS = 3_600_000


def write_log(events: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Append events as Parquet, a folder for each type and hour of arrival, so that readers prune both."""
    hour = F.floor(F.col("received_ms") / HOUR_MS)
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = events.select(*names, F.col("type").alias("event_type"), hour.alias("hour"))
    rows.write.mode("append").option("maxRecordsPerFile", max_records).partitionBy("event_type", "hour").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS + ", event_type STRING, hour BIGINT").parquet(path)


def of_type(log: DataFrame, kind: str) -> DataFrame:
    """Events of one type: read from its folders only."""
    return log.where(F.col("event_type") == kind).drop("event_type", "hour")


def truncate_before(log: DataFrame, hour: int) -> DataFrame:
    """What is left of the log from an hour on; whole folders are skipped."""
    return log.where(F.col("hour") >= hour)


def drop_before(spark: SparkSession, path: str, hour: int) -> int:
    """Delete the folders of hours before `hour` from the log on disk; returns how many went. Folder names alone are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/event_type=*/hour=*"))
    old = [f.getPath() for f in found or [] if int(f.getPath().getName().split("=")[1]) < hour]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of events -> (events, skipped lines). A line that can't be read is skipped wherever it stands.

    Limits of acceptance are not applied again; lines without a device, a type or a time are no events.
    """
    last_value_counts(spark)
    lines = spark.read.text(path)
    parsed = lines.withColumn("e", F.from_json("value", EVENTS))
    sound = F.col("e.device_id").isNotNull() & F.col("e.type").isNotNull() & F.col("e.t_ms").isNotNull()
    ok = F.coalesce(sound, F.lit(False)) & strict_json(F.col("value"))
    return parsed.where(ok).select("e.*"), parsed.where(~ok & (F.trim("value") != "")).select("value")


def export_lines(events: DataFrame, path: str) -> None:
    """Events as JSON lines, which `replay` reads."""
    events.write.mode("append").json(path)
