"""What a staged table leaves behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from wardline.sources import staging


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in Path(d).rglob("shuffle_*")}


def test_staging_lets_go_of_shuffles(spark, monkeypatch):
    monkeypatch.setattr(staging, "SWEEP_S", 0.0, raising=False)
    staging.stage(spark.range(10).repartition(2), "first")
    before = shuffle_files(spark)
    out = staging.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    staging.stage(spark.range(10), "next")
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and out.count() == 7


def test_tables_go_with_the_block_they_are_staged_in(spark):
    there = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).exists()
    with staging.passing(spark):
        with staging.passing(spark):
            inner, outer = staging.stage(spark.range(3), "inner"), staging.stage(spark.range(4), "outer", lasts=True)
            assert there(inner) and there(outer)
        assert not there(inner) and outer.count() == 4
        kept = staging.stage(spark.range(5), "kept", lasts=True)
    assert not there(outer) and kept.count() == 5
