"""Which waiting events a drain of `most` takes, by tier, in closed form.

Tier 0 goes first. Of the rest, tier 1 gets all but a quarter, tier 2 what is left, and tier 1 what tier 2 leaves:
the quarter is a floor for telemetry, not a cap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def depths(waiting: DataFrame) -> DataFrame:
    return waiting.groupBy("tier").agg(F.count(F.lit(1)).alias("depth"))


def shares(n0: int, n1: int, n2: int, most: int) -> tuple[int, int, int, int]:
    """How many of tier 0, of tier 1 at first, of tier 2, and of tier 1 again."""
    a0 = min(n0, most)
    left = most - a0
    a1 = min(n1, left - left // 4)
    a2 = min(n2, left - a1)
    return a0, a1, a2, min(n1 - a1, left - a1 - a2)


def drained(waiting: DataFrame, most: int) -> DataFrame:
    """The events taken, with `position` 1, 2, ... At most `most` of each tier are ever ordered together."""
    n = {r.tier: r.depth for r in depths(waiting).collect()}  # three rows
    a0, a1, a2, more = shares(n.get(0, 0), n.get(1, 0), n.get(2, 0), most)
    first = lambda tier, k: waiting.where(F.col("tier") == tier).orderBy("ord").limit(k).withColumn("k", F.row_number().over(Window.partitionBy("tier").orderBy("ord")))
    parts = [first(0, a0).withColumn("position", F.col("k")), first(2, a2).withColumn("position", F.col("k") + a0 + a1)]
    parts.append(first(1, a1 + more).withColumn("position", F.col("k") + a0 + F.when(F.col("k") > a1, a2).otherwise(0)))
    return reduce(DataFrame.unionByName, parts).drop("k")
