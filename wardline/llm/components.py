"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.llm import common
from wardline.llm.common import spread_join, stage

#: Bytes of a node where nodes are broadcast.
NODE_BYTES = 64


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One round over staged edges (u, v) with u > v, of at most `most` nodes."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")).withColumn("m", F.least("u", "m"))
    if most * NODE_BYTES <= common.BROADCAST_BYTES:
        linked = both.join(F.broadcast(least), "u")
    else:
        least = stage(least, "least")
        linked = spread_join(both, least, ["u"], "edges")  # the edges of hot nodes stay in place
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of node numbers -> (u, root) for each node but the roots; root is the least number of its component.

    Rounds go on until the edges no longer change, that is, form stars around the roots; each round is staged,
    and only two numbers of it come to the driver.
    """
    clean = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(clean(edges), "edges")
    seen = _mark(now)
    while True:
        most = 2 * seen[0]  # nodes of the edges, and edges of the larger star
        now = stage(clean(_star(stage(clean(_star(now, True, most)), "large"), False, most)), "small")
        mark = _mark(now)
        if mark == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = mark
