"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share a budget of all words;
a target stops at MAX_EPOCHS times its source's size, and the excess is shared anew by weight (water-filling in
closed form: sources sorted by the level at which they fill up). A source takes floor(target / size) complete
epochs first. The rest is a fractional selection: each document draws the exponential key -ln(u) / w, with u
from a hash of its doc_id and w its quality weight, and documents are taken in key order until the rest is used
up; the last one is taken in part (`taken` is exact) or, in `mix`, whole if at least half of it fits.

Keys are ranked in two levels, so that no source, however large, is sorted in one task: sums for each of BUCKETS
ranges of the key find the range where the budget ends, and only the rows of that range are sorted.

Sources may be as many as domains: they are ordered by ranges (`prefix_sums`), never in one task.

Quality weight: 1 less twice the share of ASCII punctuation and digits, 0.05 at least (or a column of yours).

Defined results: null text has size 0 and is never taken; null sources form one source; sources without words
have target 0; rows that repeat in doc_id, source and size draw the same key and share what is taken evenly
(rounded down); an empty table gives no rows; other columns, whatever their names, are kept by `mix` and don't matter
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from wardline.llm.common import WORD, number_rows, partnered, prefix_sums, sized, stage

MAX_EPOCHS, BUCKETS, SEED = 3, 4096, "mix-1"
WEIGHTS = (1, 2, 3)
SYMBOL = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"


def quality(text: Column) -> Column:
    share = F.regexp_count(text, F.lit(SYMBOL)).cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(2.0) * share)


def _keyed(docs: DataFrame, weight: Column | None, *carried: Column) -> DataFrame:
    """carried, doc_id, source, size, key and bucket of each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.substring(F.md5(F.encode(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")), 1, 13)
    u = (F.conv(head, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    w = quality(text) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.05)), F.lit(1e-6))
    out = docs.select(*carried, "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(u) / w).alias("key"))
    return out.withColumn("bucket", F.floor(F.lit(float(BUCKETS)) * F.col("key") / (F.col("key") + 1.0)).cast("int"))


def targets(totals: DataFrame) -> DataFrame:
    """Staged source, source_size -> target (double)."""
    w = F.lit(None)
    for i, x in enumerate(WEIGHTS):
        w = F.when(F.col("place") % len(WEIGHTS) == i, x).otherwise(w)
    t = number_rows(totals, F.asc_nulls_last("source"), name="place").withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    t = stage(t.withColumn("level", F.col("cap").cast("double") / F.col("w").cast("double")).drop("place"), "levels")
    every = t.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    t = prefix_sums(t, [F.asc("level"), F.asc_nulls_last("source")], {"caps": "cap", "ws": "w"}).withColumn("one", F.lit(1))
    t = t.join(F.broadcast(every.withColumn("one", F.lit(1))), "one")  # one row
    t = stage(t.withColumn("left", F.col("all_size") - F.col("caps")).withColumn("w_left", F.col("all_w") - F.col("ws")), "filling")
    share = lambda left, w_left: (F.col("w") * left).cast("double") / w_left.cast("double")
    fits = t.where(share(F.col("left"), F.col("w_left")) <= F.col("cap").cast("double"))
    # the first source, in the order in which they fill up, whose share of the rest is within its cap
    at = fits.agg(F.max(F.struct("w_left", "left")).alias("at")).withColumn("one", F.lit(1))
    t = t.join(F.broadcast(at), "one", "left")  # one row
    open_ = F.col("w_left") <= F.col("at.w_left")
    return t.withColumn("target", F.when(open_, share(F.col("at.left"), F.col("at.w_left"))).otherwise(F.col("cap").cast("double"))).select("source", "source_size", "target")


def plan(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From staged (doc_id, source, size, key, bucket): a row for each source, and the rows of the ranges where budgets end."""
    totals = stage(scored.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    t = targets(totals).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("source_size"), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))))
    t = stage(t.withColumnRenamed("source", "s"), "targets")
    sums = scored.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("through", F.sum("n").over(running))
    ends = sums.join(sized(t), F.col("source").eqNullSafe(F.col("s"))).where("through - n <= rest and rest < through")
    ends = ends.select(F.col("source").alias("s2"), F.col("bucket").alias("end_bucket"), (F.col("through") - F.col("n")).alias("end_before"))
    per_source = t.join(ends, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    per_source = stage(per_source, "per_source")
    last = scored.join(sized(per_source), F.col("source").eqNullSafe(F.col("s"))).where("bucket = end_bucket")
    groups = last.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("end_before").alias("end_before"))
    order = Window.partitionBy("source").orderBy("key", F.asc_nulls_last("doc_id"), "size")
    before = F.col("end_before") + F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") * F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("n") * F.col("size"), F.col("rest") - before))
    edge = groups.withColumn("edge_extra", F.floor(extra / F.col("n")).cast("long")).select(F.col("key").alias("k2"), F.col("doc_id").alias("d2"), F.col("source").alias("s3"), F.col("size").alias("n2"), "edge_extra")
    return per_source, stage(edge, "edge")


def _scored(docs: DataFrame, weight: Column | None) -> DataFrame:
    return stage(_keyed(docs, weight), "scored")


def _decided(rows: DataFrame, per_source: DataFrame, edge: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, key, bucket, ...) with epochs and extra: what is taken beyond complete epochs."""
    out = rows.join(sized(per_source), F.col("source").eqNullSafe(F.col("s")), "left")
    same = (F.col("key") == F.col("k2")) & (F.col("size") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("source").eqNullSafe(F.col("s3"))
    out = partnered(out, edge, same, F.xxhash64("key", "size", "doc_id", "source"), F.xxhash64("k2", "n2", "d2", "s3"), "left")
    inside = F.col("end_bucket").isNotNull()
    extra = F.when(inside & (F.col("bucket") < F.col("end_bucket")), F.col("size")).when(inside & (F.col("bucket") == F.col("end_bucket")), F.coalesce("edge_extra", F.lit(0)))
    whole = F.col("rest") >= F.col("source_size")  # no range ends the budget: all is taken once more
    return out.withColumn("extra", F.coalesce(extra, F.when(whole, F.col("size")), F.lit(0)).cast("long"))


def mixture(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    scored = _scored(docs, weight)
    return _decided(scored, *plan(scored)).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, all columns kept."""
    per_source, edge = plan(_scored(docs, weight))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs can clash with ours
    times = F.col("epochs") + F.when((F.col("size") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    taken = _decided(_keyed(docs, weight, row), per_source, edge).select("row", times.cast("int").alias("times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP1_SQL = rf"""
WITH k AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52})
         / greatest(0.05, 1.0::DOUBLE - 2.0::DOUBLE * (len(regexp_extract_all(coalesce(text, ''), '{SYMBOL}'))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS key
  FROM documents),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source)),
f AS (SELECT *, row_number() OVER o AS i, sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0) AS rest_t, sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS rest_w
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST), e AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT min(i) AS at FROM f WHERE (w * rest_t)::DOUBLE / rest_w::DOUBLE <= cap),
t AS (SELECT f.source, f.source_size, CASE WHEN f.i >= first.at THEN (f.w * g.rest_t)::DOUBLE / g.rest_w::DOUBLE ELSE f.cap::DOUBLE END AS target FROM f, first LEFT JOIN f g ON g.i = first.at),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT *, greatest(0, least(source_size, round(target - epochs * source_size)::BIGINT)) AS rest FROM e),
g AS (SELECT source, key, doc_id, size, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT *, sum(n * size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n * size AS before FROM g)
SELECT k.doc_id, k.size, p.source_size, p.target, (p.epochs * k.size + greatest(0, least(r.n * r.size, p.rest - r.before)) // r.n)::BIGINT AS taken
FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
JOIN r ON r.source IS NOT DISTINCT FROM k.source AND r.key = k.key AND r.size = k.size AND r.doc_id IS NOT DISTINCT FROM k.doc_id
"""
