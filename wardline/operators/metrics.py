"""Counters, histograms, quantiles, rates and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from wardline.sources.staging import number_rows

#: Upper bounds of latency buckets in milliseconds: fixed values.
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)
QUANTILES = (0.5, 0.95, 0.99)
#: How many of the newest observations quantiles look at.
RING = 20_000


def counters(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def histogram(values: DataFrame, column: str = "value", bounds: tuple = BOUNDS) -> DataFrame:
    """One pass: le (as text, '+Inf' last), n (cumulative), and sum and count of all on each row."""
    v = F.col(column)
    counts = values.agg(*[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0)).alias("sum"))
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(len(bounds)).alias("i"), F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return counts.select(F.inline(rows), "sum", "count")


def quantiles(values: DataFrame, column: str = "value", qs: tuple = QUANTILES) -> DataFrame:
    """Nearest-rank quantiles, exact: one row p50, p95, p99 (null if there is no value)."""
    return values.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(q * 100)}") for q in qs])


def last_n(values: DataFrame, n: int = RING, order: str = "ord") -> DataFrame:
    """The newest n observations, by top-n in each task and a merge."""
    return values.orderBy(F.desc(order)).limit(n)


def share_within(values: DataFrame, limit: int, column: str = "value") -> DataFrame:
    return values.agg(F.count_if(F.col(column) <= limit).alias("within"), F.count(column).alias("total"), F.avg((F.col(column) <= limit).cast("double")).alias("share"))


def rates(events: DataFrame, every_ms: int = 30_000, at: str = "received_ms") -> DataFrame:
    """Events for each interval that has any: start_ms, events, per_second."""
    start = F.floor(F.col(at) / every_ms) * every_ms
    return events.groupBy(start.alias("start_ms")).agg(F.count(F.lit(1)).alias("events")).withColumn("per_second", F.col("events") / (every_ms / 1000.0))


def sampled(events: DataFrame, every: int = 64) -> DataFrame:
    """Every n-th event in order of arrival, exactly: rows are numbered by ranges, not in one task."""
    return number_rows(events, F.col("ord"), name="__nth", first=1).where(F.col("__nth") % every == 0).drop("__nth")


def gauges(events: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: devices, rooms with presence, events, alarms, duplicates_collapsed."""
    e = events.agg(F.countDistinct("device_id").alias("devices"), F.countDistinct(F.when(F.col("type") == "presence", F.col("room_id"))).alias("rooms"), F.count(F.lit(1)).alias("events"))
    a = alarms.agg(F.count(F.lit(1)).alias("alarms"), F.coalesce(F.sum("duplicates_collapsed"), F.lit(0)).alias("duplicates_collapsed"))
    return e.withColumn("one", F.lit(1)).join(F.broadcast(a.withColumn("one", F.lit(1))), "one").drop("one")


def scorecard(found: Column, truth: Column) -> Column:
    """More alarms than falls: leaking; fewer: missing."""
    return F.when(found > truth, "leaking").when(found < truth, "missing").otherwise("ok")


def short(x: Column) -> Column:
    """A number with six significant digits, without trailing zeros, as C's %g writes it."""
    text = F.format_string("%.5e", x.cast("double"))  # d.ddddde+xx
    sign, digits = F.when(x < 0, "-").otherwise(""), F.translate(F.regexp_extract(text, r"([0-9.]+)e", 1), ".", "")
    power = F.regexp_extract(text, r"e([+-][0-9]+)", 1)
    e = power.cast("int")
    whole = F.when(e < 0, "0").otherwise(F.substring(digits, F.lit(1), e + 1))
    part = F.when(e < 0, F.concat(F.repeat(F.lit("0"), -e - 1), digits)).otherwise(F.substring(digits, e + 2, F.lit(6)))
    fixed = F.concat(whole, F.rtrim(F.concat(F.lit("."), F.rtrim(part, F.lit("0"))), F.lit(".")))
    scaled = F.concat(F.substring(digits, 1, 1), F.rtrim(F.concat(F.lit("."), F.rtrim(F.substring(digits, 2, 5), F.lit("0"))), F.lit(".")), F.lit("e"), power)
    return F.concat(sign, F.when(e.between(-4, 5), fixed).otherwise(scaled))


#: The histograms that are exposed, and their help.
HELP = {
    "alarm_publish_latency_ms": "Milliseconds from event acceptance to alarm publication on the feed",
    "ingest_apply_latency_ms": "Milliseconds from event acceptance to aggregation state update",
}


def series(rows: DataFrame, name: str, value: str, label: str | None = None) -> DataFrame:
    """rows -> (name, labels, value), one for each row."""
    labels = F.lit(None).cast("string") if label is None else F.format_string(f'%s="%s"', F.lit(label), F.col(label))
    return rows.select(F.lit(name).alias("name"), labels.alias("labels"), F.col(value).cast("double").alias("value"))


def keyed(rows: DataFrame) -> DataFrame:
    """Series (name, labels, value) by key: the name, and its labels after a bar if it has any."""
    key = F.concat(F.col("name"), F.coalesce(F.concat(F.lit("|"), F.nullif("labels", F.lit(""))), F.lit("")))
    return rows.groupBy(key.alias("key")).agg(F.sum("value").alias("value"))


def histogram_lines(hist: DataFrame, name: str) -> DataFrame:
    """Text exposition of one histogram: i, line."""
    head = F.array(F.lit(f"# HELP {name} {HELP[name]}"), F.lit(f"# TYPE {name} histogram"))
    bucket = F.array(F.format_string(f'{name}_bucket{{le="%s"}} %d', "le", "n"))
    foot = F.array(F.concat(F.lit(f"{name}_sum "), short(F.col("sum"))), F.format_string(f"{name}_count %d", "count"))
    lines = F.when(F.col("i") == 0, F.concat(head, bucket)).when(F.col("le") == "+Inf", F.concat(bucket, foot)).otherwise(bucket)
    d = hist.select("i", F.posexplode(lines).alias("at", "line"))
    return d.select((F.col("i") + F.col("at") + F.when(F.col("i") > 0, 2).otherwise(0)).cast("int").alias("i"), "line")


def prometheus(counted: DataFrame, gauged: DataFrame, histograms: dict[str, DataFrame]) -> DataFrame:
    """Text exposition: part (0 counters, 1 gauges, 2 and on histograms), i, line. counted and gauged have (name, labels, value)."""
    line = F.concat(F.col("name"), F.coalesce(F.concat(F.lit("{"), "labels", F.lit("}")), F.lit("")), F.lit(" "), short(F.col("value")))
    numbered = lambda rows, part: rows.select(F.lit(part).alias("part"), (F.row_number().over(Window.orderBy("name", F.asc_nulls_first("labels"))) - 1).alias("i"), line.alias("line"))  # noqa: E731  a row for each series
    out = numbered(counted, 0).unionByName(numbered(gauged, 1))
    for part, (name, hist) in enumerate(histograms.items(), 2):
        out = out.unionByName(histogram_lines(hist, name).select(F.lit(part).alias("part"), "i", "line"))
    return out


def counter_deltas(snapshots: DataFrame) -> DataFrame:
    """snapshots (at_ms, name, value) -> per_second since the previous one of the name, where it changed."""
    order = Window.partitionBy("name").orderBy("at_ms")
    d = snapshots.withColumn("dv", F.col("value") - F.lag("value").over(order)).withColumn("dt", F.col("at_ms") - F.lag("at_ms").over(order))
    return d.where("dv <> 0").select("at_ms", "name", (F.col("dv") * 1000.0 / F.col("dt")).alias("per_second"))
