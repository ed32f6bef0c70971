"""Request bodies: one JSON event, a JSON array, or lines of JSON, to rows of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators.validate import last_value_counts, strict_json


def parsed(bodies: DataFrame) -> DataFrame:
    """bodies (body_id, received_ms, body) -> a row for each event: body_id, received_ms, pos, raw.

    A body that can't be read gives one row with `body_reason` (empty_body or invalid_json) and no event; an empty
    array gives one row with neither. One bad line spoils the whole body.
    """
    last_value_counts(bodies.sparkSession)
    text = F.regexp_replace(F.coalesce(F.col("body"), F.lit("")), r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split("__t", "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    d = bodies.withColumn("__t", text).withColumn("__v", F.try_parse_json("__t"))
    is_array = F.startswith("__t", F.lit("["))
    kinds = F.transform(F.try_variant_get("__v", "$", "array<variant>"), lambda x: F.struct(F.schema_of_variant(x).alias("kind"), F.to_json(x).alias("json")))
    # objects keep their text, in which 1.0 and 1 differ; other items are malformed whatever they are
    items = F.zip_with(kinds, F.from_json("__t", "array<string>"), lambda k, own: F.when(k["kind"].startswith("OBJECT"), own).otherwise(k["json"]))
    events = F.when(is_array, items).when(F.contains("__t", F.lit("\n")), lines).otherwise(F.array("__t"))
    d = d.withColumn("__events", events)
    broken = F.when(is_array, ~strict_json(F.col("__t"))).otherwise(F.exists("__events", lambda x: ~strict_json(x)))
    reason = F.when(F.col("__t") == "", "empty_body").when(broken, "invalid_json")
    d = d.withColumn("body_reason", reason).withColumn("__events", F.when(F.col("body_reason").isNull(), F.col("__events")))
    return d.select("body_id", "received_ms", "body_reason", F.posexplode_outer("__events").alias("pos", "raw"))


def statuses(checked: DataFrame) -> DataFrame:
    """Validated rows of `parsed` -> the acknowledgement of each body: status, ok, accepted, rejected, reason."""
    real = F.col("raw").isNotNull()
    per_body = checked.groupBy("body_id").agg(
        F.first("body_reason", ignorenulls=True).alias("body_reason"),
        F.count_if(real & F.col("reason").isNull()).alias("accepted"),
        F.count_if(real & F.col("reason").isNotNull()).alias("rejected"),
        F.min_by("reason", F.when(real & F.col("reason").isNotNull(), F.col("pos"))).alias("first_reason"),
    )
    failed = F.col("body_reason").isNotNull() | ((F.col("accepted") == 0) & (F.col("rejected") == 1))
    return per_body.select("body_id", F.when(failed, 400).otherwise(202).alias("status"), (~failed).alias("ok"), "accepted", "rejected", F.coalesce("body_reason", "first_reason").alias("reason"))
