"""Validation of raw events: the first broken rule is the reason; the rest is normalised.

Kinds are taken from the parsed JSON, so that true is no number and "0.9" neither. Rejected events keep their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.config import DEFAULT, Config
from wardline.functions.times import BLANK, iso_ms, number_ms
from wardline.schemas import SLEEP_STATES, TIERS


NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
#: The field that an event of each type must have; net_status, motion and fall_warn have a number.
PAYLOAD = {"presence": "in_room", "motion": "magnitude", "sleep_state": "state", "fall_warn": "confidence", "net_status": "rssi"}


def sealed(text: Column) -> tuple[Column, Column]:
    """The text followed by its own hash, as one JSON array, and that hash. The parser stops after the first value, so the hash
    is the second and last item only if the text ends where its value does."""
    seal = F.xxhash64(text).cast("string")
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))), seal


def last_value_counts(spark: SparkSession) -> None:
    """Let the parser take the last value of a name that stands twice, where it would find the text broken."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(text: Column) -> Column:
    """Whether the whole text is one JSON value."""
    items, seal = sealed(text)
    return F.coalesce(F.try_variant_get(items, "$[1]", "string") == seal, F.lit(False))


def validated(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """raw (ord, received_ms, raw, ...) with `reason` (null: accepted) and the normalised columns.

    The text is parsed once; all fields and their kinds come from that. Of a name that stands twice in an object the last
    value counts. NaN and infinite numbers, which are no JSON, make a text malformed.
    """
    last_value_counts(raw.sparkSession)
    items, seal = sealed(F.col("raw"))
    d = raw.withColumn("__v", items).withColumn("__seal", seal)
    get = lambda n, kind: F.try_variant_get("__v", f"$[0].{n}", kind)
    payload = F.lit(None).cast("variant")
    for kind, name in PAYLOAD.items():
        payload = F.when(F.col("type") == kind, get(name, "variant")).otherwise(payload)
    d = d.withColumn("type", get("type", "string")).withColumn("__p", payload)
    d = d.withColumns({f"__{n}": F.schema_of_variant(get(n, "variant")) for n in ("device_id", "room_id", "ts", "seq")} | {"__kind": F.schema_of_variant("__p")})
    own = lambda n, kind, wanted: F.when(wanted, get(n, kind))
    text = lambda n: own(n, "string", F.col(f"__{n}") == "STRING")
    number = F.when(F.col("__kind").rlike(NUMBER), F.try_variant_get("__p", "$", "double"))
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    d = d.select(
        "*", text("device_id").alias("device_id"), text("room_id").alias("room_id"), own("seq", "bigint", F.col("__seq") == "BIGINT").alias("seq"),
        F.trim(text("ts"), F.lit(BLANK)).alias("__text"), own("ts", "double", F.col("__ts").rlike(NUMBER)).alias("__number"),
        of("presence", F.when(F.col("__kind") == "BOOLEAN", F.try_variant_get("__p", "$", "boolean"))).alias("in_room"), of("sleep_state", F.try_variant_get("__p", "$", "string")).alias("state"),
        F.when(F.abs(number) < float("inf"), number).alias("__finite"),
    )
    d = d.withColumns({name: of(kind, F.col("__finite")) for kind, name in PAYLOAD.items() if name not in ("in_room", "state")})
    d = d.withColumn("t_ms", F.when(F.col("__number").isNotNull(), number_ms(F.col("__number"))).otherwise(iso_ms(F.col("__text"))))
    empty = lambda n: F.coalesce(F.length(n), F.lit(0)) == 0
    bad = lambda kind, broken: (F.col("type") == kind) & broken
    strict = F.coalesce(F.try_variant_get("__v", "$[1]", "string") == F.col("__seal"), F.lit(False))
    reason = (
        F.when(~F.startswith(F.ltrim(F.coalesce("raw", F.lit(""))), F.lit("{")) | ~strict, "malformed")
        .when(empty("device_id"), "missing_device_id")
        .when(empty("room_id"), "missing_room_id")
        .when(~F.coalesce(F.col("type").isin(*TIERS), F.lit(False)), "bad_type")
        .when(F.col("t_ms").isNull(), "bad_ts")
        .when(F.col("t_ms") > F.col("received_ms") + config.future_limit_ms, "ts_too_future")
        .when(F.col("t_ms") < F.col("received_ms") - config.past_limit_ms, "ts_too_old")
        .when((F.coalesce("__seq", F.lit("VOID")) != "VOID") & F.col("seq").isNull(), "bad_seq")
        .when(bad("presence", F.col("in_room").isNull()), "bad_in_room")
        .when(bad("motion", F.col("magnitude").isNull()), "bad_magnitude")
        .when(bad("sleep_state", ~F.coalesce(F.col("state").isin(*SLEEP_STATES), F.lit(False))), "bad_state")
        .when(bad("fall_warn", F.col("confidence").isNull()), "bad_confidence")
        .when(bad("net_status", F.col("rssi").isNull()), "bad_rssi")
    )
    # the partition's number, never negative, keeps filters on the reason above this projection: pushed below it, they
    # would parse the text again for each rule
    reason = F.coalesce(reason, F.when(F.spark_partition_id() < 0, "never"))
    return d.withColumn("reason", reason).drop("__v", "__seal", "__p", "__kind", "__device_id", "__room_id", "__ts", "__seq", "__text", "__number", "__finite")


def tier(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in TIERS.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def accepted(checked: DataFrame) -> DataFrame:
    """The log of accepted events in the schema of `schemas.EVENTS`; payloads of other types are dropped."""
    only = {"in_room": "presence", "magnitude": "motion", "state": "sleep_state", "confidence": "fall_warn", "rssi": "net_status"}
    ok = checked.where("reason IS NULL").withColumn("tier", tier(F.col("type")))
    ok = ok.withColumns({c: F.when(F.col("type") == kind, F.col(c)) for c, kind in only.items()})
    return ok.select("ord", "received_ms", "device_id", "room_id", "type", "t_ms", "seq", *only, "tier")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NOT NULL").select("ord", "received_ms", "raw", "reason")
