"""Query parameters as columns; `evaluate` gives one value of them to the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, SparkSession, functions as F

from wardline.functions.times import BLANK, iso_ms

#: Milliseconds of each unit (none: seconds), the window without a parameter, the first number that is a time.
UNITS = {"ms": 1, "s": 1000, "": 1000, "m": 60_000, "h": 3_600_000}
DEFAULT_WINDOW, FIRST_TIME = "5m", 1_000_000_000_000


class BadParameter(ValueError):
    """A query parameter that can't be read; its text is the reason code."""


def evaluate(spark: SparkSession, value: Column) -> Any:
    """A column of literals as a value: optimised to a constant, so that no data are read."""
    return spark.range(1).select(value.alias("value")).first()[0]


def window_ms(raw: Column, most: int) -> Column:
    """A number and a unit (ms, s, m, h; seconds without one) in milliseconds, at most `most`; null if it is no
    positive duration. Without a parameter it is five minutes."""
    text = F.lower(F.trim(F.coalesce(F.nullif(raw, F.lit("")), F.lit(DEFAULT_WINDOW)), F.lit(BLANK)))
    unit = F.regexp_extract(text, "([a-z]*)$", 1)
    amount = F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(unit)), F.lit(BLANK))
    per_unit = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)
    sound = amount.rlike(r"\A[0-9]+([.][0-9]+)?\z") & (amount.try_cast("double") > 0)
    return F.when(sound, F.floor(F.least(amount.try_cast("double") * per_unit, F.when(per_unit.isNotNull(), F.lit(float(most))))))


def since(raw: Column) -> Column:
    """Where to read on, as a struct (kind, value): a cursor, a time (ts, in milliseconds), or invalid.

    Nothing or blanks mean cursor 0; digits alone a cursor below FIRST_TIME and a time from there; else ISO-8601.
    """
    text = F.trim(F.coalesce(raw, F.lit("")), F.lit(BLANK))
    digits = text.rlike(r"\A[0-9]*\z")
    value = F.when(digits, F.coalesce(F.nullif(text, F.lit("")), F.lit("0")).try_cast("long")).otherwise(iso_ms(text))
    kind = F.when(value.isNull(), "invalid").when(digits & (value < FIRST_TIME), "cursor").otherwise("ts")
    return F.struct(kind.alias("kind"), value.alias("value"))


def window_or_fail(spark: SparkSession, raw: str | None, most: int) -> int:
    value = evaluate(spark, window_ms(F.lit(raw).cast("string"), most))
    if value is None:
        raise BadParameter("bad_window")
    return value


def since_or_fail(spark: SparkSession, raw: str | None) -> tuple[str, int]:
    found = evaluate(spark, since(F.lit(raw).cast("string")))
    if found.kind == "invalid":
        raise BadParameter("bad_since")
    return found.kind, found.value


def page_limit(raw: str | int | None, default: int = 200_000, most: int = 1_000_000) -> int:
    try:
        return min(int(raw), most) if raw is not None else default
    except ValueError:
        return default
