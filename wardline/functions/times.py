"""Times as columns. All are independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space around parameters and times.
BLANK = " \t\n\r\x0b\x0c"
#: Date (extended or compact), clock time after any one character, zone: what ISO-8601 text must look like.
_DATE, _CLOCK = r"([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2}))", r"([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
_ZONE = r"(Z|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2})?)?)"
ISO = rf"(?s)\A{_DATE}(?:.{_CLOCK}{_ZONE}?)?\z"
#: The wire format, which needs no taking apart.
WIRE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z"


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; null for dates that don't exist."""
    return F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))


def _zone_ms(zone: Column) -> Column:
    """Offset of a zone: +hh, +hhmm or +hh:mm, with seconds or without."""
    digits = F.rpad(F.translate(zone, "+-:", ""), 6, "0")
    seconds = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60 + F.substring(digits, 5, 2).try_cast("int")
    return F.when(zone.isin("", "Z"), 0).when(seconds < 86_400, F.when(zone.startswith("-"), -seconds).otherwise(seconds) * 1000)


def iso_ms(text: Column) -> Column:
    """ISO-8601 text to epoch milliseconds; without a zone it is UTC; null if it is none or a field is out of range.

    Dates may be compact (20260523), clock times too, and hours may stand alone; week dates are not read. The text is
    used several times, so it should be a plain column.
    """
    part = lambda i: F.regexp_extract(text, ISO, i)
    month, day = F.concat(part(2), part(4)), F.concat(part(3), part(5))
    clock = [F.rpad(part(i), 2, "0") for i in (6, 7, 8)]
    plain = F.concat(part(1), F.lit("-"), month, F.lit("-"), day, F.lit("T"), clock[0], F.lit(":"), clock[1], F.lit(":"), clock[2], F.lit("."), F.rpad(part(9), 6, "0"))
    millis = lambda x: F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x.try_cast("timestamp_ntz")) / 1000)
    return F.when(text.rlike(WIRE), millis(F.substring(text, 1, 23))).when(text.rlike(ISO), millis(plain) - _zone_ms(part(10)))


def number_ms(value: Column) -> Column:
    """An epoch number to milliseconds: below 10^12 it counts seconds."""
    sound = ~F.isnan(value) & (F.abs(value) < 1e18)
    return F.when(sound, F.when(value < 1e12, (value * 1000).cast("long")).otherwise(value.cast("long")))


def to_iso(ms: Column) -> Column:
    """Epoch milliseconds as yyyy-MM-ddTHH:mm:ss.SSSZ, without reference to the session's time zone."""
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int"))
    rest = F.pmod(ms, F.lit(86_400_000))
    clock = F.format_string("T%02d:%02d:%02d.%03dZ", F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000)
    return F.concat(day.cast("string"), clock)


def second_of(ms: Column) -> Column:
    return F.floor(ms / 1000)
