"""Tolerant date parsing. Results are TIMESTAMP_NTZ in UTC; what cannot be read is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rapport.functions.text import strip

NTZ = "timestamp_ntz"


def parse_export_datetime(date: Column, time: Column) -> Column:
    """Date and time columns of a chat export.

    Day-first unless the second number can only be a day; two-digit years pivot
    at 69; year-first dates are accepted; AM/PM and seconds are optional.
    """
    d = F.replace(strip(F.coalesce(date, F.lit(""))), F.lit("."), F.lit("/"))
    t = F.upper(F.coalesce(time, F.lit("")))
    short = r"^(\d{1,2})([/\-])(\d{1,2})\2(\d{4}|\d{2})$"
    long = r"^(\d{4})([/\-])(\d{1,2})\2(\d{1,2})$"

    def number(c: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(c, pattern, group).try_cast("int")

    first, second = number(d, short, 1), number(d, short, 3)
    year_text = F.regexp_extract(d, short, 4)
    year_number = year_text.try_cast("int")
    year = (F.when(F.length(year_text) == 4, year_number)
            .when(year_number >= 69, year_number + 1900)
            .otherwise(year_number + 2000))
    month_first = (second > 12) & (first <= 12)
    year = F.coalesce(year, number(d, long, 1))
    month = F.coalesce(F.when(month_first, first).otherwise(second), number(d, long, 3))
    day = F.coalesce(F.when(month_first, second).otherwise(first), number(d, long, 4))

    clock = r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?"
    hour12, half = number(t, clock, 1), F.regexp_extract(t, clock, 4)
    hour = (F.when((half == "PM") & (hour12 < 12), hour12 + 12)
            .when((half == "AM") & (hour12 == 12), 0)
            .otherwise(F.coalesce(hour12, F.lit(0))))
    minute = F.coalesce(number(t, clock, 2), F.lit(0))
    second_of = F.coalesce(number(t, clock, 3), F.lit(0))
    return F.coalesce(
        F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second_of)
        .try_cast(NTZ),
        parse_iso(F.concat_ws(" ", d, strip(t))),
    )


def parse_iso(c: Column) -> Column:
    """ISO-8601 text, with or without an offset, as UTC."""
    text = strip(c.cast("string"))
    guarded = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"),
        F.regexp_replace(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"),
                         r"([T ]\d{2})(Z|[+-]|$)", "$1:00$2"),
    )
    return guarded.try_cast("timestamp").cast(NTZ)


def parse_epoch(c: Column) -> Column:
    """Epoch seconds, or milliseconds when above 1e12; zero and below is NULL."""
    value = c.try_cast("double")
    seconds = F.when(value > 1e12, value / 1000.0).otherwise(value)
    usable = F.when((seconds > 0) & (seconds < 253402300800), seconds)
    return F.timestamp_micros(F.round(usable * 1000000).cast("bigint")).cast(NTZ)


def parse_any(c: Column) -> Column:
    """Numbers are epochs, everything else ISO text."""
    return F.coalesce(parse_iso(c), F.when(c.rlike(r"^\s*\d+(\.\d+)?\s*$"), parse_epoch(c)))


def parse_calendar_stamp(c: Column) -> Column:
    """iCalendar stamps: 20240131, 20240131T101500 or 20240131T101500Z."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    day = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    clock = F.concat_ws(":", F.substring(digits, 9, 2), F.substring(digits, 11, 2), F.substring(digits, 13, 2))
    return (F.when(c.rlike(r"^\d{8}T\d{6}Z?$"), F.concat_ws(" ", day, clock).try_cast(NTZ))
            .when(c.rlike(r"^\d{8}$"), day.try_cast(NTZ)))


def ntz(value) -> Column:
    """A literal UTC timestamp from a string, datetime or Column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast(NTZ)


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from earlier to later, rounded down (negative in the future)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / 86400000000).cast("bigint")


def days_ago(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"interval {int(days)} days")
