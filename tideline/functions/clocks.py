"""Clock arithmetic and decoding of split date and time fields.

Everything stays in ``timestamp_ntz``, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, text

US_PER_HOUR = 3_600_000_000.0
US_PER_DAY = 86_400_000_000.0


def plus(c: Column | str, *, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    return col(c) + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def plus_seconds(c: Column, seconds: Column) -> Column:
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def midnight(date: Column | str) -> Column:
    return col(date).cast("date").cast("timestamp_ntz")


def micros_between(start: Column | str, stop: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(stop))


def hours_between(start: Column | str, stop: Column | str) -> Column:
    return micros_between(start, stop) / F.lit(US_PER_HOUR)


def days_between(start: Column | str, stop: Column | str) -> Column:
    return micros_between(start, stop) / F.lit(US_PER_DAY)


def boundaries_crossed(unit: str, start: Column | str, stop: Column | str) -> Column:
    """Number of minute/hour boundaries between two instants (not whole elapsed units)."""
    a, b = F.date_trunc(unit, col(start)), F.date_trunc(unit, col(stop))
    return F.timestamp_diff(unit.upper(), a, b)


def age_years_from_days(birth: Column | str, at: Column | str) -> Column:
    return F.datediff(col(at), col(birth)) / F.lit(365.25)


def age_years_from_seconds(birth: Column | str, at: Column | str) -> Column:
    return days_between(birth, at) / F.lit(365.25)


def first_clock(*candidates: Column | str) -> Column:
    """Precise clock if present, else the date-level one."""
    return F.coalesce(*[col(c).cast("timestamp_ntz") for c in candidates])


# Fixed value: accepted text clocks.
TEXT_CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?$"


def combine_hhmm(date: Column | str, time: Column | str) -> Column:
    """Date plus numeric HHMM; invalid or missing time falls back to midnight."""
    value = col(time).cast("double")
    hour, minute = F.floor(value / 100), F.pmod(value, F.lit(100.0))
    ok = hour.between(0, 23) & minute.between(0, 59)
    return plus_seconds(midnight(date), F.when(ok, hour * 3600 + minute * 60).otherwise(F.lit(0.0)))


def combine_text(date: Column | str, time: Column | str) -> Column:
    """Date plus ``HH:MM[:SS[.f]]``; invalid or missing time falls back to midnight."""
    raw = F.trim(text(time))
    hour = F.regexp_extract(raw, TEXT_CLOCK, 1).try_cast("double")
    minute = F.regexp_extract(raw, TEXT_CLOCK, 2).try_cast("double")
    second = F.coalesce(F.regexp_extract(raw, TEXT_CLOCK, 3).try_cast("double"), F.lit(0.0))
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59.999999)
    return plus_seconds(midnight(date), F.when(ok, hour * 3600 + minute * 60 + second).otherwise(F.lit(0.0)))


def decode_clock(date: Column | str, time: Column | str, numeric_first: bool = False) -> Column:
    """Date plus a text clock or seconds since midnight; null where neither reads.

    ``numeric_first`` tries the number before the text and gives up after both; the default
    order tries the text first and retries it last.
    """
    day = col(date).try_cast("date")
    raw = F.trim(col(time).cast("string"))
    number = raw.try_cast("double")
    as_seconds = plus_seconds(day.cast("timestamp_ntz"), number)
    as_text = F.concat_ws(" ", day.cast("string"), raw).try_cast("timestamp_ntz")
    in_day = number.between(0, 86399)
    has_colon = raw.contains(":")
    if numeric_first:
        return F.when(day.isNotNull() & in_day, as_seconds).when(day.isNotNull() & has_colon, as_text)
    return (
        F.when(day.isNull() | raw.isNull(), F.lit(None).cast("timestamp_ntz"))
        .when(has_colon, as_text)
        .when(in_day, as_seconds)
        .otherwise(as_text)
    )


def decode_clock_or_midnight(date: Column | str, time: Column | str) -> Column:
    """As ``decode_clock`` with a blank time read as 00:00:00."""
    blank = F.coalesce(F.nullif(F.trim(col(time).cast("string")), F.lit("")), F.lit("00:00:00"))
    return decode_clock(date, blank)


def span_start(date: Column | str) -> Column:
    return col(date).try_cast("date").cast("timestamp_ntz")


def span_stop(date: Column | str) -> Column:
    return plus(span_start(date), hours=23, minutes=59, seconds=59)
