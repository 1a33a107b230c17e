"""Interval events: coverage preparation, overlap tests, clipped hours, touched day bins.

All joins are equi-joins on the entity with the range as a residual predicate.  Facts sit on
the left of an inner join, so AQE can split a hot entity; results are reduced to one row per
entity (with a map-side partial aggregate) before they meet the cohort again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions.text import col, flag


def prepare_coverage(
    df: DataFrame,
    start: str = "starttime",
    stop: str = "stoptime",
    fill_hours: int = 24,
    minimum_hours: int = 1,
) -> DataFrame:
    """Add ``coverage_start``, ``coverage_stop`` and ``missing_stop_assumed``.

    A missing stop becomes start + ``fill_hours``; only then is a stop at or before the start
    replaced by start + ``minimum_hours``.
    """
    return df.withColumns(
        {
            "coverage_start": F.col(start).cast("timestamp_ntz"),
            "coverage_stop": covered_until(start, stop, fill_hours, minimum_hours),
            "missing_stop_assumed": F.col(stop).isNull().cast("int"),
        }
    )


def covered_until(start: str, stop: str, fill_hours: int, minimum_hours: int = 1) -> Column:
    """Stop of the coverage, for one rule on missing stops."""
    begin = F.col(start).cast("timestamp_ntz")
    end = F.coalesce(F.col(stop).cast("timestamp_ntz"), clocks.plus(begin, hours=fill_hours))
    return F.when(end <= begin, clocks.plus(begin, hours=minimum_hours)).otherwise(end)


def overlaps(
    start: Column | str, stop: Column | str, lo: Column | str, hi: Column | str, closed: str = "neither"
) -> Column:
    """Interval meets window.

    ``neither``: start < hi and stop > lo.  ``both``: start <= hi and stop >= lo (calendar days).
    ``stop``: start < hi and stop >= lo (administration records).
    """
    s, e, a, b = col(start), col(stop), col(lo), col(hi)
    if closed == "neither":
        return (s < b) & (e > a)
    if closed == "both":
        return (s <= b) & (e >= a)
    if closed == "stop":
        return (s < b) & (e >= a)
    raise ValueError(f"unknown closed rule: {closed}")


def clipped_hours(start: Column | str, stop: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Hours of the interval inside the window, never negative."""
    hours = clocks.hours_between(F.greatest(col(start), col(lo)), F.least(col(stop), col(hi)))
    return F.greatest(hours, F.lit(0.0))


def overlap_join(
    events: DataFrame,
    cohort: DataFrame,
    on: str | Sequence[str],
    lo: str,
    hi: str,
    start: str = "coverage_start",
    stop: str = "coverage_stop",
    closed: str = "neither",
) -> DataFrame:
    """Events that meet their entity's window, with ``window_start`` and ``window_end``."""
    keys = [on] if isinstance(on, str) else list(on)
    windows = cohort.select(*keys, F.col(lo).alias("window_start"), F.col(hi).alias("window_end"))
    return events.join(windows, keys, "inner").where(overlaps(start, stop, "window_start", "window_end", closed))


def overlap_profile(
    events: DataFrame,
    cohort: DataFrame,
    on: str | Sequence[str],
    flags: Mapping[str, Column],
    sums: Mapping[str, Column] | None = None,
    distinct: Mapping[str, Column] | None = None,
    window_cols: Sequence[str] = (),
    distinct_of: Column | None = None,
) -> DataFrame:
    """All windows of one source in one join and one aggregate.

    ``flags`` and ``sums`` are expressions over event and window columns; ``distinct`` are conditions under which the
    values of ``distinct_of`` are counted.  The result is the cohort with one column each (0 where the entity has no event).

    Distinct counts reduce to one row per entity and value first, then to one per entity, so rows are not multiplied by
    the number of counts.
    """
    keys = [on] if isinstance(on, str) else list(on)
    sums, distinct = sums or {}, distinct or {}
    joined = events.join(cohort.select(*keys, *window_cols), keys, "inner")
    aggs = [F.max(flag(c)).alias(k) for k, c in flags.items()] + [F.sum(c).alias(k) for k, c in sums.items()]
    if distinct:
        seen = [F.max(flag(c & distinct_of.isNotNull())).alias(k) for k, c in distinct.items()]
        joined = joined.groupBy(*keys, distinct_of.alias("_value")).agg(*aggs, *seen)
        aggs = [F.max(k).alias(k) for k in flags] + [F.sum(k).alias(k) for k in (*sums, *distinct)]
    reduced = joined.groupBy(*keys).agg(*aggs)
    fills: dict = {k: 0 for k in [*flags, *distinct]}
    fills.update({k: 0.0 for k in sums})
    return cohort.join(reduced, keys, "left").fillna(fills)


def touched_bins(
    events: DataFrame,
    cohort: DataFrame,
    on: str | Sequence[str],
    time0: str,
    horizon_days: int,
    start: str = "coverage_start",
    stop: str = "coverage_stop",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Distinct (entity, ``day_idx``) 24 h bins [t0 + d, t0 + d + 1) met by any interval.

    The first and last touched bin come from arithmetic, so the only expansion is one row per
    touched bin (at most ``horizon_days`` per interval), removed again by the distinct.
    """
    keys = [on] if isinstance(on, str) else list(on)
    day = F.lit(int(clocks.US_PER_DAY))
    joined = events.select(*keys, *keep, start, stop).join(cohort.select(*keys, time0), keys, "inner")
    from_us = clocks.micros_between(time0, start)
    to_us = clocks.micros_between(time0, stop)
    # start < bin end  <=>  bin > start - 1 day;  stop > bin start  <=>  bin < stop
    first_bin = F.greatest(F.floor(from_us / day), F.lit(0)).cast("int")
    last_bin = F.least(F.ceil(to_us / day) - 1, F.lit(horizon_days - 1)).cast("int")
    return (
        joined.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
        .withColumns({"_first": first_bin, "_last": last_bin})
        .where(F.col("_first") <= F.col("_last"))
        .select(*keys, *keep, F.explode(F.sequence("_first", "_last")).alias("day_idx"))
        .distinct()
    )


def longest_run_flag(days: DataFrame, on: Sequence[str], first_start: int, last_start: int, length: int = 3) -> DataFrame:
    """1 where ``length`` consecutive touched days start between the two bounds.

    Consecutive days share ``day_idx - rank``; a run of that many days from ``first_start`` on
    decides.  Input is already distinct by day, so a group has at most ``horizon`` rows.
    """
    starts = [
        F.when(F.col("day_idx").between(first_start + k, last_start + k), F.col("day_idx") - k)
        for k in range(length)
    ]
    return (
        days.select(*on, F.explode(F.array(*starts)).alias("run_start"))
        .where(F.col("run_start").isNotNull())
        .groupBy(*on, "run_start")
        .agg(F.count("*").alias("hits"))
        .groupBy(*on)
        .agg(F.max((F.col("hits") == length).cast("int")).alias("has_run"))
    )
