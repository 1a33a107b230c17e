"""Fixed-horizon outcomes from the landmark, hour level and calendar-day level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions.numbers import clip
from ..functions.text import col, flag
from .intervals import longest_run_flag, touched_bins


def add_mortality(
    df: DataFrame, time0: str, horizon_days: int = 30, death: str = "deathtime", death_date: str | None = "dod"
) -> DataFrame:
    """Death in the closed [t0, t0 + horizon]; follow-up is days to death or the horizon."""
    died = clocks.first_clock(death, death_date) if death_date else F.col(death).cast("timestamp_ntz")
    inside = died.isNotNull() & (died >= F.col(time0)) & (died <= clocks.plus(time0, days=horizon_days))
    days = clocks.days_between(time0, died)
    follow = F.when(inside, days).otherwise(F.lit(float(horizon_days)))
    return df.withColumns(
        {"death_dt": died, "death_by_horizon": flag(inside), "followup_time": clip(follow, 0.0, float(horizon_days))}
    )


def free_days(used: Column | str, dead: Column | str, horizon_days: int = 30) -> Column:
    """Horizon minus days used, within [0, horizon]; a death scores 0."""
    left = clip(F.lit(float(horizon_days)) - col(used), 0.0, float(horizon_days))
    return F.when(col(dead) == 1, F.lit(0.0)).otherwise(left)


def add_hospital_free_days(df: DataFrame, time0: str, horizon_days: int = 30, discharge: str = "dischtime") -> DataFrame:
    stay = clip(clocks.days_between(time0, discharge), 0.0, float(horizon_days))
    return df.withColumns(
        {
            "hospital_free_days": free_days(stay, "death_by_horizon", horizon_days),
            "observable_hospital_days_after_landmark": stay,
        }
    )


def add_treatment_burden(
    df: DataFrame,
    events: DataFrame,
    on: str,
    time0: str,
    horizon_days: int = 30,
    is_broad: str = "is_broad",
    run_from: int = 7,
) -> DataFrame:
    """Touched days (any, broad), free days, normalised exposure and the late three-day run.

    One explode of touched bins serves every measure.
    """
    bins = touched_bins(events, df, on, time0, horizon_days, keep=[is_broad])
    daily = bins.groupBy(on, "day_idx").agg(F.max(flag(F.col(is_broad))).alias("_b"))
    counts = daily.groupBy(on).agg(
        F.count("*").alias("antibiotic_days"), F.sum("_b").alias("broad_antibiotic_days_30d")
    )
    # A run may start on run_from .. horizon - 3.
    runs = longest_run_flag(daily, [on], run_from, horizon_days - 3).withColumnRenamed(
        "has_run", "late_recurrent_or_persistent_abx_course_30d"
    )
    names = ["antibiotic_days", "broad_antibiotic_days_30d", "late_recurrent_or_persistent_abx_course_30d"]
    out = df.join(counts, on, "left").join(runs, on, "left").fillna(0, subset=names)
    alive = clip("followup_time", 0.1, float(horizon_days))
    return out.withColumns(
        {
            "antibiotic_free_days": free_days("antibiotic_days", "death_by_horizon", horizon_days),
            "days_alive_30d": alive,
            "normalized_antibiotic_exposure_30d": clip(F.col("antibiotic_days") / alive, 0.0, 1.0),
            "normalized_broad_antibiotic_exposure_30d": clip(F.col("broad_antibiotic_days_30d") / alive, 0.0, 1.0),
        }
    )


def add_near_discharge(df: DataFrame, time0: str, unit_out: str = "outtime", discharge: str = "dischtime", hours: int = 24) -> DataFrame:
    limit = clocks.plus(time0, hours=hours)
    unit, home = F.col(unit_out) <= limit, F.col(discharge) <= limit
    return df.withColumns(
        {
            "icu_discharge_within_24h_after_landmark": flag(unit),
            "hospital_discharge_within_24h_after_landmark": flag(home),
            "near_discharge_24h_after_landmark": flag(F.coalesce(unit, F.lit(False)) | F.coalesce(home, F.lit(False))),
        }
    )


def touched_dates(
    events: DataFrame,
    cohort: DataFrame,
    on: Sequence[str],
    date0: str,
    start: str,
    stop: str,
    horizon_days: int = 30,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Distinct (entity, ``day_idx``) calendar days met by a closed [start, stop] date interval."""
    joined = events.select(*on, *keep, start, stop).join(cohort.select(*on, date0), list(on), "inner")
    lo = F.greatest(F.datediff(start, date0), F.lit(0))
    hi = F.least(F.datediff(stop, date0), F.lit(horizon_days - 1))
    return (
        joined.withColumns({"_lo": lo, "_hi": hi})
        .where(F.col(start).isNotNull() & F.col(stop).isNotNull() & (F.col("_lo") <= F.col("_hi")))
        .select(*on, *keep, F.explode(F.sequence("_lo", "_hi")).alias("day_idx"))
        .distinct()
    )


def date_level_outcomes(
    cohort: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    date0: str,
    discharge: str,
    death: str,
    start: str,
    stop: str,
    is_any: str = "is_any",
    is_broad: str = "is_broad",
    horizon_days: int = 30,
) -> DataFrame:
    """Calendar-day outcome bundle for encounters."""
    keys = list(on)
    used = events.where(F.col(is_any) | F.col(is_broad))
    bins = touched_dates(used, cohort, keys, date0, start, stop, horizon_days, keep=[is_any, is_broad])
    daily = bins.groupBy(*keys, "day_idx").agg(F.max(flag(F.col(is_broad))).alias("_b"))
    counts = daily.groupBy(*keys).agg(
        F.count("*").alias("antibiotic_days_30d"), F.sum("_b").alias("broad_antibiotic_days_30d")
    )
    late = "late_recurrent_or_persistent_abx_course_30d"
    runs = longest_run_flag(daily, keys, 7, horizon_days - 3).withColumnRenamed("has_run", late)
    out = cohort.join(counts, keys, "left").join(runs, keys, "left")
    out = out.fillna(0, subset=["antibiotic_days_30d", "broad_antibiotic_days_30d", late])
    h = float(horizon_days)
    dead = flag(F.col(death).between(F.col(date0), F.date_add(F.col(date0), horizon_days)))
    # With no discharge date the stay is unknown, and least/greatest skip the null: 0 days seen.
    stay = F.least(F.lit(h), F.greatest(F.lit(0.0), F.datediff(discharge, date0).cast("double")))
    alive = F.when(
        F.col("death_30d") == 1, clip(F.datediff(death, date0).cast("double"), 0.1, h)
    ).otherwise(F.lit(h))
    return (
        out.withColumn("death_30d", dead)
        .withColumns(
            {
                "hospital_free_days_30d": free_days(stay, "death_30d", horizon_days),
                "antibiotic_free_days_30d": free_days("antibiotic_days_30d", "death_30d", horizon_days),
                "days_alive_30d": alive,
                "observable_hospital_days_after_landmark": stay,
            }
        )
        .withColumns(
            {
                "normalized_antibiotic_exposure_30d": clip(F.col("antibiotic_days_30d") / F.col("days_alive_30d"), 0.0, 1.0),
                "normalized_broad_antibiotic_exposure_30d": clip(
                    F.col("broad_antibiotic_days_30d") / F.col("days_alive_30d"), 0.0, 1.0
                ),
            }
        )
    )


def day_grid(cohort: DataFrame, on: Sequence[str], days: DataFrame, horizon_days: int = 30) -> DataFrame:
    """Entity x day table (one row per day of the horizon) with a 0/1 ``touched`` flag."""
    grid = cohort.select(*on, F.explode(F.sequence(F.lit(0), F.lit(horizon_days - 1))).alias("day_idx"))
    marked = days.select(*on, "day_idx").distinct().withColumn("touched", F.lit(1))
    return grid.join(marked, [*on, "day_idx"], "left").fillna(0, subset=["touched"])


def lead_triplets(grid: DataFrame, on: Sequence[str], first: int = 7, last: int = 27) -> DataFrame:
    """Three consecutive touched days by looking ahead; a window holds one entity's horizon."""
    from pyspark.sql import Window

    w = Window.partitionBy(*on).orderBy("day_idx")
    ahead = grid.withColumns({"d1": F.lead("touched", 1, 0).over(w), "d2": F.lead("touched", 2, 0).over(w)})
    hit = F.col("day_idx").between(first, last) & (F.col("touched") + F.col("d1") + F.col("d2") == 3)
    return ahead.groupBy(*on).agg(F.sum("touched").alias("n_days"), F.max(flag(hit)).alias("has_run"))
