"""Anchors, clocks, landmark rules, attrition and treatment classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..functions.text import col, flag
from .intervals import clipped_hours, covered_until, overlap_profile, overlaps


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key as a mergeable aggregate, so a hot key is reduced before the shuffle.

    Missing order values sort last; remaining columns break ties.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    null_last = [F.col(c).isNull() for c in order]
    packed = F.struct(*null_last, *order, *[F.col(c).cast("string") for c in rest])
    whole = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(whole, packed).alias("_r")).select(*keys, "_r.*")


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *[F.col(c).cast("string") for c in rest])
    whole = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(whole, packed).alias("_r")).select(*keys, "_r.*")


def first_anchor(
    events: DataFrame,
    entities: DataFrame,
    on: str | Sequence[str],
    start: str,
    reference: str,
    before_hours: int = 6,
    after_hours: int = 24,
    closed: str = "both",
    out: str = "anchor_time",
) -> DataFrame:
    """Earliest qualifying start per entity within the window around its reference time."""
    keys = [on] if isinstance(on, str) else list(on)
    lo, hi = clocks.plus(reference, hours=-before_hours), clocks.plus(reference, hours=after_hours)
    upper = F.col(start) <= hi if closed == "both" else F.col(start) < hi
    joined = events.join(entities.select(*keys, reference), keys, "inner")
    return joined.where((F.col(start) >= lo) & upper).groupBy(*keys).agg(F.min(start).alias(out))


def add_clocks(
    df: DataFrame,
    anchor: str,
    decision_hours: int = 72,
    landmark_hours: int = 96,
    decision: str = "decision_time",
    landmark: str = "analysis_time0",
) -> DataFrame:
    return df.withColumns(
        {decision: clocks.plus(anchor, hours=decision_hours), landmark: clocks.plus(anchor, hours=landmark_hours)}
    )


def after_landmark(when: Column | str, landmark: Column | str, strict: bool = True, null_passes: bool = True) -> Column:
    """Event later than the landmark (or on it, when lenient)."""
    e, t = col(when), col(landmark)
    later = e > t if strict else e >= t
    return (e.isNull() | later) if null_passes else F.coalesce(later, F.lit(False))


def alive_and_present(death: Column | str, discharge: Column | str, landmark: Column | str) -> Column:
    """Hour-level rule: death missing or later, discharge known and later."""
    return after_landmark(death, landmark) & after_landmark(discharge, landmark, null_passes=False)


def attrition(df: DataFrame, steps: Mapping[str, Column], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts after each cumulative condition, all in one scan.

    ``extra`` rows are counted among those left at the end.
    """
    aggs, passed, order = [], F.lit(True), []
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"s{len(aggs)}"))
        order.append(name)
    for name, condition in (extra or {}).items():
        aggs.append(F.count_if(passed & F.coalesce(condition, F.lit(False))).alias(f"s{len(aggs)}"))
        order.append(name)
    wide = df.agg(*aggs)
    rows = F.array(
        *[F.struct(F.lit(i).alias("stage"), F.lit(s).alias("step"), F.col(f"s{i}").alias("n")) for i, s in enumerate(order)]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def attrition_losses(flow: DataFrame) -> DataFrame:
    """Rows lost since the previous stage (only where non-increasing) and share of the first stage.

    The window spans the handful of stage rows, never data rows.
    """
    w = Window.orderBy("stage")
    before = F.lag("n").over(w)
    return flow.withColumns(
        {
            "excluded_from_previous": F.when(before >= F.col("n"), before - F.col("n")),
            "percent_of_first": F.try_divide(F.col("n") * 100.0, F.first("n").over(w).cast("double")),
        }
    )


def with_flag_from(cohort: DataFrame, ids: DataFrame, on: str | Sequence[str], name: str) -> DataFrame:
    """0/1 membership of the id set: a left join against distinct ids."""
    keys = [on] if isinstance(on, str) else list(on)
    marked = ids.select(*keys).where(F.col(keys[0]).isNotNull()).distinct().withColumn(name, F.lit(1))
    return cohort.join(marked, keys, "left").fillna(0, subset=[name])


def treatment_subtype(a: Column, any_after: Column) -> Column:
    return (
        F.when(a == 0, F.lit(lx.CONTINUED)).when(any_after == 1, F.lit(lx.NARROWED)).otherwise(F.lit(lx.STOPPED))
    )


def classify_treatment(
    cohort: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    is_broad: str = "is_broad",
    is_any: str = "is_any",
    decision: str = "decision_time",
    landmark: str = "analysis_time0",
    closed: str = "neither",
    lookback_hours: int | None = None,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """A = 1 without broad overlap in [decision, landmark), subtype and broad hours, in one pass.

    The same pass gives ``has_prior_coverage`` (see ``prior_coverage``) if ``lookback_hours`` is set, and a 0/1 column
    for each condition in ``also`` over event and window columns.
    """
    meets = overlaps("coverage_start", "coverage_stop", decision, landmark, closed)
    broad, systemic = F.col(is_broad) & meets, F.col(is_any) & meets
    hours = clipped_hours("coverage_start", "coverage_stop", decision, landmark)
    flags = {"_broad": broad, "has_any_systemic_72_96": systemic, **(also or {})}
    if lookback_hours is not None:
        before = overlaps("coverage_start", "coverage_stop", clocks.plus(decision, hours=-lookback_hours), decision)
        flags["has_prior_coverage"] = F.col(is_broad) & before
    out = overlap_profile(
        events,
        cohort,
        on,
        flags=flags,
        sums={"broad_overlap_hours_72_96": F.when(broad, hours)},
        window_cols=[decision, landmark],
    )
    out = out.withColumn("A", 1 - F.col("_broad")).drop("_broad")
    return out.withColumn("deescalation_type", treatment_subtype(F.col("A"), F.col("has_any_systemic_72_96")))


def classify_by_fill(
    cohort: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    fill_hours: Sequence[int],
    lookback_hours: int = 24,
    start: str = "starttime",
    stop: str = "stoptime",
    is_broad: str = "is_broad",
    is_any: str = "is_any",
    decision: str = "decision_time",
    landmark: str = "analysis_time0",
) -> DataFrame:
    """Cohort x fill: ``fill_hours``, prior coverage and treatment class under each rule on missing stops.

    All fills are alternative stops of the same events, so they share one join and one aggregate.
    """
    begin = F.col(start).cast("timestamp_ntz")
    before = clocks.plus(decision, hours=-lookback_hours)
    flags, sums = {}, {}
    for i, hours in enumerate(fill_hours):
        end = covered_until(start, stop, hours)
        meets = overlaps(begin, end, decision, landmark)
        flags |= {
            f"_prior{i}": F.col(is_broad) & overlaps(begin, end, before, F.col(decision)), f"_broad{i}": F.col(is_broad) & meets, f"_any{i}": F.col(is_any) & meets,
        }
        sums[f"_hours{i}"] = F.when(F.col(is_broad) & meets, clipped_hours(begin, end, decision, landmark))
    wide = overlap_profile(events.where(begin.isNotNull()), cohort, on, flags, sums, window_cols=[decision, landmark])
    cells = [
        F.struct(
            F.lit(hours).alias("fill_hours"), F.col(f"_prior{i}").alias("has_prior_coverage"), F.col(f"_any{i}").alias("has_any_systemic_72_96"),
            (1 - F.col(f"_broad{i}")).alias("A"), F.col(f"_hours{i}").alias("broad_overlap_hours_72_96"),
        )
        for i, hours in enumerate(fill_hours)
    ]
    long = wide.select(*cohort.columns, F.explode(F.array(*cells)).alias("_c")).select(*cohort.columns, "_c.*")
    return long.withColumn("deescalation_type", treatment_subtype(F.col("A"), F.col("has_any_systemic_72_96")))


def prior_coverage(
    cohort: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    is_broad: str = "is_broad",
    decision: str = "decision_time",
    lookback_hours: int = 24,
    out: str = "has_prior_coverage",
) -> DataFrame:
    """Flag entities with broad coverage in [decision − lookback, decision)."""
    lo = clocks.plus(decision, hours=-lookback_hours)
    meets = overlaps("coverage_start", "coverage_stop", lo, decision)
    return overlap_profile(events, cohort, on, flags={out: F.col(is_broad) & meets}, window_cols=[decision])


def exposure_groups(
    cohort: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    broad: Column,
    non_broad: Column,
    start: str,
    stop: str,
    lo: str,
    hi: str,
    closed: str = "both",
    out: str = "exposure_group",
) -> DataFrame:
    """Date-level three-way class: continued, narrowed, stopped."""
    meets = overlaps(start, stop, lo, hi, closed)
    flags = {"_b": broad & meets, "_n": non_broad & meets}
    got = overlap_profile(events, cohort, on, flags=flags, window_cols=[lo, hi])
    label = (
        F.when(F.col("_b") == 1, "continued_broad")
        .when(F.col("_n") == 1, "deescalated_narrowed_nonbroad")
        .otherwise("deescalated_stopped_all")
    )
    return got.withColumn(out, label).drop("_b", "_n")


def vasopressor_profile(
    cohort: DataFrame,
    events: DataFrame,
    on: str,
    admitted: str = "intime",
    anchor: str = "first_broad_time",
    decision: str = "decision_time",
    washout_hours: int = 6,
    start: str = "coverage_start",
    stop: str = "coverage_stop",
) -> DataFrame:
    """Any use, clipped hours, washout flag and early/late windows from one join."""
    hit = lambda lo, hi: overlaps(start, stop, lo, hi)
    late_lo = clocks.plus(decision, hours=-24)
    flags = {
        "vasopressor_any_pre72": hit(admitted, decision),
        f"vasopressor_overlap_last{washout_hours}h_pre72": hit(clocks.plus(decision, hours=-washout_hours), decision),
        "vasopressor_any_0_24h": hit(anchor, clocks.plus(anchor, hours=24)),
        "vasopressor_any_48_72h": hit(late_lo, decision),
    }
    sums = {"vasopressor_hours_pre72": F.when(hit(admitted, decision), clipped_hours(start, stop, admitted, decision))}
    out = overlap_profile(events, cohort, on, flags, sums, window_cols=[admitted, anchor, decision])
    stopped = (F.col("vasopressor_any_0_24h") == 1) & (F.col("vasopressor_any_48_72h") == 0)
    return out.withColumns(
        {
            "vasopressor_hours_pre72": F.least(F.col("vasopressor_hours_pre72"), F.lit(72.0)),
            "vasopressor_stopped_before_72h": flag(stopped),
        }
    )


def landmark_ambiguity(df: DataFrame, landmark_date: Column, discharge: str, death: str) -> DataFrame:
    """How many discharges and deaths fall on the landmark calendar day."""
    return df.agg(
        F.count("*").alias("anchored"),
        F.count_if(F.col(discharge) == landmark_date).alias("discharge_on_landmark_date"),
        F.count_if(F.col(death) == landmark_date).alias("death_on_landmark_date"),
    )


def provenance(df: DataFrame, subject: str, encounter: str, start: str) -> DataFrame:
    """Distinct subjects, repeat encounters and date span, aggregated in two levels."""
    per = df.groupBy(subject).agg(
        F.countDistinct(encounter).alias("k"), F.min(start).alias("lo"), F.max(start).alias("hi")
    )
    return per.agg(
        F.count("*").alias("n_subjects"),
        F.sum("k").alias("n_encounters"),
        F.count_if(F.col("k") > 1).alias("n_subjects_repeated"),
        F.max("k").alias("max_encounters"),
        F.min("lo").alias("first_start"),
        F.max("hi").alias("last_start"),
    )
