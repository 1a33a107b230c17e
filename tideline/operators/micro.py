"""Two-clock microbiology: classification, eligibility by result availability, intensity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..functions.text import flag, text

# Names of the eligibility sets.
SETS = {
    "sampled": "is_sampled",
    "positive_available_by_72": "is_positive_by_decision",
    "positive_eventual": "is_positive_eventually",
    "positive_missing_result_time": "is_positive_no_result_time",
    "strict_sampled": "is_strict_sampled",
    "strict_positive_available_by_72": "is_strict_positive_by_decision",
}


def classify(
    df: DataFrame,
    specimen: str = "spec_type_desc_lower",
    test: str = "test_name_lower",
    organism: str = "org_name",
    result_time: str = "result_available_time",
    patterns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per-row flags, ``micro_category`` and ``strict_culture_exclusion_reason``."""
    p = {
        "screen": lx.SCREEN_PATTERN,
        "non_culture": lx.NON_CULTURE_TEST_PATTERN,
        "culture": lx.CULTURE_TEST_NAME_PATTERN,
        "specimen": lx.CLINICAL_SPECIMEN_PATTERN,
        "flora": lx.FLORA_PATTERN,
        **(patterns or {}),
    }
    spec, name, org = text(specimen), text(test), F.trim(text(organism))
    screen = F.concat(spec, F.lit(" "), name).rlike(p["screen"])
    other_test, culture = name.rlike(p["non_culture"]), name.rlike(p["culture"])
    strict = ~screen & culture & ~other_test
    grown = org != ""
    flora = F.lower(text(organism)).rlike(p["flora"])
    flags = {
        "screen_or_surveillance": screen,
        "non_culture_test": other_test,
        "culture_test_name": culture,
        "clinical_specimen_type": spec.rlike(p["specimen"]),
        "clinical_micro": ~screen,
        "true_culture_micro": strict,
        "positive_clinical_culture": ~screen & grown,
        "positive_true_culture": strict & grown,
        "positive_clinical_culture_no_flora": ~screen & grown & ~flora,
        "positive_true_culture_no_flora": strict & grown & ~flora,
        "positive_organism_row": ~screen & grown,
        "result_time_missing_for_positive_row": ~screen & grown & F.col(result_time).isNull(),
        "strict_culture_record": strict,
        "strict_positive_culture": strict & grown,
    }
    reason = (
        F.when(screen, "screen_or_surveillance")
        .when(other_test, "non_culture_diagnostic_test")
        .when(~culture, "test_name_not_culture")
        .otherwise("not_excluded_from_strict_culture")
    )
    category = (
        F.when(screen, "screen_or_surveillance_excluded")
        .when(other_test, "non_culture_test_excluded_from_strict_sensitivity")
        .when(~culture, "clinical_record_test_name_not_culture")
        .otherwise("strict_test_name_culture_included")
    )
    return df.withColumns(
        {k: flag(c) for k, c in flags.items()}
        | {"strict_culture_exclusion_reason": reason, "micro_category": category}
    )


def in_sampling_window(specimen_time: str, anchor: str, decision: str, before_hours: int = 24) -> Column:
    return F.col(specimen_time).isNotNull() & F.col(specimen_time).between(
        clocks.plus(anchor, hours=-before_hours), F.col(decision)
    )


def eligibility_flags(
    micro: DataFrame,
    cohort: DataFrame,
    on: str,
    anchor: str = "first_broad_time",
    decision: str = "decision_time",
    before_hours: int = 24,
) -> DataFrame:
    """Cohort plus one 0/1 column per eligibility set, from one join and one aggregate.

    Sampling goes by specimen time, positivity by result availability.
    """
    rows = micro.join(cohort.select(on, anchor, decision), on, "inner").where(
        in_sampling_window("specimen_time", anchor, decision, before_hours) & (F.col("clinical_micro") == 1)
    )
    known = F.col("result_available_time").isNotNull() & (F.col("result_available_time") <= F.col(decision))
    positive, strict_pos = F.col("positive_clinical_culture") == 1, F.col("positive_true_culture") == 1
    strict = F.col("true_culture_micro") == 1
    conditions = {
        "is_sampled": F.lit(True),
        "is_positive_by_decision": positive & known,
        "is_positive_eventually": positive,
        "is_positive_no_result_time": F.col("result_time_missing_for_positive_row") == 1,
        "is_strict_sampled": strict,
        "is_strict_positive_by_decision": strict & strict_pos & known,
    }
    reduced = rows.groupBy(on).agg(*[F.max(flag(c)).alias(k) for k, c in conditions.items()])
    out = cohort.join(reduced, on, "left").fillna(0, subset=list(conditions))
    one = lambda c: F.col(c) == 1
    return out.withColumns(
        {
            "is_eligible": flag(one("is_sampled") & ~one("is_positive_by_decision")),
            "is_strict_eligible": flag(one("is_strict_sampled") & ~one("is_strict_positive_by_decision")),
            "is_eventually_negative": flag(one("is_sampled") & ~one("is_positive_eventually")),
        }
    )


def set_sizes(flags: DataFrame) -> DataFrame:
    """Sizes of the eight sets in one aggregate."""
    named = {**SETS, "strict_eligible": "is_strict_eligible", "eventual_culture_negative": "is_eventually_negative"}
    wide = flags.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in named.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n_entities")) for k in named])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def diagnostic_intensity(
    micro: DataFrame, cohort: DataFrame, on: str, anchor: str = "first_broad_time", decision: str = "decision_time"
) -> DataFrame:
    """Counts, distinct specimens, repeat sampling in the last 24 h, and site flags."""
    rows = micro.join(cohort.select(on, anchor, decision), on, "inner").where(
        in_sampling_window("specimen_time", anchor, decision) & (F.col("clinical_micro") == 1)
    )
    words = F.concat(text("spec_type_desc_lower"), F.lit(" "), text("test_name_lower"))
    late = F.col("specimen_time").between(clocks.plus(decision, hours=-24), F.col(decision))
    counts = {
        "micro_records_pre72": F.count("*"),
        "clinical_micro_records_pre72": F.count_if(F.col("clinical_micro") == 1),
        "strict_culture_records_pre72": F.count_if(F.col("strict_culture_record") == 1),
        "distinct_specimen_types_pre72": F.countDistinct("spec_type_desc_lower"),
        "repeat_micro_48_72h": F.max(flag(late)),
    }
    counts |= {k: F.max(flag(words.rlike(p))) for k, p in lx.CULTURE_SITES.items()}
    reduced = rows.groupBy(on).agg(*[c.alias(k) for k, c in counts.items()])
    return cohort.join(reduced, on, "left").fillna(0, subset=list(counts))
