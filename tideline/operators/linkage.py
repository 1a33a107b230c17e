"""Record linkage between culture rows and later result rows.

No join here emits pairs within a patient.  Follow-up rows are reduced to one row per keys and
run of k + 1 days, whose days are the bits of a number per fact; each row serves its own run and
the one before.  The culture side joins those unique keys one to one and reads its own k + 1 bits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flag


def nearest_follow(
    rows: DataFrame, follow: DataFrame, keys: Sequence[str], date: str, max_days: int, facts: Mapping[str, Column], served: str = "specimen_date"
) -> DataFrame:
    """Adds to ``rows`` the days (0..``max_days``) from their served date to the nearest follow-up row with each fact.

    Null where no follow-up row of the same keys has the fact in time.  ``facts`` are conditions on follow-up rows.
    """
    span = max_days + 1
    if 2 * span > 62:
        raise ValueError("a window has at most 30 days")
    day, own = F.unix_date(F.col(date).cast("date")), F.unix_date(F.col(served).cast("date"))
    # A follow-up day serves the dates of its own run of ``span`` days and of the run before.
    first = day - F.pmod(day, F.lit(span))
    spread = follow.where(F.col(date).isNotNull()).select(
        *keys, day.alias("_day"), F.explode(F.array(first, first - span)).alias("_run"), *[c.alias(k) for k, c in facts.items()]
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_day") - F.col("_run"))
    runs = spread.groupBy(*keys, "_run").agg(*[F.bit_or(F.when(F.col(k), bit)).alias(k) for k in facts])
    met = rows.withColumn("_run", own - F.pmod(own, F.lit(span))).join(runs, [*keys, "_run"], "left")
    found = {}
    for k in facts:
        late = F.call_function("shiftright", F.col(k), own - F.col("_run")).bitwiseAND(F.lit((1 << span) - 1))
        # The bits below the lowest one that is set.
        found[k] = F.when(late != 0, F.bit_count(late.bitwiseAND(-late) - 1))
    return met.withColumns(found).drop("_run").select(*rows.columns, *facts)


def exists_flags(
    cultures: DataFrame, follow: DataFrame, keys: Sequence[str], date: str, max_days: int, facts: Mapping[str, Column]
) -> DataFrame:
    """Per culture row: does a follow-up row with each fact fall 0..max_days after its specimen date."""
    out = nearest_follow(cultures, follow.dropna(subset=list(keys)), keys, date, max_days, facts)
    return out.withColumns({k: F.col(k).isNotNull().cast("int") for k in facts})


def exists_null_tolerant(
    cultures: DataFrame, follow: DataFrame, patient: str, encounter: str, date: str, max_days: int, out: str
) -> DataFrame:
    """As above on the patient, with an encounter that matches or is missing on either side."""
    joined = nearest_follow(cultures, follow.dropna(subset=[patient, encounter]), [patient, encounter], date, max_days, {"_hit": F.lit(True)})
    joined = nearest_follow(
        joined, follow.dropna(subset=[patient]), [patient], date, max_days, {"_any": F.lit(True), "_open": F.col(encounter).isNull()}
    )
    hit = (
        F.col("_hit").isNotNull()
        | F.col("_open").isNotNull()
        | (F.col(encounter).isNull() & F.col("_any").isNotNull())
    )
    return joined.withColumn(out, hit.cast("int")).drop("_hit", "_any", "_open")


# Linkage rules as (key level, window in days, needs a non-blank result).
RULES = {
    "patient_only_0_7d": ("patient", 7, False),
    "patient_encounter_exact_0_7d": ("encounter", 7, False),
    "patient_encounter_exact_0_7d_nonblank": ("encounter", 7, True),
    "patient_encounter_same_day": ("encounter", 0, False),
    "patient_encounter_0_1d": ("encounter", 1, False),
    "patient_encounter_0_2d": ("encounter", 2, False),
    "patient_encounter_0_7d_specimen_match": ("specimen", 7, False),
    "patient_encounter_0_2d_specimen_match": ("specimen", 2, False),
}
TYPES = {"organism": "organism_or_identification", "susceptibility": "susceptibility_or_mic"}
MISSING = "<MISSING>"


def linked_units(cultures: DataFrame, follow: DataFrame, unit_cols: Sequence[str]) -> DataFrame:
    """Distinct culture units with one 0/1 column per (rule, follow-up type).

    Three one-to-one joins (patient, + encounter, + specimen source) serve all eight rules: the
    smallest offset decides every window.
    """
    facts = {}
    for short, kind in TYPES.items():
        facts[f"{short}"] = F.col("followup_type") == kind
        facts[f"{short}_nb"] = (F.col("followup_type") == kind) & (F.col("has_nonblank_result") == 1)
    levels = {
        "patient": ["patid"],
        "encounter": ["patid", "encounterid"],
        "specimen": ["patid", "encounterid", "specimen_source"],
    }
    out = cultures.select(*unit_cols).distinct()
    for level, keys in levels.items():
        usable = follow.dropna(subset=[k for k in keys if k != "specimen_source"])
        if level == "specimen":
            usable = usable.where(F.col("specimen_source") != MISSING)
        out = nearest_follow(out, usable, keys, "result_date", 7, {f"{level}_{k}": c for k, c in facts.items()})
    flags = {}
    for rule, (level, days, nonblank) in RULES.items():
        for short in TYPES:
            offset = F.col(f"{level}_{short}{'_nb' if nonblank else ''}")
            flags[f"{rule}__{short}"] = flag(offset <= days)
    return out.select(*unit_cols, *[c.alias(k) for k, c in flags.items()])


def rule_totals(linked: DataFrame) -> DataFrame:
    """Linked units per rule: any type, organism, susceptibility."""
    one = lambda rule, short: F.col(f"{rule}__{short}") == 1
    aggs = []
    for i, rule in enumerate(RULES):
        aggs += [
            F.count_if(one(rule, "organism") | one(rule, "susceptibility")).alias(f"a{i}"),
            F.count_if(one(rule, "organism")).alias(f"o{i}"),
            F.count_if(one(rule, "susceptibility")).alias(f"s{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("linkage_rule"), F.col(f"a{i}").alias("linked_units"),
                F.col(f"o{i}").alias("organism_units"), F.col(f"s{i}").alias("susceptibility_units"),
            )
            for i, rule in enumerate(RULES)
        ]
    )
    return linked.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def rule_detail(linked: DataFrame, group: str) -> DataFrame:
    """Linked units per rule, culture group and follow-up type."""
    cells = F.array(
        *[
            F.when(
                F.col(f"{rule}__{short}") == 1, F.struct(F.lit(rule).alias("linkage_rule"), F.lit(kind).alias("followup_type"))
            )
            for rule in RULES
            for short, kind in TYPES.items()
        ]
    )
    long = linked.select(group, F.explode(F.array_compact(cells)).alias("c"))
    return long.groupBy("c.linkage_rule", group, "c.followup_type").agg(F.count("*").alias("n"))


def sibling_counts(
    units: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    group: str,
    kind: str,
    attributes: Sequence[str],
    present: Column,
    max_days: int = 2,
) -> DataFrame:
    """Sibling rows 0..max_days after each culture unit, counted per (group, class, offset).

    ``units`` are distinct (keys, specimen_date, group).  Siblings collapse to a count of
    distinct attribute tuples per (keys, result date, class) before they meet a unit, so the
    product of units and rows is added up, never written out.
    """
    distinct_rows = rows.dropna(subset=[*keys, "result_date"]).select(
        *keys, "result_date", kind, *attributes, flag(present).alias("_present")
    ).distinct()
    per_date = distinct_rows.groupBy(*keys, "result_date", kind).agg(
        F.count("*").alias("_n"), F.sum("_present").alias("_p")
    )
    offsets = F.explode(F.array(*[F.lit(k) for k in range(max_days + 1)]))
    spread = per_date.withColumn("day_offset", offsets).withColumn(
        "specimen_date", F.date_sub(F.col("result_date"), F.col("day_offset"))
    )
    met = units.join(spread, [*keys, "specimen_date"])
    return met.groupBy(group, kind, "day_offset").agg(
        F.sum("_n").alias("n"), F.count("*").alias("units_with_component"), F.sum("_p").alias("rows_with_raw_result")
    )


def timestamp_rule_totals(cultures: DataFrame, siblings: DataFrame, max_days: int = 7) -> DataFrame:
    """Culture units with a classed sibling sharing specimen time, specimen date or order date.

    Every rule is an existence test on unique keys; the sibling's result must fall 0..max_days
    after the culture's specimen date.
    """
    unit_keys = ["patid", "encounterid", "specimen_date", "specimen_time", "order_date", "culture_group"]
    units = cultures.dropna(subset=["patid", "encounterid", "specimen_date"]).select(*unit_keys).distinct()
    near = F.datediff("result_date", "specimen_date").between(0, max_days)
    same_day = siblings.dropna(subset=["patid", "encounterid"]).where(near)
    by_time = (
        same_day.dropna(subset=["specimen_time"]).select("patid", "encounterid", "specimen_date", "specimen_time").distinct()
        .withColumn("_time", F.lit(1))
    )
    by_date = same_day.select("patid", "encounterid", "specimen_date").distinct().withColumn("_date", F.lit(1))
    got = units.join(by_time, ["patid", "encounterid", "specimen_date", "specimen_time"], "left").join(
        by_date, ["patid", "encounterid", "specimen_date"], "left"
    )
    ordered = siblings.dropna(subset=["patid", "encounterid", "order_date"])
    got = nearest_follow(got, ordered, ["patid", "encounterid", "order_date"], "result_date", max_days, {"_order": F.lit(True)})
    rules = {
        "same_specimen_date_time": F.col("_time") == 1,
        "same_specimen_date": F.col("_date") == 1,
        "same_order_date": F.col("_order").isNotNull(),
        "same_specimen_datetime_or_order_date": (F.col("_time") == 1) | F.col("_order").isNotNull(),
    }
    # A unit is (patient, encounter, specimen date and time, group): order dates fold into it.
    per = got.groupBy("patid", "encounterid", "specimen_date", "specimen_time", "culture_group").agg(
        *[F.max(flag(c)).alias(k) for k, c in rules.items()]
    )
    wide = per.agg(*[F.sum(k).alias(k) for k in rules])
    rows = F.array(*[F.struct(F.lit(k).alias("linkage_rule"), F.col(k).alias("linked_units")) for k in rules])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
