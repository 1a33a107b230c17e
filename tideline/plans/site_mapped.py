"""Cohort and exposure over configuration-mapped tables (canonical names from a mapping)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..functions.text import flag, text
from ..operators import cohort as co
from ..operators import micro as mi
from ..operators import phenotype as ph
from ..operators import sensitivity as se
from ..operators.audits import crosstab_counts
from ..operators.intervals import overlap_join, prepare_coverage
from ..operators.weighting import crude_rates
from ..session import stage_border
from ..sources.tables import normalise_columns, rename_from_mapping, require_columns

MED_KEYS = [
    "patid", "encounterid", "code", "raw_code", "raw_name", "route", "raw_route", "start_date", "start_time", "end_date",
    "stop_date", "stop_time",
]
MICRO_LOCAL = ["patid", "encounterid", "specimen_datetime", "result_datetime", "specimen", "test_name", "organism"]
MICRO_LAB = [
    "patid", "encounterid", "specimen_date", "specimen_time", "result_date", "result_time", "specimen", "test_name", "loinc",
    "result_qual", "raw_result", "result_snomed",
]


def _clock(df: DataFrame, date: str, time: str):
    """Date plus time column if there is one: numbers read as HHMM, text as a clock."""
    if date not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    day = F.col(date).try_cast("date")
    if time not in df.columns:
        return day.cast("timestamp_ntz")
    numeric = dict(df.dtypes)[time] in ("int", "bigint", "smallint", "tinyint", "float", "double") or dict(df.dtypes)[time].startswith("decimal")
    return clocks.combine_hhmm(day, time) if numeric else clocks.combine_text(day, time)


def medications(raw: DataFrame, mapping: Mapping[str, str], fill_hours: int = 24) -> DataFrame:
    """Canonical medication intervals with drug classes."""
    d = rename_from_mapping(raw, mapping, MED_KEYS)
    require_columns(d, ["raw_name", "start_date"], "medications")
    fallback = {"code": "raw_code", "route": "raw_route"}
    for name in ("patid", "encounterid", "code", "route"):
        if name not in d.columns:
            other = fallback.get(name)
            d = d.withColumn(name, F.col(other) if other in d.columns else F.lit(""))
    if "stop_date" in d.columns:
        stop = _clock(d, "stop_date", "stop_time")
    elif "end_date" in d.columns:
        stop = F.col("end_date").try_cast("timestamp_ntz")
    else:
        stop = F.lit(None).cast("timestamp_ntz")
    rows = d.select(
        "patid", "encounterid", F.col("code").cast("string").alias("code"), "raw_name", "route",
        _clock(d, "start_date", "start_time").alias("_start"), stop.alias("_stop"),
    )
    covered = prepare_coverage(rows, "_start", "_stop", fill_hours).drop("_start", "_stop")
    return ph.classify_drugs(covered, "code", "raw_name", "route")


def icu_stays(raw: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """First stay per encounter."""
    d = rename_from_mapping(raw, mapping, ["patid", "encounterid", "start_datetime", "end_datetime", "careunit"])
    require_columns(d, ["patid", "encounterid", "start_datetime", "end_datetime"], "icu stays")
    extra = ["careunit"] if "careunit" in d.columns else []
    rows = d.select(
        "patid", "encounterid", F.col("start_datetime").try_cast("timestamp_ntz").alias("icu_start"),
        F.col("end_datetime").try_cast("timestamp_ntz").alias("icu_end"), *extra,
    ).where(F.col("icu_start").isNotNull())
    return co.first_row(rows, ["encounterid"], ["icu_start"])


def base_encounters(encounter: DataFrame, demographic: DataFrame, icu: DataFrame) -> DataFrame:
    """Adult inpatient encounters with a unit stay; an untimed discharge is 23:59 of its day."""
    enc, dem = normalise_columns(encounter), normalise_columns(demographic)
    require_columns(enc, ["patid", "encounterid", "admit_date", "discharge_date", "enc_type"], "encounter")
    require_columns(dem, ["patid", "birth_date", "sex", "race"], "demographic")
    if "discharge_time" in enc.columns:
        left = _clock(enc, "discharge_date", "discharge_time")
    else:
        left = clocks.plus(F.col("discharge_date").try_cast("date").cast("timestamp_ntz"), hours=23, minutes=59)
    rows = enc.where(F.col("enc_type").isin("IP", "EI")).select(
        "patid", "encounterid", _clock(enc, "admit_date", "admit_time").alias("admit_dt"), left.alias("discharge_dt")
    )
    people = dem.select("patid", F.col("birth_date").try_cast("timestamp_ntz").alias("birth_date"), "sex", "race")
    out = rows.join(people, "patid", "left").join(icu, ["patid", "encounterid"])
    return out.withColumn("age", clocks.age_years_from_seconds("birth_date", "icu_start")).where("age >= 18")


def micro_rows(raw: DataFrame, mapping: Mapping[str, str], local: bool = True) -> DataFrame:
    """Specimen and result clocks, texts and organism; laboratory rows use the raw result as organism."""
    d = rename_from_mapping(raw, mapping, MICRO_LOCAL if local else MICRO_LAB)
    if local:
        taken, known = (F.col(c).try_cast("timestamp_ntz") for c in ("specimen_datetime", "result_datetime"))
        organism = F.col("organism") if "organism" in d.columns else F.lit("")
    else:
        taken, known = _clock(d, "specimen_date", "specimen_time"), _clock(d, "result_date", "result_time")
        organism = F.col("raw_result") if "raw_result" in d.columns else F.lit("")
    have = lambda c: F.lower(text(c)) if c in d.columns else F.lit("")
    return d.select(
        "encounterid", taken.alias("specimen_time"), known.alias("result_available_time"), text(organism).alias("org_name"),
        have("specimen").alias("spec_type_desc_lower"), have("test_name").alias("test_name_lower"),
    )


def eligible_micro(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    classed = mi.classify(rows, patterns={"screen": lx.SITE_MAPPED_SCREEN_PATTERN})
    return mi.eligibility_flags(classed, cohort, "encounterid")


def without_vasopressors(cohort: DataFrame, admin: DataFrame, pattern: str, lookback_hours: int = 6) -> DataFrame:
    """Anti join with entities on a vasopressor in the hours before the decision."""
    if not pattern:
        raise ValueError("no vasopressor name patterns configured")
    window = cohort.select("encounterid", "decision_time", clocks.plus("decision_time", hours=-lookback_hours).alias("_from"))
    vaso = admin.where(F.lower(text("raw_name")).rlike(pattern)).select("encounterid", "coverage_start", "coverage_stop")
    active = overlap_join(vaso, window, "encounterid", "_from", "decision_time").select("encounterid").distinct()
    return cohort.join(active, "encounterid", "left_anti")


def classify(cohort: DataFrame, meds: DataFrame) -> DataFrame:
    """Broad coverage in [48 h, decision) required, then the treatment classes."""
    rows = meds.select(
        "encounterid", "coverage_start", "coverage_stop", (F.col("is_broad_spectrum") == 1).alias("is_broad"),
        (F.col("is_systemic_antibiotic") == 1).alias("is_any"),
    )
    window = cohort.withColumn("_from", clocks.plus("first_broad_time", hours=48))
    met = overlap_join(rows.where("is_broad"), window, "encounterid", "_from", "decision_time").select("encounterid").distinct()
    return co.classify_treatment(cohort.join(met, "encounterid", "left_semi"), rows, "encounterid")


def run(tables: Mapping[str, DataFrame], config: Mapping) -> dict[str, DataFrame]:
    """Cohort, attrition, order-versus-administration table and crude mortality.

    ``tables``: encounter, demographic, icu_stays, prescribing, med_admin, micro, death.
    """
    clock, meds_cfg = config.get("clock", {}), config.get("medications", {})
    fill = int(meds_cfg.get("missing_stop_fill_hours", 24))
    icu = icu_stays(tables["icu_stays"], config["icu"])
    base = stage_border(base_encounters(tables["encounter"], tables["demographic"], icu))
    orders = stage_border(medications(tables["prescribing"], meds_cfg["prescribing_columns"], fill))
    admin = stage_border(medications(tables["med_admin"], meds_cfg["med_admin_columns"], fill))
    primary = orders if meds_cfg.get("primary_source", "prescribing") == "prescribing" else admin
    anchor = co.first_anchor(
        primary.where("is_broad_spectrum = 1").select("encounterid", "coverage_start"), base, "encounterid", "coverage_start", "icu_start",
        int(clock.get("qualifying_start_hours_before_icu", 6)), int(clock.get("qualifying_start_hours_after_icu", 24)), out="first_broad_time",
    )
    started = co.add_clocks(base.join(anchor, "encounterid"), "first_broad_time", int(clock.get("decision_hours", 72)), int(clock.get("classification_end_hours", 96)))
    started = stage_border(started.where(co.after_landmark("discharge_dt", "analysis_time0", null_passes=False)))
    micro_cfg = config["microbiology"]
    local = micro_cfg.get("source", "local") == "local"
    rows = micro_rows(tables["micro"], micro_cfg["local_columns" if local else "lab_result_cm_columns"], local)
    sampled = stage_border(eligible_micro(rows, started).where("is_eligible = 1"))
    pattern = "|".join(config.get("vasopressors", {}).get("name_patterns", []))
    washed = stage_border(without_vasopressors(sampled, admin, pattern, int(clock.get("vasopressor_free_lookback_hours", 6))))
    cohort = classify(washed, primary)
    deaths = normalise_columns(tables["death"]).groupBy("patid").agg(F.min(F.col("death_date").try_cast("timestamp_ntz")).alias("death_date"))
    horizon = int(clock.get("horizon_days", 30))
    dead = F.col("death_date").between(F.col("analysis_time0"), clocks.plus("analysis_time0", days=horizon))
    cohort = stage_border(cohort.join(deaths, "patid", "left").withColumn("death_by_30d", flag(dead)))
    other = classify(washed, admin).select("encounterid", F.col("A").alias("A_admin"), F.col("deescalation_type").alias("type_admin"))
    # The administration classes are taken on the final cohort; entities without prior administration stay missing.
    both = cohort.select("encounterid", F.col("A").alias("A_order"), F.col("deescalation_type").alias("type_order")).join(other, "encounterid", "left")
    steps = [
        ("Adult IP/EI encounters with timestamped ICU episode", base), ("Qualifying early broad-spectrum exposure; hospitalized through 96 h", started),
        ("Clinical microbiology sampled and no positive result available by 72 h", sampled), ("No active vasopressor overlap during 66-72 h", washed),
        ("Broad-spectrum coverage during 48-72 h; final analytic cohort", cohort), ("De-escalated/stopped", cohort.where("A = 1")),
        ("Continued broad-spectrum", cohort.where("A = 0")),
    ]
    flow = se.union_rows([df.agg(F.lit(i).alias("stage"), F.lit(s).alias("step"), F.count("*").alias("n")) for i, (s, df) in enumerate(steps)])
    return {
        "cohort": cohort, "flow": flow, "order_vs_administration": crosstab_counts(both, "A_order", "A_admin"), "comparison": both,
        "crude_mortality": crude_rates(cohort, "death_by_30d"), "mapping": ph.mapping_counts(orders, ["code", "raw_name", "route"]),
    }
