"""Full study over the hour-level tables: cohort, features, outcomes, weights, result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..functions.text import lower_trim, text
from ..operators import cohort as co
from ..operators import features as ft
from ..operators import micro as mi
from ..operators import outcomes as oc
from ..operators import phenotype as ph
from ..operators import reports as rp
from ..operators import sensitivity as se
from ..operators import weighting as wt
from ..operators.intervals import prepare_coverage
from ..operators.resample import bootstrap_table, interval_table
from ..operators.several import Model
from ..session import stage_border, stage_counted
from ..sources.tables import semi_scan

T0 = "analysis_time0"


@dataclass
class HourConfig:
    """Study settings; the defaults are fixed values of the design."""

    start_hours_before: int = 6
    start_hours_after: int = 24
    decision_hours: int = 72
    landmark_hours: int = 96
    coverage_lookback_hours: int = 24
    washout_hours: int = 6
    horizon_days: int = 30
    stop_fill_hours: int = 24
    stop_fill_alternatives: Sequence[int] = (12, 48)
    truncations: Sequence[tuple[float, float]] = ((1.0, 99.0), (2.5, 97.5))
    reps: int = 1000
    seed: int = 20260426
    score_vars: Sequence[str] = lx.SCORE_VARS
    models: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(lx.PROGRESSIVE_MODELS))


OUTCOMES = {
    "death_by_horizon": "risk",
    "hospital_free_days": "mean",
    "antibiotic_free_days": "mean",
    "normalized_antibiotic_exposure_30d": "mean",
    "normalized_broad_antibiotic_exposure_30d": "mean",
    "late_recurrent_or_persistent_abx_course_30d": "risk",
}


def master(t: Mapping[str, DataFrame]) -> DataFrame:
    """Admissions with patient facts and the first unit stay."""
    stays = co.first_row(t["icustays"], ["hadm_id"], ["intime"])
    return t["admissions"].join(t["patients"], "subject_id", "left").join(stays, ["subject_id", "hadm_id"], "left")


def adult_stays(t: Mapping[str, DataFrame]) -> DataFrame:
    return master(t).where(F.col("intime").isNotNull() & F.col("outtime").isNotNull() & (F.col("anchor_age") >= 18))


def prescriptions(t: Mapping[str, DataFrame], base: DataFrame, fill_hours: int) -> DataFrame:
    """Covered prescriptions of the base cohort, with the phenotype flags; unrelated drugs drop."""
    rx = semi_scan(t["prescriptions"], base, "hadm_id").withColumns(
        {"drug_lower": F.lower(text("drug")), "route_lower": lower_trim("route")}
    )
    rx = prepare_coverage(rx, fill_hours=fill_hours).where(F.col("coverage_start").isNotNull())
    rx = rx.withColumns(
        {
            "is_broad": ph.broad_systemic("drug_lower", "route_lower"),
            "is_any": ph.any_systemic("drug_lower", "route_lower"),
            "is_named": ph.named("drug_lower"),
        }
    )
    steroid = F.col("drug_lower").rlike(lx.STEROID_PATTERN)
    return rx.where(F.col("is_broad") | F.col("is_any") | F.col("is_named") | steroid)


def anchored(base: DataFrame, rx: DataFrame, cfg: HourConfig) -> DataFrame:
    anchor = co.first_anchor(
        rx.where("is_broad"), base, "hadm_id", "coverage_start", "intime", cfg.start_hours_before, cfg.start_hours_after,
        out="first_broad_time",
    )
    out = co.add_clocks(base.join(anchor, "hadm_id"), "first_broad_time", cfg.decision_hours, cfg.landmark_hours)
    died = clocks.first_clock("deathtime", "dod")
    return out.where(co.alive_and_present(died, "dischtime", T0))


def microbiology(t: Mapping[str, DataFrame], cohort: DataFrame) -> DataFrame:
    rows = semi_scan(t["microbiologyevents"], cohort, "hadm_id").withColumns(
        {
            "specimen_time": clocks.first_clock("charttime", "chartdate"),
            "result_available_time": clocks.first_clock("storetime", "storedate"),
            "spec_type_desc_lower": F.lower(text("spec_type_desc")),
            "test_name_lower": F.lower(text("test_name")),
        }
    )
    return mi.classify(rows)


def titled(facts: DataFrame, dictionary: DataFrame) -> DataFrame:
    out = facts.join(dictionary, ["icd_code", "icd_version"], "left")
    return out.withColumn("long_title_lower", F.lower(text("long_title")))


def vasopressors(t: Mapping[str, DataFrame], cohort: DataFrame) -> DataFrame:
    items = t["d_items"].select("itemid", F.lower(text("label")).alias("label_lower")).where(
        F.col("label_lower").rlike(lx.VASOPRESSOR_LABEL_PATTERN)
    )
    rows = semi_scan(t["inputevents"], cohort, "stay_id").join(items, "itemid").where(F.col("starttime").isNotNull())
    return prepare_coverage(rows, "starttime", "endtime", fill_hours=1)


def lab_rows(t: Mapping[str, DataFrame], cohort: DataFrame) -> DataFrame:
    items = ph.labelled_items(t["d_labitems"], "itemid", "label", lx.LAB_LABELS).select("itemid", "concept")
    rows = semi_scan(t["labevents"], cohort, "hadm_id").join(items, "itemid")
    return rows.select("hadm_id", "concept", "charttime", "valuenum")


def charted_rows(t: Mapping[str, DataFrame], cohort: DataFrame) -> DataFrame:
    items = ph.concept_items(t["d_items"], "itemid", "label", {**lx.VITAL_PATTERNS, **lx.BODY_PATTERNS}).select("itemid", "concept")
    rows = semi_scan(t["chartevents"], cohort, "stay_id").join(items, "itemid")
    return rows.select("stay_id", "concept", "charttime", "valuenum")


def output_rows(t: Mapping[str, DataFrame], cohort: DataFrame) -> DataFrame:
    items = t["d_items"].where(F.lower(text("label")).rlike(lx.URINE_LABEL_PATTERN)).select("itemid")
    rows = semi_scan(t["outputevents"], cohort, "stay_id").join(items, "itemid")
    return rows.select("stay_id", "charttime", F.col("value").try_cast("double").alias("value_num"))


def build_cohort(t: Mapping[str, DataFrame], cfg: HourConfig | None = None) -> dict[str, DataFrame]:
    """Every stage of the cohort as a table, and ``flow``, their counts, taken while they are written.

    Each source is scanned once; stages that several passes read are written to the shared folder.
    """
    cfg = cfg or HourConfig()
    n = {"n": F.count(F.lit(1))}
    base, n_base = stage_counted(adult_stays(t), **n)
    rx = stage_border(prescriptions(t, base, cfg.stop_fill_hours))
    started, n_started = stage_counted(anchored(base, rx, cfg), **n)
    micro = stage_border(microbiology(t, started))
    flagged, n_flagged = stage_counted(mi.eligibility_flags(micro, started, "hadm_id"), n=F.count_if(F.col("is_eligible") == 1))
    sampled = flagged.where("is_eligible = 1")
    dx = titled(semi_scan(t["diagnoses_icd"], sampled, "hadm_id"), t["d_icd_diagnoses"])
    px = titled(semi_scan(t["procedures_icd"], sampled, "hadm_id"), t["d_icd_procedures"])
    wide = ft.add_baseline_covariates(sampled, dx, px)
    wide = co.vasopressor_profile(wide, vasopressors(t, sampled), "stay_id", washout_hours=cfg.washout_hours)
    washed, n_washed = stage_counted(wide.where(F.col(f"vasopressor_overlap_last{cfg.washout_hours}h_pre72") == 0), **n)
    wide = ft.add_vital_features(ft.add_lab_features(washed, lab_rows(t, washed)), charted_rows(t, washed))
    wide = stage_border(wide)
    wide = ft.add_severity(ft.finish_baseline_vitals(ft.finish_baseline_labs(wide)))
    out = co.classify_treatment(wide, rx, "hadm_id", lookback_hours=cfg.coverage_lookback_hours).where("has_prior_coverage = 1")
    out = oc.add_mortality(out, T0, cfg.horizon_days)
    out = oc.add_hospital_free_days(out, T0, cfg.horizon_days)
    antibiotics = rx.where(F.col("is_broad") | F.col("is_any"))
    out = oc.add_treatment_burden(out, antibiotics, "hadm_id", T0, cfg.horizon_days)
    out = oc.add_near_discharge(out, T0)
    out = ft.add_urine_features(out, output_rows(t, washed))
    out = ft.add_treatment_intensity(out, antibiotics)
    out = mi.diagnostic_intensity(micro, out, "hadm_id")
    out = stage_border(ft.add_steroids(out, rx))
    out = ft.finish_urine_features(ft.finish_vital_trajectories(ft.finish_lab_trajectories(out)))
    out, n_out = stage_counted(ft.add_organ_scores(out), **n, treated=F.count_if(F.col("A") == 1), control=F.count_if(F.col("A") == 0))
    counts = [n_base["n"], n_started["n"], n_flagged["n"], n_washed["n"], n_out["n"], n_out["n"], n_out["treated"], n_out["control"]]
    flow = base.sparkSession.createDataFrame([(i, step, k) for i, (step, k) in enumerate(zip(FLOW_STEPS, counts, strict=True))], "stage int, step string, n long")
    return {
        "base": base, "anchored": started, "flags": flagged, "sampled": sampled, "washed": washed, "prescriptions": rx,
        "microbiology": micro, "cohort": out, "flow": flow,
    }


#: Fixed labels of the attrition table, the arms last.
FLOW_STEPS = (
    "Adult ICU admissions with hospital data", "Early systemic IV broad-spectrum exposure; alive and hospitalized through 96 h",
    "Clinical microbiology sampled and no positive result available by 72 h", "No active vasopressor overlap during 66-72 h",
    "Systemic IV broad-spectrum coverage during 48-72 h", "Final analytic cohort", "De-escalated/stopped", "Continued broad-spectrum",
)


def stop_fill_table(stages: Mapping[str, DataFrame], cfg: HourConfig) -> DataFrame:
    """Exposure rebuilt with other fills for missing stops, all of them in one join and one fit; features stay as they are."""
    drop = ["A", "has_any_systemic_72_96", "deescalation_type", "broad_overlap_hours_72_96", "has_prior_coverage"]
    again = co.classify_by_fill(stages["cohort"].drop(*drop), stages["prescriptions"], "hadm_id", list(cfg.stop_fill_alternatives), cfg.coverage_lookback_hours)
    again = again.where("has_prior_coverage = 1")
    kinds = {f"_fill{i}": (F.col("fill_hours") == hours).cast("int") for i, hours in enumerate(cfg.stop_fill_alternatives)}
    models = [Model.over(f"stop fill {hours} h", cfg.score_vars, rows=f"_fill{i}") for i, hours in enumerate(cfg.stop_fill_alternatives)]
    return se.summaries(stage_border(again.withColumns(kinds)), models, "death_by_horizon", minimum_rows=0)


def excluded_rows(stages: Mapping[str, DataFrame], limit: int = 1000) -> DataFrame:
    """Sample of named rows that fail the systemic rule."""
    rows = stages["prescriptions"].where(F.col("is_named") & ~F.col("is_broad"))
    return rows.select("hadm_id", "drug", "route", "starttime", "stoptime").orderBy("hadm_id", "drug", "route", "starttime").limit(limit)


def results(t: Mapping[str, DataFrame], stages: Mapping[str, DataFrame], cfg: HourConfig | None = None) -> dict[str, DataFrame]:
    """The result tables of a run."""
    cfg = cfg or HourConfig()
    cohort, vars_ = stages["cohort"], list(cfg.score_vars)
    fitted = wt.fit_weights(cohort, vars_)
    df, weights = wt.add_strategies(fitted.df, cfg.truncations)
    df = stage_border(df)
    boot, diag = bootstrap_table(
        cohort, ["hadm_id"], vars_, OUTCOMES, cfg.reps, cfg.seed, pairs=cfg.truncations, overlap=True
    )
    boot = stage_border(boot)
    rows_boot = se.Boot(("hadm_id",), cfg.reps, cfg.seed)
    subsets = {
        "Narrowed/non-broad only vs continued broad": se.subtype_contrast(lx.NARROWED),
        "Stopped all observed systemic antibiotics vs continued broad": se.subtype_contrast(lx.STOPPED),
        **se.named_subsets(),
    }
    return {
        "cohort_flow": stages["flow"],
        "microbiology_counts": mi.set_sizes(stages["flags"]),
        "table_one": wt.table_one(df, lx.CONTINUOUS_VARS, lx.BINARY_VARS),
        "table_one_weighted": wt.table_one(df, lx.CONTINUOUS_VARS, lx.BINARY_VARS, weight="SW_A"),
        "balance": wt.balance_table(df, vars_, weights),
        "weight_summary": wt.weight_summary(df),
        "weight_tails": wt.weight_tails(df),
        "score_distribution": rp.describe_by(df, "A", "ps_den"),
        "effects": wt.effect_table(df, OUTCOMES, weights),
        "intervals": interval_table(boot, cfg.reps),
        "bootstrap": boot,
        "strategies": wt.strategy_table(df, vars_, weights, "death_by_horizon"),
        "progressive": se.progressive_models(cohort, cfg.models, "death_by_horizon", boot=rows_boot),
        "sensitivity": se.sensitivity_set(cohort, subsets, vars_, "death_by_horizon", boot=rows_boot),
        "stop_fill": stop_fill_table(stages, cfg),
        "durations": rp.duration_summary(df, "antibiotic_days"),
        "subtypes": rp.group_profile(cohort, "deescalation_type", {c: F.avg(c) for c in OUTCOMES}),
        "excluded_rows": excluded_rows(stages),
        "weighted_cohort": df,
    }


def repair_rows(t: Mapping[str, DataFrame]) -> DataFrame:
    """Charted rows of the true temperature, oxygen and coma-scale component items."""
    name = lower_trim("label")
    part = F.create_map(*[F.lit(x) for kv in lx.GCS_COMPONENT_LABELS.items() for x in kv])
    domain = (
        F.when(name.isin(*lx.TRUE_TEMPERATURE_LABELS), "temperature").when(name.isin(*lx.TRUE_FIO2_LABELS), "fio2")
        .when(name.isin(*lx.GCS_COMPONENT_LABELS), "gcs")
    )
    items = t["d_items"].select("itemid", "label", domain.alias("domain"), F.try_element_at(part, name).alias("component"))
    rows = t["chartevents"].join(items.where(F.col("domain").isNotNull()), "itemid")
    return rows.where(F.col("valuenum").isNotNull() & F.col("charttime").isNotNull())


def repaired_cohort(t: Mapping[str, DataFrame], cohort: DataFrame) -> DataFrame:
    """Cohort with ``new_`` vitals next to the old ones."""
    return stage_border(ft.repair_measures(repair_rows(t), cohort))


def vital_ablation(repaired: DataFrame, score_vars: Sequence[str], outcome: str = "death_by_horizon") -> DataFrame:
    """Eight scenarios over one table: which vitals are corrected, which leave the score."""
    both, old = ft.repaired_beside_old(repaired)
    no_fio2 = [v for v in score_vars if not v.startswith("fio2_")]
    no_gcs = [v for v in score_vars if not v.startswith("gcs_total_")]
    whole = ("temperature", "gcs", "fio2")
    # Fixed labels of the scenarios.
    spec = {
        "A_original": ((), score_vars), "B_temperature_only": (("temperature",), score_vars),
        "C_temperature_plus_gcs": (("temperature", "gcs"), score_vars), "D_temperature_plus_fio2": (("temperature", "fio2"), score_vars),
        "E_all_corrected": (whole, score_vars), "F_all_corrected_exclude_fio2_ps": (whole, no_fio2),
        "G_all_corrected_exclude_gcs_ps": (whole, no_gcs), "H_all_corrected_exclude_gcs_fio2_ps": (whole, [v for v in no_fio2 if v in no_gcs]),
    }
    scenarios = {
        name: ({c: kept for part, columns in old.items() if part not in parts for c, kept in columns.items()}, list(vars_)) for name, (parts, vars_) in spec.items()
    }
    return se.ablation(both, scenarios, outcome)


#: Tables of ``repair_study``.
STUDY = ("changed_rows", "change_sizes", "comparison", "weighted_cohort")


def repair_study(
    repaired: DataFrame, score_vars: Sequence[str], keys: Sequence[str], outcome: str = "death_by_horizon", wanted: Sequence[str] = STUDY
) -> dict[str, DataFrame]:
    """What a repair changed: rows and sizes of the changes, both fits side by side, the corrected cohort with its own weights.

    ``repaired`` has old and ``new_`` vitals; weights of an earlier fit are replaced by those of the corrected one.
    Only the tables in ``wanted`` are computed.
    """
    both, old = ft.repaired_beside_old(repaired)
    before = {c: kept for columns in old.values() for c, kept in columns.items()}
    if "weighted_cohort" not in wanted:
        read = dict.fromkeys(["A", outcome, *score_vars, *before.values()])
        both = both.select(*[c for c in read if c in both.columns])
    both = stage_border(both) if "comparison" in wanted or "weighted_cohort" in wanted else both
    out = {}
    if "changed_rows" in wanted or "change_sizes" in wanted:
        changes = stage_border(ft.repair_change(repaired, {c: (c, f"new_{c}") for names in ft.REPAIRED.values() for c in names}, keys))
        out |= {"changed_rows": changes, "change_sizes": ft.change_sizes(changes)}
    if "comparison" in wanted:
        out["comparison"] = se.summaries(both, [Model.over("original", score_vars, before), Model.over("vital_corrected", score_vars)], outcome)
    if "weighted_cohort" in wanted:
        corrected = both.drop("ps_den", "ps_num", "SW_A", *before.values())
        out["weighted_cohort"] = wt.fit_weights(corrected, list(score_vars)).df
    return {k: out[k] for k in wanted}
