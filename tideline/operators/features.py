"""Windowed features up to the decision time.  Every ``add_*`` maps a cohort to a wider cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..functions import numbers as nb
from ..functions.text import col, collapse_spaces, flag, text
from .cohort import with_flag_from
from .intervals import clipped_hours, overlap_profile, overlaps
from .order_stats import column_medians
from .points import complete_triplets, inside, measure, window_measures


def impute_medians(
    df: DataFrame, columns: Sequence[str], default: float = 0.0, suffix: str = "_missing", flags: bool = True
) -> DataFrame:
    """``<col>_missing`` then the exact median; an all-null column takes ``default``.

    Give it a stage-border table: the medians are one set of passes over it.
    """
    medians = column_medians(df, columns)
    out = {}
    for c in columns:
        if flags:
            out[f"{c}{suffix}"] = F.col(c).isNull().cast("int")
        out[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(default if medians[c] is None else medians[c])))
    return df.withColumns(out)


def early_window(ts: str, anchor: str) -> Column:
    return inside(ts, anchor, clocks.plus(anchor, hours=24))


def late_window(ts: str, decision: str, hours: int = 24) -> Column:
    return inside(ts, clocks.plus(decision, hours=-hours), decision)


def category_flags(unit: Column | str = "first_careunit", race: Column | str = "race", gender: Column | str = "gender") -> dict[str, Column]:
    """0/1 flags by parts of the care unit's name (not exclusive), race and sex; a missing text has none."""
    where = F.lower(text(unit))
    flags = {"sex_male": col(gender) == "M", "race_white": F.lower(text(race)).contains("white")}
    return {k: flag(c) for k, c in (flags | {k: where.rlike(p) for k, p in lx.CARE_UNITS.items()}).items()}


def add_baseline_covariates(cohort: DataFrame, diagnoses: DataFrame, procedures: DataFrame, on: str = "hadm_id") -> DataFrame:
    """Demographics, care-unit flags and title flags.  Title flags are not limited in time."""
    title = text("long_title_lower")
    dx = diagnoses.groupBy(on).agg(
        F.max(flag(title.rlike(lx.CHRONIC_TITLES))).alias("comorb"),
        F.max(flag(title.rlike(lx.HEART_FAILURE_TITLES))).alias("heart_failure"),
        F.max(flag(title.rlike(lx.KIDNEY_TITLES))).alias("chronic_kidney"),
    )
    vented = procedures.where(title.rlike(lx.VENTILATION_TITLES))
    names = ["comorb", "heart_failure", "chronic_kidney"]
    out = with_flag_from(cohort.join(dx, on, "left").fillna(0, subset=names), vented, on, "vent_proc")
    waited = nb.clip(clocks.hours_between("admittime", "intime"), -24.0, 24.0 * 30)
    return out.withColumns(
        {
            "age": F.col("anchor_age").cast("double"),
            "hours_admit_to_icu": F.coalesce(waited, F.lit(0.0)),
        }
        | category_flags()
    )


def lab_measures(concepts: Mapping[str, str]) -> dict[str, Column]:
    """Baseline first/last and early/late last/worst for every lab concept in one aggregate.

    ``concepts`` maps a concept to the prefix of its baseline columns (empty: none).
    """
    ts, v = "charttime", "valuenum"
    baseline = inside(ts, "intime", "decision_time")
    early, late = early_window(ts, "first_broad_time"), late_window(ts, "decision_time")
    out: dict[str, Column] = {}
    for concept, base in concepts.items():
        mine = (F.col("concept") == concept) & F.col(v).isNotNull()
        if base:
            out[f"{base}_last_pre72"] = measure("last", v, ts, mine & baseline)
            out[f"{base}_first_pre72"] = measure("first", v, ts, mine & baseline)
        # A value outside its range still occupies its place in time, as a null.
        clean = nb.in_range(v, nb.LAB_RANGES[concept])
        worst = "min" if concept == "platelet" else "max"
        for window, when, tag in (("early", early, "0_24h"), ("late", late, "48_72h")):
            last = F.max_by(clean, F.when(mine & when, F.struct(F.col(ts), F.col(v))))
            out[f"{concept}_{window}_last_{tag}"] = last
            out[f"{concept}_{window}_worst_{tag}"] = measure(worst, clean, ts, mine & when)
    return out


BASELINE_LABS = {"lactate": "lactate", "creatinine": "creatinine", "wbc": "white_blood_cells", "platelet": "", "bilirubin": ""}


def add_lab_features(cohort: DataFrame, labs: DataFrame, on: str = "hadm_id") -> DataFrame:
    """Raw lab features (no imputation yet).  ``labs``: on, concept, charttime, valuenum."""
    windows = ["intime", "first_broad_time", "decision_time"]
    out = window_measures(labs, cohort, on, lab_measures(BASELINE_LABS), windows)
    more = {}
    for base in filter(None, BASELINE_LABS.values()):
        more[f"{base}_change_pre72"] = F.col(f"{base}_last_pre72") - F.col(f"{base}_first_pre72")
        more[f"{base}_missing_pre72"] = F.col(f"{base}_last_pre72").isNull().cast("int")
    for c in BASELINE_LABS:
        more[f"{c}_change_early_to_late"] = F.col(f"{c}_late_last_48_72h") - F.col(f"{c}_early_last_0_24h")
    return out.withColumns(more).drop(*[f"{b}_first_pre72" for b in BASELINE_LABS.values() if b])


def finish_baseline_labs(df: DataFrame) -> DataFrame:
    """Last value: median; change: 0."""
    last = [f"{b}_last_pre72" for b in BASELINE_LABS.values() if b]
    out = impute_medians(df, last, flags=False)
    return out.fillna(0.0, subset=[c.replace("_last_", "_change_") for c in last])


def finish_lab_trajectories(df: DataFrame) -> DataFrame:
    """Impute, then the direction flags (from imputed changes)."""
    parts = ("early_last_0_24h", "early_worst_0_24h", "late_last_48_72h", "late_worst_48_72h", "change_early_to_late")
    out = impute_medians(df, [f"{c}_{part}" for c in BASELINE_LABS for part in parts])
    falls = {"platelet"}
    return out.withColumns(
        {
            (f"{c}_falling_pre72" if c in falls else f"{c}_rising_pre72"): flag(
                F.col(f"{c}_change_early_to_late") < 0 if c in falls else F.col(f"{c}_change_early_to_late") > 0
            )
            for c in BASELINE_LABS
        }
    )


# Baseline vitals (concept, aggregate, output column).
BASELINE_VITALS = (
    ("heart_rate", "max", "hr_max_pre72"),
    ("resp_rate", "max", "rr_max_pre72"),
    ("spo2", "min", "spo2_min_pre72"),
    ("map", "min", "map_min_pre72"),
    ("temperature", "max", "temp_max_pre72"),
)
# Trajectory aggregate per concept.
TRAJECTORY_VITALS = {
    "heart_rate": "max", "resp_rate": "max", "spo2": "min", "map": "min",
    "temperature": "max", "gcs_total": "min", "fio2": "max",
}


def baseline_vital_value(value: str = "valuenum", concept: str = "concept") -> Column:
    """Range-clean value.  The baseline temperature range keeps mixed units on purpose."""
    out = F.when(F.col(concept) == "temperature", nb.in_range(value, nb.BASELINE_TEMPERATURE_RANGE))
    for name in ("heart_rate", "resp_rate", "spo2", "map"):
        out = out.when(F.col(concept) == name, nb.in_range(value, nb.VITAL_RANGES[name]))
    return out


def trajectory_vital_value(value: str = "valuenum", concept: str = "concept") -> Column:
    """Temperature is converted before its range test; oxygen is tested before it is scaled."""
    celsius = nb.temperature_by_size(value)
    out = F.when(F.col(concept) == "temperature", nb.in_range(celsius, (25.0, 45.0)))
    out = out.when(F.col(concept) == "fio2", nb.oxygen_fraction(nb.in_range(value, nb.VITAL_RANGES["fio2"])))
    for name in ("heart_rate", "resp_rate", "spo2", "map", "gcs_total"):
        out = out.when(F.col(concept) == name, nb.in_range(value, nb.VITAL_RANGES[name]))
    return out


def vital_measures() -> dict[str, Column]:
    ts = "charttime"
    baseline = inside(ts, "intime", "decision_time")
    early, late = early_window(ts, "first_broad_time"), late_window(ts, "decision_time")
    base_v, traj_v = baseline_vital_value(), trajectory_vital_value()
    out = {
        name: measure(kind, base_v, ts, (F.col("concept") == concept) & baseline)
        for concept, kind, name in BASELINE_VITALS
    }
    for concept, kind in TRAJECTORY_VITALS.items():
        mine = F.col("concept") == concept
        out[f"{concept}_0_24h"] = measure(kind, traj_v, ts, mine & early)
        out[f"{concept}_48_72h"] = measure(kind, traj_v, ts, mine & late)
    hot = (F.col("concept") == "temperature") & late_window(ts, "decision_time", 12) & (traj_v >= 38)
    out["fever_last12h_pre72"] = F.max(flag(hot))
    # Body size: first plausible height and weight since unit entry.
    height = nb.in_range(nb.height_cm("valuenum"), (120.0, 230.0))
    weight = nb.in_range("valuenum", (25.0, 300.0))
    for name, v in (("height_cm", height), ("weight_kg", weight)):
        ok = (F.col("concept") == name) & baseline & v.isNotNull()
        out[f"{name}_pre72"] = F.min_by(v, F.when(ok, F.struct(F.col(ts), v)))
    return out


def add_vital_features(cohort: DataFrame, charted: DataFrame, on: str = "stay_id") -> DataFrame:
    """Raw vitals, fever flag and body mass index from one scan of charted events."""
    windows = ["intime", "first_broad_time", "decision_time"]
    out = window_measures(charted, cohort, on, vital_measures(), windows, zero_fill=["fever_last12h_pre72"])
    return out.withColumn("bmi_pre72", nb.body_mass_index("weight_kg_pre72", "height_cm_pre72"))


def finish_baseline_vitals(df: DataFrame) -> DataFrame:
    return impute_medians(df, [name for _, _, name in BASELINE_VITALS])


def finish_vital_trajectories(df: DataFrame) -> DataFrame:
    traj = [f"{c}_{w}" for c in TRAJECTORY_VITALS for w in ("0_24h", "48_72h")]
    out = impute_medians(df, traj)
    out = impute_medians(out, ["bmi_pre72"], default=30.0)
    better = {"map": True, "spo2": True, "temp": False, "rr": False}
    source = {"map": "map", "spo2": "spo2", "temp": "temperature", "rr": "resp_rate"}
    return out.withColumns(
        {
            f"{k}_improved_pre72": flag(
                F.col(f"{source[k]}_48_72h") > F.col(f"{source[k]}_0_24h")
                if up
                else F.col(f"{source[k]}_48_72h") < F.col(f"{source[k]}_0_24h")
            )
            for k, up in better.items()
        }
    )


def add_urine_features(cohort: DataFrame, outputs: DataFrame, on: str = "stay_id") -> DataFrame:
    """Summed output per window, values in [0, 10000] only; raw (not imputed)."""
    ok = F.col("value_num").between(0, 10000)
    sums = {
        "urine_output_ml_0_24h": measure("sum", "value_num", "charttime", ok & early_window("charttime", "first_broad_time")),
        "urine_output_ml_48_72h": measure("sum", "value_num", "charttime", ok & late_window("charttime", "decision_time")),
    }
    out = window_measures(outputs, cohort, on, sums, ["first_broad_time", "decision_time"])
    return out.withColumn("urine_output_change_pre72", F.col("urine_output_ml_48_72h") - F.col("urine_output_ml_0_24h"))


def finish_urine_features(df: DataFrame) -> DataFrame:
    out = impute_medians(df, ["urine_output_ml_0_24h", "urine_output_ml_48_72h", "urine_output_change_pre72"])
    return out.withColumn("low_urine_output_48_72h", flag(F.col("urine_output_ml_48_72h") < 500))


def add_treatment_intensity(
    cohort: DataFrame,
    events: DataFrame,
    on: str = "hadm_id",
    lo: str = "first_broad_time",
    hi: str = "decision_time",
    drug: str = "drug_lower",
    is_broad: str = "is_broad",
    is_any: str = "is_any",
    classes: Mapping[str, str] | None = None,
    any_classes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Hours (overlaps add up), distinct agents and class flags before the decision.

    Class flags come from broad events; ``any_classes`` from any systemic event.
    """
    classes = classes if classes is not None else {
        "anti_mrsa_pre72": lx.ANTI_MRSA_PATTERN,
        "antipseudomonal_pre72": lx.ANTIPSEUDOMONAL_PATTERN,
        "carbapenem_pre72": lx.CARBAPENEM_PATTERN,
    }
    any_classes = any_classes if any_classes is not None else {"anaerobic_coverage_pre72": lx.ANAEROBIC_PATTERN}
    meets = overlaps("coverage_start", "coverage_stop", lo, hi)
    hours = clipped_hours("coverage_start", "coverage_stop", lo, hi)
    broad, systemic = meets & F.col(is_broad), meets & F.col(is_any)
    agent = collapse_spaces(drug)
    return overlap_profile(
        events.where(F.col(is_broad) | F.col(is_any)),
        cohort,
        on,
        flags={k: broad & text(drug).rlike(p) for k, p in classes.items()}
        | {k: systemic & text(drug).rlike(p) for k, p in any_classes.items()},
        sums={"systemic_abx_hours_pre72": F.when(systemic, hours), "broad_abx_hours_pre72": F.when(broad, hours)},
        distinct={"systemic_abx_agents_pre72": systemic, "broad_abx_agents_pre72": broad},
        window_cols=[lo, hi],
        distinct_of=agent,
    )


def add_steroids(cohort: DataFrame, rx: DataFrame, on: str = "hadm_id", lo: str = "first_broad_time", hi: str = "decision_time") -> DataFrame:
    meets = overlaps("coverage_start", "coverage_stop", lo, hi)
    given = meets & text("drug_lower").rlike(lx.STEROID_PATTERN) & ~text("route_lower").rlike(lx.STEROID_BAD_ROUTE)
    flags = {
        "steroid_any_pre72": given,
        "hydrocortisone_any_pre72": given & text("drug_lower").contains("hydrocortisone"),
    }
    return overlap_profile(rx, cohort, on, flags=flags, window_cols=[lo, hi])


def add_organ_scores(df: DataFrame) -> DataFrame:
    """Six banded component scores per window, their sum, change and improvement."""
    out = df
    for tag, when in (("0_24h", "early"), ("48_72h", "late")):
        renal = F.greatest(
            nb.banded(f"creatinine_{when}_last_{tag}", nb.CREATININE_BANDS),
            F.when(F.col(f"urine_output_ml_{tag}") < 500, 3).otherwise(0),
        )
        parts = {
            f"cv_score_{tag}": F.when(F.col(f"vasopressor_any_{tag}") == 1, 3)
            .when(F.col(f"map_{tag}") < 70, 1)
            .otherwise(0),
            f"renal_score_{tag}": renal,
            f"coag_score_{tag}": nb.banded(f"platelet_{when}_worst_{tag}", nb.PLATELET_BANDS, rising=False),
            f"liver_score_{tag}": nb.banded(f"bilirubin_{when}_worst_{tag}", nb.BILIRUBIN_BANDS),
            f"neuro_score_{tag}": nb.banded(f"gcs_total_{tag}", nb.GCS_BANDS, rising=False),
            f"resp_score_{tag}": F.when((F.col(f"spo2_{tag}") < 90) | (F.col("vent_proc") == 1), 2)
            .when(F.col(f"spo2_{tag}") < 94, 1)
            .otherwise(0),
        }
        out = out.withColumns(parts)
        names = list(parts)
        out = out.withColumn(f"sofa_like_{tag}", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    out = out.withColumn("sofa_like_change_pre72", F.col("sofa_like_48_72h") - F.col("sofa_like_0_24h"))
    return out.withColumn("sofa_like_improved_pre72", flag(F.col("sofa_like_change_pre72") < 0))


SEVERITY_TERMS = (
    "lactate_last_pre72", "creatinine_last_pre72", "white_blood_cells_last_pre72", "hr_max_pre72",
    "rr_max_pre72", "map_min_pre72", "spo2_min_pre72", "vasopressor_hours_pre72",
)


def severity(df: DataFrame, terms: Sequence[str], reversed_terms: Sequence[str]) -> Column:
    """Sum of z-scores (population sd); terms without spread drop out, missing values add 0."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in terms], *[F.stddev_pop(c).alias(f"s_{c}") for c in terms]
    ).first()
    total = F.lit(0.0)
    for c in terms:
        mean, sd = row[f"m_{c}"], row[f"s_{c}"]
        if not sd:
            continue
        z = (F.col(c) - F.lit(mean)) / F.lit(sd)
        total = total + F.coalesce(-z if c in reversed_terms else z, F.lit(0.0))
    return total


def add_severity(df: DataFrame) -> DataFrame:
    score = severity(df, SEVERITY_TERMS, ("map_min_pre72", "spo2_min_pre72"))
    return df.withColumn("severity_pre72", score + 0.3 * F.col("vent_proc") + 0.2 * F.col("comorb"))


def repair_measures(charted: DataFrame, cohort: DataFrame, on: str = "stay_id") -> DataFrame:
    """Corrected vitals: unit-aware temperature, coma-scale triplets, oxygen fraction.

    ``charted`` has ``domain`` (temperature, fio2, gcs), ``label``, ``component``, charttime, valuenum.
    Columns come back under a ``new_`` prefix, not imputed.
    """
    ts = "charttime"
    windows = cohort.select(on, "intime", "first_broad_time", "decision_time")
    celsius = nb.in_range(nb.temperature_by_label("valuenum", "label"), (30.0, 45.0))
    oxygen = nb.in_range(nb.oxygen_fraction("valuenum"), (0.20, 1.0))
    early, late = early_window(ts, "first_broad_time"), late_window(ts, "decision_time")
    flat = charted.where(F.col("domain") != "gcs")
    first = flat.join(windows, on, "inner").groupBy(on).agg(
        measure("max", celsius, ts, (F.col("domain") == "temperature") & inside(ts, "intime", "decision_time")).alias(
            "new_temp_max_pre72"
        ),
        measure("max", oxygen, ts, (F.col("domain") == "fio2") & early).alias("new_fio2_0_24h"),
        measure("max", oxygen, ts, (F.col("domain") == "fio2") & late).alias("new_fio2_48_72h"),
    )
    triplets = complete_triplets(
        charted.where(F.col("domain") == "gcs"), [on, ts], "component", "valuenum", lx.GCS_COMPONENT_RANGES, "gcs_total"
    )
    second = triplets.join(windows, on, "inner").groupBy(on).agg(
        measure("min", "gcs_total", ts, early).alias("new_gcs_total_0_24h"),
        measure("min", "gcs_total", ts, late).alias("new_gcs_total_48_72h"),
    )
    return cohort.join(first, on, "left").join(second, on, "left")


REPAIRED = {
    "temperature": ("temp_max_pre72",),
    "gcs": ("gcs_total_0_24h", "gcs_total_48_72h"),
    "fio2": ("fio2_0_24h", "fio2_48_72h"),
}


def apply_repair(df: DataFrame, parts: Sequence[str] = ("temperature", "gcs", "fio2")) -> DataFrame:
    """Swap in imputed ``new_`` columns for the chosen parts and rescore the organ scores."""
    names = [c for p in parts for c in REPAIRED[p]]
    out = df.withColumns({f"{c}_missing": F.col(f"new_{c}").isNull().cast("int") for c in names})
    out = impute_medians(out, [f"new_{c}" for c in names], flags=False)
    out = out.withColumns({c: F.col(f"new_{c}") for c in names})
    return add_organ_scores(out) if "gcs" in parts else out


def repaired_beside_old(df: DataFrame) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """``apply_repair`` of all parts with the old values kept; per part, the column that holds each old value.

    Organ scores follow the coma scale only, so a part's old columns stand for it in any mix of parts.
    """
    scores = [c for c in df.columns if c.endswith(("_score_0_24h", "_score_48_72h")) or c.startswith("sofa_like_")]
    old: dict[str, dict[str, str]] = {}
    for part, names in REPAIRED.items():
        changed = [*names, *(f"{c}_missing" for c in names), *(scores if part == "gcs" else ())]
        old[part] = {c: f"old_{c}" for c in changed if c in df.columns}
    kept = df.withColumns({k: F.col(c) for columns in old.values() for c, k in columns.items()})
    return apply_repair(kept), old


def repair_change(df: DataFrame, changed: Mapping[str, tuple[str, str]], keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows whose repaired value differs from the old one: keys, variable, old, new, size of the change (null beside a null).

    ``changed`` maps a variable to its old and new column.  Temperatures above 60 are put on the Celsius scale first.
    """
    cells = []
    for name, (old, new) in changed.items():
        before = F.col(old).cast("double")
        if name.startswith("temp"):
            before = F.when(before > 60, nb.fahrenheit_to_celsius(before)).otherwise(before)
        cells.append(F.struct(F.lit(name).alias("variable"), F.round(before, digits).alias("old"), F.round(F.col(new).cast("double"), digits).alias("new")))
    long = df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    return long.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", F.round(F.col("new") - F.col("old"), digits))


def change_sizes(changes: DataFrame, bounds: tuple[float, float] = (0.1, 0.5)) -> DataFrame:
    """Per variable: rows changed, those by more than each bound, those that gained or lost a value, the largest change."""
    moved = F.abs("change")
    return changes.groupBy("variable").agg(
        F.count("*").alias("n_changed"),
        *[F.count_if(moved > b).alias(f"n_changed_gt_{str(b).replace('.', '_')}") for b in bounds],
        F.count_if(F.col("old").isNull()).alias("n_gained"), F.count_if(F.col("new").isNull()).alias("n_lost"), F.max(moved).alias("max_abs_change"),
    )
