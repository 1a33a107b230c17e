"""Full study over the date-level tables, with landmark and exposure rules as parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..functions import numbers as nb
from ..functions.text import flag, icd_normalised, upper_trim
from ..operators import cohort as co
from ..operators import outcomes as oc
from ..operators import phenotype as ph
from ..operators import reports as rp
from ..operators import sensitivity as se
from ..operators import weighting as wt
from ..operators.intervals import overlap_profile, overlaps
from ..operators.points import measure, window_measures
from ..operators.resample import bootstrap_table, interval_table
from ..session import stage_border
from ..sources.schemas import DATE_SITE
from ..sources.tables import canonical

KEYS = ["patid", "encounterid"]
BINARY = [
    "sex_male", "race_white", "comorb", "heart_failure", "chronic_kidney", "vasopressor_any_0_24h", "vasopressor_any_48_72h",
    "vasopressor_stopped_before_72h",
]
CONTINUOUS = ["age"] + [
    f"{c}_{part}" for c in [*lx.SITE_B_LABS, *lx.SITE_B_VITALS, "map"] for part in ("0_24h", "48_72h", "delta")
]
OUTCOMES = {
    "death_30d": "risk", "hospital_free_days_30d": "mean", "antibiotic_free_days_30d": "mean",
    "normalized_antibiotic_exposure_30d": "mean", "normalized_broad_antibiotic_exposure_30d": "mean",
    "late_recurrent_or_persistent_abx_course_30d": "risk",
}


#: Landmark and exposure rules of the robustness runs: the labels are fixed.
VARIANTS = {"strict landmark, orders": ("strict", "order"), "lenient landmark, orders": ("lenient", "order"), "strict landmark, administrations": ("strict", "admin"), "lenient landmark, administrations": ("lenient", "admin")}


@dataclass
class DateConfig:
    """``landmark``: strict or lenient; ``exposure``: order or admin."""

    include_codes: Sequence[str] = ()
    exclude_codes: Sequence[str] = ()
    landmark: str = "strict"
    exposure: str = "order"
    reps: int = 1000
    seed: int = 20260826


def canonical_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Canonical columns; keys as text."""
    out = {}
    for name, df in raw.items():
        named = canonical(df, DATE_SITE[name])
        out[name] = named.withColumns({k: F.col(k).cast("string") for k in KEYS if k in named.columns})
    return out


def prescriptions(t: Mapping[str, DataFrame], cfg: DateConfig) -> DataFrame:
    """Orders with clock, closed date interval (a missing end is the start day) and phenotype flags."""
    day = F.coalesce(F.col("start_date").try_cast("date"), F.col("order_date").try_cast("date"))
    return t["prescribing"].select(
        *KEYS,
        clocks.decode_clock("order_date", "order_time").alias("order_ts"),
        day.alias("start_day"),
        F.coalesce(F.col("end_date").try_cast("date"), day).alias("end_day"),
        ph.coded_broad("name", "code", "route", cfg.include_codes, cfg.exclude_codes).alias("is_broad"),
        ph.coded_non_broad("name", "route").alias("is_other"),
    )


def base_encounters(t: Mapping[str, DataFrame]) -> DataFrame:
    return t["encounter"].select(
        *KEYS, F.col("admit_date").try_cast("date").alias("admit_date"), F.col("discharge_date").try_cast("date").alias("discharge_date")
    ).distinct()


def landmark_cohort(t: Mapping[str, DataFrame], rx: DataFrame, cfg: DateConfig) -> DataFrame:
    """Anchor in [admission, + 24 h), then alive and present at the landmark day."""
    base = base_encounters(t).withColumn("admit_ts", F.col("admit_date").cast("timestamp_ntz"))
    anchor = co.first_anchor(rx.where("is_broad"), base, KEYS, "order_ts", "admit_ts", 0, 24, closed="left", out="anchor_ts")
    deaths = t["death"].groupBy("patid").agg(F.min(F.col("death_date").try_cast("date")).alias("death_date"))
    out = co.add_clocks(anchor.join(base, KEYS), "anchor_ts").join(deaths, "patid", "left")
    out = out.withColumns({"decision_date": F.to_date("decision_time"), "analysis_date": F.to_date("analysis_time0")})
    strict = cfg.landmark == "strict"
    return out.where(
        co.after_landmark("discharge_date", "analysis_date", strict) & co.after_landmark("death_date", "analysis_date", strict)
    )


#: Fixed labels of the attrition table, the arms last.
FLOW_STEPS = (
    "Encounters", "Broad-spectrum order within 24 h of admission", "Not discharged by the landmark", "Alive at the landmark", "De-escalated or stopped",
    "Continued broad-spectrum",
)


def flow_table(raw: Mapping[str, DataFrame], cfg: DateConfig | None = None) -> DataFrame:
    """Attrition of the cohort by nested conditions over one row per encounter, so every source is scanned once."""
    cfg = cfg or DateConfig()
    t = canonical_tables(raw)
    rx = stage_border(prescriptions(t, cfg).where("is_broad"))
    base = base_encounters(t).withColumn("admit_ts", F.col("admit_date").cast("timestamp_ntz"))
    anchor = co.first_anchor(rx, base, KEYS, "order_ts", "admit_ts", 0, 24, closed="left", out="anchor_ts")
    deaths = t["death"].groupBy("patid").agg(F.min(F.col("death_date").try_cast("date")).alias("death_date"))
    rows = co.add_clocks(base.join(anchor, KEYS, "left").join(deaths, "patid", "left"), "anchor_ts")
    rows = rows.withColumns({"decision_date": F.to_date("decision_time"), "analysis_date": F.to_date("analysis_time0")})
    rows = order_exposure(rows, rx.withColumn("is_other", F.lit(False))) if cfg.exposure == "order" else admin_exposure(rows, t, cfg)
    strict = cfg.landmark == "strict"
    steps = dict(zip(FLOW_STEPS, (
        F.lit(True), F.col("anchor_ts").isNotNull(), co.after_landmark("discharge_date", "analysis_date", strict), co.after_landmark("death_date", "analysis_date", strict),
    )))
    return co.attrition(rows, steps, {FLOW_STEPS[4]: F.col("A") == 1, FLOW_STEPS[5]: F.col("A") == 0})


def order_exposure(cohort: DataFrame, rx: DataFrame) -> DataFrame:
    hit = overlaps("start_day", "end_day", "decision_date", "analysis_date", "both")
    out = overlap_profile(
        rx, cohort, KEYS, {"_b": F.col("is_broad") & hit, "nonbroad_72_96": F.col("is_other") & hit},
        window_cols=["decision_date", "analysis_date"],
    )
    return out.withColumn("A", 1 - F.col("_b")).drop("_b")


def admin_exposure(cohort: DataFrame, t: Mapping[str, DataFrame], cfg: DateConfig) -> DataFrame:
    """Administrations as whole-day spans; a missing stop is the end of the start day."""
    rows = t["med_admin"].select(
        *KEYS, clocks.span_start("start_date").alias("s"), F.coalesce(clocks.span_stop("stop_date"), clocks.span_stop("start_date")).alias("e"),
        ph.coded_broad("name", "code", "route", cfg.include_codes, cfg.exclude_codes).alias("is_broad"),
    )
    hit = overlaps("s", "e", "decision_time", "analysis_time0", "stop")
    out = overlap_profile(rows, cohort, KEYS, {"_b": F.col("is_broad") & hit}, window_cols=["decision_time", "analysis_time0"])
    return out.withColumn("A", 1 - F.col("_b")).drop("_b")


def _windows(ts: str):
    t, a = F.col(ts), F.col("anchor_ts")
    return {
        "0_24h": (t >= a) & (t < clocks.plus(a, hours=24)),
        "48_72h": (t >= clocks.plus(a, hours=48)) & (t < clocks.plus(a, hours=72)),
    }


def add_covariates(cohort: DataFrame, t: Mapping[str, DataFrame]) -> DataFrame:
    """Demographics, code flags, labs, vitals, mean pressure, vasopressors; one join per source."""
    dem = t["demographic"].groupBy("patid").agg(
        F.min(F.col("birth_date").try_cast("date")).alias("birth_date"),
        F.max(flag(upper_trim("sex").isin("M", "MALE", "1"))).alias("sex_male"),
        F.max(flag(upper_trim("race").isin("05", "WHITE"))).alias("race_white"),
    )
    out = cohort.join(dem, "patid", "left").withColumn("age", clocks.age_years_from_days("birth_date", "admit_date"))
    codes = ph.prefix_flags(icd_normalised("dx"))
    dx = t["diagnosis"].groupBy(*KEYS).agg(*[F.max(flag(c)).alias(k) for k, c in codes.items()])
    dx = dx.select(*KEYS, F.greatest(*codes).alias("comorb"), "heart_failure", "chronic_kidney")
    out = out.join(dx, KEYS, "left")

    lab_code = F.trim(F.col("code").cast("string"))
    labs = t["lab"].select(
        *KEYS, lab_code.alias("code"), F.col("value").try_cast("double").alias("v"),
        clocks.decode_clock("date", "time", numeric_first=True).alias("ts"),
    ).where(lab_code.isin(*[c for codes_, *_ in lx.SITE_B_LABS.values() for c in codes_]))
    measures = {}
    for concept, (codes_, lo, hi, kind) in lx.SITE_B_LABS.items():
        ok = F.col("code").isin(*codes_) & F.col("v").between(lo, hi)
        for tag, when in _windows("ts").items():
            measures[f"{concept}_{tag}"] = measure(kind, "v", "ts", ok & when)
    out = window_measures(labs, out, KEYS, measures, ["anchor_ts"])

    obs = t["obs"].select(
        *KEYS, F.trim(F.col("code").cast("string")).alias("code"), F.col("value").try_cast("double").alias("v"), "unit",
        clocks.decode_clock("date", "time", numeric_first=True).alias("ts"),
    ).where(F.col("code").isin(*[code for code, *_ in lx.SITE_B_VITALS.values()]))
    measures = {}
    for concept, (code, lo, hi, kind) in lx.SITE_B_VITALS.items():
        value = nb.temperature_by_unit("v", "unit") if concept == "temperature" else F.col("v")
        ok = (F.col("code") == code) & value.between(lo, hi)
        for tag, when in _windows("ts").items():
            measures[f"{concept}_{tag}"] = measure(kind, value, "ts", ok & when)
    out = window_measures(obs, out, KEYS, measures, ["anchor_ts"])

    pressure = nb.mean_pressure(F.col("systolic").try_cast("double"), F.col("diastolic").try_cast("double"))
    vital = t["vital"].select(*KEYS, pressure.alias("v"), clocks.decode_clock("date", "time", numeric_first=True).alias("ts"))
    out = window_measures(
        vital.where(F.col("v").isNotNull()), out, KEYS,
        {f"map_{tag}": measure("min", "v", "ts", when) for tag, when in _windows("ts").items()}, ["anchor_ts"],
    )
    out = out.withColumns(
        {f"{c}_delta": F.col(f"{c}_48_72h") - F.col(f"{c}_0_24h") for c in [*lx.SITE_B_LABS, *lx.SITE_B_VITALS, "map"]}
    )

    start = clocks.span_start("start_date")
    vaso = t["med_admin"].where(ph.named_without("name", lx.SITE_B_VASOPRESSOR_TERMS, lx.SITE_B_VASOPRESSOR_EXCLUDE)).select(
        *KEYS, start.alias("s"), F.coalesce(clocks.span_stop("stop_date"), clocks.plus(start, hours=1)).alias("e")
    )
    a = F.col("anchor_ts")
    flags = {
        "vasopressor_any_0_24h": overlaps("s", "e", a, clocks.plus(a, hours=24)),
        "vasopressor_any_48_72h": overlaps("s", "e", clocks.plus(a, hours=48), clocks.plus(a, hours=72)),
    }
    out = overlap_profile(vaso, out, KEYS, flags, window_cols=["anchor_ts"])
    stopped = (F.col("vasopressor_any_0_24h") == 1) & (F.col("vasopressor_any_48_72h") == 0)
    return out.withColumn("vasopressor_stopped_before_72h", flag(stopped))


def build_cohort(raw: Mapping[str, DataFrame], cfg: DateConfig | None = None) -> DataFrame:
    """Analytic table: exposure, covariates (not imputed) and outcomes."""
    cfg = cfg or DateConfig()
    t = canonical_tables(raw)
    rx = prescriptions(t, cfg)
    rx = stage_border(rx.where(F.col("is_broad") | F.col("is_other")).withColumn("is_any", F.col("is_broad") | F.col("is_other")))
    cohort = stage_border(landmark_cohort(t, rx, cfg))
    exposed = order_exposure(cohort, rx) if cfg.exposure == "order" else admin_exposure(cohort, t, cfg)
    wide = add_covariates(exposed, t)
    return stage_border(
        oc.date_level_outcomes(wide, rx, KEYS, "analysis_date", "discharge_date", "death_date", "start_day", "end_day")
    )


def variant_cohorts(raw: Mapping[str, DataFrame], cfg: DateConfig | None = None) -> DataFrame:
    """One table for all variants: the lenient cohort with ``is_strict``, both exposures (``A_order``, ``A_admin``) and outcomes.

    The strict cohort is a part of the lenient one, so neither is built twice.
    """
    cfg = replace(cfg or DateConfig(), landmark="lenient")
    t = canonical_tables(raw)
    rx = prescriptions(t, cfg)
    rx = stage_border(rx.where(F.col("is_broad") | F.col("is_other")).withColumn("is_any", F.col("is_broad") | F.col("is_other")))
    cohort = landmark_cohort(t, rx, cfg)
    strict = co.after_landmark("discharge_date", "analysis_date", True) & co.after_landmark("death_date", "analysis_date", True)
    cohort = stage_border(cohort.withColumn("is_strict", flag(strict)))
    both = order_exposure(cohort, rx).withColumnRenamed("A", "A_order")
    both = admin_exposure(both, t, cfg).withColumnRenamed("A", "A_admin")
    return stage_border(oc.date_level_outcomes(both, rx, KEYS, "analysis_date", "discharge_date", "death_date", "start_day", "end_day"))


def robustness(
    cohorts: DataFrame, binary: Sequence[str], continuous: Sequence[str], outcomes: Mapping[str, str] | None = None,
    variants: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Effects of every variant of landmark and exposure, each with its own score; ``analysis`` names the variant."""
    rows = []
    for label, (landmark, exposure) in (variants or VARIANTS).items():
        part = cohorts.withColumn("A", F.col(f"A_{exposure}"))
        w = wt.fit_weights(part.where("is_strict = 1") if landmark == "strict" else part, site_b=(binary, continuous))
        rows.append(wt.effect_table(w.df, outcomes or OUTCOMES, {label: "SW_A"}))
    return se.union_rows(rows)


def results(
    cohort: DataFrame,
    cfg: DateConfig | None = None,
    truncations: Sequence[tuple[float, float]] = ((1.0, 99.0), (2.5, 97.5)),
    binary: Sequence[str] = BINARY,
    continuous: Sequence[str] = CONTINUOUS,
) -> dict[str, DataFrame]:
    """The result tables of a run."""
    cfg = cfg or DateConfig()
    fitted = wt.fit_weights(cohort, site_b=(binary, continuous))
    df, weights = wt.add_strategies(fitted.df, truncations)
    df = stage_border(df)
    fitted.df = df
    boot, _ = bootstrap_table(
        cohort, KEYS, [*binary, *continuous], OUTCOMES, cfg.reps, cfg.seed, pairs=truncations, overlap=True, prepare="median", binary=binary
    )
    boot = stage_border(boot)
    return {
        "missing_by_arm": wt.missing_by_arm(df, [*binary, *continuous]),
        "balance": wt.model_balance(fitted, weights),
        "score_distribution": rp.describe_by(df, "A", "ps_den"),
        "weight_summary": wt.weight_summary(df),
        "effects": wt.effect_table(df, OUTCOMES, {**weights, "Unadjusted": None}),
        "outcome_summary": rp.outcome_summary(df, [k for k, v in OUTCOMES.items() if v == "risk"], [k for k, v in OUTCOMES.items() if v == "mean"]),
        "bootstrap": boot,
        "intervals": interval_table(boot, cfg.reps),
        "weighted_cohort": df,
    }
