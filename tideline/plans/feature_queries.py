"""Windowed features, scores and fixed-horizon outcomes over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import numbers as nb
from ..functions.text import flag
from ..operators import features as ft
from ..operators import outcomes as oc
from ..operators import reports as rp
from ..operators.cohort import classify_treatment
from ..operators.intervals import longest_run_flag, touched_bins
from ..operators.points import complete_triplets, inside, measure, window_measures
from ..operators.weighting import effect_table
from ..session import stage_border
from . import roles as ro
from .cohort_queries import classes_sql
from .registry import query

MEDS = ro.meds_sql()
EARLY = "l.charttime >= u.anchor_time AND l.charttime < u.anchor_time + INTERVAL 3 DAY"
LATE = "l.charttime >= u.anchor_time + INTERVAL 6 DAY AND l.charttime < u.anchor_time + INTERVAL 9 DAY"


def _span(lo: int, hi: int):
    return inside("charttime", clocks.plus("anchor_time", days=lo), clocks.plus("anchor_time", days=hi), "left")


@query(
    "window_first_last_delta",
    "A3 A4 C31 J6",
    ro.with_sql(ro.LABS_SQL, ro.USERS_SQL)
    + f"""SELECT *, round(late_last - early_last, 6) AS delta FROM (
      SELECT u.subject, arg_max(valuenum, (charttime, event_id)) FILTER (WHERE concept = 'purchase' AND {EARLY}) AS early_last,
        arg_max(valuenum, (charttime, event_id)) FILTER (WHERE concept = 'purchase' AND {LATE}) AS late_last,
        arg_min(valuenum, (charttime, event_id)) FILTER (WHERE concept = 'purchase' AND {EARLY}) AS early_first
      FROM users u LEFT JOIN labs l USING (subject) GROUP BY 1)""",
)
def window_first_last_delta(spark, folder):
    buy = F.col("concept") == "purchase"
    measures = {
        "early_last": measure("last", "valuenum", "charttime", buy & _span(0, 3), "event_id"),
        "late_last": measure("last", "valuenum", "charttime", buy & _span(6, 9), "event_id"),
        "early_first": measure("first", "valuenum", "charttime", buy & _span(0, 3), "event_id"),
    }
    users = ro.users(spark, folder).select("subject", "anchor_time")
    out = window_measures(ro.labs(spark, folder), users, "subject", measures, ["anchor_time"])
    return out.drop("anchor_time").withColumn("delta", F.round(F.col("late_last") - F.col("early_last"), 6))


CONCEPTS = ("view", "click", "purchase", "error")


@query(
    "window_worst_by_concept",
    "A2 C15 C17",
    ro.with_sql(ro.LABS_SQL, ro.USERS_SQL)
    + "SELECT u.subject, "
    + ", ".join(
        f"{fn}(CASE WHEN concept = '{c}' AND {w} AND valuenum BETWEEN 1 AND 150 THEN valuenum END) AS {c}_{fn}_{tag}"
        for c in CONCEPTS for fn in ("min", "max") for tag, w in (("early", EARLY), ("late", LATE))
    )
    + " FROM users u LEFT JOIN labs l USING (subject) GROUP BY 1",
)
def window_worst_by_concept(spark, folder):
    clean = nb.in_range("valuenum", (1.0, 150.0))
    measures = {
        f"{c}_{fn}_{tag}": measure(fn, clean, "charttime", (F.col("concept") == c) & w)
        for c in CONCEPTS for fn in ("min", "max") for tag, w in (("early", _span(0, 3)), ("late", _span(6, 9)))
    }
    users = ro.users(spark, folder).select("subject", "anchor_time")
    return window_measures(ro.labs(spark, folder), users, "subject", measures, ["anchor_time"]).drop("anchor_time")


RANGES = {"view": (5.0, 100.0), "click": (1.0, 80.0), "purchase": (0.5, 200.0), "error": (2.0, 50.0), "signup": (0.0, 1e9)}


@query(
    "range_clean",
    "P12",
    "SELECT event_type AS concept, count(*) AS n, count(*) FILTER (WHERE ok) AS n_kept, round(sum(CASE WHEN ok THEN value END), 4) AS kept_sum FROM (SELECT *, CASE event_type "
    + " ".join(f"WHEN '{c}' THEN value BETWEEN {lo} AND {hi}" for c, (lo, hi) in RANGES.items())
    + " END AS ok FROM events) GROUP BY 1",
)
def range_clean(spark, folder):
    value = None
    for c, bounds in RANGES.items():
        hit = F.col("concept") == c
        value = F.when(hit, nb.in_range("valuenum", bounds)) if value is None else value.when(hit, nb.in_range("valuenum", bounds))
    rows = ro.labs(spark, folder).withColumn("clean", value)
    return rows.groupBy("concept").agg(
        F.count("*").alias("n"), F.count("clean").alias("n_kept"), F.round(F.sum("clean"), 4).alias("kept_sum")
    )


@query(
    "unit_convert",
    "F9 F10 F11 F12 F14",
    """SELECT event_type AS concept, round(sum(CASE WHEN value > 70 THEN (value - 32) * 5 / 9 ELSE value END), 4) AS by_size,
      round(sum(CASE WHEN event_type LIKE '%click%' THEN (value - 32) * 5 / 9 WHEN event_type NOT LIKE '%view%' AND value > 60 THEN (value - 32) * 5 / 9 ELSE value END), 4) AS by_label,
      round(sum(CASE WHEN value > 1.5 THEN value / 100 ELSE value END), 4) AS oxygen,
      round(sum(CASE WHEN value BETWEEN 40 AND 300 AND value / 2 BETWEEN 20 AND 200 AND (value + 2 * (value / 2)) / 3.0 BETWEEN 20 AND 200 THEN (value + 2 * (value / 2)) / 3.0 END), 4) AS pressure,
      round(sum(CASE WHEN value > 40 AND value < 90 THEN value * 2.54 ELSE value END), 4) AS height,
      round(sum(80.0 / pow(nullif(value, 0) / 100.0, 2.0)), 2) AS bmi,
      round(sum(CASE WHEN value > 20 THEN greatest(25.0, least(value, 60.0)) END), 4) AS clipped
    FROM events GROUP BY 1""",
)
def unit_convert(spark, folder):
    v = F.col("valuenum")
    label = F.when(F.col("concept") == "click", "x Fahrenheit").when(F.col("concept") == "view", "y Celsius").otherwise("plain")
    cols = {
        "by_size": nb.temperature_by_size(v),
        "by_label": nb.temperature_by_label(v, label),
        "oxygen": nb.oxygen_fraction(v),
        "pressure": nb.mean_pressure(v, v / 2),
        "height": nb.height_cm(v),
        "clipped": nb.clip(F.when(v > 20, v), 25.0, 60.0),
    }
    return ro.labs(spark, folder).groupBy("concept").agg(
        *[F.round(F.sum(c), 4).alias(k) for k, c in cols.items()],
        F.round(F.sum(nb.body_mass_index(F.lit(80.0), v)), 2).alias("bmi"),
    )


@query(
    "triplet_pivot",
    "A16 C34",
    """SELECT user_id AS subject, strftime(day, '%Y-%m-%d %H:%M:%S') AS charttime, view, click, purchase, round(view + click + purchase, 6) AS total FROM (
      SELECT user_id, date_trunc('day', ts) AS day, max(CASE WHEN event_type = 'view' AND value BETWEEN 1 AND 100 THEN value END) AS view,
        max(CASE WHEN event_type = 'click' AND value BETWEEN 1 AND 80 THEN value END) AS click,
        max(CASE WHEN event_type = 'purchase' AND value BETWEEN 1 AND 60 THEN value END) AS purchase FROM events GROUP BY 1, 2)
    WHERE view IS NOT NULL AND click IS NOT NULL AND purchase IS NOT NULL AND view + click + purchase BETWEEN 3 AND 240""",
)
def triplet_pivot(spark, folder):
    rows = ro.labs(spark, folder).withColumn("charttime", F.date_trunc("day", "charttime"))
    out = complete_triplets(
        rows, ["subject", "charttime"], "concept", "valuenum", {"view": (1, 100), "click": (1, 80), "purchase": (1, 60)}, "total"
    )
    return out.withColumns({"charttime": ro.stamp("charttime"), "total": F.round("total", 6)})


# Users as stays: entry = first event, anchor = first signup, decision = +9 d.
LAB_NAMES = {"view": "lactate", "click": "creatinine", "purchase": "wbc", "error": "platelet", "signup": "bilirubin"}
STAYS = """stays AS (SELECT subject, min(charttime) AS intime, min(charttime) FILTER (WHERE concept = 'signup') AS first_broad_time,
   min(charttime) FILTER (WHERE concept = 'signup') + INTERVAL 9 DAY AS decision_time FROM labs GROUP BY 1)"""


def _stays(spark, folder):
    rows = ro.labs(spark, folder)
    clock = rows.groupBy("subject").agg(
        F.min("charttime").alias("intime"), F.min(F.when(F.col("concept") == "signup", F.col("charttime"))).alias("first_broad_time")
    )
    return clock.withColumn("decision_time", clocks.plus("first_broad_time", days=9))


def _renamed(spark, folder, names):
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return ro.labs(spark, folder).withColumn("concept", pairs[F.col("concept")])


E24 = "charttime >= s.first_broad_time AND charttime <= s.first_broad_time + INTERVAL 24 HOUR"
L24 = "charttime >= s.decision_time - INTERVAL 24 HOUR AND charttime <= s.decision_time"
BASE = "charttime >= s.intime AND charttime <= s.decision_time"


def _lab_sql(event: str, concept: str) -> str:
    lo, hi = nb.LAB_RANGES[concept]
    worst = "min" if concept == "platelet" else "max"
    clean = f"CASE WHEN valuenum BETWEEN {lo} AND {hi} THEN valuenum END"
    out = []
    for when, cond, tag in (("early", E24, "0_24h"), ("late", L24, "48_72h")):
        # arg_max skips rows with a null value, so the last row is taken as a struct.
        out.append(
            f"arg_max(struct_pack(v := {clean}), (charttime, valuenum)) FILTER (WHERE concept = '{event}' AND {cond}).v AS {concept}_{when}_last_{tag}"
        )
        out.append(f"{worst}({clean}) FILTER (WHERE concept = '{event}' AND {cond}) AS {concept}_{when}_worst_{tag}")
    return ", ".join(out)


@query(
    "lab_trajectory_features",
    "C14 C16",
    ro.with_sql(ro.LABS_SQL, STAYS)
    + "SELECT * EXCLUDE (base_first), round(base_last - base_first, 6) AS lactate_change_pre72, CASE WHEN base_last IS NULL THEN 1 ELSE 0 END AS lactate_missing_pre72, "
    + "round(lactate_late_last_48_72h - lactate_early_last_0_24h, 6) AS lactate_change_early_to_late FROM (SELECT s.subject, "
    + f"arg_max(valuenum, (charttime, valuenum)) FILTER (WHERE concept = 'view' AND {BASE}) AS base_last, arg_min(valuenum, (charttime, valuenum)) FILTER (WHERE concept = 'view' AND {BASE}) AS base_first, "
    + _lab_sql("view", "lactate") + ", " + _lab_sql("error", "platelet")
    + " FROM stays s JOIN labs l USING (subject) GROUP BY 1)",
)
def lab_trajectory_features(spark, folder):
    out = ft.add_lab_features(_stays(spark, folder), _renamed(spark, folder, LAB_NAMES), "subject")
    traj = [f"{c}_{w}" for c in ("lactate", "platelet") for w in ("early_last_0_24h", "early_worst_0_24h", "late_last_48_72h", "late_worst_48_72h")]
    return out.select(
        "subject", F.col("lactate_last_pre72").alias("base_last"), F.round("lactate_change_pre72", 6).alias("lactate_change_pre72"),
        "lactate_missing_pre72", F.round("lactate_change_early_to_late", 6).alias("lactate_change_early_to_late"), *traj,
    )


VITAL_NAMES = {"view": "heart_rate", "click": "temperature", "purchase": "fio2", "error": "height_cm", "signup": "weight_kg"}
CELSIUS = "CASE WHEN valuenum > 70 THEN (valuenum - 32) * 5 / 9 ELSE valuenum END"
OXYGEN = "CASE WHEN valuenum BETWEEN 0.2 AND 100 THEN CASE WHEN valuenum > 1.5 THEN valuenum / 100 ELSE valuenum END END"
HEIGHT = "CASE WHEN valuenum > 40 AND valuenum < 90 THEN valuenum * 2.54 ELSE valuenum END"


@query(
    "vital_features",
    "C15 C17 C19 F12",
    ro.with_sql(ro.LABS_SQL, STAYS)
    + f"""SELECT subject, hr_max_pre72, temp_max_pre72, heart_rate_48_72h, round(temperature_0_24h, 6) AS temperature_0_24h, round(temperature_48_72h, 6) AS temperature_48_72h,
        round(fio2_48_72h, 6) AS fio2_48_72h, fever_last12h_pre72, round(w / pow(h / 100.0, 2.0), 6) AS bmi_pre72 FROM (
      SELECT s.subject, max(CASE WHEN concept = 'view' AND {BASE} AND valuenum BETWEEN 20 AND 250 THEN valuenum END) AS hr_max_pre72,
        max(CASE WHEN concept = 'click' AND {BASE} AND valuenum BETWEEN 20 AND 110 THEN valuenum END) AS temp_max_pre72,
        max(CASE WHEN concept = 'view' AND {L24} AND valuenum BETWEEN 20 AND 250 THEN valuenum END) AS heart_rate_48_72h,
        max(CASE WHEN concept = 'click' AND {E24} AND {CELSIUS} BETWEEN 25 AND 45 THEN {CELSIUS} END) AS temperature_0_24h,
        max(CASE WHEN concept = 'click' AND {L24} AND {CELSIUS} BETWEEN 25 AND 45 THEN {CELSIUS} END) AS temperature_48_72h,
        max(CASE WHEN concept = 'purchase' AND {L24} THEN {OXYGEN} END) AS fio2_48_72h,
        max(CASE WHEN concept = 'click' AND charttime >= s.decision_time - INTERVAL 12 HOUR AND charttime <= s.decision_time AND {CELSIUS} BETWEEN 38 AND 45 THEN 1 ELSE 0 END) AS fever_last12h_pre72,
        arg_min({HEIGHT}, (charttime, valuenum)) FILTER (WHERE concept = 'error' AND {BASE} AND {HEIGHT} BETWEEN 120 AND 230) AS h,
        arg_min(valuenum, (charttime, valuenum)) FILTER (WHERE concept = 'signup' AND {BASE} AND valuenum BETWEEN 25 AND 300) AS w
      FROM stays s JOIN labs l USING (subject) GROUP BY 1)""",
)
def vital_features(spark, folder):
    out = ft.add_vital_features(_stays(spark, folder), _renamed(spark, folder, VITAL_NAMES), "subject")
    rounded = ["temperature_0_24h", "temperature_48_72h", "fio2_48_72h", "bmi_pre72"]
    return out.select(
        "subject", "hr_max_pre72", "temp_max_pre72", "heart_rate_48_72h", "fever_last12h_pre72", *[F.round(c, 6).alias(c) for c in rounded]
    )


@query(
    "fluid_sums",
    "A8 C18",
    ro.with_sql(ro.LABS_SQL, STAYS)
    + f"""SELECT s.subject, round(sum(CASE WHEN valuenum BETWEEN 0 AND 10000 AND {E24} THEN valuenum END), 4) AS early,
        round(sum(CASE WHEN valuenum BETWEEN 0 AND 10000 AND {L24} THEN valuenum END), 4) AS late,
        round(sum(CASE WHEN valuenum BETWEEN 0 AND 10000 AND {L24} THEN valuenum END) - sum(CASE WHEN valuenum BETWEEN 0 AND 10000 AND {E24} THEN valuenum END), 4) AS change
      FROM stays s JOIN labs l USING (subject) GROUP BY 1""",
)
def fluid_sums(spark, folder):
    rows = ro.labs(spark, folder).withColumnRenamed("valuenum", "value_num")
    out = ft.add_urine_features(_stays(spark, folder), rows, "subject")
    names = {"early": "urine_output_ml_0_24h", "late": "urine_output_ml_48_72h", "change": "urine_output_change_pre72"}
    return out.select("subject", *[F.round(c, 4).alias(k) for k, c in names.items()])


@query(
    "median_impute_flags",
    "C22 A11",
    ro.with_sql(ro.UNITS_SQL)
    + """, b AS (SELECT unit, CASE WHEN unit % 3 = 0 THEN NULL ELSE price END AS price, balance FROM units)
      SELECT unit, CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_missing, CASE WHEN balance IS NULL THEN 1 ELSE 0 END AS balance_missing,
        round(coalesce(price, (SELECT median(price) FROM b)), 4) AS price, round(coalesce(balance, (SELECT median(balance) FROM b)), 4) AS balance FROM b""",
)
def median_impute_flags(spark, folder):
    rows = ro.units(spark, folder).select("unit", F.when(F.col("unit") % 3 != 0, F.col("price")).alias("price"), "balance")
    out = ft.impute_medians(stage_border(rows), ["price", "balance"])
    return out.withColumns({c: F.round(c, 4) for c in ("price", "balance")})


def _bands(x: str, bands, rising: bool) -> str:
    op = "<" if rising else ">="
    cases = " ".join(f"WHEN {x} {op} {b} THEN {p}" for b, p in bands if b is not None)
    return f"CASE WHEN {x} IS NULL THEN 0 {cases} ELSE {bands[-1][1]} END"


def _score_sql(tag: str) -> str:
    cr, bi, pl, gc = (
        _bands("creat", nb.CREATININE_BANDS, True), _bands("bili", nb.BILIRUBIN_BANDS, True),
        _bands("plate", nb.PLATELET_BANDS, False), _bands("gcs", nb.GCS_BANDS, False),
    )
    return f"""(CASE WHEN vaso = 1 THEN 3 WHEN map < 70 THEN 1 ELSE 0 END) + greatest({cr}, CASE WHEN urine < 500 THEN 3 ELSE 0 END)
      + {pl} + {bi} + {gc} + (CASE WHEN spo2 < 90 OR vent = 1 THEN 2 WHEN spo2 < 94 THEN 1 ELSE 0 END)"""


SCORE_INPUT = """(SELECT unit, 'early' AS w, price / 80000 AS creat, balance / 500 AS bili, price / 2000 AS plate, 3 + unit % 13 AS gcs, 60 + unit % 40 AS map, closed AS vaso,
    price / 300 AS urine, 85 + unit % 15 AS spo2, building AS vent FROM units
  UNION ALL SELECT unit, 'late', price / 100000, balance / 900, price / 1500, 3 + (unit + 5) % 13, 65 + unit % 40, 1 - closed, price / 250, 88 + unit % 12, building FROM units)"""


@query(
    "banded_score",
    "F13 C20",
    ro.with_sql(ro.UNITS_SQL)
    + f""", s AS (SELECT unit, w, {_score_sql('x')} AS score FROM {SCORE_INPUT}),
      p AS (SELECT unit, CAST(max(score) FILTER (WHERE w = 'early') AS INTEGER) AS early, CAST(max(score) FILTER (WHERE w = 'late') AS INTEGER) AS late FROM s GROUP BY 1)
      SELECT early, late, late - early AS change, CASE WHEN late < early THEN 1 ELSE 0 END AS improved, count(*) AS n FROM p GROUP BY ALL""",
)
def banded_score(spark, folder):
    u = ro.units(spark, folder)
    price, bal, key = F.col("price"), F.col("balance"), F.col("unit")
    rows = u.select(
        "unit", F.col("building").alias("vent_proc"),
        (price / 80000).alias("creatinine_early_last_0_24h"), (price / 100000).alias("creatinine_late_last_48_72h"),
        (bal / 500).alias("bilirubin_early_worst_0_24h"), (bal / 900).alias("bilirubin_late_worst_48_72h"),
        (price / 2000).alias("platelet_early_worst_0_24h"), (price / 1500).alias("platelet_late_worst_48_72h"),
        (3 + key % 13).alias("gcs_total_0_24h"), (3 + (key + 5) % 13).alias("gcs_total_48_72h"),
        (60 + key % 40).alias("map_0_24h"), (65 + key % 40).alias("map_48_72h"),
        F.col("closed").alias("vasopressor_any_0_24h"), (1 - F.col("closed")).alias("vasopressor_any_48_72h"),
        (price / 300).alias("urine_output_ml_0_24h"), (price / 250).alias("urine_output_ml_48_72h"),
        (85 + key % 15).alias("spo2_0_24h"), (88 + key % 12).alias("spo2_48_72h"),
    )
    out = ft.add_organ_scores(rows)
    return out.groupBy(
        F.col("sofa_like_0_24h").alias("early"), F.col("sofa_like_48_72h").alias("late"),
        F.col("sofa_like_change_pre72").alias("change"), F.col("sofa_like_improved_pre72").alias("improved"),
    ).agg(F.count("*").alias("n"))


@query(
    "severity_zscore",
    "C21",
    ro.with_sql(ro.UNITS_SQL)
    + """, k AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(balance) AS mb, stddev_pop(balance) AS sb FROM units)
      SELECT unit, round((price - mp) / sp - coalesce((balance - mb) / sb, 0) + 0.3 * closed + 0.2 * building, 6) AS severity FROM units, k""",
)
def severity_zscore(spark, folder):
    u = stage_border(ro.units(spark, folder).select("unit", "price", "balance", "closed", "building"))
    score = ft.severity(u, ["price", "balance"], ["balance"])
    return u.select("unit", F.round(score + 0.3 * F.col("closed") + 0.2 * F.col("building"), 6).alias("severity"))


TITLES = {"ring": "heart failure", "gear": "chronic kidney disease", "bolt": "type 2 diabetes", "plate": "mechanical ventilation"}
TITLE_CASE = "CASE split_part(lower(p_name), ' ', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + " END"
UNIT_NAMES = {"1-URGENT": "Medical ICU", "2-HIGH": "Coronary Care", "3-MEDIUM": "Surgical ICU", "4-NOT SPECIFIED": "Neuro Medical"}


@query(
    "baseline_flags",
    "C13 C2 F6",
    f"""WITH t AS (SELECT l_orderkey AS hadm_id, {TITLE_CASE} AS title FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
      g AS (SELECT hadm_id, max(CASE WHEN regexp_matches(title, 'diabetes|chronic kidney|heart failure') THEN 1 ELSE 0 END) AS comorb,
             max(CASE WHEN title = 'heart failure' THEN 1 ELSE 0 END) AS heart_failure, max(CASE WHEN title LIKE 'chronic kidney%' THEN 1 ELSE 0 END) AS chronic_kidney,
             max(CASE WHEN title LIKE 'mechanical%' THEN 1 ELSE 0 END) AS vent_proc FROM t GROUP BY 1)
      SELECT comorb, heart_failure, chronic_kidney, vent_proc, sex_male, micu, sicu, cardiac_icu, neuro_icu, hours_admit_to_icu, count(*) AS n FROM (
        SELECT coalesce(comorb, 0) AS comorb, coalesce(heart_failure, 0) AS heart_failure, coalesce(chronic_kidney, 0) AS chronic_kidney, coalesce(vent_proc, 0) AS vent_proc,
          CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS sex_male, CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 1 ELSE 0 END AS micu,
          CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS sicu, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS cardiac_icu,
          CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS neuro_icu,
          CAST(least(720.0, greatest(-24.0, (o_orderkey % 1000 - 50)::DOUBLE)) AS DOUBLE) AS hours_admit_to_icu
        FROM orders o LEFT JOIN g ON g.hadm_id = o.o_orderkey) GROUP BY ALL""",
)
def baseline_flags(spark, folder):
    line, order, part = (ro.table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    noun = F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2))
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("hadm_id"), F.try_element_at(titles, noun).alias("long_title_lower")
    )
    care = F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])
    hours = (F.col("o_orderkey") % 1000 - 50).cast("int")
    cohort = order.select(
        F.col("o_orderkey").alias("hadm_id"), F.lit(50).alias("anchor_age"),
        F.when(F.col("o_custkey") % 2 == 0, "M").otherwise("F").alias("gender"), F.lit("white").alias("race"),
        F.try_element_at(care, F.col("o_orderpriority")).alias("first_careunit"),
        F.col("o_orderdate").alias("admittime"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours)).alias("intime"),
    )
    out = ft.add_baseline_covariates(cohort, rows, rows)
    keys = ["comorb", "heart_failure", "chronic_kidney", "vent_proc", "sex_male", "micu", "sicu", "cardiac_icu", "neuro_icu", "hours_admit_to_icu"]
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


STEROIDS = {"ring": "hydrocortisone cream", "gear": "prednisone", "bolt": "dexamethasone"}


@query(
    "steroid_flags",
    "C19 J3",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + """SELECT p.subject, max(CASE WHEN hit AND regexp_matches(drug_lower, 'ring|gear|bolt') AND route_lower <> 'inhal' THEN 1 ELSE 0 END) AS steroid_any_pre72,
         max(CASE WHEN hit AND drug_lower LIKE '%ring%' AND route_lower <> 'inhal' THEN 1 ELSE 0 END) AS hydrocortisone_any_pre72
       FROM people p LEFT JOIN (SELECT m.*, m.coverage_start < p.decision_time AND m.coverage_stop > p.first_time AS hit FROM meds m JOIN people p USING (subject)) m USING (subject) GROUP BY 1""",
)
def steroid_flags(spark, folder):
    names = F.create_map(*[F.lit(x) for kv in STEROIDS.items() for x in kv])
    noun = F.split_part("drug_lower", F.lit(" "), F.lit(2))
    meds = ro.meds(spark, folder).withColumn("drug_lower", F.try_element_at(names, noun))
    people = ro.people(spark, folder).select("subject", "first_time", "decision_time")
    return ft.add_steroids(people, meds, "subject", "first_time").drop("first_time", "decision_time")


# ---- outcomes ----
LIFE = """life AS (SELECT p.*, d.deathtime FROM people p LEFT JOIN (
    SELECT o_custkey AS subject, min(o_orderdate) AS deathtime FROM orders WHERE o_totalprice > 350000 AND o_orderstatus = 'F' GROUP BY 1) d USING (subject))"""


def _life(spark, folder):
    order = ro.table(spark, folder, "orders").where("o_totalprice > 350000 and o_orderstatus = 'F'")
    died = order.groupBy(F.col("o_custkey").alias("subject")).agg(F.min("o_orderdate").alias("deathtime"))
    return ro.people(spark, folder).join(died, "subject", "left")


DEAD = "deathtime IS NOT NULL AND deathtime >= analysis_time0 AND deathtime <= analysis_time0 + INTERVAL 300 DAY"


@query(
    "horizon_outcomes",
    "C26 C27 C25 F5 F6",
    ro.with_sql(ro.PEOPLE_SQL, LIFE)
    + f"""SELECT subject, CASE WHEN {DEAD} THEN 1 ELSE 0 END AS death_by_horizon,
        round(least(300.0, greatest(0.0, CASE WHEN {DEAD} THEN {ro.days_sql('analysis_time0', 'deathtime')} ELSE 300.0 END)), 6) AS followup_time,
        round(CASE WHEN {DEAD} THEN 0.0 ELSE least(300.0, greatest(0.0, 300.0 - least(300.0, greatest(0.0, {ro.days_sql('analysis_time0', 'last_time')})))) END, 6) AS hospital_free_days,
        CASE WHEN last_time <= analysis_time0 + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS near_discharge
      FROM life""",
)
def horizon_outcomes(spark, folder):
    out = oc.add_mortality(_life(spark, folder), "analysis_time0", 300, "deathtime", None)
    out = oc.add_hospital_free_days(out, "analysis_time0", 300, "last_time")
    out = oc.add_near_discharge(out, "analysis_time0", "last_time", "last_time")
    return out.select(
        "subject", "death_by_horizon", F.round("followup_time", 6).alias("followup_time"),
        F.round("hospital_free_days", 6).alias("hospital_free_days"), F.col("near_discharge_24h_after_landmark").alias("near_discharge"),
    )


GRID = """grid AS (SELECT p.subject, p.analysis_time0, d.day_idx FROM people p CROSS JOIN (SELECT unnest(range(30)) AS day_idx) d),
  daily AS (SELECT g.subject, g.day_idx, max(CASE WHEN m.is_any THEN 1 ELSE 0 END) AS any_abx, max(CASE WHEN m.is_broad THEN 1 ELSE 0 END) AS broad_abx FROM grid g
    JOIN (SELECT * FROM meds WHERE is_any) m ON m.subject = g.subject AND m.coverage_start < g.analysis_time0 + to_days(CAST(g.day_idx + 1 AS INTEGER)) AND m.coverage_stop > g.analysis_time0 + to_days(CAST(g.day_idx AS INTEGER)) GROUP BY ALL)"""


def _bins(spark, folder):
    meds = ro.meds(spark, folder).where("is_any").select("subject", "is_broad", "coverage_start", "coverage_stop")
    people = ro.people(spark, folder).select("subject", "analysis_time0")
    return people, meds, touched_bins(meds, people, "subject", "analysis_time0", 30)


@query("touched_days", "C28", ro.with_sql(MEDS, ro.PEOPLE_SQL, GRID) + "SELECT subject, count(*) AS n_days FROM daily GROUP BY 1")
def touched_days(spark, folder):
    return _bins(spark, folder)[2].groupBy("subject").agg(F.count("*").alias("n_days"))


RUN = "max(CASE WHEN d0.day_idx BETWEEN 7 AND 27 AND d1.day_idx IS NOT NULL AND d2.day_idx IS NOT NULL THEN 1 ELSE 0 END)"
RUN_FROM = "daily d0 LEFT JOIN daily d1 ON d1.subject = d0.subject AND d1.day_idx = d0.day_idx + 1 LEFT JOIN daily d2 ON d2.subject = d0.subject AND d2.day_idx = d0.day_idx + 2"


@query("three_day_run", "W2", ro.with_sql(MEDS, ro.PEOPLE_SQL, GRID) + f"SELECT d0.subject, {RUN} AS has_run FROM {RUN_FROM} GROUP BY 1 HAVING max(d0.day_idx) >= 7")
def three_day_run(spark, folder):
    return longest_run_flag(_bins(spark, folder)[2], ["subject"], 7, 27)


@query(
    "day_grid_leads",
    "W1 J16",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, GRID)
    + """, f AS (SELECT g.subject, g.day_idx, CASE WHEN d.subject IS NULL THEN 0 ELSE 1 END AS t FROM grid g LEFT JOIN daily d USING (subject, day_idx)),
      w AS (SELECT *, lead(t, 1, 0) OVER (PARTITION BY subject ORDER BY day_idx) AS d1, lead(t, 2, 0) OVER (PARTITION BY subject ORDER BY day_idx) AS d2 FROM f)
      SELECT subject, CAST(sum(t) AS BIGINT) AS n_days, max(CASE WHEN day_idx BETWEEN 7 AND 27 AND t = 1 AND d1 = 1 AND d2 = 1 THEN 1 ELSE 0 END) AS has_run FROM w GROUP BY 1""",
)
def day_grid_leads(spark, folder):
    people, _, bins = _bins(spark, folder)
    return oc.lead_triplets(oc.day_grid(people, ["subject"], bins), ["subject"])


@query(
    "treatment_burden",
    "C29 C28",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, LIFE, GRID)
    + f""", b AS (SELECT subject, count(*) AS nd, sum(broad_abx) AS nb FROM daily GROUP BY 1), r AS (SELECT d0.subject, {RUN} AS has_run FROM {RUN_FROM} GROUP BY 1),
      k AS (SELECT l.subject, CASE WHEN {DEAD.replace('300', '30')} THEN 1 ELSE 0 END AS dead,
              least(30.0, greatest(0.1, CASE WHEN {DEAD.replace('300', '30')} THEN {ro.days_sql('analysis_time0', 'deathtime')} ELSE 30.0 END)) AS alive FROM life l)
      SELECT k.subject, coalesce(nd, 0) AS antibiotic_days, CAST(coalesce(nb, 0) AS BIGINT) AS broad_antibiotic_days_30d, coalesce(has_run, 0) AS late_run,
        CAST(CASE WHEN dead = 1 THEN 0 ELSE 30 - coalesce(nd, 0) END AS DOUBLE) AS antibiotic_free_days,
        round(least(1.0, coalesce(nd, 0) / alive), 6) AS normalized_any, round(least(1.0, coalesce(nb, 0) / alive), 6) AS normalized_broad
      FROM k LEFT JOIN b USING (subject) LEFT JOIN r USING (subject)""",
)
def treatment_burden(spark, folder):
    meds = _bins(spark, folder)[1]
    life = oc.add_mortality(_life(spark, folder), "analysis_time0", 30, "deathtime", None)
    out = oc.add_treatment_burden(life, meds, "subject", "analysis_time0")
    return out.select(
        "subject", "antibiotic_days", "broad_antibiotic_days_30d", F.col("late_recurrent_or_persistent_abx_course_30d").alias("late_run"),
        "antibiotic_free_days", F.round("normalized_antibiotic_exposure_30d", 6).alias("normalized_any"),
        F.round("normalized_broad_antibiotic_exposure_30d", 6).alias("normalized_broad"),
    )


@query(
    "date_level_outcomes",
    "C30 J4",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, LIFE)
    + """, c AS (SELECT subject, CAST(analysis_time0 AS DATE) AS d0, CAST(last_time AS DATE) AS dis, CAST(deathtime AS DATE) AS dd FROM life),
      g AS (SELECT c.*, d.day_idx FROM c CROSS JOIN (SELECT unnest(range(30)) AS day_idx) d),
      daily AS (SELECT g.subject, g.day_idx, max(CASE WHEN m.is_broad THEN 1 ELSE 0 END) AS b FROM g JOIN meds m ON m.subject = g.subject AND m.is_any
        AND CAST(m.coverage_start AS DATE) <= g.d0 + CAST(g.day_idx AS INTEGER) AND CAST(m.coverage_stop AS DATE) >= g.d0 + CAST(g.day_idx AS INTEGER) GROUP BY ALL),
      n AS (SELECT subject, count(*) AS nd, sum(b) AS nb FROM daily GROUP BY 1),
      k AS (SELECT c.*, coalesce(nd, 0) AS nd, coalesce(nb, 0) AS nb, CASE WHEN dd >= d0 AND dd <= d0 + 30 THEN 1 ELSE 0 END AS dead FROM c LEFT JOIN n USING (subject))
      SELECT subject, dead AS death_30d, nd AS antibiotic_days_30d, CAST(nb AS BIGINT) AS broad_antibiotic_days_30d,
        CASE WHEN dead = 1 THEN 0.0 ELSE 30.0 - least(30.0, greatest(0.0, date_diff('day', d0, dis)::DOUBLE)) END::DOUBLE AS hospital_free_days_30d,
        CASE WHEN dead = 1 THEN 0.0 ELSE greatest(0.0, 30.0 - nd::DOUBLE) END::DOUBLE AS antibiotic_free_days_30d,
        CASE WHEN dead = 1 THEN greatest(0.1, least(30.0, date_diff('day', d0, dd)::DOUBLE)) ELSE 30.0 END::DOUBLE AS days_alive_30d,
        round(least(1.0, nd / CASE WHEN dead = 1 THEN greatest(0.1, least(30.0, date_diff('day', d0, dd)::DOUBLE)) ELSE 30.0 END), 6) AS normalized_any FROM k""",
)
def date_level_outcomes(spark, folder):
    life = _life(spark, folder).select(
        "subject", F.to_date("analysis_time0").alias("d0"), F.to_date("last_time").alias("dis"), F.to_date("deathtime").alias("dd")
    )
    meds = ro.meds(spark, folder).withColumns({"s0": F.to_date("coverage_start"), "s1": F.to_date("coverage_stop")})
    out = oc.date_level_outcomes(life, meds, ["subject"], "d0", "dis", "dd", "s0", "s1")
    return out.select(
        "subject", "death_30d", "antibiotic_days_30d", "broad_antibiotic_days_30d", "hospital_free_days_30d", "antibiotic_free_days_30d",
        "days_alive_30d", F.round("normalized_antibiotic_exposure_30d", 6).alias("normalized_any"),
    )


@query(
    "landmark_effect",
    "C3 C4 J3 C8 C26 M14 A18",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, classes_sql())
    + """, y AS (SELECT p.subject, max(CASE WHEN m.source = 'F' AND m.starttime > p.analysis_time0 AND m.starttime <= p.analysis_time0 + INTERVAL 60 DAY THEN 1 ELSE 0 END) AS y
              FROM people p LEFT JOIN meds m USING (subject) GROUP BY 1),
      a AS (SELECT c.A, y.y FROM classes_meds c JOIN y USING (subject)),
      s AS (SELECT avg(y) FILTER (WHERE A = 1) AS t, avg(y) FILTER (WHERE A = 0) AS c FROM a)
      SELECT 'crude' AS analysis, 'y' AS outcome, 'risk' AS kind, round(t, 6) AS treated, round(c, 6) AS control, round(t - c, 6) AS difference, round(t / c, 6) AS ratio FROM s""",
)
def landmark_effect(spark, folder):
    people = ro.people(spark, folder).select("subject", "decision_time", "analysis_time0")
    late = (F.col("starttime") > F.col("analysis_time0")) & (F.col("starttime") <= clocks.plus("analysis_time0", days=60))
    rows = classify_treatment(people, ro.meds(spark, folder), "subject", also={"y": (F.col("source") == "F") & late})
    out = effect_table(rows, {"y": "risk"}, {"crude": None})
    return out.withColumns({c: F.round(c, 6) for c in ("treated", "control", "difference", "ratio")})


@query(
    "stream_horizon_outcome",
    "C26 C4",
    ro.with_sql(ro.LABS_SQL, ro.USERS_SQL)
    + """SELECT u.subject, max(CASE WHEN concept = 'error' AND valuenum > 100 AND charttime > analysis_time0 AND charttime <= anchor_time + INTERVAL 20 DAY THEN 1 ELSE 0 END) AS y
       FROM users u LEFT JOIN labs l USING (subject) GROUP BY 1""",
)
def stream_horizon_outcome(spark, folder):
    bad = (F.col("concept") == "error") & (F.col("valuenum") > 100)
    when = (F.col("charttime") > F.col("analysis_time0")) & (F.col("charttime") <= clocks.plus("anchor_time", days=20))
    users = ro.users(spark, folder)
    out = window_measures(
        ro.labs(spark, folder), users, "subject", {"y": F.max(flag(bad & when))}, ["anchor_time", "analysis_time0"], zero_fill=["y"]
    )
    return out.select("subject", "y")


@query(
    "describe_by_group",
    "A10 A11",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS minimum, max(value) AS maximum, """
    + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100):02d}" for p in rp.DESCRIBE_PROBS)
    + " FROM events GROUP BY 1",
)
def describe_by_group(spark, folder):
    out = rp.describe_by(ro.table(spark, folder, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("event_type", "n", "minimum", "maximum")})


@query(
    "item_summary",
    "A17",
    """SELECT p_name, count(l_extendedprice) AS n, count(DISTINCT l_orderkey) AS n_entities, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, """
    + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{int(p * 100):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    + " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
)
def item_summary(spark, folder):
    part = ro.table(spark, folder, "part").select("p_partkey", "p_name")
    rows = ro.table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    out = rp.item_summary(rows, "p_name", "l_orderkey", "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("p") and c != "p_name"})


@query(
    "clock_arithmetic",
    "F6 F7 F8 F14",
    f"""SELECT l_returnflag, round(sum({ro.hours_sql('o_orderdate', 'l_shipdate')}), 4) AS hours, round(avg(date_diff('day', o_orderdate, l_shipdate) / 365.25), 6) AS years,
        round(avg(date_diff('day', TIMESTAMP '1960-01-01', o_orderdate) / 365.25), 6) AS age_days, CAST(sum(date_diff('hour', o_orderdate + INTERVAL 30 MINUTE, l_shipdate + INTERVAL 29 MINUTE)) AS BIGINT) AS hour_marks,
        CAST(sum(date_diff('minute', o_orderdate + INTERVAL 50 SECOND, l_shipdate + INTERVAL 10 SECOND)) AS BIGINT) AS minute_marks
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def clock_arithmetic(spark, folder):
    rows = ro.table(spark, folder, "lineitem").join(ro.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    birth = F.lit("1960-01-01").cast("timestamp_ntz")
    return rows.groupBy("l_returnflag").agg(
        F.round(F.sum(clocks.hours_between("o_orderdate", "l_shipdate")), 4).alias("hours"),
        F.round(F.avg(clocks.age_years_from_days("o_orderdate", "l_shipdate")), 6).alias("years"),
        F.round(F.avg(clocks.age_years_from_seconds(birth, "o_orderdate")), 6).alias("age_days"),
        F.sum(clocks.boundaries_crossed("hour", clocks.plus("o_orderdate", minutes=30), clocks.plus("l_shipdate", minutes=29))).alias("hour_marks"),
        F.sum(clocks.boundaries_crossed("minute", clocks.plus("o_orderdate", seconds=50), clocks.plus("l_shipdate", seconds=10))).alias("minute_marks"),
    )
