"""Corrected vitals over the tables: repair, what it changed, refits, ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..session import stage_border
from . import roles as ro
from . import site_hour as sh
from .feature_queries import BASE, E24, L24, STAYS, _score_sql, _stays
from .newton_sql import score
from .registry import query
from .weight_queries import _summary, summary_sql

# ---- repair of charted rows ----
#: Coma-scale parts charted with an event: their value is its id modulo this, values outside the part's range among them.
PARTS = {"eye": 5, "verbal": 6, "motor": 7}
ORGAN_INPUTS = {
    "creatinine": ("creatinine_early_last_0_24h", "creatinine_late_last_48_72h"), "platelet": ("platelet_early_worst_0_24h", "platelet_late_worst_48_72h"),
    "bilirubin": ("bilirubin_early_worst_0_24h", "bilirubin_late_worst_48_72h"), "map": ("map_0_24h", "map_48_72h"), "spo2": ("spo2_0_24h", "spo2_48_72h"),
    "urine": ("urine_output_ml_0_24h", "urine_output_ml_48_72h"), "vaso": ("vasopressor_any_0_24h", "vasopressor_any_48_72h"),
}


def _charted(spark, folder):
    """Temperatures in either unit, oxygen in per cent or as fraction, and coma-scale parts charted together."""
    n = F.col("event_id")
    flat = F.col("concept").isin("click", "purchase")
    said = F.struct(F.lit(None).cast("string").alias("component"), F.col("valuenum").alias("v"))
    parts = F.array(*[F.struct(F.lit(p).alias("component"), (n % m).cast("double").alias("v")) for p, m in PARTS.items()])
    rows = ro.labs(spark, folder).withColumns(
        {
            "domain": F.when(F.col("concept") == "click", "temperature").when(F.col("concept") == "purchase", "fio2").otherwise("gcs"),
            "label": F.when(n % 2 == 0, "Temperature Fahrenheit").otherwise("Temperature"),
            "charted": F.explode(F.when(flat, F.array(said)).otherwise(parts)),
        }
    )
    return rows.select("subject", "domain", "label", "charttime", "charted.component", F.col("charted.v").alias("valuenum"))


def _repaired(spark, folder):
    """Stays with the repaired vitals beside old ones of a known shape."""
    s = F.col("subject")
    out = ft.repair_measures(_charted(spark, folder), _stays(spark, folder), "subject")
    out = out.withColumns({"temp_max_pre72": F.lit(98.6), "gcs_total_0_24h": F.lit(15.0), "gcs_total_48_72h": F.lit(15.0), "fio2_0_24h": F.lit(0.21), "fio2_48_72h": F.lit(0.21)})
    values = {"creatinine": s % 6, "platelet": s % 9 * 25, "bilirubin": s % 7 * 2, "map": 60 + s % 30, "spo2": 85 + s % 15, "urine": s % 8 * 150, "vaso": s % 2}
    made = {c: (values[k] + i if k != "vaso" else values[k]).cast("double") for k, both in ORGAN_INPUTS.items() for i, c in enumerate(both)}
    return stage_border(out.withColumns({**made, "vent_proc": (s % 5 == 0).cast("int")}))


NEW = ("new_temp_max_pre72", "new_fio2_0_24h", "new_fio2_48_72h", "new_gcs_total_0_24h", "new_gcs_total_48_72h")
_part = lambda name, hi: f"max(CASE WHEN event_id % {PARTS[name]} BETWEEN 1 AND {hi} THEN event_id % {PARTS[name]} END) AS {name}"
REPAIRED_SQL = f"""flat AS (
  SELECT s.subject, max(CASE WHEN concept = 'click' AND {BASE} AND f BETWEEN 30 AND 45 THEN f END) AS new_temp_max_pre72,
    max(CASE WHEN concept = 'purchase' AND {E24} AND o BETWEEN 0.2 AND 1 THEN o END) AS new_fio2_0_24h,
    max(CASE WHEN concept = 'purchase' AND {L24} AND o BETWEEN 0.2 AND 1 THEN o END) AS new_fio2_48_72h
  FROM stays s JOIN (SELECT *, CASE WHEN event_id % 2 = 0 OR valuenum > 60 THEN (valuenum - 32.0) * 5.0 / 9.0 ELSE valuenum END AS f,
    CASE WHEN valuenum > 1.5 THEN valuenum / 100.0 ELSE valuenum END AS o FROM labs WHERE concept IN ('click', 'purchase')) l USING (subject) GROUP BY 1
), triplets AS (
  SELECT subject, charttime, eye + verbal + motor AS total FROM (
    SELECT subject, charttime, {_part("eye", 4)}, {_part("verbal", 5)}, {_part("motor", 6)}
    FROM labs WHERE concept NOT IN ('click', 'purchase') GROUP BY ALL) WHERE eye + verbal + motor BETWEEN 3 AND 15
), coma AS (
  SELECT s.subject, min(CASE WHEN {E24} THEN total END)::DOUBLE AS new_gcs_total_0_24h, min(CASE WHEN {L24} THEN total END)::DOUBLE AS new_gcs_total_48_72h
  FROM stays s JOIN triplets USING (subject) GROUP BY 1
), repaired AS MATERIALIZED (
  SELECT s.subject, {", ".join(NEW)} FROM stays s LEFT JOIN flat USING (subject) LEFT JOIN coma USING (subject)
)"""


def _scores_of(tag: str, i: int, gcs: str) -> str:
    values = f"subject % 6 + {i} AS creat, subject % 9 * 25 + {i} AS plate, subject % 7 * 2 + {i} AS bili, 60 + subject % 30 + {i} AS map, 85 + subject % 15 + {i} AS spo2"
    return f"""(SELECT {_score_sql('')} FROM (SELECT {values}, subject % 8 * 150 + {i} AS urine, subject % 2 AS vaso, CASE WHEN subject % 5 = 0 THEN 1 ELSE 0 END AS vent, {gcs} AS gcs)) AS sofa_like_{tag}"""


@query(
    "vital_repair",
    "C34 F9 F10",
    ro.with_sql(ro.LABS_SQL, STAYS, REPAIRED_SQL)
    + f"""SELECT subject, {", ".join(f"round({c}, 6) AS {c}" for c in NEW)},
        {", ".join(f"CASE WHEN new_gcs_total_{t} IS NULL THEN 1 ELSE 0 END AS gcs_total_{t}_missing" for t in ("0_24h", "48_72h"))},
        {_scores_of("0_24h", 0, "g0")}, {_scores_of("48_72h", 1, "g1")}
      FROM (SELECT *, coalesce(new_gcs_total_0_24h, (SELECT median(new_gcs_total_0_24h) FROM repaired), 0.0) AS g0,
              coalesce(new_gcs_total_48_72h, (SELECT median(new_gcs_total_48_72h) FROM repaired), 0.0) AS g1 FROM repaired)""",
)
def vital_repair(spark, folder):
    rows = _repaired(spark, folder)
    fixed = ft.apply_repair(rows.select("*", *[F.col(c).alias(f"seen_{c}") for c in NEW]))
    return fixed.select(
        "subject", *[F.round(f"seen_{c}", 6).alias(c) for c in NEW], "gcs_total_0_24h_missing", "gcs_total_48_72h_missing", "sofa_like_0_24h", "sofa_like_48_72h"
    )


CHANGED = {"temp_max_pre72": "98.6", "gcs_total_0_24h": "15.0", "gcs_total_48_72h": "15.0", "fio2_0_24h": "0.21", "fio2_48_72h": "0.21"}
_changes = " UNION ALL ".join(
    f"SELECT subject, '{c}' AS variable, round({'(98.6 - 32.0) * 5.0 / 9.0' if c.startswith('temp') else old}::DOUBLE, 6) AS old, round(new_{c}, 6) AS new FROM repaired" for c, old in CHANGED.items()
)
CHANGES_SQL = f"changes AS MATERIALIZED (SELECT *, round(new - old, 6) AS change FROM ({_changes}) WHERE old IS DISTINCT FROM new)"


def _changes_of(spark, folder):
    return ft.repair_change(_repaired(spark, folder), {c: (c, f"new_{c}") for c in CHANGED}, ["subject"])


@query("vital_changed_rows", "C34", ro.with_sql(ro.LABS_SQL, STAYS, REPAIRED_SQL, CHANGES_SQL) + "SELECT * FROM changes")
def vital_changed_rows(spark, folder):
    return _changes_of(spark, folder)


@query(
    "vital_change",
    "C34",
    ro.with_sql(ro.LABS_SQL, STAYS, REPAIRED_SQL, CHANGES_SQL)
    + """SELECT variable, count(*) AS n_changed, count(*) FILTER (WHERE abs(change) > 0.1) AS n_changed_gt_0_1, count(*) FILTER (WHERE abs(change) > 0.5) AS n_changed_gt_0_5,
        count(*) FILTER (WHERE old IS NULL) AS n_gained, count(*) FILTER (WHERE new IS NULL) AS n_lost, max(abs(change)) AS max_abs_change FROM changes GROUP BY 1""",
)
def vital_change(spark, folder):
    return ft.change_sizes(_changes_of(spark, folder))


# ---- ablation and refit on units ----
VITALS = {
    "temp_max_pre72": ("CASE WHEN unit % 4 = 0 THEN 96.8::DOUBLE + (unit % 50) / 10.0::DOUBLE ELSE 36.0::DOUBLE + (unit % 30) / 10.0::DOUBLE END", "CASE WHEN unit % 9 <> 0 THEN 36.0::DOUBLE + (unit % 37) / 10.0::DOUBLE END"),
    "gcs_total_0_24h": ("(3 + unit % 13)::DOUBLE", "CASE WHEN unit % 5 <> 0 THEN (3 + unit * 7 % 13)::DOUBLE END"),
    "gcs_total_48_72h": ("(3 + unit % 11)::DOUBLE", "CASE WHEN unit % 6 <> 0 THEN (3 + unit * 5 % 13)::DOUBLE END"),
    "fio2_0_24h": ("0.21::DOUBLE + (unit % 70) / 100.0::DOUBLE", "CASE WHEN unit % 7 <> 0 THEN 0.21::DOUBLE + (unit % 61) / 100.0::DOUBLE END"),
    "fio2_48_72h": ("0.21::DOUBLE + (unit % 47) / 100.0::DOUBLE", "CASE WHEN unit % 8 <> 0 THEN 0.21::DOUBLE + (unit % 59) / 100.0::DOUBLE END"),
}
ORGANS = {
    "creatinine": ("price / 80000", "price / 100000"), "platelet": ("price / 2000", "price / 1500"), "bilirubin": ("balance / 500", "balance / 900"),
    "map": ("60 + unit % 40", "65 + unit % 40"), "spo2": ("85 + unit % 15", "88 + unit % 12"), "urine": ("price / 300", "price / 250"), "vaso": ("closed", "1 - closed"),
}
SCORE_VARS = ["temp_max_pre72", "gcs_total_48_72h", "fio2_48_72h", "sofa_like_48_72h", "price"]


def _vital_units(spark, folder):
    """Units with old vitals, repaired ones beside them, and what the organ scores read."""
    return stage_border(
        ft.add_organ_scores(
            ro.units(spark, folder).withColumns(
                {c: F.expr(old) for c, (old, _) in VITALS.items()} | {f"new_{c}": F.expr(new) for c, (_, new) in VITALS.items()}
                | {c: F.expr(e) for k, both in ORGANS.items() for c, e in zip(ORGAN_INPUTS[k], both)} | {"vent_proc": F.col("building")}
            )
        )
    )


def _organ_sql(tag: str, i: int, gcs: str) -> str:
    names = {"creatinine": "creat", "platelet": "plate", "bilirubin": "bili", "map": "map", "spo2": "spo2", "urine": "urine", "vaso": "vaso"}
    inputs = ", ".join(f"{ORGANS[k][i]} AS {n}" for k, n in names.items())
    return f"(SELECT {_score_sql('')} FROM (SELECT {inputs}, building AS vent, {gcs} AS gcs))"


_old = ", ".join(f"{old} AS old_{c}" for c, (old, _) in VITALS.items())
_new = ", ".join(f"{new} AS raw_{c}" for c, (_, new) in VITALS.items())
_filled = ", ".join(f"coalesce(raw_{c}, (SELECT median(raw_{c}) FROM vital_raw)) AS new_{c}" for c in VITALS)
VITAL_UNITS_SQL = f"""vital_raw AS MATERIALIZED (SELECT *, {_old}, {_new} FROM units),
vital_units AS MATERIALIZED (SELECT *, {_organ_sql("48_72h", 1, "old_gcs_total_48_72h")} AS old_sofa_like_48_72h, {_organ_sql("48_72h", 1, "new_gcs_total_48_72h")} AS new_sofa_like_48_72h
  FROM (SELECT *, {_filled} FROM vital_raw))"""
WHOLE = ("temperature", "gcs", "fio2")
OF_PART = {"temp_max_pre72": "temperature", "gcs_total_48_72h": "gcs", "sofa_like_48_72h": "gcs", "fio2_48_72h": "fio2"}
SCENARIOS = {
    "A_original": ((), ()), "B_temperature_only": (("temperature",), ()), "C_temperature_plus_gcs": (("temperature", "gcs"), ()),
    "D_temperature_plus_fio2": (("temperature", "fio2"), ()), "E_all_corrected": (WHOLE, ()), "F_all_corrected_exclude_fio2_ps": (WHOLE, ("fio2",)),
    "G_all_corrected_exclude_gcs_ps": (WHOLE, ("gcs_total",)), "H_all_corrected_exclude_gcs_fio2_ps": (WHOLE, ("fio2", "gcs_total")),
}


def _scenario_sql(parts, gone) -> tuple[str, list[str]]:
    kept = [v for v in SCORE_VARS if not any(v.startswith(g) for g in gone)]
    columns = ", ".join(f"{'new' if OF_PART[v] in parts else 'old'}_{v}::DOUBLE AS {v}" for v in OF_PART)
    return f"(SELECT unit, A, y, price, {columns} FROM vital_units)", kept


def _about(source: str, names: list[str]) -> dict[str, tuple[str, bool]]:
    return {v: (f"{v} - (SELECT avg({v}) FROM {source})", False) for v in names}


_made = {k: _scenario_sql(*v) for k, v in SCENARIOS.items()}
ABLATION_SQL = ro.with_sql(
    ro.UNITS_SQL, VITAL_UNITS_SQL, *[f"s_{k[0]} AS MATERIALIZED {source}" for k, (source, _) in _made.items()],
    *[score(f"s_{k[0]}", kept, [], name=f"w_{k[0]}") for k, (_, kept) in _made.items()],
)


@query("ablation", "M31", ABLATION_SQL + " UNION ALL ".join(summary_sql(k, f"w_{k[0]}", _about(f"s_{k[0]}", kept)) for k, (_, kept) in _made.items()))
def ablation(spark, folder):
    return _summary(sh.vital_ablation(_vital_units(spark, folder), SCORE_VARS, "y"))


REFIT = {"original": "A_original", "vital_corrected": "E_all_corrected"}


@query(
    "vital_refit",
    "C34 M31",
    ro.with_sql(
        ro.UNITS_SQL, VITAL_UNITS_SQL, *[f"s_{k[0]} AS MATERIALIZED {_made[k][0]}" for k in REFIT.values()],
        *[score(f"s_{k[0]}", SCORE_VARS, [], name=f"w_{k[0]}") for k in REFIT.values()],
    )
    + " UNION ALL ".join(summary_sql(label, f"w_{k[0]}", _about(f"s_{k[0]}", SCORE_VARS)) for label, k in REFIT.items()),
)
def vital_refit(spark, folder):
    return _summary(sh.repair_study(_vital_units(spark, folder), SCORE_VARS, ["unit"], "y", ["comparison"])["comparison"])


@query(
    "vital_refit_weights",
    "C34",
    ro.with_sql(ro.UNITS_SQL, VITAL_UNITS_SQL, f"s_E AS MATERIALIZED {_made['E_all_corrected'][0]}", score("s_E", SCORE_VARS, [], name="w_E"))
    + "SELECT unit, round(ps_den, 6) AS ps_den, round(pn, 6) AS ps_num, round(SW_A, 6) AS SW_A FROM w_E, (SELECT avg(A) AS pn FROM s_E)",
)
def vital_refit_weights(spark, folder):
    df = sh.repair_study(_vital_units(spark, folder), SCORE_VARS, ["unit"], "y", ["weighted_cohort"])["weighted_cohort"]
    return df.select("unit", *[F.round(c, 6).alias(c) for c in ("ps_den", "ps_num", "SW_A")])
