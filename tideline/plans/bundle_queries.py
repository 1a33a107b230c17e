"""The date-level covariate bundle and its attrition over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import cohort as co
from ..session import stage_border
from . import roles as ro
from . import site_date as sd
from .registry import query
from .weight_queries import VARIANTS_SQL

#: Which code an event is charted under, by its type; both engines read these.
LAB_OF = {"view": "2524-7", "click": "2160-0", "purchase": "777-3", "error": "1975-2", "signup": "6690-2"}
OBS_OF = {"view": "8867-4", "click": "59408-5", "purchase": "8310-5", "error": "9279-1"}
DX = "CASE o_orderpriority WHEN '1-URGENT' THEN 'I50.9' WHEN '2-HIGH' THEN 'n18.3' WHEN '3-MEDIUM' THEN '250.00' WHEN '5-LOW' THEN 'C50' ELSE 'Z00' END"
SEX = "CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN ' male ' END"
RACE = "CASE c_custkey % 3 WHEN 0 THEN '05' WHEN 1 THEN '03' ELSE 'White' END"


def _case(of: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + " END"


def _raw(spark, folder):
    """All sources of the date-level site; times are seconds since midnight."""
    first = ro.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.to_date(F.min("o_orderdate")).alias("adm"))
    keys = [F.col("subject").cast("string").alias("PATID"), F.concat(F.lit("e"), F.col("subject").cast("string")).alias("ENCOUNTERID")]
    cust = ro.table(spark, folder, "customer")
    orders = ro.table(spark, folder, "orders").join(first, F.col("o_custkey") == F.col("subject"))
    events = ro.table(spark, folder, "events").join(first, F.col("user_id") == F.col("subject"))
    seconds = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("string")
    when = [F.date_add("adm", (F.col("event_id") % 5).cast("int")).cast("string").alias("d"), seconds.alias("s"), F.col("value").cast("string").alias("v")]
    charted = events.select(*keys, F.expr(_case(LAB_OF)).alias("lab"), F.expr(_case(OBS_OF)).alias("obs"), F.when(F.col("event_id") % 2 == 0, "F").alias("u"), *when)
    return ro.date_site(spark, folder) | {
        "demographic": cust.select(
            F.col("c_custkey").cast("string").alias("PATID"), F.date_add(F.lit("1930-01-01").cast("date"), (F.col("c_custkey") * 37 % 20000).cast("int")).cast("string").alias("BIRTH_DATE"),
            F.expr(SEX).alias("SEX"), F.expr(RACE).alias("RACE"),
        ),
        "diagnosis": orders.select(*keys, F.expr(DX).alias("DX")),
        "lab": charted.select("PATID", "ENCOUNTERID", F.col("lab").alias("LAB_LOINC"), F.col("v").alias("RESULT_NUM"), F.col("d").alias("SPECIMEN_DATE"), F.col("s").alias("SPECIMEN_TIME")),
        "obs": charted.where("obs is not null").select(
            "PATID", "ENCOUNTERID", F.col("obs").alias("OBSCLIN_CODE"), F.col("v").alias("OBSCLIN_RESULT_NUM"), F.col("u").alias("OBSCLIN_RESULT_UNIT"), F.col("d").alias("OBSCLIN_START_DATE"),
            F.col("s").alias("OBSCLIN_START_TIME"),
        ),
        "vital": orders.select(
            *keys, (90 + F.col("o_orderkey") % 100).cast("string").alias("SYSTOLIC"), (40 + F.col("o_orderkey") % 50).cast("string").alias("DIASTOLIC"),
            F.date_add("adm", (F.col("o_orderkey") % 4).cast("int")).cast("string").alias("MEASURE_DATE"), (F.col("o_orderkey") * 7 % 86400).cast("string").alias("MEASURE_TIME"),
        ),
    }


EARLY, LATE = "ts >= anchor AND ts < anchor + INTERVAL 24 HOUR", "ts >= anchor + INTERVAL 48 HOUR AND ts < anchor + INTERVAL 72 HOUR"
WINDOWS = {"0_24h": EARLY, "48_72h": LATE}


def _measured(concept: str, code: str, value: str, lo: float, hi: float, kind: str) -> str:
    out = []
    for tag, when in WINDOWS.items():
        ok = f"{code} AND {value} BETWEEN {lo} AND {hi} AND {when}"
        pick = f"arg_max({value}, (ts, {value})) FILTER (WHERE {ok})" if kind == "last" else f"{kind}(CASE WHEN {ok} THEN {value} END)"
        out.append(f"{pick} AS {concept}_{tag}")
    return ", ".join(out)


_labs = ", ".join(_measured(c, f"lab IN ({', '.join(repr(x) for x in codes)})", "v", lo, hi, kind) for c, (codes, lo, hi, kind) in lx.SITE_B_LABS.items())
_celsius = "CASE WHEN u = 'F' THEN (v - 32.0) * 5.0 / 9.0 ELSE v END"
_vitals = ", ".join(_measured(c, f"obs = '{code}'", f"({_celsius})" if c == "temperature" else "v", lo, hi, kind) for c, (code, lo, hi, kind) in lx.SITE_B_VITALS.items())
CONCEPTS = [*lx.SITE_B_LABS, *lx.SITE_B_VITALS, "map"]
BUNDLE_SQL = f"""strict AS (SELECT * FROM landmarks WHERE is_strict),
charted AS (SELECT s.subject, anchor, {_case(LAB_OF)} AS lab, {_case(OBS_OF)} AS obs, CASE WHEN event_id % 2 = 0 THEN 'F' END AS u, value AS v,
  s.adm + CAST(event_id % 5 AS INTEGER) + to_seconds(extract(hour FROM e.ts) * 3600 + extract(minute FROM e.ts) * 60 + CAST(floor(extract(second FROM e.ts)) AS BIGINT)) AS ts FROM events e JOIN strict s ON s.subject = e.user_id),
labs_ AS (SELECT subject, {_labs}, {_vitals} FROM charted GROUP BY 1),
pressures AS (SELECT subject, anchor, (90 + o_orderkey % 100 + 2 * (40 + o_orderkey % 50)) / 3.0::DOUBLE AS v, s.adm + CAST(o_orderkey % 4 AS INTEGER) + to_seconds(o_orderkey * 7 % 86400) AS ts FROM orders JOIN strict s ON s.subject = o_custkey),
maps AS (SELECT subject, {_measured("map", "TRUE", "v", 20, 200, "min")} FROM pressures GROUP BY 1),
dx AS (SELECT subject, {", ".join(f"max(CASE WHEN regexp_matches(upper(regexp_replace({DX}, '[^A-Z0-9]', '', 'g')), '{p}') THEN 1 ELSE 0 END) AS {k}" for k, p in lx.ICD_PREFIXES.items())} FROM orders JOIN strict ON subject = o_custkey GROUP BY 1),
doses AS (SELECT s.subject, max(CASE WHEN g.sd < anchor + INTERVAL 24 HOUR AND e > anchor THEN 1 ELSE 0 END) AS early, max(CASE WHEN g.sd < anchor + INTERVAL 72 HOUR AND e > anchor + INTERVAL 48 HOUR THEN 1 ELSE 0 END) AS late
  FROM strict s JOIN (SELECT subject, sd, CASE WHEN l_linenumber % 2 = 0 THEN sd + 1 + INTERVAL 86399 SECOND ELSE sd + INTERVAL 1 HOUR END AS e FROM given WHERE lower(drug_name) LIKE '%norepinephrine%') g USING (subject) GROUP BY 1)"""
ROUNDED = [f"{c}_{p}" for c in CONCEPTS for p in ("0_24h", "48_72h", "delta")]


@query(
    "date_site_bundle",
    "C31 P16 F7",
    ro.with_sql(ro.DRUG_LINES_SQL, ro.DATE_SITE_SQL, VARIANTS_SQL, BUNDLE_SQL)
    + f"""SELECT s.subject::VARCHAR AS patid, round((s.adm - (DATE '1930-01-01' + CAST(s.subject * 37 % 20000 AS INTEGER))) / 365.25::DOUBLE, 6) AS age,
      CASE WHEN upper(trim({SEX})) IN ('M', 'MALE', '1') THEN 1 ELSE 0 END AS sex_male, CASE WHEN upper(trim({RACE})) IN ('05', 'WHITE') THEN 1 ELSE 0 END AS race_white,
      greatest({", ".join(lx.ICD_PREFIXES)}) AS comorb, heart_failure, chronic_kidney, coalesce(doses.early, 0) AS vasopressor_any_0_24h, coalesce(doses.late, 0) AS vasopressor_any_48_72h,
      CASE WHEN coalesce(doses.early, 0) = 1 AND coalesce(doses.late, 0) = 0 THEN 1 ELSE 0 END AS vasopressor_stopped_before_72h,
      {", ".join(f"round({c}_{t}, 6) AS {c}_{t}" for c in CONCEPTS for t in WINDOWS)}, {", ".join(f"round({c}_48_72h - {c}_0_24h, 6) AS {c}_delta" for c in CONCEPTS)}
    FROM strict s JOIN customer ON c_custkey = s.subject LEFT JOIN labs_ USING (subject) LEFT JOIN maps USING (subject) LEFT JOIN dx USING (subject) LEFT JOIN doses USING (subject)""",
)
def date_site_bundle(spark, folder):
    t = sd.canonical_tables(_raw(spark, folder))
    cfg = sd.DateConfig()
    rx = sd.prescriptions(t, cfg)
    cohort = stage_border(sd.landmark_cohort(t, rx, cfg))
    out = sd.add_covariates(cohort, t)
    return out.select("patid", F.round("age", 6).alias("age"), *sd.BINARY, *[F.round(c, 6).alias(c) for c in ROUNDED])


@query(
    "date_site_flow",
    "C32 C33 P14",
    ro.with_sql(ro.DRUG_LINES_SQL, ro.DATE_SITE_SQL, VARIANTS_SQL)
    + f"""SELECT unnest([{", ".join(repr(s) for s in sd.FLOW_STEPS)}]) AS step, unnest(range({len(sd.FLOW_STEPS)}))::INTEGER AS stage,
      unnest([(SELECT count(*) FROM firsts), (SELECT count(*) FROM anchors), (SELECT count(*) FROM anchors JOIN encounter e USING (subject) WHERE e.dis IS NULL OR e.dis > CAST(anchor + INTERVAL 96 HOUR AS DATE)),
        (SELECT count(*) FROM variants WHERE is_strict), (SELECT count(*) FROM variants WHERE is_strict AND A_order = 1), (SELECT count(*) FROM variants WHERE is_strict AND A_order = 0)]) AS n""",
)
def date_site_flow(spark, folder):
    return sd.flow_table(ro.date_site(spark, folder))


@query(
    "date_site_losses",
    "W5 C32",
    ro.with_sql(ro.DRUG_LINES_SQL, ro.DATE_SITE_SQL, VARIANTS_SQL)
    + """, f AS (SELECT 0 AS stage, count(*) AS n FROM firsts UNION ALL SELECT 1, count(*) FROM anchors UNION ALL SELECT 2, count(*) FROM anchors JOIN encounter e USING (subject) WHERE e.dis IS NULL OR e.dis > CAST(anchor + INTERVAL 96 HOUR AS DATE)
        UNION ALL SELECT 3, count(*) FROM variants WHERE is_strict)
      SELECT stage, n, CAST(CASE WHEN lag(n) OVER w >= n THEN lag(n) OVER w - n END AS DOUBLE) AS excluded_from_previous, round(n * 100.0::DOUBLE / first_value(n) OVER w, 6) AS percent_of_first FROM f WINDOW w AS (ORDER BY stage)""",
)
def date_site_losses(spark, folder):
    flow = sd.flow_table(ro.date_site(spark, folder)).where("stage < 4").select("stage", "n")
    out = co.attrition_losses(flow)
    return out.withColumns({"percent_of_first": F.round("percent_of_first", 6), "excluded_from_previous": F.col("excluded_from_previous").cast("double")})
