"""The study roles (medications, labs, cohort, units, ...) played by the given tables.

Each Spark builder has the same definition as the SQL fragment next to it; the fragments are
``WITH`` entries for the comparison SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phenotype
from ..operators.cohort import add_clocks
from ..operators.intervals import prepare_coverage

# Fixed values of the role mapping.
BROAD_NAMES = "ring|bolt|gear"
DAY = 24
DECISION_DAYS, LANDMARK_DAYS = 72, 96


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def meds(spark: SparkSession, folder: str, fill_days: int = 24) -> DataFrame:
    """Interval events per customer: lines of orders with the part as drug."""
    line, order, part = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    route = F.when(F.col("l_returnflag") == "R", "iv").when(F.col("l_returnflag") == "A", "po").otherwise("inhal")
    days = F.make_dt_interval(F.col("l_quantity").cast("int"))
    rows = (
        line.join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("subject"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_shipdate").alias("starttime"),
            F.when(F.col("l_linenumber") % 5 != 0, F.col("l_shipdate") + days).alias("stoptime"),
            F.lower("p_name").alias("drug_lower"),
            route.alias("route_lower"),
            F.col("p_partkey").alias("code"),
            F.lower("p_type").alias("form"),
            F.col("l_linestatus").alias("source"),
        )
    )
    rows = prepare_coverage(rows, fill_hours=fill_days * DAY, minimum_hours=1)
    return rows.withColumns(
        {
            "is_broad": phenotype.broad_systemic("drug_lower", "route_lower", BROAD_NAMES, ("iv", "po")),
            "is_any": phenotype.any_systemic("drug_lower", "route_lower", "."),
        }
    )


def meds_sql(fill_days: int = 24, name: str = "meds") -> str:
    return f"""
{name}_raw AS (
  SELECT o.o_custkey AS subject, l.l_orderkey AS order_id, l.l_linenumber AS line, l.l_shipdate AS starttime,
         CASE WHEN l.l_linenumber % 5 = 0 THEN NULL
              ELSE l.l_shipdate + to_days(CAST(l.l_quantity AS INTEGER)) END AS stoptime,
         lower(p.p_name) AS drug_lower,
         CASE l.l_returnflag WHEN 'R' THEN 'iv' WHEN 'A' THEN 'po' ELSE 'inhal' END AS route_lower,
         p.p_partkey AS code, lower(p.p_type) AS form, l.l_linestatus AS source
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
),
{name} AS (
  SELECT *, starttime AS coverage_start,
         CASE WHEN coalesce(stoptime, starttime + INTERVAL {fill_days} DAY) <= starttime
              THEN starttime + INTERVAL 1 HOUR
              ELSE coalesce(stoptime, starttime + INTERVAL {fill_days} DAY) END AS coverage_stop,
         CASE WHEN stoptime IS NULL THEN 1 ELSE 0 END AS missing_stop_assumed,
         (regexp_matches(drug_lower, '{BROAD_NAMES}') AND route_lower IN ('iv', 'po')) AS is_broad,
         (route_lower <> 'inhal') AS is_any
  FROM {name}_raw
)"""


def people(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with orders: first order, decision and landmark, last order as exit."""
    order, cust = table(spark, folder, "orders"), table(spark, folder, "customer")
    clock = order.groupBy(F.col("o_custkey").alias("subject")).agg(
        F.min("o_orderdate").alias("first_time"),
        F.max("o_orderdate").alias("last_time"),
        F.count("*").alias("n_orders"),
    )
    out = add_clocks(clock, "first_time", DECISION_DAYS * DAY, LANDMARK_DAYS * DAY)
    return out.join(
        cust.select(F.col("c_custkey").alias("subject"), "c_nationkey", "c_acctbal", "c_mktsegment"), "subject"
    )


PEOPLE_SQL = f"""
people AS (
  SELECT k.*, c.c_nationkey, c.c_acctbal, c.c_mktsegment FROM (
    SELECT o_custkey AS subject, min(o_orderdate) AS first_time, max(o_orderdate) AS last_time, count(*) AS n_orders,
           min(o_orderdate) + INTERVAL {DECISION_DAYS} DAY AS decision_time,
           min(o_orderdate) + INTERVAL {LANDMARK_DAYS} DAY AS analysis_time0
    FROM orders GROUP BY 1) k
  JOIN customer c ON c.c_custkey = k.subject
)"""


def labs(spark: SparkSession, folder: str) -> DataFrame:
    """Point events: the event stream, concept = event type."""
    return table(spark, folder, "events").select(
        F.col("event_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("concept"),
        F.col("ts").alias("charttime"), F.col("value").alias("valuenum"),
    )


LABS_SQL = """
labs AS (SELECT event_id, user_id AS subject, event_type AS concept, ts AS charttime, value AS valuenum FROM events)"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user with a signup: anchor, decision (+9 d), landmark (+12 d)."""
    anchor = (
        labs(spark, folder).where(F.col("concept") == "signup").groupBy("subject").agg(F.min("charttime").alias("anchor_time"))
    )
    return add_clocks(anchor, "anchor_time", 9 * DAY, 12 * DAY)


USERS_SQL = """
users AS (
  SELECT user_id AS subject, min(ts) AS anchor_time, min(ts) + INTERVAL 9 DAY AS decision_time,
         min(ts) + INTERVAL 12 DAY AS analysis_time0
  FROM events WHERE event_type = 'signup' GROUP BY 1
)"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Laboratory result rows: order lines, the part noun deciding what kind of row it is."""
    line, order, part = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    noun = F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2))
    kind = (
        F.when((noun == "ring") & (F.col("p_size") % 5 == 0), "AFB stool culture")
        .when((noun == "widget") & (F.col("p_size") % 3 == 0), "Sputum culture")
        .when((noun == "plate") & (F.col("p_size") % 3 == 0), "Fungal fluid culture")
        .when(noun == "ring", "blood culture").when(noun == "widget", "urine culture").when(noun == "plate", "wound culture")
        .when(noun == "bolt", "organism identification").when(noun == "gear", "susceptibility panel")
        .when(noun == "gizmo", "gram stain").otherwise(F.concat(F.lit("other "), noun))
    )
    qual = F.when(F.col("l_returnflag") == "R", "Positive").when(F.col("l_returnflag") == "A", "Negative")
    raw = (
        F.when(F.col("l_suppkey") % 5 == 0, "no growth to date").when(F.col("l_suppkey") % 5 == 1, "growth of organism isolated")
        .when(F.col("l_suppkey") % 5 == 2, "normal skin flora").when(F.col("l_suppkey") % 5 == 3, F.col("l_suppkey").cast("string"))
        .otherwise(F.lit(None))
    )
    joined = line.join(
        order.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(part.select("p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("o_custkey").alias("patid"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey")).alias("encounterid"),
        F.concat(F.lower("p_type"), F.lit("|"), kind).alias("raw_lab_name"),
        F.col("p_size").alias("loinc"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("specimen_source"),
        F.to_date("o_orderdate").alias("specimen_date"),
        F.when(F.col("l_suppkey") % 6 != 0, (F.col("l_suppkey") % 24).cast("int")).alias("specimen_time"),
        F.to_date("o_orderdate").alias("order_date"),
        F.date_add(F.to_date("o_orderdate"), (F.col("l_partkey") % 10).cast("int")).alias("result_date"),
        qual.alias("result_qual"),
        raw.alias("raw_result"),
    )


RESULTS_SQL = """
results AS (
  SELECT o.o_custkey AS patid, CASE WHEN l.l_orderkey % 7 <> 0 THEN l.l_orderkey END AS encounterid,
         lower(p.p_type) || '|' || CASE WHEN split_part(lower(p.p_name), ' ', 2) = 'ring' AND p.p_size % 5 = 0 THEN 'AFB stool culture'
           WHEN split_part(lower(p.p_name), ' ', 2) = 'widget' AND p.p_size % 3 = 0 THEN 'Sputum culture'
           WHEN split_part(lower(p.p_name), ' ', 2) = 'plate' AND p.p_size % 3 = 0 THEN 'Fungal fluid culture'
           ELSE CASE split_part(lower(p.p_name), ' ', 2)
           WHEN 'ring' THEN 'blood culture' WHEN 'widget' THEN 'urine culture' WHEN 'plate' THEN 'wound culture'
           WHEN 'bolt' THEN 'organism identification' WHEN 'gear' THEN 'susceptibility panel'
           WHEN 'gizmo' THEN 'gram stain' ELSE 'other ' || split_part(lower(p.p_name), ' ', 2) END END AS raw_lab_name,
         p.p_size AS loinc, CASE WHEN p.p_size % 4 <> 0 THEN p.p_type END AS specimen_source,
         CAST(o.o_orderdate AS DATE) AS specimen_date,
         CASE WHEN l.l_suppkey % 6 <> 0 THEN CAST(l.l_suppkey % 24 AS INTEGER) END AS specimen_time,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(o.o_orderdate AS DATE) + CAST(l.l_partkey % 10 AS INTEGER) AS result_date,
         CASE l.l_returnflag WHEN 'R' THEN 'Positive' WHEN 'A' THEN 'Negative' END AS result_qual,
         CASE l.l_suppkey % 5 WHEN 0 THEN 'no growth to date' WHEN 1 THEN 'growth of organism isolated'
              WHEN 2 THEN 'normal skin flora' WHEN 3 THEN CAST(l.l_suppkey AS VARCHAR) END AS raw_result
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
)"""


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Weighting units: orders with treatment, covariates (some missing) and outcomes."""
    order, cust, line = (table(spark, folder, n) for n in ("orders", "customer", "lineitem"))
    outcome = line.groupBy("l_orderkey").agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"), F.sum("l_quantity").alias("yc")
    )
    return (
        order.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(outcome, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("unit"),
            F.col("o_custkey").alias("subject"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("A"),
            F.col("o_totalprice").alias("price"),
            (F.col("o_orderstatus") == "F").cast("int").alias("closed"),
            F.when(F.col("o_custkey") % 10 != 0, F.col("c_acctbal")).alias("balance"),
            (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"),
            F.coalesce("y", F.lit(0)).alias("y"),
            F.coalesce("yc", F.lit(0.0)).alias("yc"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderdate").alias("start"),
        )
    )


UNITS_SQL = """
outcome AS (
  SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, sum(l_quantity) AS yc
  FROM lineitem GROUP BY 1
),
units AS (
  SELECT o.o_orderkey AS unit, o.o_custkey AS subject,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS A,
         o.o_totalprice AS price, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed,
         CASE WHEN o.o_custkey % 10 <> 0 THEN c.c_acctbal END AS balance,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS building,
         coalesce(q.y, 0) AS y, coalesce(q.yc, 0.0) AS yc, o.o_orderpriority AS priority, o.o_orderdate AS start
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN outcome q ON q.l_orderkey = o.o_orderkey
)"""


# Real drug names, routes and codes by the noun of the part, its return flag and its number; both engines read these.
DRUG_NAME = """CASE split_part(lower(p_name), ' ', 2) WHEN 'ring' THEN 'Vancomycin 1 g vial' WHEN 'bolt' THEN 'Zosyn 3.375 g' WHEN 'gear' THEN 'Cefepime inj'
  WHEN 'anvil' THEN 'ceftazidime-avibactam' WHEN 'plate' THEN 'Ceftriaxone 2 g' WHEN 'widget' THEN 'Vancomycin oral solution' WHEN 'gizmo' THEN 'Norepinephrine 4 mg' ELSE p_name END"""
DRUG_ROUTE = "CASE l_returnflag WHEN 'R' THEN 'IV' WHEN 'A' THEN CASE WHEN l_linenumber % 3 = 0 THEN ' Oral ' ELSE 'INTRAVENOUS' END ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'INHALATION' END END"
DRUG_CODE = "CASE p_partkey % 11 WHEN 0 THEN '11124' WHEN 1 THEN '29561' WHEN 2 THEN '313570' WHEN 3 THEN ' 33533 ' WHEN 4 THEN NULL ELSE 'x' END"


def drug_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with a real drug name, route and code."""
    line, order, part = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    rows = line.join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")
    )
    return rows.select(
        F.col("o_custkey").alias("subject"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_linestatus",
        F.expr(DRUG_NAME).alias("drug_name"), F.expr(DRUG_ROUTE).alias("drug_route"), F.expr(DRUG_CODE).alias("drug_code"),
    )


DRUG_LINES_SQL = f"""
drug_lines AS (
  SELECT o.o_custkey AS subject, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_linestatus, {DRUG_NAME} AS drug_name, {DRUG_ROUTE} AS drug_route, {DRUG_CODE} AS drug_code
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
)"""


def date_site(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The date-level site played by customers: dates near their first order."""
    first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.to_date(F.min("o_orderdate")).alias("adm"))
    keys = [F.col("subject").cast("string").alias("PATID"), F.concat(F.lit("e"), F.col("subject").cast("string")).alias("ENCOUNTERID")]
    n = F.col("subject")
    day = lambda base, days: F.date_add(base, days.cast("int"))
    lines = drug_lines(spark, folder).join(first, "subject")
    ordered = lines.withColumn("od", day(F.col("adm"), F.col("l_orderkey") % 16))
    begun = ordered.withColumn("sd", F.when(F.col("l_linenumber") % 3 != 0, day(F.col("od"), F.col("l_linenumber") % 3)))
    given = lines.where("l_linestatus = 'O'").withColumn("sd", day(F.col("adm"), F.col("l_suppkey") % 8))
    text = lambda c, name: c.cast("string").alias(name)
    return {
        "encounter": first.select(*keys, text(F.col("adm"), "ADMIT_DATE"), text(F.when(n % 7 != 0, day(F.col("adm"), 4 + n % 23)), "DISCHARGE_DATE")),
        "death": first.where("subject % 6 = 0").select(keys[0], text(day(F.col("adm"), n % 45), "DEATH_DATE")),
        "prescribing": begun.select(
            *keys, text(F.col("od"), "RX_ORDER_DATE"), F.lit("08:30").alias("RX_ORDER_TIME"), text(F.col("sd"), "RX_START_DATE"),
            text(F.when(F.col("l_linenumber") % 4 != 0, day(F.coalesce("sd", "od"), F.col("l_quantity") % 2)), "RX_END_DATE"),
            F.col("drug_name").alias("RAW_RX_MED_NAME"), F.col("drug_code").alias("RXNORM_CUI"), F.col("drug_route").alias("RX_ROUTE"),
        ),
        "med_admin": given.select(
            *keys, text(F.col("sd"), "MEDADMIN_START_DATE"), text(F.when(F.col("l_linenumber") % 2 == 0, day(F.col("sd"), F.lit(1))), "MEDADMIN_STOP_DATE"),
            F.col("drug_name").alias("RAW_MEDADMIN_MED_NAME"), F.col("drug_code").alias("MEDADMIN_CODE"), F.col("drug_route").alias("MEDADMIN_ROUTE"),
        ),
    }


DATE_SITE_SQL = """
firsts AS MATERIALIZED (SELECT o_custkey AS subject, CAST(min(o_orderdate) AS DATE) AS adm FROM orders GROUP BY 1),
encounter AS (SELECT subject, adm, CASE WHEN subject % 7 <> 0 THEN adm + CAST(4 + subject % 23 AS INTEGER) END AS dis, CASE WHEN subject % 6 = 0 THEN adm + CAST(subject % 45 AS INTEGER) END AS died FROM firsts),
ordered AS (SELECT l.*, f.adm, adm + CAST(l_orderkey % 16 AS INTEGER) AS od FROM drug_lines l JOIN firsts f USING (subject)),
begun AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN od + CAST(l_linenumber % 3 AS INTEGER) END AS sd FROM ordered),
given AS (SELECT l.*, f.adm, adm + CAST(l_suppkey % 8 AS INTEGER) AS sd FROM drug_lines l JOIN firsts f USING (subject) WHERE l_linestatus = 'O')"""


def stamp(c):
    """Timestamps leave the queries as text, equal in every engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def hours_sql(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 3600000000.0::DOUBLE)"


def days_sql(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 86400000000.0::DOUBLE)"


def r(c, digits: int = 6):
    return F.round(c, digits)


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
