"""Anchors, clocks, landmark rules, interval overlap and treatment classes over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..operators import cohort as co
from ..operators import intervals as iv
from ..operators.features import add_treatment_intensity
from . import roles as ro
from .registry import query

MEDS = ro.meds_sql()
HIT = "m.coverage_start < p.analysis_time0 AND m.coverage_stop > p.decision_time"


@query(
    "anchor_first_event",
    "A1 C3 J15 O4",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + f"""SELECT p.subject, {ro.stamp_sql('min(m.starttime)')} AS anchor_time,
          {ro.stamp_sql('min(m.starttime) + INTERVAL 72 HOUR')} AS decision_time,
          {ro.stamp_sql('min(m.starttime) + INTERVAL 96 HOUR')} AS analysis_time0
    FROM people p JOIN meds m ON m.subject = p.subject
    WHERE m.is_broad AND m.starttime >= p.first_time - INTERVAL 6 HOUR AND m.starttime <= p.first_time + INTERVAL 720 HOUR
    GROUP BY p.subject""",
)
def anchor_first_event(spark, folder):
    people = ro.people(spark, folder).select("subject", "first_time")
    events = ro.meds(spark, folder).where("is_broad").select("subject", "starttime")
    found = co.first_anchor(events, people, "subject", "starttime", "first_time", 6, 720)
    out = co.add_clocks(found, "anchor_time")
    return out.select("subject", *[ro.stamp(c).alias(c) for c in ("anchor_time", "decision_time", "analysis_time0")])


def _flow(spark, folder):
    people, meds = ro.people(spark, folder), ro.meds(spark, folder)
    got = co.classify_treatment(people, meds, "subject", lookback_hours=24 * 24)
    steps = {
        "customers with orders": F.lit(True),
        "positive balance": F.col("c_acctbal") > 0,
        "active after the landmark": co.after_landmark("last_time", "analysis_time0", null_passes=False),
        "covered before the decision": F.col("has_prior_coverage") == 1,
    }
    return co.attrition(got, steps, {"deescalated or stopped": F.col("A") == 1, "continued": F.col("A") == 0})


FLOW_SQL = (
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + f""", pre AS (SELECT DISTINCT p.subject FROM people p JOIN meds m USING (subject)
         WHERE m.is_broad AND m.coverage_start < p.decision_time AND m.coverage_stop > p.decision_time - INTERVAL 24 DAY),
    post AS (SELECT DISTINCT p.subject FROM people p JOIN meds m USING (subject) WHERE m.is_broad AND {HIT}),
    f AS (SELECT p.*, p.c_acctbal > 0 AS s1, p.last_time > p.analysis_time0 AS s2,
                 p.subject IN (SELECT subject FROM pre) AS s3, p.subject IN (SELECT subject FROM post) AS post_broad FROM people p),
    flow AS (
      SELECT 0 AS stage, 'customers with orders' AS step, count(*) AS n FROM f
      UNION ALL SELECT 1, 'positive balance', count(*) FILTER (WHERE s1) FROM f
      UNION ALL SELECT 2, 'active after the landmark', count(*) FILTER (WHERE s1 AND s2) FROM f
      UNION ALL SELECT 3, 'covered before the decision', count(*) FILTER (WHERE s1 AND s2 AND s3) FROM f
      UNION ALL SELECT 4, 'deescalated or stopped', count(*) FILTER (WHERE s1 AND s2 AND s3 AND NOT post_broad) FROM f
      UNION ALL SELECT 5, 'continued', count(*) FILTER (WHERE s1 AND s2 AND s3 AND post_broad) FROM f)
    """
)


@query("attrition_flow", "C32 P13 C10 J7 C5", FLOW_SQL + "SELECT stage, step, n FROM flow")
def attrition_flow(spark, folder):
    return _flow(spark, folder)


@query(
    "attrition_losses",
    "W5",
    FLOW_SQL
    + """SELECT stage, step, n, CAST(CASE WHEN lag(n) OVER w >= n THEN lag(n) OVER w - n END AS DOUBLE) AS excluded_from_previous,
         round(n * 100.0::DOUBLE / first_value(n) OVER w, 6) AS percent_of_first
         FROM flow WINDOW w AS (ORDER BY stage)""",
)
def attrition_losses(spark, folder):
    out = co.attrition_losses(_flow(spark, folder))
    return out.withColumns(
        {"percent_of_first": ro.r("percent_of_first"), "excluded_from_previous": F.col("excluded_from_previous").cast("double")}
    )


@query(
    "landmark_strict_vs_lenient",
    "P14 C5 C4 M27",
    ro.with_sql(ro.PEOPLE_SQL)
    + """SELECT count(*) AS n_all,
         count(*) FILTER (WHERE CAST(last_time AS DATE) > CAST(analysis_time0 AS DATE)) AS n_strict,
         count(*) FILTER (WHERE CAST(last_time AS DATE) >= CAST(analysis_time0 AS DATE)) AS n_lenient
       FROM people""",
)
def landmark_strict_vs_lenient(spark, folder):
    last, mark = F.to_date("last_time"), F.to_date("analysis_time0")
    return ro.people(spark, folder).agg(
        F.count("*").alias("n_all"),
        F.count_if(co.after_landmark(last, mark)).alias("n_strict"),
        F.count_if(co.after_landmark(last, mark, strict=False)).alias("n_lenient"),
    )


@query(
    "landmark_date_ambiguity",
    "C33",
    """SELECT count(*) AS anchored,
              count(*) FILTER (WHERE CAST(lst AS DATE) = CAST(mn + INTERVAL 96 DAY AS DATE)) AS discharge_on_landmark_date,
              count(*) FILTER (WHERE CAST(o_orderdate AS DATE) = CAST(mn + INTERVAL 96 DAY AS DATE)) AS death_on_landmark_date
       FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS mn, max(o_orderdate) OVER (PARTITION BY o_custkey) AS lst FROM orders)""",
)
def landmark_date_ambiguity(spark, folder):
    order = ro.table(spark, folder, "orders")
    span = order.groupBy("o_custkey").agg(F.min("o_orderdate").alias("mn"), F.max("o_orderdate").alias("lst"))
    rows = order.join(span, "o_custkey").withColumns({"discharge": F.to_date("lst"), "death": F.to_date("o_orderdate")})
    return co.landmark_ambiguity(rows, F.to_date(clocks.plus("mn", days=96)), "discharge", "death")


@query(
    "cohort_provenance",
    "C35 A19",
    f"""SELECT count(*) AS n_subjects, CAST(sum(k) AS BIGINT) AS n_encounters, count(*) FILTER (WHERE k > 1) AS n_subjects_repeated,
        max(k) AS max_encounters, {ro.stamp_sql('min(lo)')} AS first_start, {ro.stamp_sql('max(hi)')} AS last_start
    FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS k, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1)""",
)
def cohort_provenance(spark, folder):
    out = co.provenance(ro.table(spark, folder, "orders"), "o_custkey", "o_orderkey", "o_orderdate")
    return out.withColumns({c: ro.stamp(c) for c in ("first_start", "last_start")})


@query(
    "master_entities",
    "C1 J1 J2 W3 O3",
    f"""SELECT c.c_custkey AS subject, n.n_name AS nation, f.o_orderkey AS first_order, {ro.stamp_sql('f.o_orderdate')} AS first_time,
        f.o_orderpriority AS first_priority
    FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1) f
      ON f.o_custkey = c.c_custkey""",
)
def master_entities(spark, folder):
    order = ro.table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    first = co.first_row(order, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    cust, nation = ro.table(spark, folder, "customer"), ro.table(spark, folder, "nation")
    return (
        cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("subject"), F.col("n_name").alias("nation"), F.col("o_orderkey").alias("first_order"),
            ro.stamp("o_orderdate").alias("first_time"), F.col("o_orderpriority").alias("first_priority"),
        )
    )


@query(
    "last_row_per_group",
    "W4 O3",
    f"""SELECT o_custkey AS subject, o_orderkey AS last_order, {ro.stamp_sql('o_orderdate')} AS last_time FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def last_row_per_group(spark, folder):
    order = ro.table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    last = co.last_row(order, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("last_order"), ro.stamp("o_orderdate").alias("last_time")
    )


@query(
    "coverage_prepare",
    "F4 C2",
    ro.with_sql(MEDS)
    + f"""SELECT order_id, line, code, {ro.stamp_sql('coverage_start')} AS coverage_start, {ro.stamp_sql('coverage_stop')} AS coverage_stop,
       missing_stop_assumed, count(*) AS n FROM meds GROUP BY ALL""",
)
def coverage_prepare(spark, folder):
    keys = ["order_id", "line", "code", "coverage_start", "coverage_stop", "missing_stop_assumed"]
    out = ro.meds(spark, folder).groupBy(*keys).agg(F.count("*").alias("n"))
    return out.withColumns({c: ro.stamp(c) for c in ("coverage_start", "coverage_stop")})


@query(
    "overlap_halfopen",
    "J3",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + f"SELECT p.subject, count(*) AS n_events, count(DISTINCT m.order_id) AS n_orders FROM people p JOIN meds m USING (subject) WHERE {HIT} GROUP BY 1",
)
def overlap_halfopen(spark, folder):
    meds = ro.meds(spark, folder).select("subject", "order_id", "coverage_start", "coverage_stop")
    rows = iv.overlap_join(meds, ro.people(spark, folder), "subject", "decision_time", "analysis_time0")
    return rows.groupBy("subject").agg(F.count("*").alias("n_events"), F.countDistinct("order_id").alias("n_orders"))


@query(
    "overlap_closed_dates",
    "J4 A9",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + """SELECT p.subject, max(CASE WHEN m.is_broad AND CAST(m.coverage_start AS DATE) <= CAST(p.analysis_time0 AS DATE)
             AND CAST(m.coverage_stop AS DATE) >= CAST(p.decision_time AS DATE) THEN 1 ELSE 0 END) AS broad,
           max(CASE WHEN m.is_any AND NOT m.is_broad AND CAST(m.coverage_start AS DATE) <= CAST(p.analysis_time0 AS DATE)
             AND CAST(m.coverage_stop AS DATE) >= CAST(p.decision_time AS DATE) THEN 1 ELSE 0 END) AS other
         FROM people p LEFT JOIN meds m USING (subject) GROUP BY 1""",
)
def overlap_closed_dates(spark, folder):
    hit = iv.overlaps(
        F.to_date("coverage_start"), F.to_date("coverage_stop"), F.to_date("decision_time"), F.to_date("analysis_time0"), "both"
    )
    flags = {"broad": F.col("is_broad") & hit, "other": F.col("is_any") & ~F.col("is_broad") & hit}
    people = ro.people(spark, folder).select("subject", "decision_time", "analysis_time0")
    out = iv.overlap_profile(ro.meds(spark, folder), people, "subject", flags, window_cols=["decision_time", "analysis_time0"])
    return out.select("subject", "broad", "other")


@query(
    "overlap_mixed",
    "J5",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + """SELECT p.subject, max(CASE WHEN m.is_broad AND m.coverage_start < p.analysis_time0 AND m.coverage_stop >= p.decision_time THEN 1 ELSE 0 END) AS broad
         FROM people p LEFT JOIN meds m USING (subject) GROUP BY 1""",
)
def overlap_mixed(spark, folder):
    hit = iv.overlaps("coverage_start", "coverage_stop", "decision_time", "analysis_time0", "stop")
    people = ro.people(spark, folder).select("subject", "decision_time", "analysis_time0")
    out = iv.overlap_profile(
        ro.meds(spark, folder), people, "subject", {"broad": F.col("is_broad") & hit}, window_cols=["decision_time", "analysis_time0"]
    )
    return out.select("subject", "broad")


PRE = "m.coverage_start < p.decision_time AND m.coverage_stop > p.first_time"
PRE_H = ro.hours_sql("greatest(m.coverage_start, p.first_time)", "least(m.coverage_stop, p.decision_time)")


@query(
    "overlap_hours_agents",
    "A5 A6 C23",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + f"""SELECT p.subject, round(coalesce(sum(CASE WHEN m.is_any AND {PRE} THEN {PRE_H} END), 0), 4) AS systemic_hours,
         round(coalesce(sum(CASE WHEN m.is_broad AND {PRE} THEN {PRE_H} END), 0), 4) AS broad_hours,
         count(DISTINCT CASE WHEN m.is_any AND {PRE} THEN trim(regexp_replace(m.drug_lower, '\\s+', ' ', 'g')) END) AS systemic_agents,
         count(DISTINCT CASE WHEN m.is_broad AND {PRE} THEN trim(regexp_replace(m.drug_lower, '\\s+', ' ', 'g')) END) AS broad_agents,
         coalesce(max(CASE WHEN m.is_broad AND {PRE} AND regexp_matches(m.drug_lower, 'red|blue') THEN 1 ELSE 0 END), 0) AS class_colour,
         coalesce(max(CASE WHEN m.is_any AND {PRE} AND regexp_matches(m.drug_lower, 'small|large') THEN 1 ELSE 0 END), 0) AS class_size
       FROM people p LEFT JOIN meds m USING (subject) GROUP BY 1""",
)
def overlap_hours_agents(spark, folder):
    people = ro.people(spark, folder).select("subject", "first_time", "decision_time")
    out = add_treatment_intensity(
        people, ro.meds(spark, folder), "subject", "first_time", "decision_time",
        classes={"class_colour": "red|blue"}, any_classes={"class_size": "small|large"},
    )
    return out.select(
        "subject", ro.r("systemic_abx_hours_pre72", 4).alias("systemic_hours"), ro.r("broad_abx_hours_pre72", 4).alias("broad_hours"),
        F.col("systemic_abx_agents_pre72").alias("systemic_agents"), F.col("broad_abx_agents_pre72").alias("broad_agents"),
        "class_colour", "class_size",
    )


def classes_sql(meds: str = "meds") -> str:
    hours = ro.hours_sql("greatest(m.coverage_start, p.decision_time)", "least(m.coverage_stop, p.analysis_time0)")
    return f"""classes_{meds} AS (
      SELECT g.*, CASE WHEN A = 0 THEN '{lx.CONTINUED}' WHEN has_any_systemic_72_96 = 1 THEN '{lx.NARROWED}' ELSE '{lx.STOPPED}' END AS deescalation_type
      FROM (SELECT p.subject, 1 - max(CASE WHEN m.is_broad AND {HIT} THEN 1 ELSE 0 END) AS A,
              max(CASE WHEN m.is_any AND {HIT} THEN 1 ELSE 0 END) AS has_any_systemic_72_96,
              coalesce(sum(CASE WHEN m.is_broad AND {HIT} THEN {hours} END), 0) AS broad_overlap_hours_72_96
            FROM people p LEFT JOIN {meds} m USING (subject) GROUP BY 1) g)"""


@query(
    "treatment_classes",
    "C8",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, classes_sql())
    + """SELECT subject, A, has_any_systemic_72_96, deescalation_type, round(broad_overlap_hours_72_96, 4) AS broad_overlap_hours_72_96
         FROM classes_meds""",
)
def treatment_classes(spark, folder):
    people = ro.people(spark, folder).select("subject", "decision_time", "analysis_time0")
    out = co.classify_treatment(people, ro.meds(spark, folder), "subject")
    return out.select(
        "subject", "A", "has_any_systemic_72_96", "deescalation_type", ro.r("broad_overlap_hours_72_96", 4).alias("broad_overlap_hours_72_96")
    )


@query(
    "subtype_descriptives",
    "M33",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, classes_sql())
    + """SELECT deescalation_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent,
           round(avg(p.n_orders), 6) AS mean_orders FROM classes_meds JOIN people p USING (subject) GROUP BY 1""",
)
def subtype_descriptives(spark, folder):
    people = ro.people(spark, folder)
    got = co.classify_treatment(people, ro.meds(spark, folder), "subject")
    from ..operators.reports import group_profile

    out = group_profile(got, "deescalation_type", {"mean_orders": F.avg("n_orders")})
    return out.select("deescalation_type", "n", ro.r("percent").alias("percent"), ro.r("mean_orders").alias("mean_orders"))


@query(
    "require_prior_coverage",
    "C10 J7",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + """SELECT p.subject FROM people p WHERE EXISTS (SELECT 1 FROM meds m WHERE m.subject = p.subject AND m.is_broad
         AND m.coverage_start < p.decision_time AND m.coverage_stop > p.decision_time - INTERVAL 24 DAY)""",
)
def require_prior_coverage(spark, folder):
    people = ro.people(spark, folder).select("subject", "decision_time")
    out = co.prior_coverage(people, ro.meds(spark, folder), "subject", lookback_hours=24 * 24)
    return out.where("has_prior_coverage = 1").select("subject")


@query(
    "washout_exclusion",
    "C11 J8 U1",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + """SELECT p.subject FROM people p WHERE NOT EXISTS (SELECT 1 FROM meds m WHERE m.subject = p.subject AND m.is_any
         AND m.coverage_start < p.decision_time AND m.coverage_stop > p.decision_time - INTERVAL 6 DAY)""",
)
def washout_exclusion(spark, folder):
    people = ro.people(spark, folder).withColumn("washout_from", clocks.plus("decision_time", days=-6))
    meds = ro.meds(spark, folder).where("is_any").select("subject", "coverage_start", "coverage_stop")
    active = iv.overlap_join(meds, people, "subject", "washout_from", "decision_time").select("subject").distinct()
    return people.join(active, "subject", "left_anti").select("subject")


@query(
    "early_late_windows",
    "C11 C12",
    ro.with_sql(MEDS, ro.PEOPLE_SQL)
    + f"""SELECT subject, any_pre, early, late, CASE WHEN early = 1 AND late = 0 THEN 1 ELSE 0 END AS stopped, round(least(hours, 72), 4) AS hours FROM (
        SELECT p.subject, max(CASE WHEN m.is_broad AND {PRE} THEN 1 ELSE 0 END) AS any_pre,
          max(CASE WHEN m.is_broad AND m.coverage_start < p.first_time + INTERVAL 24 HOUR AND m.coverage_stop > p.first_time THEN 1 ELSE 0 END) AS early,
          max(CASE WHEN m.is_broad AND m.coverage_start < p.decision_time AND m.coverage_stop > p.decision_time - INTERVAL 24 HOUR THEN 1 ELSE 0 END) AS late,
          coalesce(sum(CASE WHEN m.is_broad AND {PRE} THEN {PRE_H} END), 0) AS hours
        FROM people p LEFT JOIN meds m USING (subject) GROUP BY 1)""",
)
def early_late_windows(spark, folder):
    people = ro.people(spark, folder).select("subject", "first_time", "decision_time").withColumn("seen_from", F.col("first_time"))
    meds = ro.meds(spark, folder).where("is_broad").select("subject", "coverage_start", "coverage_stop")
    out = co.vasopressor_profile(people, meds, "subject", admitted="seen_from", anchor="first_time")
    return out.select(
        "subject", F.col("vasopressor_any_pre72").alias("any_pre"), F.col("vasopressor_any_0_24h").alias("early"),
        F.col("vasopressor_any_48_72h").alias("late"), F.col("vasopressor_stopped_before_72h").alias("stopped"),
        ro.r("vasopressor_hours_pre72", 4).alias("hours"),
    )


@query(
    "stop_fill_sensitivity",
    "M25",
    " UNION ALL ".join(
        f"SELECT * FROM ({ro.with_sql(ro.meds_sql(d), ro.PEOPLE_SQL, classes_sql())}"
        f"""SELECT {d} AS fill_days, count(*) AS n, CAST(sum(A) AS BIGINT) AS treated,
            count(*) FILTER (WHERE deescalation_type = '{lx.NARROWED}') AS narrowed FROM classes_meds
            WHERE subject IN (SELECT p.subject FROM people p JOIN meds m USING (subject) WHERE m.is_broad
              AND m.coverage_start < p.decision_time AND m.coverage_stop > p.decision_time - INTERVAL 24 DAY))"""
        for d in (12, 24, 48)
    ),
)
def stop_fill_sensitivity(spark, folder):
    people = ro.people(spark, folder).select("subject", "decision_time", "analysis_time0")
    got = co.classify_by_fill(people, ro.meds(spark, folder), "subject", [24 * d for d in (12, 24, 48)], lookback_hours=24 * 24)
    out = got.where("has_prior_coverage = 1").groupBy("fill_hours").agg(
        F.count("*").alias("n"), F.sum("A").alias("treated"), F.count_if(F.col("deescalation_type") == lx.NARROWED).alias("narrowed")
    )
    return out.select((F.col("fill_hours") / 24).cast("int").alias("fill_days"), "n", "treated", "narrowed")


def _groups(spark, folder, source):
    people = ro.people(spark, folder).select("subject", F.to_date("decision_time").alias("lo"), F.to_date("analysis_time0").alias("hi"))
    meds = ro.meds(spark, folder).where(F.col("source") == source)
    meds = meds.withColumns({"d0": F.to_date("coverage_start"), "d1": F.to_date("coverage_stop")})
    got = co.exposure_groups(people, meds, "subject", F.col("is_broad"), F.col("is_any") & ~F.col("is_broad"), "d0", "d1", "lo", "hi")
    return got.select("subject", F.col("exposure_group"))


def groups_sql(source: str, name: str) -> str:
    hit = "CAST(m.coverage_start AS DATE) <= CAST(p.analysis_time0 AS DATE) AND CAST(m.coverage_stop AS DATE) >= CAST(p.decision_time AS DATE)"
    return f"""{name} AS (SELECT subject, CASE WHEN b = 1 THEN 'continued_broad' WHEN nb = 1 THEN 'deescalated_narrowed_nonbroad' ELSE 'deescalated_stopped_all' END AS g
      FROM (SELECT p.subject, max(CASE WHEN m.is_broad AND {hit} THEN 1 ELSE 0 END) AS b,
                   max(CASE WHEN m.is_any AND NOT m.is_broad AND {hit} THEN 1 ELSE 0 END) AS nb
            FROM people p LEFT JOIN (SELECT * FROM meds WHERE source = '{source}') m USING (subject) GROUP BY 1))"""


@query(
    "exposure_groups_dates",
    "C9",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, groups_sql("O", "a")) + "SELECT g AS exposure_group, count(*) AS n FROM a GROUP BY 1",
)
def exposure_groups_dates(spark, folder):
    return _groups(spark, folder, "O").groupBy("exposure_group").agg(F.count("*").alias("n"))


@query(
    "reclass_matrix",
    "Q17 A12 J20",
    ro.with_sql(MEDS, ro.PEOPLE_SQL, groups_sql("O", "a"), groups_sql("F", "b"))
    + """SELECT a.g AS order_group, b.g AS admin_group, count(*) AS n, CASE WHEN count(*) < 11 THEN 1 ELSE 0 END AS suppressed,
           CAST(a.g = b.g AS INTEGER) AS agree FROM a JOIN b USING (subject) GROUP BY ALL""",
)
def reclass_matrix(spark, folder):
    from ..operators.audits import crosstab_counts

    a = _groups(spark, folder, "O").withColumnRenamed("exposure_group", "order_group")
    b = _groups(spark, folder, "F").withColumnRenamed("exposure_group", "admin_group")
    out = crosstab_counts(a.join(b, "subject", "left"), "order_group", "admin_group")
    return out.withColumns(
        {"suppressed": (F.col("n") < 11).cast("int"), "agree": (F.col("order_group") == F.col("admin_group")).cast("int")}
    )
