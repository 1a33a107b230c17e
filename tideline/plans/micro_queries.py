"""Two-clock eligibility, culture classes and record linkage over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import lexicon as lx
from ..functions.text import flag, prefix_before, text
from ..operators import audits as au
from ..operators import linkage as lk
from ..operators import micro as mi
from ..operators import phenotype as ph
from ..session import stage_border
from ..sources import tables
from . import roles as ro
from .registry import query


# Two-clock rows: specimen = order date, result = ship date, organism = returned lines.
def _micro(spark, folder):
    line, order, part = (ro.table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    rows = (
        line.join(order.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("subject"),
            F.col("o_orderdate").alias("specimen_time"),
            F.when(F.col("l_linenumber") % 6 != 0, F.col("l_shipdate")).alias("result_available_time"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" "), F.col("p_type"))).otherwise("").alias("org_name"),
            F.lower("p_name").alias("spec_type_desc_lower"),
            F.lower("p_type").alias("test_name_lower"),
        )
    )
    patterns = {"screen": "hot|screen", "non_culture": "promo", "culture": "economy|standard|promo", "specimen": "ring|gear", "flora": "economy"}
    return mi.classify(rows, patterns=patterns)


MICRO = """micro_raw AS (
  SELECT o.o_custkey AS subject, o.o_orderdate AS specimen_time, CASE WHEN l.l_linenumber % 6 <> 0 THEN l.l_shipdate END AS result_available_time,
    CASE WHEN l.l_returnflag = 'R' THEN ' ' || p.p_type ELSE '' END AS org_name, lower(p.p_name) AS spec, lower(p.p_type) AS test
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
micro AS (SELECT *, regexp_matches(spec || ' ' || test, 'hot|screen') AS scr, regexp_matches(test, 'promo') AS nonc,
    regexp_matches(test, 'economy|standard|promo') AS cul, trim(org_name) <> '' AS grown FROM micro_raw),
people AS (SELECT o_custkey AS subject, min(o_orderdate) AS first_broad_time, min(o_orderdate) + INTERVAL 360 DAY AS decision_time FROM orders GROUP BY 1),
win AS (SELECT m.*, p.decision_time FROM micro m JOIN people p USING (subject)
  WHERE m.specimen_time >= p.first_broad_time - INTERVAL 24 HOUR AND m.specimen_time <= p.decision_time AND NOT scr)"""
FLAGS = """flags AS (SELECT p.subject, max(CASE WHEN w.subject IS NOT NULL THEN 1 ELSE 0 END) AS is_sampled,
  max(CASE WHEN grown AND result_available_time <= w.decision_time THEN 1 ELSE 0 END) AS is_positive_by_decision,
  max(CASE WHEN grown THEN 1 ELSE 0 END) AS is_positive_eventually,
  max(CASE WHEN grown AND w.subject IS NOT NULL AND result_available_time IS NULL THEN 1 ELSE 0 END) AS is_positive_no_result_time,
  max(CASE WHEN cul AND NOT nonc THEN 1 ELSE 0 END) AS is_strict_sampled,
  max(CASE WHEN cul AND NOT nonc AND grown AND result_available_time <= w.decision_time THEN 1 ELSE 0 END) AS is_strict_positive_by_decision
  FROM people p LEFT JOIN win w USING (subject) GROUP BY 1)"""


def _people(spark, folder):
    clock = ro.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.min("o_orderdate").alias("first_broad_time"))
    return clock.withColumn("decision_time", clocks.plus("first_broad_time", days=360))


@query(
    "micro_categories",
    "C6",
    f"""WITH {MICRO} SELECT
      CASE WHEN scr THEN 'screen_or_surveillance_excluded' WHEN nonc THEN 'non_culture_test_excluded_from_strict_sensitivity'
           WHEN NOT cul THEN 'clinical_record_test_name_not_culture' ELSE 'strict_test_name_culture_included' END AS micro_category,
      CASE WHEN scr THEN 'screen_or_surveillance' WHEN nonc THEN 'non_culture_diagnostic_test'
           WHEN NOT cul THEN 'test_name_not_culture' ELSE 'not_excluded_from_strict_culture' END AS strict_culture_exclusion_reason,
      count(*) AS n, count(*) FILTER (WHERE NOT scr AND grown) AS n_positive,
      count(*) FILTER (WHERE NOT scr AND grown AND NOT regexp_matches(lower(org_name), 'economy')) AS n_positive_no_flora,
      count(*) FILTER (WHERE regexp_matches(spec, 'ring|gear')) AS n_clinical_specimen,
      count(*) FILTER (WHERE NOT scr AND grown AND result_available_time IS NULL) AS n_positive_no_time
    FROM micro GROUP BY ALL""",
)
def micro_categories(spark, folder):
    return _micro(spark, folder).groupBy("micro_category", "strict_culture_exclusion_reason").agg(
        F.count("*").alias("n"),
        F.sum("positive_clinical_culture").alias("n_positive"),
        F.sum("positive_clinical_culture_no_flora").alias("n_positive_no_flora"),
        F.sum("clinical_specimen_type").alias("n_clinical_specimen"),
        F.sum("result_time_missing_for_positive_row").alias("n_positive_no_time"),
    )


@query(
    "two_clock_eligibility",
    "C7 U1 F5",
    f"""WITH {MICRO}, {FLAGS} SELECT *, CASE WHEN is_sampled = 1 AND is_positive_by_decision = 0 THEN 1 ELSE 0 END AS is_eligible,
      CASE WHEN is_strict_sampled = 1 AND is_strict_positive_by_decision = 0 THEN 1 ELSE 0 END AS is_strict_eligible,
      CASE WHEN is_sampled = 1 AND is_positive_eventually = 0 THEN 1 ELSE 0 END AS is_eventually_negative FROM flags""",
)
def two_clock_eligibility(spark, folder):
    return mi.eligibility_flags(_micro(spark, folder), _people(spark, folder), "subject").drop("first_broad_time", "decision_time")


@query(
    "set_sizes",
    "U2",
    f"""WITH {MICRO}, {FLAGS}
    SELECT 'sampled' AS metric, CAST(sum(is_sampled) AS BIGINT) AS n_entities FROM flags
    UNION ALL SELECT 'positive_available_by_72', CAST(sum(is_positive_by_decision) AS BIGINT) FROM flags
    UNION ALL SELECT 'positive_eventual', CAST(sum(is_positive_eventually) AS BIGINT) FROM flags
    UNION ALL SELECT 'positive_missing_result_time', CAST(sum(is_positive_no_result_time) AS BIGINT) FROM flags
    UNION ALL SELECT 'strict_sampled', CAST(sum(is_strict_sampled) AS BIGINT) FROM flags
    UNION ALL SELECT 'strict_positive_available_by_72', CAST(sum(is_strict_positive_by_decision) AS BIGINT) FROM flags
    UNION ALL SELECT 'strict_eligible', count(*) FILTER (WHERE is_strict_sampled = 1 AND is_strict_positive_by_decision = 0) FROM flags
    UNION ALL SELECT 'eventual_culture_negative', count(*) FILTER (WHERE is_sampled = 1 AND is_positive_eventually = 0) FROM flags""",
)
def set_sizes(spark, folder):
    return mi.set_sizes(mi.eligibility_flags(_micro(spark, folder), _people(spark, folder), "subject"))


SITES = {"blood_culture_pre72": "ring", "urine_culture_pre72": "plate|widget"}


@query(
    "diagnostic_intensity",
    "C24 A7",
    f"""WITH {MICRO} SELECT p.subject, count(w.subject) AS micro_records_pre72,
      count(*) FILTER (WHERE w.subject IS NOT NULL AND cul AND NOT nonc) AS strict_culture_records_pre72, count(DISTINCT w.spec) AS distinct_specimen_types_pre72,
      coalesce(max(CASE WHEN w.specimen_time >= p.decision_time - INTERVAL 24 HOUR AND w.specimen_time <= p.decision_time THEN 1 ELSE 0 END), 0) AS repeat_micro_48_72h,
      coalesce(max(CASE WHEN regexp_matches(w.spec || ' ' || w.test, 'csf|cerebrospinal|pleural|peritoneal|synovial|fluid|tissue|wound') THEN 1 ELSE 0 END), 0) AS sterile_fluid_culture_pre72
    FROM people p LEFT JOIN win w USING (subject) GROUP BY 1""",
)
def diagnostic_intensity(spark, folder):
    out = mi.diagnostic_intensity(_micro(spark, folder), _people(spark, folder), "subject")
    return out.select(
        "subject", "micro_records_pre72", "strict_culture_records_pre72", "distinct_specimen_types_pre72", "repeat_micro_48_72h",
        "sterile_fluid_culture_pre72",
    )


# ---- linkage over laboratory result rows ----
def _results(spark, folder):
    """Result rows as a stage table, with what the linkage queries ask of their names."""
    blank = (F.trim(text("raw_result")) == "") & (F.trim(text("result_qual")) == "")
    facts = {"is_culture": ph.culture_row("raw_lab_name"), "followup_type": ph.followup_type("raw_lab_name"), "has_nonblank_result": flag(~blank)}
    return stage_border(ro.results(spark, folder).withColumns(facts))


def _cultures(rows, groups=lx.LINKAGE_CULTURE_GROUPS):
    cultures = rows.where("is_culture").dropna(subset=["patid", "specimen_date"])
    return cultures.withColumns(
        {"culture_group": ph.culture_group("raw_lab_name", groups), "specimen_source": F.coalesce("specimen_source", F.lit(lk.MISSING))}
    )


def _linkage_rows(spark, folder, groups=lx.LINKAGE_CULTURE_GROUPS):
    # Cultures and three follow-up levels read one staged scan.
    rows = _results(spark, folder)
    follow = rows.where(F.col("followup_type").isNotNull()).withColumn("specimen_source", F.coalesce("specimen_source", F.lit(lk.MISSING)))
    return _cultures(rows, groups), follow


def cultures_sql(groups):
    cases = " ".join(f"WHEN regexp_matches(lower(raw_lab_name), '{p}') THEN '{g}'" for g, p in groups.items())
    return f"""cultures AS (SELECT patid, encounterid, specimen_date, specimen_time, order_date, result_qual, raw_result, raw_lab_name, loinc,
    coalesce(specimen_source, '<MISSING>') AS specimen_source,
    CASE {cases} ELSE 'other_culture' END AS culture_group
  FROM results WHERE raw_lab_name LIKE '%culture%' AND raw_lab_name NOT LIKE 'ua w culture if ind.%' AND raw_lab_name NOT LIKE '%culture if indicated%')"""


CULTURES, POSITIVITY_CULTURES = cultures_sql(lx.LINKAGE_CULTURE_GROUPS), cultures_sql(lx.CULTURE_GROUPS)
FOLLOW = """follow AS (SELECT *, CASE WHEN raw_lab_name LIKE '%susceptib%' THEN 'susceptibility_or_mic' ELSE 'organism_or_identification' END AS followup_type,
    coalesce(specimen_source, '<MISSING>') AS source2,
    CASE WHEN trim(coalesce(raw_result, '')) <> '' OR trim(coalesce(result_qual, '')) <> '' THEN 1 ELSE 0 END AS has_nonblank_result
  FROM results WHERE raw_lab_name LIKE '%organism%' OR raw_lab_name LIKE '%susceptib%')"""
WITHIN = "f.patid = c.patid AND f.result_date BETWEEN c.specimen_date AND c.specimen_date + {k}"
SAME = " AND f.encounterid = c.encounterid"
RULE_SQL = {
    "patient_only_0_7d": WITHIN.format(k=7),
    "patient_encounter_exact_0_7d": WITHIN.format(k=7) + SAME,
    "patient_encounter_exact_0_7d_nonblank": WITHIN.format(k=7) + SAME + " AND f.has_nonblank_result = 1",
    "patient_encounter_same_day": WITHIN.format(k=0) + SAME,
    "patient_encounter_0_1d": WITHIN.format(k=1) + SAME,
    "patient_encounter_0_2d": WITHIN.format(k=2) + SAME,
    "patient_encounter_0_7d_specimen_match": WITHIN.format(k=7) + SAME + " AND f.source2 = c.specimen_source AND c.specimen_source <> '<MISSING>'",
    "patient_encounter_0_2d_specimen_match": WITHIN.format(k=2) + SAME + " AND f.source2 = c.specimen_source AND c.specimen_source <> '<MISSING>'",
}
UNIT = "(c.patid, c.encounterid, c.specimen_date, c.culture_group, c.specimen_source)"
UNIT_COLS = ["patid", "encounterid", "specimen_date", "culture_group", "specimen_source"]


@query(
    "linkage_rules",
    "J11 Q15 A14",
    ro.with_sql(ro.RESULTS_SQL, CULTURES, FOLLOW)
    + " UNION ALL ".join(
        f"""SELECT '{rule}' AS linkage_rule, count(DISTINCT {UNIT}) AS linked_units,
          count(DISTINCT CASE WHEN f.followup_type = 'organism_or_identification' THEN {UNIT} END) AS organism_units,
          count(DISTINCT CASE WHEN f.followup_type = 'susceptibility_or_mic' THEN {UNIT} END) AS susceptibility_units
        FROM cultures c JOIN follow f ON {cond}"""
        for rule, cond in RULE_SQL.items()
    ),
)
def linkage_rules(spark, folder):
    return lk.rule_totals(lk.linked_units(*_linkage_rows(spark, folder), UNIT_COLS))


@query(
    "linkage_rule_detail",
    "J11 U5 Q15",
    ro.with_sql(ro.RESULTS_SQL, CULTURES, FOLLOW)
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS linkage_rule, c.culture_group, f.followup_type, count(DISTINCT {UNIT}) AS n FROM cultures c JOIN follow f ON {cond} GROUP BY ALL"
        for rule, cond in RULE_SQL.items()
    ),
)
def linkage_rule_detail(spark, folder):
    return lk.rule_detail(lk.linked_units(*_linkage_rows(spark, folder), UNIT_COLS), "culture_group")


@query(
    "linkage_completeness",
    "U6 Q23",
    ro.with_sql(ro.RESULTS_SQL, CULTURES, FOLLOW)
    + """SELECT 'culture' AS row_type, count(*) AS n_rows, count(*) FILTER (WHERE encounterid IS NULL) AS encounter_missing, count(*) FILTER (WHERE specimen_source = '<MISSING>') AS source_missing FROM cultures
       UNION ALL SELECT 'followup', count(*), count(*) FILTER (WHERE encounterid IS NULL), count(*) FILTER (WHERE source2 = '<MISSING>') FROM follow""",
)
def linkage_completeness(spark, folder):
    parts = dict(zip(("culture", "followup"), _linkage_rows(spark, folder)))
    rows = [
        df.agg(
            F.lit(name).alias("row_type"), F.count("*").alias("n_rows"), F.count_if(F.col("encounterid").isNull()).alias("encounter_missing"),
            F.count_if(F.col("specimen_source") == lk.MISSING).alias("source_missing"),
        )
        for name, df in parts.items()
    ]
    return rows[0].unionByName(rows[1])


NEG = lx.NEGATIVE_TEXT
POS = lx.POSITIVE_TEXT
DIRECT = f"""CASE WHEN upper(trim(coalesce(result_qual, ''))) IN ('NEGATIVE', 'NOT DETECTED', 'NO GROWTH') OR regexp_matches(lower(trim(coalesce(raw_result, ''))), '{NEG}') THEN 'direct_negative'
  WHEN upper(trim(coalesce(result_qual, ''))) IN ('POSITIVE', 'PRESUMPTIVE POSITIVE', 'DETECTED', 'PRESENT') OR regexp_matches(lower(trim(coalesce(raw_result, ''))), '{POS}') THEN 'direct_positive'
  ELSE 'direct_unresolved' END"""
FOUND = "EXISTS (SELECT 1 FROM follow f WHERE " + WITHIN.format(k=7) + SAME + " AND {cond})"


@query(
    "exists_flags",
    "J9 Q14 P18",
    ro.with_sql(ro.RESULTS_SQL, POSITIVITY_CULTURES, FOLLOW)
    + f"""SELECT culture_group, direct_class, has_followup_signal, has_organism_signal, has_susceptibility_signal, count(*) AS n FROM (
      SELECT c.culture_group, {DIRECT} AS direct_class,
        CAST({FOUND.format(cond=f"f.has_nonblank_result = 1 AND NOT regexp_matches(lower(trim(coalesce(f.raw_result, ''))), '{NEG}')")} AS INTEGER) AS has_followup_signal,
        CAST({FOUND.format(cond="f.followup_type = 'organism_or_identification'")} AS INTEGER) AS has_organism_signal,
        CAST({FOUND.format(cond="f.followup_type = 'susceptibility_or_mic'")} AS INTEGER) AS has_susceptibility_signal
      FROM cultures c) GROUP BY ALL""",
)
def exists_flags(spark, folder):
    cultures, follow = _linkage_rows(spark, folder, lx.CULTURE_GROUPS)
    cultures = cultures.withColumn("direct_class", ph.direct_result("result_qual", "raw_result"))
    clean = ~F.lower(F.trim(text("raw_result"))).rlike(NEG)
    facts = {
        "has_followup_signal": (F.col("has_nonblank_result") == 1) & clean,
        "has_organism_signal": F.col("followup_type") == lk.TYPES["organism"],
        "has_susceptibility_signal": F.col("followup_type") == lk.TYPES["susceptibility"],
    }
    out = lk.exists_flags(cultures, follow, ["patid", "encounterid"], "result_date", 7, facts)
    return out.groupBy("culture_group", "direct_class", *facts).agg(F.count("*").alias("n"))


@query(
    "exists_null_tolerant",
    "J10",
    ro.with_sql(ro.RESULTS_SQL, POSITIVITY_CULTURES, FOLLOW)
    + f"""SELECT culture_group, count(*) AS culture_rows, CAST(sum(hit) AS BIGINT) AS rows_with_followup FROM (
      SELECT c.culture_group, CAST(EXISTS (SELECT 1 FROM follow f WHERE {WITHIN.format(k=7)}
        AND (f.encounterid = c.encounterid OR c.encounterid IS NULL OR f.encounterid IS NULL)) AS INTEGER) AS hit FROM cultures c) GROUP BY 1""",
)
def exists_null_tolerant(spark, folder):
    cultures, follow = _linkage_rows(spark, folder, lx.CULTURE_GROUPS)
    out = lk.exists_null_tolerant(cultures, follow, "patid", "encounterid", "result_date", 7, "hit")
    return out.groupBy("culture_group").agg(F.count("*").alias("culture_rows"), F.sum("hit").alias("rows_with_followup"))


SIBLING = """CASE WHEN l.raw_lab_name LIKE '%susceptib%' THEN 'susceptibility_or_mic' WHEN l.raw_lab_name LIKE '%organism%' THEN 'organism_or_identification'
  WHEN l.raw_lab_name LIKE '%gram stain%' THEN 'gram_stain' ELSE 'other_lab' END"""


def _siblings(rows):
    return rows.where("NOT is_culture").withColumns(
        {
            "sibling_class": ph.sibling_class("raw_lab_name"),
            "loinc": F.coalesce(F.col("loinc").cast("string"), F.lit(lk.MISSING)),
            "result_qual": F.coalesce("result_qual", F.lit(lk.MISSING)),
            "specimen_source": F.coalesce("specimen_source", F.lit(lk.MISSING)),
            "panel_prefix": prefix_before("raw_lab_name"),
        }
    )


@query(
    "sibling_components",
    "J12 A14",
    ro.with_sql(ro.RESULTS_SQL, CULTURES)
    + f""", u AS (SELECT DISTINCT patid, encounterid, specimen_date, culture_group FROM cultures WHERE encounterid IS NOT NULL),
      s AS (SELECT DISTINCT u.*, l.loinc, l.raw_lab_name, coalesce(l.specimen_source, '<MISSING>') AS src, coalesce(l.result_qual, '<MISSING>') AS rq,
              CASE WHEN trim(coalesce(l.raw_result, '')) <> '' THEN 1 ELSE 0 END AS present, {SIBLING} AS sibling_class,
              date_diff('day', u.specimen_date, l.result_date) AS day_offset
            FROM u JOIN results l ON l.patid = u.patid AND l.encounterid = u.encounterid AND l.result_date BETWEEN u.specimen_date AND u.specimen_date + 2
            WHERE NOT (l.raw_lab_name LIKE '%culture%'))
      SELECT culture_group, sibling_class, CAST(day_offset AS INTEGER) AS day_offset, count(*) AS n,
        count(DISTINCT (patid, encounterid, specimen_date, culture_group)) AS units_with_component, CAST(sum(present) AS BIGINT) AS rows_with_raw_result
      FROM s GROUP BY ALL""",
)
def sibling_components(spark, folder):
    results = _results(spark, folder)
    cultures = _cultures(results)
    units = cultures.dropna(subset=["encounterid"]).select("patid", "encounterid", "specimen_date", "culture_group").distinct()
    return lk.sibling_counts(
        units, _siblings(results), ["patid", "encounterid"], "culture_group", "sibling_class",
        ["loinc", "raw_lab_name", "specimen_source", "result_qual"], F.trim(text("raw_result")) != "",
    )


@query(
    "panel_prefix_link",
    "J13 F15",
    ro.with_sql(ro.RESULTS_SQL, CULTURES)
    + f""", u AS (SELECT DISTINCT patid, encounterid, specimen_date, culture_group, lower(trim(split_part(raw_lab_name, '|', 1))) AS prefix FROM cultures WHERE encounterid IS NOT NULL),
      s AS (SELECT DISTINCT u.*, l.loinc, l.raw_lab_name, coalesce(l.result_qual, '<MISSING>') AS rq,
              CASE WHEN trim(coalesce(l.raw_result, '')) <> '' THEN 1 ELSE 0 END AS present, {SIBLING} AS component_class, date_diff('day', u.specimen_date, l.result_date) AS day_offset
            FROM u JOIN results l ON l.patid = u.patid AND l.encounterid = u.encounterid AND l.result_date BETWEEN u.specimen_date AND u.specimen_date + 2
              AND lower(trim(split_part(l.raw_lab_name, '|', 1))) = u.prefix
            WHERE u.prefix <> '' AND NOT (l.raw_lab_name LIKE '%culture%'))
      SELECT culture_group, component_class, CAST(day_offset AS INTEGER) AS day_offset, count(*) AS n,
        count(DISTINCT (patid, encounterid, specimen_date, culture_group, prefix)) AS units_with_component, CAST(sum(present) AS BIGINT) AS rows_with_raw_result
      FROM s GROUP BY ALL""",
)
def panel_prefix_link(spark, folder):
    results = _results(spark, folder)
    cultures = _cultures(results)
    units = (
        cultures.dropna(subset=["encounterid"]).withColumn("panel_prefix", prefix_before("raw_lab_name")).where("panel_prefix <> ''")
        .select("patid", "encounterid", "specimen_date", "culture_group", "panel_prefix").distinct()
    )
    rows = _siblings(results).withColumnRenamed("sibling_class", "component_class")
    return lk.sibling_counts(
        units, rows, ["patid", "encounterid", "panel_prefix"], "culture_group", "component_class",
        ["loinc", "raw_lab_name", "result_qual"], F.trim(text("raw_result")) != "",
    )


@query(
    "timestamp_linkage",
    "J14",
    ro.with_sql(ro.RESULTS_SQL, CULTURES)
    + """, u AS (SELECT DISTINCT patid, encounterid, specimen_date, specimen_time, order_date, culture_group FROM cultures WHERE encounterid IS NOT NULL),
      k AS (SELECT DISTINCT u.*, l.specimen_date AS sd, l.specimen_time AS st, l.order_date AS od FROM u JOIN results l ON l.patid = u.patid AND l.encounterid = u.encounterid
        AND l.result_date BETWEEN u.specimen_date AND u.specimen_date + 7 WHERE regexp_matches(l.raw_lab_name, 'organism|susceptib|gram stain')),
      t AS (SELECT *, coalesce(sd = specimen_date AND st = specimen_time, false) AS a, coalesce(sd = specimen_date, false) AS b, coalesce(od = order_date, false) AS c FROM k)
      """
    + " UNION ALL ".join(
        f"SELECT '{k}' AS linkage_rule, count(DISTINCT (patid, encounterid, specimen_date, specimen_time, culture_group)) AS linked_units FROM t WHERE {cond}"
        for k, cond in {
            "same_specimen_date_time": "a", "same_specimen_date": "b", "same_order_date": "c", "same_specimen_datetime_or_order_date": "a OR c",
        }.items()
    ),
)
def timestamp_linkage(spark, folder):
    results = _results(spark, folder)
    cultures = _cultures(results)
    classed = _siblings(results).where(F.col("sibling_class").isin("organism_or_identification", "susceptibility_or_mic", "gram_stain"))
    return lk.timestamp_rule_totals(cultures, classed)


@query(
    "micro_field_completeness",
    "Q23",
    ro.with_sql(ro.RESULTS_SQL, CULTURES)
    + """SELECT count(*) AS n_rows, count(specimen_date) AS specimen_date_present, count(specimen_time) AS specimen_time_present, count(result_qual) AS result_qual_present,
      count(raw_result) AS raw_result_present, count(*) FILTER (WHERE specimen_time IS NOT NULL AND raw_result IS NOT NULL) AS specimen_time_and_raw_result FROM cultures""",
)
def micro_field_completeness(spark, folder):
    cultures, _ = _linkage_rows(spark, folder)
    return au.field_completeness(
        cultures, ["specimen_date", "specimen_time", "result_qual", "raw_result"], [("specimen_time", "raw_result")]
    )


@query(
    "join_key_diagnostic",
    "J17",
    ro.with_sql(ro.RESULTS_SQL)
    + """, c AS (SELECT o_custkey AS patid, o_orderkey AS encounterid FROM orders WHERE o_orderstatus = 'F')
      SELECT 'patid_encounter' AS join_rule, count(DISTINCT c.encounterid) AS any_row, count(DISTINCT CASE WHEN try_cast(r.raw_result AS DOUBLE) IS NOT NULL THEN c.encounterid END) AS numeric_row
      FROM c JOIN results r ON r.patid = c.patid AND r.encounterid = c.encounterid
      UNION ALL SELECT 'encounter_only', count(DISTINCT c.encounterid), count(DISTINCT CASE WHEN try_cast(r.raw_result AS DOUBLE) IS NOT NULL THEN c.encounterid END)
      FROM c JOIN results r ON r.encounterid = c.encounterid
      UNION ALL SELECT 'patid_only', count(DISTINCT c.encounterid), count(DISTINCT CASE WHEN try_cast(r.raw_result AS DOUBLE) IS NOT NULL THEN c.encounterid END)
      FROM c JOIN results r ON r.patid = c.patid""",
)
def join_key_diagnostic(spark, folder):
    cohort = ro.table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("patid"), F.col("o_orderkey").alias("encounterid")
    )
    rules = {"patid_encounter": ["patid", "encounterid"], "encounter_only": ["encounterid"], "patid_only": ["patid"]}
    flags = {"any_row": F.lit(True), "numeric_row": F.col("raw_result").try_cast("double").isNotNull()}
    return au.join_key_diagnostic(ro.results(spark, folder), cohort, rules, "encounterid", flags)


@query(
    "one_to_one_merge",
    "J18",
    """SELECT c_mktsegment AS segment, count(*) AS n, count(c_custkey) AS n_matched, round(sum(o_totalprice), 2) AS total
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def one_to_one_merge(spark, folder):
    cust = ro.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("found"), "c_mktsegment")
    rows = tables.one_to_one(ro.table(spark, folder, "orders").select("o_custkey", "o_totalprice"), cust, ["o_custkey"])
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), F.count("found").alias("n_matched"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "nesting_check",
    "J19 J8 Q7",
    """SELECT count(*) AS n_analytic, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS n_nested,
         count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_outside FROM orders""",
)
def nesting_check(spark, folder):
    from ..operators.cohort import with_flag_from

    order = ro.table(spark, folder, "orders").select("o_orderkey")
    ids = ro.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    got = with_flag_from(order, ids, "o_orderkey", "nested")
    return got.agg(
        F.count("*").alias("n_analytic"), F.sum("nested").alias("n_nested"), F.count_if(F.col("nested") == 0).alias("n_outside")
    )
