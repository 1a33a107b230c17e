"""Phenotype masks, drug groups, code maps, dictionaries and text classes over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import flag, icd_normalised
from ..operators import audits as au
from ..operators import features as ft
from ..operators import phenotype as ph
from . import roles as ro
from .registry import query

MEDS = ro.meds_sql()


def esc(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    "phenotype_mask",
    "P5 P6",
    ro.with_sql(MEDS)
    + f"""SELECT route_lower, drug_lower, CAST(is_broad AS INTEGER) AS broad, CAST(is_any AS INTEGER) AS systemic,
          CAST(regexp_matches(drug_lower, '{ro.BROAD_NAMES}') AS INTEGER) AS named, count(*) AS n
        FROM (SELECT route_lower, drug_lower,
                regexp_matches(drug_lower, '{ro.BROAD_NAMES}') AND route_lower = 'iv'
                  AND NOT regexp_matches(drug_lower, '{lx.NON_SYSTEMIC_TEXT}') AND NOT regexp_matches(route_lower, '{lx.NON_SYSTEMIC_ROUTE}') AS is_broad,
                regexp_matches(drug_lower, '{ro.BROAD_NAMES}|plate') AND NOT regexp_matches(drug_lower, '{lx.NON_SYSTEMIC_TEXT}')
                  AND NOT regexp_matches(route_lower, '{lx.NON_SYSTEMIC_ROUTE}')
                  AND NOT (drug_lower LIKE '%ring%' AND regexp_matches(route_lower, '{lx.ORAL_ENTERAL_ROUTE}')) AS is_any
              FROM meds) GROUP BY ALL""",
)
def phenotype_mask(spark, folder):
    meds = ro.meds(spark, folder)
    masks = {
        "broad": ph.broad_systemic("drug_lower", "route_lower", ro.BROAD_NAMES),
        "systemic": ph.any_systemic("drug_lower", "route_lower", ro.BROAD_NAMES + "|plate", oral_exception="ring"),
        "named": ph.named("drug_lower", ro.BROAD_NAMES),
    }
    rows = meds.select("route_lower", "drug_lower", *[flag(c).alias(k) for k, c in masks.items()])
    return rows.groupBy("route_lower", "drug_lower", *masks).agg(F.count("*").alias("n"))


@query(
    "excluded_name_rows",
    "P6 O2",
    ro.with_sql(MEDS)
    + f"""SELECT order_id, line, code, drug_lower, route_lower FROM meds
        WHERE regexp_matches(drug_lower, '{ro.BROAD_NAMES}') AND NOT is_broad
        ORDER BY order_id, line, code, drug_lower, route_lower LIMIT 1000""",
)
def excluded_name_rows(spark, folder):
    keys = ["order_id", "line", "code", "drug_lower", "route_lower"]
    meds = ro.meds(spark, folder)
    rows = meds.where(ph.named("drug_lower", ro.BROAD_NAMES) & ~F.col("is_broad"))
    return rows.select(*keys).orderBy(*keys).limit(1000)


INCLUDE, EXCLUDE = tuple(str(x) for x in range(0, 400, 4)), tuple(str(x) for x in range(0, 400, 12))


@query(
    "coded_predicate",
    "P7",
    ro.with_sql(MEDS)
    + f"""SELECT drug_lower, broad, other, count(*) AS n FROM (
        SELECT drug_lower,
          CAST((CAST(code AS VARCHAR) IN {INCLUDE} OR regexp_matches(drug_lower, 'ring|bolt')) AND CAST(code AS VARCHAR) NOT IN {EXCLUDE}
               AND NOT regexp_matches(drug_lower, 'small|hot') AND upper(route_lower) NOT IN ('PO', 'X') AS INTEGER) AS broad,
          CAST(regexp_matches(drug_lower, 'plate|anvil') AND NOT regexp_matches(drug_lower, 'small|hot') AND upper(route_lower) NOT IN ('PO', 'X') AS INTEGER) AS other
        FROM meds) GROUP BY ALL""",
)
def coded_predicate(spark, folder):
    broad = ph.coded_broad("drug_lower", "code", "route_lower", INCLUDE, EXCLUDE, "ring|bolt", "small|hot", ("PO", "X"))
    other = ph.coded_non_broad("drug_lower", "route_lower", "plate|anvil", "small|hot", ("PO", "X"))
    rows = ro.meds(spark, folder).select("drug_lower", flag(broad).alias("broad"), flag(other).alias("other"))
    return rows.groupBy("drug_lower", "broad", "other").agg(F.count("*").alias("n"))


GROUPS = {"metal": ("gear", "bolt", "anvil"), "jewel": ("ring",), "small_thing": ("small", "widget"), "flat": ("plate",)}
CODES = {"1": "coded_one", "2": "coded_two", "8": "coded_eight"}
CODE_WHEN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())
NAME_WHEN = " ".join(
    f"WHEN {' OR '.join(f'''drug_lower LIKE '%{w}%' ''' for w in ws)} THEN '{g}'" for g, ws in GROUPS.items()
)
GROUPED = f"""grouped AS (SELECT *, CASE WHEN code % 50 = 7 OR route_lower = 'inhal' OR drug_lower LIKE '%old%' THEN NULL
   ELSE coalesce(CASE CAST(code AS VARCHAR) {CODE_WHEN} END, CASE {NAME_WHEN} END) END AS drug_group FROM meds)"""


def _grouped(spark, folder):
    meds = ro.meds(spark, folder)
    gone = (F.col("code") % 50 == 7) | ph.not_intravenous("code", "drug_lower", "route_lower", ("none",), ("old",), ("INHAL",))
    return meds.withColumn("drug_group", ph.drug_group("code", "drug_lower", "route_lower", CODES, GROUPS, gone))


@query(
    "drug_group_first_match",
    "P8",
    ro.with_sql(MEDS, GROUPED) + "SELECT drug_lower, coalesce(drug_group, '<none>') AS drug_group, count(*) AS n FROM grouped GROUP BY ALL",
)
def drug_group_first_match(spark, folder):
    got = _grouped(spark, folder).withColumn("drug_group", F.coalesce("drug_group", F.lit("<none>")))
    return got.groupBy("drug_lower", "drug_group").agg(F.count("*").alias("n"))


def _either(column: str, words) -> str:
    return "(" + " OR ".join(f"{column} LIKE '%{w}%'" for w in words) + ")"


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


MAPPED_SQL = f"""lined AS (SELECT *, trim(lower(drug_name)) AS nm, trim(coalesce(drug_code, '')) AS cd, upper(trim(coalesce(drug_route, ''))) AS rt FROM drug_lines),
judged AS (SELECT *, cd IN {_listed(lx.NON_IV_CODES)} OR {_either('nm', lx.NON_IV_NAMES)} OR rt IN {_listed(lx.NON_IV_ROUTES)} AS gone,
  coalesce(CASE cd {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.CODE_TO_GROUP.items())} END,
    CASE {" ".join(f"WHEN {_either('nm', ws)} THEN '{g}'" for g, ws in lx.GROUP_NAMES.items())} END) AS grp FROM lined),
mapped AS (SELECT *, CASE WHEN NOT gone THEN grp END AS broad_drug_group, CAST(NOT gone AND grp IS NOT NULL AS INTEGER) AS is_broad_spectrum,
  CAST(NOT gone AND (grp IS NOT NULL OR {_either('nm', lx.NON_BROAD_NAMES)}) AS INTEGER) AS is_systemic_antibiotic FROM judged)"""


@query(
    "drug_mapping_counts",
    "P9 A12",
    ro.with_sql(ro.DRUG_LINES_SQL, MAPPED_SQL)
    + "SELECT drug_name, drug_route, drug_code, broad_drug_group, is_broad_spectrum, is_systemic_antibiotic, count(*) AS n FROM mapped GROUP BY ALL",
)
def drug_mapping_counts(spark, folder):
    rows = ph.classify_drugs(ro.drug_lines(spark, folder), "drug_code", "drug_name", "drug_route")
    return ph.mapping_counts(rows, ["drug_name", "drug_route", "drug_code"])


@query(
    "formulation_class",
    "Q11",
    """WITH t AS (SELECT p_partkey, lower(p_type) || CASE p_size % 5 WHEN 0 THEN ' oral tablet' WHEN 1 THEN ' vial' WHEN 2 THEN ' nebulizer oral' WHEN 3 THEN '' ELSE ' premix' END AS nm,
          CASE p_partkey % 4 WHEN 0 THEN ' oral ' WHEN 1 THEN 'intravenous' WHEN 2 THEN 'inhalation' END AS rt FROM part)
       SELECT cls AS formulation, count(*) AS n, count(DISTINCT p_partkey) AS n_parts FROM (
         SELECT p_partkey, CASE
           WHEN nm LIKE '%inhal%' OR nm LIKE '%nebul%' OR nm LIKE '%cayston%' OR upper(trim(coalesce(rt, ''))) IN ('RESPIRATORY_TRACT', 'INHALATION') THEN 'inhaled'
           WHEN nm LIKE '%oral%' OR nm LIKE '%capsule%' OR nm LIKE '%tablet%' OR nm LIKE '%by mouth%' OR upper(trim(coalesce(rt, ''))) = 'ORAL' THEN 'oral'
           WHEN nm LIKE '%inject%' OR nm LIKE '%intravenous%' OR nm LIKE '% vial%' OR nm LIKE '%infusion%' OR nm LIKE '%premix%' OR nm LIKE '%piggyback%' OR upper(trim(coalesce(rt, ''))) = 'INTRAVENOUS' THEN 'injectable_or_iv'
           ELSE 'unspecified' END AS cls FROM t) GROUP BY 1""",
)
def formulation_class(spark, folder):
    size, key = F.col("p_size") % 5, F.col("p_partkey") % 4
    tail = F.when(size == 0, " oral tablet").when(size == 1, " vial").when(size == 2, " nebulizer oral").when(size == 3, "").otherwise(" premix")
    route = F.when(key == 0, " oral ").when(key == 1, "intravenous").when(key == 2, "inhalation")
    part = ro.table(spark, folder, "part").withColumn("formulation", ph.formulation(F.concat(F.lower("p_type"), tail), route))
    return part.groupBy("formulation").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("n_parts"))


@query(
    "code_name_agreement",
    "Q10 A15",
    ro.with_sql(MEDS)
    + """SELECT source, count(*) FILTER (WHERE nm AND cd) AS name_and_code, count(*) FILTER (WHERE nm AND NOT cd) AS name_only,
          count(*) FILTER (WHERE NOT nm AND cd) AS code_only, count(*) FILTER (WHERE code % 9 = 0) AS excluded,
          count(DISTINCT CASE WHEN cd THEN order_id END) AS code_entities
        FROM (SELECT *, regexp_matches(drug_lower, 'ring|bolt') AS nm, code % 5 = 0 AND code % 9 <> 0 AS cd FROM meds) GROUP BY 1""",
)
def code_name_agreement(spark, folder):
    by_code = (F.col("code") % 5 == 0) & (F.col("code") % 9 != 0)
    return au.code_name_agreement(
        ro.meds(spark, folder), ph.named("drug_lower", "ring|bolt"), by_code, F.col("code") % 9 == 0, "order_id", ["source"]
    )


AGENTS = {"ring": "ring", "fastener": "bolt|gear", "round": "ring|gear", "flat": "plate"}


@query(
    "agent_route_counts",
    "Q12 U5 A21",
    ro.with_sql(MEDS)
    + " UNION ALL ".join(
        f"SELECT '{k}' AS agent, source, route_lower, count(*) AS n, count(DISTINCT order_id) AS n_orders FROM meds WHERE regexp_matches(drug_lower, '{p}') GROUP BY ALL"
        for k, p in AGENTS.items()
    ),
)
def agent_route_counts(spark, folder):
    rows = au.exploded_matches(ro.meds(spark, folder), "drug_lower", AGENTS)
    return rows.groupBy("agent", "source", "route_lower").agg(F.count("*").alias("n"), F.countDistinct("order_id").alias("n_orders"))


@query(
    "source_overlap",
    "U3 U4 Q12",
    ro.with_sql(MEDS)
    + """, a AS (SELECT DISTINCT order_id FROM meds WHERE source = 'O' AND is_broad), b AS (SELECT DISTINCT order_id FROM meds WHERE source = 'F' AND is_broad),
       u AS (SELECT order_id FROM a UNION SELECT order_id FROM b)
       SELECT count(a.order_id) AS in_first, count(b.order_id) AS in_second,
         count(*) FILTER (WHERE a.order_id IS NOT NULL AND b.order_id IS NOT NULL) AS in_both,
         count(*) FILTER (WHERE a.order_id IS NOT NULL AND b.order_id IS NULL) AS only_first,
         count(*) FILTER (WHERE a.order_id IS NULL AND b.order_id IS NOT NULL) AS only_second
       FROM u LEFT JOIN a USING (order_id) LEFT JOIN b USING (order_id)""",
)
def source_overlap(spark, folder):
    meds = ro.meds(spark, folder).where("is_broad")
    return au.source_overlap(meds.where("source = 'O'"), meds.where("source = 'F'"), "order_id")


@query(
    "concept_items",
    "P10 J2",
    """SELECT concept, count(*) AS n_items, count(DISTINCT l.l_orderkey) AS n_orders FROM (
         SELECT DISTINCT p_partkey, concept FROM (
           SELECT p_partkey, 'round' AS concept FROM part WHERE regexp_matches(lower(p_name), 'ring$|gear')
           UNION ALL SELECT p_partkey, 'small' FROM part WHERE regexp_matches(lower(p_name), '^small')
           UNION ALL SELECT p_partkey, 'any_g' FROM part WHERE regexp_matches(lower(p_name), ' g'))) c
       JOIN lineitem l ON l.l_partkey = c.p_partkey GROUP BY 1""",
)
def concept_items(spark, folder):
    items = ph.concept_items(
        ro.table(spark, folder, "part"), "p_partkey", "p_name", {"round": "ring$|gear", "small": "^small", "any_g": " g"}
    )
    line = ro.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    rows = line.join(items.select("p_partkey", "concept"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("concept").agg(F.count("*").alias("n_items"), F.countDistinct("l_orderkey").alias("n_orders"))


@query(
    "exact_label_items",
    "P11 P4",
    """SELECT CASE lower(trim(p_name)) WHEN 'small ring' THEN 'sr' WHEN 'red widget' THEN 'rw' ELSE 'hg' END AS concept, count(*) AS n
       FROM part WHERE lower(trim(p_name)) IN ('small ring', 'red widget', 'hot gear') GROUP BY 1""",
)
def exact_label_items(spark, folder):
    got = ph.labelled_items(
        ro.table(spark, folder, "part"), "p_partkey", "p_name", {"small ring": "sr", "red widget": "rw", "hot gear": "hg"}
    )
    return got.groupBy("concept").agg(F.count("*").alias("n"))


@query(
    "name_include_exclude",
    "P15",
    """SELECT p_type, count(*) FILTER (WHERE (strpos(lower(p_name), 'ring') > 0 OR strpos(lower(p_name), 'gear') > 0)
        AND NOT (strpos(lower(p_name), 'small') > 0 OR strpos(lower(p_name), 'hot') > 0)) AS n_kept, count(*) AS n FROM part GROUP BY 1""",
)
def name_include_exclude(spark, folder):
    keep = ph.named_without("p_name", ("ring", "gear"), ("small", "hot"))
    return ro.table(spark, folder, "part").groupBy("p_type").agg(F.count_if(keep).alias("n_kept"), F.count("*").alias("n"))


# Care unit, race and sex of an order; both engines read these.
UNIT_CASE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Medical/Surgical ICU' WHEN '2-HIGH' THEN 'Coronary Care Unit' WHEN '3-MEDIUM' THEN 'Neuro Surgical ICU' WHEN '4-NOT SPECIFIED' THEN 'Cardiac Vascular' END"
RACE_CASE = "CASE o_custkey % 4 WHEN 0 THEN 'WHITE - OTHER' WHEN 1 THEN 'Black' WHEN 2 THEN 'white' END"
SEX_CASE = "CASE o_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END"
_unit_flag = lambda p: f"CASE WHEN regexp_matches(lower(unit), '{p}') THEN 1 ELSE 0 END"


@query(
    "category_flags",
    "P16",
    f"""SELECT unit, race, sex, CASE WHEN sex = 'M' THEN 1 ELSE 0 END AS sex_male, CASE WHEN lower(race) LIKE '%white%' THEN 1 ELSE 0 END AS race_white,
         {", ".join(f"{_unit_flag(p)} AS {k}" for k, p in lx.CARE_UNITS.items())}, count(*) AS n
       FROM (SELECT {UNIT_CASE} AS unit, {RACE_CASE} AS race, {SEX_CASE} AS sex FROM orders) GROUP BY ALL""",
)
def category_flags(spark, folder):
    rows = ro.table(spark, folder, "orders").select(F.expr(UNIT_CASE).alias("unit"), F.expr(RACE_CASE).alias("race"), F.expr(SEX_CASE).alias("sex"))
    flags = ft.category_flags("unit", "race", "sex")
    return rows.withColumns(flags).groupBy("unit", "race", "sex", *flags).agg(F.count("*").alias("n"))


@query(
    "code_prefix_classes",
    "P17 A9 J7",
    """WITH d AS (SELECT l.l_orderkey, upper(regexp_replace(coalesce(code, ''), '[^A-Z0-9]', '', 'g')) AS norm FROM (
           SELECT l_orderkey, CASE l_suppkey % 4 WHEN 0 THEN 'I' || CAST(40 + l_partkey % 20 AS VARCHAR) || '.2'
             WHEN 1 THEN CAST(400 + l_partkey % 200 AS VARCHAR) || '.' || CAST(l_suppkey % 10 AS VARCHAR)
             WHEN 2 THEN 'n' || CAST(l_partkey % 30 AS VARCHAR) || '-x' ELSE NULL END AS code FROM lineitem) l)
       SELECT count(*) AS n, CAST(sum(hf) AS BIGINT) AS heart_failure, CAST(sum(ck) AS BIGINT) AS chronic_kidney, CAST(sum(cp) AS BIGINT) AS copd FROM (
         SELECT l_orderkey, max(CASE WHEN regexp_matches(norm, '^(I50|428)') THEN 1 ELSE 0 END) AS hf,
           max(CASE WHEN regexp_matches(norm, '^(N18|585)') THEN 1 ELSE 0 END) AS ck,
           max(CASE WHEN regexp_matches(norm, '^(J44|491|492|496)') THEN 1 ELSE 0 END) AS cp FROM d GROUP BY 1)""",
)
def code_prefix_classes(spark, folder):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    code = (
        F.when(supp % 4 == 0, F.concat(F.lit("I"), (40 + part % 20).cast("string"), F.lit(".2")))
        .when(supp % 4 == 1, F.concat((400 + part % 200).cast("string"), F.lit("."), (supp % 10).cast("string")))
        .when(supp % 4 == 2, F.concat(F.lit("n"), (part % 30).cast("string"), F.lit("-x")))
    )
    flags = ph.prefix_flags(icd_normalised(code))
    names = ["heart_failure", "chronic_kidney", "copd"]
    per = ro.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(*[F.max(flag(flags[k])).alias(k) for k in names])
    return per.agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in names])


KEYWORDS = {"license": "license|copyright", "contact": "@|phone", "number": "[0-9]{3}", "the": r"\bthe\b"}


@query(
    "keyword_hits",
    "Q16",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS keyword, count(*) FILTER (WHERE regexp_matches(lower(coalesce({c}, '')), '{esc(p)}')) AS n FROM documents"
        for c in ("text", "source")
        for k, p in KEYWORDS.items()
    ),
)
def keyword_hits(spark, folder):
    return ph.keyword_hits(ro.table(spark, folder, "documents"), ["text", "source"], KEYWORDS)


TEXT_CASE = " ".join(f"WHEN regexp_matches(t, '{esc(p)}') THEN '{k}'" for k, p in lx.RESULT_TEXT_CLASSES.items())


@query(
    "result_text_classes",
    "Q13 F15",
    f"""SELECT lang, CASE WHEN trim(t) = '' THEN 'missing_or_blank' {TEXT_CASE} ELSE 'other_text_pattern' END AS result_pattern, count(*) AS n
        FROM (SELECT lang, lower(coalesce(text, '')) AS t FROM documents) GROUP BY ALL""",
)
def result_text_classes(spark, folder):
    docs = ro.table(spark, folder, "documents")
    return docs.groupBy("lang", ph.result_text_class("text").alias("result_pattern")).agg(F.count("*").alias("n"))
