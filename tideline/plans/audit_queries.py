"""Clock, coverage, mapping, schema and source audits over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clocks
from ..functions.text import flag
from ..operators import audits as au
from ..operators.intervals import overlap_profile, overlaps
from ..operators.order_stats import exact_quantiles
from ..session import shared_dir, stage_border
from ..sources import preflight, tables
from . import roles as ro
from .registry import query

# Date and time fields cut out of the event stamp; some are blanked or written differently.
FIELDS = """fields AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS d,
   CASE WHEN event_id % 11 <> 0 THEN CAST(extract(hour FROM ts) * 100 + extract(minute FROM ts) AS INTEGER) END AS hhmm,
   CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN ' 25:99 ' WHEN event_id % 13 = 2 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%H:%M:%S') END AS txt,
   CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN strftime(ts, '%H:%M:%S') ELSE CAST(CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS INTEGER) AS VARCHAR) END AS secs
   FROM events)"""


def _fields(spark, folder):
    ev, k = ro.table(spark, folder, "events"), F.col("event_id")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return ev.select(
        "event_id", "user_id", "ts", F.to_date("ts").alias("d"),
        F.when(k % 11 != 0, F.hour("ts") * 100 + F.minute("ts")).alias("hhmm"),
        F.when(k % 13 == 0, None).when(k % 13 == 1, " 25:99 ").when(k % 13 == 2, F.date_format("ts", "HH:mm"))
        .otherwise(F.date_format("ts", "HH:mm:ss")).alias("txt"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, F.date_format("ts", "HH:mm:ss")).otherwise(seconds.cast("string")).alias("secs"),
    )


MID = "CAST(d AS TIMESTAMP)"
DECODED = f"""decoded AS (SELECT *, {MID} + to_seconds(coalesce((hhmm // 100) * 3600 + (hhmm % 100) * 60, 0)) AS from_hhmm,
   CASE WHEN txt IS NULL OR trim(txt) = '25:99' THEN {MID} ELSE {MID} + to_seconds(CAST(split_part(trim(txt), ':', 1) AS INTEGER) * 3600 + CAST(split_part(trim(txt), ':', 2) AS INTEGER) * 60 + coalesce(try_cast(split_part(trim(txt), ':', 3) AS INTEGER), 0)) END AS from_text,
   CASE WHEN secs IS NULL THEN NULL WHEN strpos(secs, ':') > 0 THEN try_cast(CAST(d AS VARCHAR) || ' ' || secs AS TIMESTAMP) ELSE {MID} + to_seconds(CAST(secs AS INTEGER)) END AS from_seconds
   FROM fields)"""


@query(
    "decode_time_fields",
    "F1 F2 F3",
    f"""WITH {FIELDS}, {DECODED} SELECT event_id, {ro.stamp_sql('from_hhmm')} AS from_hhmm, {ro.stamp_sql('from_text')} AS from_text, {ro.stamp_sql('from_seconds')} AS text_first,
      {ro.stamp_sql('from_seconds')} AS number_first, {ro.stamp_sql('coalesce(from_seconds, ' + MID + ')')} AS or_midnight, {ro.stamp_sql(MID + ' + INTERVAL 86399 SECOND')} AS span_stop FROM decoded""",
)
def decode_time_fields(spark, folder):
    cols = {
        "from_hhmm": clocks.combine_hhmm("d", "hhmm"), "from_text": clocks.combine_text("d", "txt"),
        "text_first": clocks.decode_clock("d", "secs"), "number_first": clocks.decode_clock("d", "secs", numeric_first=True),
        "or_midnight": clocks.decode_clock_or_midnight("d", "secs"), "span_stop": clocks.span_stop("d"),
    }
    return _fields(spark, folder).select("event_id", *[ro.stamp(c).alias(k) for k, c in cols.items()])


def _encoding_sql(clock: str, c: str) -> str:
    t = f"trim(CAST({c} AS VARCHAR))"
    n = f"try_cast({t} AS DOUBLE)"
    return f"""SELECT '{clock}' AS clock, count(*) AS n_rows, count(*) FILTER (WHERE {t} <> '') AS nonnull_rows, count(*) FILTER (WHERE strpos({t}, ':') > 0) AS colon_rows,
      count({n}) AS numeric_rows, count(*) FILTER (WHERE abs({n} - round({n})) < 1e-9) AS integer_like_rows, min({n}) AS numeric_min, max({n}) AS numeric_max,
      count(*) FILTER (WHERE {n} BETWEEN 0 AND 23) AS numeric_0_23, count(*) FILTER (WHERE {n} BETWEEN 0 AND 1439) AS numeric_0_1439, count(*) FILTER (WHERE {n} BETWEEN 0 AND 2359) AS numeric_0_2359,
      count(*) FILTER (WHERE {n} BETWEEN 0 AND 86399) AS numeric_0_86399, count(CASE WHEN strpos({t}, ':') > 0 THEN try_cast(CAST(d AS VARCHAR) || ' ' || {t} AS TIMESTAMP) END) AS reads_text,
      count(*) FILTER (WHERE {n} BETWEEN 0 AND 1439) AS reads_minutes, count(*) FILTER (WHERE {n} BETWEEN 0 AND 86399) AS reads_seconds,
      count(*) FILTER (WHERE {n} BETWEEN 0 AND 2359 AND floor({n} / 100) BETWEEN 0 AND 23 AND {n} % 100 BETWEEN 0 AND 59) AS reads_hhmm FROM fields"""


@query("time_encoding_profile", "Q2", f"WITH {FIELDS} " + " UNION ALL ".join(_encoding_sql(k, k) for k in ("hhmm", "txt", "secs")))
def time_encoding_profile(spark, folder):
    return au.time_encoding(_fields(spark, folder), {c: ("d", c) for c in ("hhmm", "txt", "secs")})


CLOCKS = ["from_hhmm", "from_text", "from_seconds"]


def _decoded(spark, folder):
    return _fields(spark, folder).withColumns(
        {"from_hhmm": clocks.combine_hhmm("d", "hhmm"), "from_text": clocks.combine_text("d", "txt"), "from_seconds": clocks.decode_clock("d", "secs")}
    )


@query(
    "clock_completeness",
    "Q3",
    f"WITH {FIELDS}, {DECODED} "
    + " UNION ALL ".join(f"SELECT '{c}' AS clock, count({c}) AS rows_with_clock, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN user_id END) AS entities_with_clock FROM decoded" for c in CLOCKS),
)
def clock_completeness(spark, folder):
    return au.clock_completeness(_decoded(spark, folder), CLOCKS, "user_id")


@query(
    "clock_pair_offsets",
    "Q3 F8",
    f"WITH {FIELDS}, {DECODED} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS clock_a, '{b}' AS clock_b, count(*) AS paired_rows, count(DISTINCT user_id) AS paired_entities, round(avg(abs(date_diff('minute', {a}, {b}))), 6) AS mean_abs_minutes,
        quantile_cont(abs(date_diff('minute', {a}, {b}))::DOUBLE, 0.5) AS median_abs_minutes, round(quantile_cont(abs(date_diff('minute', {a}, {b}))::DOUBLE, 0.95), 6) AS p95_abs_minutes,
        count(*) FILTER (WHERE CAST({a} AS DATE) = CAST({b} AS DATE)) AS same_date_rows, round(count(*) FILTER (WHERE CAST({a} AS DATE) = CAST({b} AS DATE)) / count(*), 6) AS same_date_share
        FROM decoded WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
        for i, a in enumerate(CLOCKS) for b in CLOCKS[i + 1 :]
    ),
)
def clock_pair_offsets(spark, folder):
    out = au.clock_pairs(_decoded(spark, folder), CLOCKS, "user_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_abs_minutes", "p95_abs_minutes", "same_date_share")})


@query(
    "anchor_clock_offsets",
    "Q4 F8",
    ro.with_sql(ro.LABS_SQL, ro.USERS_SQL)
    + """SELECT concept, count(*) AS n, quantile_cont(h, 0.5) AS median_hours, round(quantile_cont(h, 0.05), 6) AS p05_hours, round(quantile_cont(h, 0.95), 6) AS p95_hours FROM (
      SELECT concept, date_diff('hour', anchor_time, charttime)::DOUBLE AS h FROM labs JOIN users USING (subject)) GROUP BY 1""",
)
def anchor_clock_offsets(spark, folder):
    rows = ro.labs(spark, folder).join(ro.users(spark, folder), "subject")
    rows = rows.select("concept", clocks.boundaries_crossed("hour", "anchor_time", "charttime").alias("h"))
    out = exact_quantiles(rows, ["concept"], "h", [0.05, 0.5, 0.95], ["p05_hours", "median_hours", "p95_hours"])
    return out.withColumns({c: F.round(c, 6) for c in ("p05_hours", "p95_hours")})


def _bin_sql() -> str:
    out = []
    for name, lo, hi in au.OFFSET_BINS:
        parts = [f"charttime >= anchor_time + INTERVAL ({lo}) DAY"] if lo is not None else []
        parts += [f"charttime < anchor_time + INTERVAL ({hi}) DAY"] if hi is not None else []
        out.append(f"count(*) FILTER (WHERE {' AND '.join(parts)}) AS {name}")
    return ", ".join(out)


@query("anchor_delta_bins", "Q4", ro.with_sql(ro.LABS_SQL, ro.USERS_SQL) + f"SELECT concept, {_bin_sql()} FROM labs JOIN users USING (subject) GROUP BY 1")
def anchor_delta_bins(spark, folder):
    rows = ro.labs(spark, folder).join(ro.users(spark, folder).select("subject", "anchor_time"), "subject")
    return au.offset_bins(rows, "charttime", "anchor_time", ["concept"])


WINDOWS = {"before_10d": (-10, 0), "day0_1": (0, 1), "day2_3": (2, 3), "day0_3": (0, 3), "day3_30": (3, 30)}


@query(
    "window_coverage",
    "Q5 Q8 J6",
    ro.with_sql(ro.LABS_SQL, ro.USERS_SQL)
    + " UNION ALL ".join(
        f"""SELECT concept, '{w}' AS "window", count(DISTINCT CASE WHEN charttime >= anchor_time + INTERVAL ({lo}) DAY AND charttime < anchor_time + INTERVAL ({hi}) DAY THEN subject END) AS n_entities,
        (SELECT count(*) FROM users) AS cohort_n, round(count(DISTINCT CASE WHEN charttime >= anchor_time + INTERVAL ({lo}) DAY AND charttime < anchor_time + INTERVAL ({hi}) DAY THEN subject END) / (SELECT count(*) FROM users), 6) AS share
        FROM labs JOIN users USING (subject) GROUP BY 1"""
        for w, (lo, hi) in WINDOWS.items()
    ),
)
def window_coverage(spark, folder):
    out = au.window_coverage(ro.labs(spark, folder), ro.users(spark, folder), "subject", "charttime", "anchor_time", "concept", WINDOWS, "days")
    return out.withColumn("share", F.round("share", 6))


OBSERVED = {
    "any": "TRUE", "late_error": "late_errors > 0", "seen_after_landmark": "last_ts > analysis_time0", "large_late_error": "large_errors > 0",
}
GRID_WINDOWS = {"0_3d": (0, 3), "6_9d": (6, 9), "pre9d": (0, 9)}


@query(
    "outcome_feasibility",
    "Q8 Q1",
    ro.with_sql(
        ro.LABS_SQL, ro.USERS_SQL,
        """seen AS (SELECT u.*, l.* EXCLUDE (subject) FROM users u JOIN (SELECT s.subject, max(charttime) AS last_ts,
          count(*) FILTER (WHERE concept = 'error' AND charttime > analysis_time0) AS late_errors, count(*) FILTER (WHERE concept = 'error' AND valuenum > 100 AND charttime > analysis_time0) AS large_errors
          FROM users s JOIN labs USING (subject) GROUP BY 1) l USING (subject))""",
        "grid AS (" + " UNION ALL ".join(
            f"""SELECT concept, '{w}' AS "window", '{o}' AS outcome, count(DISTINCT CASE WHEN {c} AND charttime >= anchor_time + INTERVAL ({lo}) DAY AND charttime <= anchor_time + INTERVAL ({hi}) DAY THEN subject END) AS k,
            (SELECT count(*) FROM seen WHERE {c}) AS size FROM seen JOIN labs USING (subject) GROUP BY 1"""
            for w, (lo, hi) in GRID_WINDOWS.items() for o, c in OBSERVED.items()
        ) + ")",
    )
    + """SELECT concept, "window", outcome, CASE WHEN k >= 11 THEN k END AS n_entities, CASE WHEN size >= 11 THEN size END AS cohort_n, CAST(k < 11 AS INTEGER) AS suppressed FROM grid""",
)
def outcome_feasibility(spark, folder):
    labs, users = ro.labs(spark, folder), ro.users(spark, folder)
    late = (F.col("concept") == "error") & (F.col("charttime") > F.col("analysis_time0"))
    facts = labs.join(users.select("subject", "analysis_time0"), "subject").groupBy("subject").agg(
        F.max("charttime").alias("last_ts"), F.count_if(late).alias("late_errors"), F.count_if(late & (F.col("valuenum") > 100)).alias("large_errors")
    )
    seen = stage_border(users.join(facts, "subject"))
    return au.feasibility_grid(labs, seen, "subject", "charttime", "anchor_time", "concept", GRID_WINDOWS, {o: F.expr(c) for o, c in OBSERVED.items()}, "days")


@query(
    "parser_comparison",
    "Q6",
    f"""WITH {FIELDS}, {ro.USERS_SQL}, p AS (SELECT user_id AS subject, 'text_midnight' AS parser, CASE WHEN strpos(coalesce(secs, '00:00:00'), ':') > 0 THEN CAST(d AS TIMESTAMP) + CAST(coalesce(secs, '00:00:00') AS INTERVAL) END AS s, {MID} + INTERVAL 1 DAY AS e FROM fields
      UNION ALL SELECT user_id, 'auto', CASE WHEN secs IS NULL THEN {MID} WHEN strpos(secs, ':') > 0 THEN CAST(d AS TIMESTAMP) + CAST(secs AS INTERVAL) ELSE {MID} + to_seconds(CAST(secs AS INTEGER)) END, {MID} + INTERVAL 1 DAY FROM fields
      UNION ALL SELECT user_id, 'date_span', {MID}, {MID} + INTERVAL 86399 SECOND FROM fields)
      SELECT parser, CAST(sum(early) AS BIGINT) AS early, CAST(sum(late) AS BIGINT) AS late, CAST(sum(CASE WHEN early = 1 AND late = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stopped FROM (
        SELECT parser, u.subject, max(CASE WHEN s < anchor_time + INTERVAL 24 HOUR AND e > anchor_time THEN 1 ELSE 0 END) AS early,
          max(CASE WHEN s < anchor_time + INTERVAL 72 HOUR AND e > anchor_time + INTERVAL 48 HOUR THEN 1 ELSE 0 END) AS late FROM users u JOIN p USING (subject) GROUP BY 1, 2) GROUP BY 1""",
)
def parser_comparison(spark, folder):
    f = _fields(spark, folder).withColumnRenamed("user_id", "subject")
    colon = F.coalesce("secs", F.lit("00:00:00"))
    next_day = clocks.plus(clocks.midnight("d"), days=1)
    starts = {
        "text_midnight": (F.when(colon.contains(":"), clocks.decode_clock("d", colon)), next_day),
        "auto": (clocks.decode_clock_or_midnight("d", "secs"), next_day),
        "date_span": (clocks.span_start("d"), clocks.span_stop("d")),
    }
    # One scan and one join for all parsers: each is a pair of columns.
    rows = f.select("subject", *[s.alias(f"{k}_s") for k, (s, _) in starts.items()], *[e.alias(f"{k}_e") for k, (_, e) in starts.items()])
    flags = {}
    for k in starts:
        flags[f"{k}__early"] = overlaps(f"{k}_s", f"{k}_e", "anchor_time", clocks.plus("anchor_time", hours=24))
        flags[f"{k}__late"] = overlaps(f"{k}_s", f"{k}_e", clocks.plus("anchor_time", hours=48), clocks.plus("anchor_time", hours=72))
    users = ro.users(spark, folder).select("subject", "anchor_time")
    per = overlap_profile(rows, users, "subject", flags, window_cols=["anchor_time"])
    cells = F.array(
        *[F.struct(F.lit(k).alias("parser"), F.col(f"{k}__early").alias("early"), F.col(f"{k}__late").alias("late")) for k in starts]
    )
    return per.select(F.explode(cells).alias("c")).select("c.*").groupBy("parser").agg(
        F.sum("early").alias("early"), F.sum("late").alias("late"), F.sum(flag((F.col("early") == 1) & (F.col("late") == 0))).alias("stopped")
    )


# Fixed value: rows of a ranked candidate map.
MAP_ROWS = 100


@query(
    "candidate_maps",
    "Q9 A13 O6",
    """SELECT p_brand, p_type, count(*) AS n, count(DISTINCT l_orderkey) AS n_entities, count(*) FILTER (WHERE l_discount > 0.05) AS n_valued
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(*) >= 11 ORDER BY n DESC, p_brand, p_type LIMIT 100""",
)
def candidate_maps(spark, folder):
    part = ro.table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    rows = ro.table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    extra = {"n_entities": F.countDistinct("l_orderkey"), "n_valued": F.count_if(F.col("l_discount") > 0.05)}
    return au.frequent_values(rows, ["p_brand", "p_type"], extra, top=MAP_ROWS)


@query(
    "category_topk",
    "A20 O6",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), '<MISSING>') AS category, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce(CAST({c} AS VARCHAR), '<MISSING>')) AS INTEGER) AS rank FROM orders GROUP BY 2) WHERE rank <= 25"""
        for c in ("o_orderpriority", "o_orderstatus", "o_custkey")
    ),
)
def category_topk(spark, folder):
    return au.category_counts(ro.table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


RESULT_TYPES = {
    "patid": "bigint", "encounterid": "bigint", "raw_lab_name": "string", "loinc": "int", "specimen_source": "string", "specimen_date": "date",
    "specimen_time": "int", "order_date": "date", "result_date": "date", "result_qual": "string", "raw_result": "string",
}


@query(
    "schema_profile",
    "S10 S3",
    ro.with_sql(ro.RESULTS_SQL)
    + " UNION ALL ".join(
        f"SELECT 'results' AS source, '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*), 6) AS null_fraction FROM results"
        for c, t in RESULT_TYPES.items()
    ),
)
def schema_profile(spark, folder):
    return au.schema_profile(ro.results(spark, folder), "results").withColumn("null_fraction", F.round("null_fraction", 6))


@query(
    "facility_counts",
    "A21",
    """SELECT c_nationkey AS facility, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_patients, count(DISTINCT o_orderkey) AS n_encounters
       FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def facility_counts(spark, folder):
    rows = ro.table(spark, folder, "orders").join(ro.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("facility")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_patients"), F.countDistinct("o_orderkey").alias("n_encounters")
    )


@query(
    "suppressed_counts",
    "Q1",
    """SELECT p_size, p_type, CAST(CASE WHEN count(*) >= 11 THEN count(*) END AS DOUBLE) AS n, CASE WHEN count(*) < 11 THEN 1 ELSE 0 END AS suppressed FROM part GROUP BY ALL""",
)
def suppressed_counts(spark, folder):
    out = au.suppressed_counts(ro.table(spark, folder, "part"), ["p_size", "p_type"])
    return out.withColumn("n", F.col("n").cast("double"))


@query(
    "semi_filtered_scan",
    "S2 J7",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""",
)
def semi_filtered_scan(spark, folder):
    ids = ro.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = tables.semi_scan(ro.table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), ids, "l_orderkey")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "view_sql_counts",
    "S6 A13",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 11""",
)
def view_sql_counts(spark, folder):
    tables.register_views({"tideline_orders": ro.table(spark, folder, "orders")})
    return spark.sql(
        """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM tideline_orders
           GROUP BY 1, 2 HAVING count(*) >= 11"""
    )


@query(
    "canonical_columns",
    "P1 P2 P3 S4 O4",
    """SELECT count(DISTINCT (o_orderkey, o_custkey)) AS n_encounters, count(DISTINCT o_custkey) AS n_patients, count(o_orderdate) AS n_dated FROM orders""",
)
def canonical_columns(spark, folder):
    raw = tables.read_table(spark, f"{folder}/orders.parquet").withColumnsRenamed({"o_orderkey": " ENC ", "o_custkey": "PatId"})
    named = tables.rename_from_mapping(raw, {"encounterid": "enc", "admit": "O_ORDERDATE", "absent": "nope"}, ["encounterid", "admit", "absent"])
    rows = tables.canonical(named, {"patid": ["PATID"], "encounterid": ["ENCOUNTER_ID", "ENCOUNTERID"], "admit_date": ["ADMIT"]})
    return rows.select("patid", "encounterid", "admit_date").distinct().agg(
        F.count("*").alias("n_encounters"), F.countDistinct("patid").alias("n_patients"), F.count("admit_date").alias("n_dated")
    )


FOUND = """(VALUES ('orders', '<table>', 1, 'orders'), ('orders', 'key', 1, 'o_orderkey'), ('orders', 'date', 1, 'o_orderdate'), ('orders', 'clock', 0, NULL),
  ('lineitem', '<table>', 1, 'lineitem'), ('lineitem', 'key', 1, 'l_orderkey'), ('lineitem', 'stop', 0, NULL), ('customer', '<table>', 1, 'customer'),
  ('customer', 'key', 1, 'c_custkey'), ('death', '<table>', 0, NULL), ('death', 'key', 0, NULL)) v(source, requirement, present, found)"""


@query(
    "preflight_report",
    "S11 S3",
    f"""SELECT v.source, requirement, present, found, n_rows::DOUBLE AS n_rows FROM {FOUND} LEFT JOIN (
      SELECT 'orders' AS source, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer) c USING (source)""",
)
def preflight_report(spark, folder):
    have = {n: tables.column_names(spark, f"{folder}/{n}.parquet") for n in ("orders", "lineitem", "customer")}
    required = {
        "orders": {"key": ["ORDERKEY", "O_ORDERKEY"], "date": ["O_ORDERDATE"], "clock": ["O_ORDERTIME"]},
        "lineitem": {"key": ["L_ORDERKEY"], "stop": ["L_STOPDATE"]},
        "customer": {"key": ["C_CUSTKEY"]},
        "death": {"key": ["PATID"]},
    }
    report = preflight.check_columns(spark, have, required)
    # Row counts come with the report, so an empty table shows as well.
    counts = None
    for name in have:
        row = ro.table(spark, folder, name).agg(F.lit(name).alias("source"), F.count("*").alias("n_rows"))
        counts = row if counts is None else counts.unionByName(row)
    return report.join(F.broadcast(counts), "source", "left").withColumn("n_rows", F.col("n_rows").cast("double"))


@query(
    "csv_round_trip",
    "S1 S7",
    """SELECT o_orderstatus, count(*) AS n, count(o_orderdate) AS n_dated, round(sum(o_totalprice), 2) AS total, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_date
       FROM orders GROUP BY 1""",
)
def csv_round_trip(spark, folder):
    path = f"{shared_dir(spark)}/tideline-{uuid.uuid4().hex}"
    order = ro.table(spark, folder, "orders")
    tables.write_result(order, path)
    return tables.read_csv(spark, path, order.schema).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count("o_orderdate").alias("n_dated"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        ro.stamp(F.max("o_orderdate")).alias("last_date"),
    )


@query(
    "cohort_checkpoint",
    "S8",
    ro.with_sql(ro.PEOPLE_SQL)
    + "SELECT c_mktsegment, count(*) AS n, CAST(sum(n_orders) AS BIGINT) AS n_orders FROM people GROUP BY 1",
)
def cohort_checkpoint(spark, folder):
    kept = tables.save_cohort(ro.people(spark, folder), f"{shared_dir(spark)}/tideline-{uuid.uuid4().hex}")
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("n_orders").alias("n_orders"))
