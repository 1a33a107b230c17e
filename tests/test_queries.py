"""A sample of registered queries against DuckDB, and the shape of their plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.plans import catalog
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "anchor_first_event", "treatment_classes", "two_clock_eligibility", "linkage_rules", "lab_trajectory_features", "touched_days",
    "decode_time_fields", "iptw_logit", "bootstrap_strategies", "item_summary", "bootstrap_median_strategies", "subtype_contrasts", "weighting_comparison",
    "vital_repair", "vital_change", "run_gate", "robustness_variants", "drug_mapping_counts", "outcome_feasibility", "date_site_bundle", "date_site_flow",
    "category_flags",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    q = catalog.QUERIES[name]
    df = q.build(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got, want = df.toPandas(), con.execute(q.sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert canonical(got) == canonical(want)


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["analysis", "outcome", "kind", "treated", "control", "difference", "ratio"]
    assert set(catalog.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_contrasts_draw_the_replicates_of_the_study(spark, monkeypatch):
    from tideline.operators import sensitivity as se
    from tideline.plans import site_hour

    drawn = []

    def limits(df, fits, outcome, ids, reps, seed, tasks):
        drawn.append(reps)
        return spark.createDataFrame([], "analysis int, estimand string, lower_95 double, upper_95 double")

    monkeypatch.setattr(se, "model_intervals", limits)
    catalog.QUERIES["subtype_contrasts"].build(spark, FOLDER)
    assert drawn == [site_hour.HourConfig.reps] == [1000]
    assert catalog.QUERIES["subtype_contrasts"].sql.count("unnest(range(1000))") == 5


def test_scan_reads_only_needed_columns(spark):
    plan = catalog.QUERIES["overlap_halfopen"].build(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert reads and not any("l_tax" in line or "o_totalprice" in line for line in reads)


def test_hot_entity_join_is_split(spark):
    """One entity with most of the rows: AQE reads its join partition in slices."""
    from pyspark.sql import functions as F

    from tideline.operators.intervals import overlap_profile

    old = {
        k: spark.conf.get(k)
        for k in (
            "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        )
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    try:
        events = spark.range(0, 400_000, 1, 8).select(
            F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("pad")
        )
        cohort = spark.range(50).select(F.col("id").alias("k"), F.lit(200_000).alias("hi"))
        out = overlap_profile(events, cohort, "k", {"hit": F.col("t") < F.col("hi")}, {"chars": F.length("pad")}, window_cols=["hi"])
        rows = {r["k"]: (r["hit"], r["chars"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skewed" in plan
        assert rows[7][0] == 1 and sum(c for _, c in rows.values()) == 400_000 * 64
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["attrition_flow", "stop_fill_sensitivity", "landmark_effect", "overlap_hours_agents"])
def test_one_scan_of_the_facts_and_no_expand(spark, name):
    """However many windows, fills and counts a query has, the interval source is read and joined once."""
    plan = catalog.QUERIES[name].build(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line and "l_orderkey" in line]
    assert len(scans) == 1, plan
    assert "Expand" not in plan


@pytest.mark.parametrize("name", ["coverage_prepare", "agent_route_counts", "diagnostic_intensity"])
def test_tasks_do_not_grow_with_the_input(spark, monkeypatch, name):
    """Shuffle partitions and parts of files follow from the input's size, so more input gives more tasks, not larger ones."""
    from tideline import session

    monkeypatch.setattr(session, "INPUT_BYTES", 8 << 10)
    monkeypatch.setattr(session, "TASK_BYTES", 16 << 10)
    catalog.QUERIES[name].build(spark, FOLDER)
    bytes_read = sum(os.path.getsize(f"{FOLDER}/{t}.parquet") for t in ("customer", "supplier", "part", "orders", "lineitem", "events"))
    rows = catalog.QUERIES[name].build(spark, FOLDER)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    want = str(-(-bytes_read // (8 << 10)))
    assert exchanges and all(f", {want})" in line or f", {want}," in line for line in exchanges), exchanges
    scan = spark.read.parquet(f"{FOLDER}/lineitem.parquet").rdd.getNumPartitions()
    assert scan == -(-os.path.getsize(f"{FOLDER}/lineitem.parquet") // (16 << 10))
    monkeypatch.undo()
    session.size_shuffles(spark, FOLDER, ())
