import gzip
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import audits as au
from tideline.operators import linkage as lk
from tideline.sources import preflight, schemas, tables

D0 = date(2024, 1, 1)


@pytest.fixture(scope="module")
def linked(spark):
    """A hot patient owns a third of the rows; encounters and sources are partly missing."""
    rng = random.Random(5)
    pick = lambda: 1 if rng.random() < 0.34 else rng.randrange(2, 12)
    cultures = [
        (pick(), rng.choice([None, 10, 11]), D0 + timedelta(days=rng.randrange(30)), rng.choice(["blood", "urine"]), rng.choice(["A", "B", lk.MISSING]))
        for _ in range(150)
    ]
    follow = [
        (pick(), rng.choice([None, 10, 11]), D0 + timedelta(days=rng.randrange(40)), rng.choice(list(lk.TYPES.values())), rng.choice(["A", "B", lk.MISSING]), rng.randrange(2))
        for _ in range(150)
    ]
    c = spark.createDataFrame(cultures, "patid int, encounterid int, specimen_date date, culture_group string, specimen_source string")
    f = spark.createDataFrame(follow, "patid int, encounterid int, result_date date, followup_type string, specimen_source string, has_nonblank_result int")
    return cultures, follow, c, f


def test_rule_totals_match_pairwise_search(spark, linked):
    cultures, follow, c, f = linked
    units = ["patid", "encounterid", "specimen_date", "culture_group", "specimen_source"]
    got = {r["linkage_rule"]: (r["linked_units"], r["organism_units"], r["susceptibility_units"]) for r in lk.rule_totals(lk.linked_units(c, f, units)).collect()}
    for rule, (level, days, nonblank) in lk.RULES.items():
        hit = {None: set(), **{t: set() for t in lk.TYPES.values()}}
        for u in set(cultures):
            for p, e, d, t, s, nb in follow:
                ok = p == u[0] and 0 <= (d - u[2]).days <= days and (not nonblank or nb)
                if level != "patient":
                    ok = ok and e is not None and e == u[1]
                if level == "specimen":
                    ok = ok and s == u[4] and s != lk.MISSING
                if ok:
                    hit[None].add(u)
                    hit[t].add(u)
        assert got[rule] == (len(hit[None]), len(hit[lk.TYPES["organism"]]), len(hit[lk.TYPES["susceptibility"]])), rule


def test_null_tolerant_exists(spark, linked):
    cultures, follow, c, f = linked
    got = sorted((r["patid"], r["encounterid"] or 0, r["specimen_date"], r["hit"]) for r in lk.exists_null_tolerant(c, f, "patid", "encounterid", "result_date", 7, "hit").collect())
    want = sorted(
        (p, e or 0, d, int(any(fp == p and 0 <= (fd - d).days <= 7 and (fe == e or e is None or fe is None) for fp, fe, fd, *_ in follow)))
        for p, e, d, *_ in cultures
    )
    assert got == want


def test_linkage_plans_have_no_pair_joins(spark, linked):
    _, _, c, f = linked
    units = ["patid", "encounterid", "specimen_date", "culture_group", "specimen_source"]
    plan = lk.rule_totals(lk.linked_units(c, f, units))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_csv_gz_to_parquet(spark, tmp_path):
    path = str(tmp_path / "admissions.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("race,hadm_id,subject_id,admittime,dischtime,deathtime,hospital_expire_flag,extra\n")
        f.write("WHITE,10,1,2150-01-01 10:00:00,2150-01-09 11:00:00,,0,x\nOTHER,11,2,bad,2150-02-01 00:00:00,,1,y\n")
    schema = schemas.HOUR_SITE["hosp/admissions"]
    got = tables.read_table(spark, path, schema=schema).orderBy("hadm_id").collect()
    assert got[0]["admittime"].isoformat() == "2150-01-01T10:00:00" and got[1]["admittime"] is None and got[1]["hospital_expire_flag"] == 1
    target = str(tmp_path / "admissions.parquet")
    tables.convert_to_parquet(spark, path, target, schema, 2)
    assert tables.read_table(spark, target, ["hadm_id"]).count() == 2
    assert tables.column_names(spark, target) == schema.names
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")
    out = str(tmp_path / "result")
    tables.write_result(spark.range(3), out)
    assert spark.read.option("header", True).csv(out).count() == 3
    saved = tables.save_cohort(spark.range(4), str(tmp_path / "cohort"))
    assert saved.count() == 4
    with pytest.raises(Exception):
        tables.save_cohort(spark.range(4), str(tmp_path / "cohort"))


def test_column_resolution_and_checks(spark):
    df = spark.createDataFrame([(1, 2)], "PatID int, ENCOUNTER_ID int")
    got = tables.canonical(df, {"patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "time": ["NOPE"]})
    assert got.columns == ["patid", "encounterid", "time"] and got.first()["time"] is None
    with pytest.raises(ValueError):
        tables.canonical(df, {"death": ["DEATH_DATE"]})
    right = spark.createDataFrame([(1, 5), (1, 6)], "PatID int, v int")
    with pytest.raises(ValueError):
        tables.one_to_one(df, right, ["PatID"])
    report = preflight.check_columns(spark, {"a": ["X", "y"]}, {"a": {"x": ["x"], "z": ["z"]}, "b": {"k": ["k"]}})
    assert {(r["source"], r["requirement"]): r["present"] for r in report.collect()} == {
        ("a", "<table>"): 1, ("a", "x"): 1, ("a", "z"): 0, ("b", "<table>"): 0, ("b", "k"): 0,
    }
    maps = preflight.check_mappings(spark, {"icu": {"patid": "P"}}, {"icu": ["patid", "careunit"], "medications.columns": ["code"]})
    assert sorted((r["source"], r["requirement"], r["present"]) for r in maps.collect()) == [("icu", "careunit", 0), ("icu", "patid", 1), ("medications.columns", "code", 0)]


def test_parity_and_gate(spark):
    expected = spark.createDataFrame([("n", 10.0), ("rd", 0.1), ("gone", 1.0)], "m string, expected double")
    observed = spark.createDataFrame([("n", 10.0), ("rd", 0.10005)], "m string, observed double")
    got = {r["m"]: r["passes"] for r in au.parity_check(observed, expected, ["m"], F.when(F.col("m") == "n", 0.0).otherwise(1e-4)).collect()}
    assert got == {"n": 1, "rd": 1, "gone": 0}
    facts = spark.createDataFrame([(0.2, 10.0)], "smd double, w double")
    gate = {r["rule"]: r["passes"] for r in au.run_gate(facts, {"smd": ("smd", "<=", 0.1), "weight": ("w", "<=", 50)}).collect()}
    assert gate == {"smd": 0, "weight": 1}


def test_nearest_follow_reads_days_across_runs_and_spreads_a_row_twice(spark):
    rng = random.Random(9)
    day = lambda: date(1969, 12, 20) + timedelta(days=rng.randrange(40))
    rows = [(rng.choice([1, 2, None]), day()) for _ in range(80)]
    follow = [(rng.choice([1, 2, 3]), day() if rng.random() < 0.9 else None, rng.choice([True, False, None])) for _ in range(12)]
    r, f = spark.createDataFrame(rows, "k int, specimen_date date"), spark.createDataFrame(follow, "k int, d date, ok boolean")
    for most in (0, 1, 7, 30):
        out = lk.nearest_follow(r, f, ["k"], "d", most, {"ok_days": F.col("ok"), "days": F.lit(True)})
        for x in out.collect():
            gaps = {ok: [(d - x.specimen_date).days for k, d, o in follow if k == x.k and d is not None and 0 <= (d - x.specimen_date).days <= most and (o or not ok)] for ok in (True, False)}
            assert (x.ok_days, x.days) == (min(gaps[True], default=None), min(gaps[False], default=None))
    assert out.count() == len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # However long the window, a follow-up row is spread over two runs.
    assert plan.count("Generate explode(array(") == 1 and plan.count("Join") == 1
    with pytest.raises(ValueError):
        lk.nearest_follow(r, f, ["k"], "d", 31, {"days": F.lit(True)})
