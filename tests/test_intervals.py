import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators import cohort as co
from tideline.operators import intervals as iv
from tideline.operators import outcomes as oc

T0 = datetime(2024, 1, 1)


def hours(h):
    return T0 + timedelta(hours=h)


def test_missing_stop_then_invalid_stop(spark):
    df = spark.createDataFrame([(1, T0, None), (2, T0, hours(-1)), (3, T0, hours(5))], "id int, starttime timestamp_ntz, stoptime timestamp_ntz")
    got = {r["id"]: ((r["coverage_stop"] - r["coverage_start"]).total_seconds() / 3600, r["missing_stop_assumed"]) for r in iv.prepare_coverage(df).collect()}
    assert got == {1: (24.0, 1), 2: (1.0, 0), 3: (5.0, 0)}


def test_window_edges(spark):
    # window [72, 96); an interval ending at 72 or starting at 96 touches only under closed rules
    df = spark.createDataFrame([(1, hours(0), hours(72)), (2, hours(96), hours(99)), (3, hours(71), hours(73))], "id int, s timestamp_ntz, e timestamp_ntz")
    lo, hi = F.lit(hours(72)).cast("timestamp_ntz"), F.lit(hours(96)).cast("timestamp_ntz")
    got = {
        rule: [r["id"] for r in df.where(iv.overlaps("s", "e", lo, hi, rule)).orderBy("id").collect()] for rule in ("neither", "both", "stop")
    }
    assert got == {"neither": [3], "both": [1, 2, 3], "stop": [1, 3]}


def brute_days(t0, intervals, horizon):
    return {
        d for d in range(horizon)
        if any(s < t0 + timedelta(days=d + 1) and e > t0 + timedelta(days=d) for s, e in intervals)
    }


def test_touched_bins_and_runs_match_brute_force(spark):
    rng = random.Random(3)
    people = [(i, hours(rng.randrange(0, 24))) for i in range(60)]
    events, truth = [], {}
    for i, t0 in people:
        mine = []
        for _ in range(rng.randrange(0, 5)):
            s = t0 + timedelta(hours=rng.choice([-48, -24, 0, 24, 168, 190, 300, 600, 719, 720]) + rng.choice([0, 0, 1, 5]))
            mine.append((s, s + timedelta(hours=rng.choice([1, 23, 24, 48, 72, 200]))))
        events += [(i, s, e) for s, e in mine]
        truth[i] = brute_days(t0, mine, 30)
    cohort = spark.createDataFrame(people, "id int, t0 timestamp_ntz")
    meds = spark.createDataFrame(events, "id int, coverage_start timestamp_ntz, coverage_stop timestamp_ntz")
    bins = iv.touched_bins(meds, cohort, "id", "t0", 30)
    got = {}
    for r in bins.collect():
        got.setdefault(r["id"], set()).add(r["day_idx"])
    assert got == {k: v for k, v in truth.items() if v}
    runs = {r["id"]: r["has_run"] for r in iv.longest_run_flag(bins, ["id"], 7, 27).collect()}
    leads = {r["id"]: r["has_run"] for r in oc.lead_triplets(oc.day_grid(cohort, ["id"], bins), ["id"]).collect()}
    for i, days in truth.items():
        want = int(any({s, s + 1, s + 2} <= days for s in range(7, 28)))
        assert runs.get(i, 0) == want and leads[i] == want


def test_overlap_hours_double_count(spark):
    cohort = spark.createDataFrame([(1, hours(72), hours(96))], "id int, decision_time timestamp_ntz, analysis_time0 timestamp_ntz")
    rows = [(1, hours(70), hours(80), True, True), (1, hours(75), hours(200), True, True), (1, hours(90), hours(91), False, True)]
    meds = spark.createDataFrame(rows, "id int, coverage_start timestamp_ntz, coverage_stop timestamp_ntz, is_broad boolean, is_any boolean")
    got = co.classify_treatment(cohort, meds, "id").first()
    assert got["A"] == 0 and got["broad_overlap_hours_72_96"] == 8.0 + 21.0 and got["deescalation_type"] == "continued_broad"


def test_first_anchor_bounds(spark):
    ent = spark.createDataFrame([(1, hours(0)), (2, hours(0)), (3, hours(0))], "id int, ref timestamp_ntz")
    ev = spark.createDataFrame([(1, hours(-6)), (1, hours(3)), (2, hours(24)), (3, hours(25))], "id int, s timestamp_ntz")
    closed = {r["id"] for r in co.first_anchor(ev, ent, "id", "s", "ref").collect()}
    half = {r["id"] for r in co.first_anchor(ev, ent, "id", "s", "ref", closed="left").collect()}
    assert closed == {1, 2} and half == {1}


def test_first_row_puts_missing_order_last(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, hours(2), "y"), (1, hours(1), "z"), (2, None, "only")], "id int, t timestamp_ntz, v string")
    assert {r["id"]: r["v"] for r in co.first_row(df, ["id"], ["t"]).collect()} == {1: "z", 2: "only"}


def test_attrition_never_increases(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    flow = co.attrition(df, {"all": F.lit(True), "a": F.col("x") > 1, "b": F.col("x") > 3}, {"last": F.col("x") == 6})
    n = [r["n"] for r in co.attrition_losses(flow).orderBy("stage").collect()]
    assert n[0] == 100 and all(a >= b for a, b in zip(n, n[1:]))
