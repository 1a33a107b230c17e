"""Models fitted together against the same models fitted one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import audits as au
from tideline.operators import features as ft
from tideline.operators import resample as rs
from tideline.operators import sensitivity as se
from tideline.operators import several as sv
from tideline.operators import weighting as wt
from tideline.session import stage_border


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=n)
    d = pd.DataFrame({"id": np.arange(n), "x": x, "z": rng.normal(3, 2, n), "b": rng.integers(0, 2, n).astype(float), "k": 7.0})
    d["A"] = (rng.random(n) < 1 / (1 + np.exp(-0.7 * x))).astype(int)
    d["T"] = rng.integers(0, 2, n)
    d["y"] = (rng.random(n) < 0.3).astype(float)
    d["part"] = (np.arange(n) % 3 > 0).astype(int)
    d["none"] = 0
    d.loc[::7, "z"] = np.nan
    d.loc[::11, "y"] = np.nan
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in d.itertuples(index=False)]
    return stage_border(spark.createDataFrame(rows, "id long, x double, z double, b double, k double, A int, T int, y double, part int, none int").repartition(5))


MODELS = [
    sv.Model.over("one", ["x"]), sv.Model.over("all", ["x", "z", "b", "k", "absent"]), sv.Model.over("part", ["x", "z"], rows="part"),
    sv.Model.over("other", ["x", "b"], treat="T", rows="part"), sv.Model.over("square", ["x", "z"], squares=("x",)), sv.Model.over("swapped", ["x", "b"], {"x": "z"}),
]
ALONE = {"one": (["x"], "A", None, ()), "all": (["x", "z", "b", "k", "absent"], "A", None, ()), "part": (["x", "z"], "A", "part = 1", ()), "other": (["x", "b"], "T", "part = 1", ()), "square": (["x", "z"], "A", None, ("x",)), "swapped": (["z", "b"], "A", None, ())}


def test_coefficients_are_those_of_single_fits(cohort):
    fits = sv.fit_models(cohort, MODELS)
    for i, m in enumerate(MODELS):
        columns, treat, rows, squares = ALONE[m.name]
        alone = wt.fit_weights(cohort.where(rows) if rows else cohort, columns, treat, quadratic=squares)
        assert np.allclose(fits.beta[i], alone.fit.beta[0], atol=1e-8), m.name
        assert fits.method[i] == "glm" and abs(fits.share(i) - alone.prevalence) < 1e-12


def test_a_newton_step_is_one_scan_for_all_models(cohort, monkeypatch):
    seen, real = [], sv.summed_rows

    def counted(df, kernel, tasks=None):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append(plan.count("FileScan"))
        return real(df, kernel, tasks)

    monkeypatch.setattr(sv, "summed_rows", counted)
    fits = sv.fit_models(cohort, MODELS)
    assert len(seen) == fits.passes < 12 and set(seen) == {1}


def test_summaries_match_effects_balance_and_sizes(cohort):
    got = se.summaries(cohort, MODELS, "y").toPandas().set_index("analysis")
    for m in MODELS:
        columns, treat, rows, squares = ALONE[m.name]
        w = wt.fit_weights(cohort.where(rows) if rows else cohort, columns, treat, quadratic=squares)
        eff = wt.effect_table(w.df, {"y": "risk"}, {"w": "SW_A"}, treat).first()
        bal = wt.worst_balance(wt.balance_table(w.df, columns, {"w": "SW_A"}, treat)).first()
        one = F.col(treat) == 1
        facts = w.df.agg(
            F.count("*").alias("n"), F.count_if(one).alias("t"), wt.effective_size(F.when(one, F.col("SW_A"))).alias("et"),
            wt.effective_size(F.when(~one, F.col("SW_A"))).alias("ec"), F.max("SW_A").alias("mw"), F.min("ps_den").alias("lo"), F.max("ps_den").alias("hi"),
        ).first()
        r = got.loc[m.name]
        assert np.allclose([r.treated, r.control, r.difference, r.ratio], [eff["treated"], eff["control"], eff["difference"], eff["ratio"]], atol=1e-9), m.name
        assert np.allclose([r.max_post_smd, r.ess_treated, r.ess_control, r.max_weight, r.ps_min, r.ps_max], [bal["max_post_smd"], *facts[2:]], atol=1e-7), m.name
        assert (r.n, r.n_treated, r.n_control) == (facts["n"], facts["t"], facts["n"] - facts["t"])
    # The swapped covariate keeps its name in the model.
    assert got.loc["swapped", "worst_balanced_variable"] in ("x", "b") and got.loc["all", "n_vars_used"] == 3


def test_intervals_are_those_of_single_bootstraps(cohort, monkeypatch):
    some = [MODELS[0], MODELS[2], MODELS[3]]
    got = se.summaries(cohort, some, "y", se.Boot(("id",), 5, 3)).toPandas().set_index("analysis")
    for m in some:
        columns, treat, rows, _ = ALONE[m.name]
        table, _ = rs.bootstrap_table(cohort.where(rows) if rows else cohort, ["id"], columns, {"y": "risk"}, 5, 3, treat)
        want = {r["estimand"]: r for r in rs.interval_table(table.where("analysis = 'stabilized'"), 5).collect()}
        r = got.loc[m.name]
        assert np.allclose(
            [r.rd_lower_95, r.rd_upper_95, r.rr_lower_95, r.rr_upper_95],
            [want["difference"]["lower_95"], want["difference"]["upper_95"], want["ratio"]["lower_95"], want["ratio"]["upper_95"]], atol=1e-7,
        ), m.name
    # Batches of replicates give the same.
    monkeypatch.setattr(sv, "TASK_BUDGET", 12)
    again = se.summaries(cohort, MODELS[:1], "y", se.Boot(("id",), 5, 3)).first()
    assert np.allclose([got.loc["one", c] for c in se.INTERVALS], [again[c] for c in se.INTERVALS], atol=1e-9)


def test_subsets_with_few_rows_or_one_arm_are_reported(cohort):
    subsets = {"half": se.Subset(F.col("part") == 1), "recoded": se.Subset(F.col("x").isNotNull(), F.col("T")), "empty": se.Subset(F.col("none") == 1), "one arm": se.Subset(F.col("A") == 1)}
    got = se.sensitivity_set(cohort, subsets, ["x", "b"], "y").toPandas().set_index("analysis")
    assert got.status.to_dict() == {"half": "ok", "recoded": "ok", "empty": "not_run", "one arm": "not_run"}
    assert got.loc["half", "n"] == 400 and got.loc["empty", "n"] == 0 and got.loc["one arm", "n"] > 100
    with pytest.raises(ValueError):
        se.summary_row(cohort.where("A = 1"), ["x"], "a", "y")


def test_comparison_prunes_copies_and_adds_the_quadratic_row(cohort):
    out, pruned = se.weighting_comparison(cohort.withColumn("x2", F.col("x")), ["id"], ["x", "x2", "z", "b"], "y", ["z"])
    got = out.toPandas().set_index("analysis")
    assert pruned == [("x", "x2")] and len(got) == 5
    q = wt.fit_weights(cohort, ["x", "z", "b"], quadratic=["z"])
    eff = wt.effect_table(q.df, {"y": "risk"}, {"w": "SW_A"}).first()
    assert abs(got.loc["Quadratic PS sensitivity", "difference"] - eff["difference"]) < 1e-9


def narrowed(spark, values, reps, probs, monkeypatch=None, parts=6):
    rows = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, v double")
    table = stage_border(rows.repartition(parts).withColumns(rs.row_hashes(["id"], 9)))
    known = [v for v in values if v is not None and v == v]
    lo, hi = np.array([min(known, default=0.0)]), np.array([max(known, default=0.0)])
    got = rs.replicate_quantiles(table, rs.kn.Series(["v"]), np.arange(reps), probs, lo, hi)[0]
    held = table.toPandas().sort_values("id")
    m = rs.kn.multiplicities(held._h1.to_numpy(), held._h2.to_numpy(), np.arange(reps)).astype(int)
    v = held.v.to_numpy(float)
    want = np.array([np.quantile(np.repeat(v[~np.isnan(v)], m[~np.isnan(v), r]), probs) for r in range(reps)])
    return got, want


def test_replicate_quantiles_of_awkward_values(spark, monkeypatch):
    rng = np.random.default_rng(1)
    probs = [0.0, 0.01, 0.5, 0.975, 1.0]
    cases = [
        list(rng.normal(size=3000)) + [1e12], [-1e300, 0.0, -0.0, 5e-324, 1e300] * 40, [3.0] * 500 + [None, float("nan")] * 20,
        list(rng.integers(-3, 3, 2000)), [1.0, 1e12] * 300,
    ]
    for values, small in zip(cases, (4096, 8, 4096, 4096, 8)):
        monkeypatch.setattr(rs, "SLIVER", small)
        got, want = narrowed(spark, values, 3, probs)
        assert np.allclose(got, want, rtol=1e-12, atol=0), values[:3]


def test_a_far_outlier_leaves_a_bounded_last_bin(spark, monkeypatch):
    table = spark.range(1_000_000).select("id", F.when(F.col("id") == 5, 1e12).otherwise(F.xxhash64("id") / 1e15).alias("v"))
    table = stage_border(table.repartition(8).withColumns(rs.row_hashes(["id"], 2)))
    rows, real = [], rs._ranked_slivers

    def counted(table, series, reps, a, b, open_, start, rank):
        schema = "s int, r int, k int, v double, m long"
        kernel = rs.partial(rs.kn.sliver_rows, series=series, reps=reps, lo=a, hi=b, live=open_)
        rows.extend(r["m"] for r in table.mapInPandas(kernel, schema).groupBy("s", "r", "k").agg(F.sum("m").alias("m")).collect())
        return real(table, series, reps, a, b, open_, start, rank)

    monkeypatch.setattr(rs, "_ranked_slivers", counted)
    edge = table.agg(F.min("v"), F.max("v")).first()
    got = rs.replicate_quantiles(table, rs.kn.Series(["v"]), np.arange(2), [0.5], np.array([edge[0]]), np.array([edge[1]]))
    assert rows and max(rows) <= rs.SLIVER
    held = table.toPandas()
    m = rs.kn.multiplicities(held._h1.to_numpy(), held._h2.to_numpy(), np.arange(2)).astype(int)
    assert np.allclose(got[0, :, 0], [np.quantile(np.repeat(held.v, m[:, r]), 0.5) for r in range(2)], rtol=1e-12)


def test_vectors_are_added_with_a_fixed_fan_in(spark, monkeypatch):
    from tideline.operators import logit as lg

    table = stage_border(spark.range(400).select(F.lit(1.0).alias("A"), F.col("id").cast("double").alias("x")).repartition(40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        monkeypatch.setattr(lg, "FAN_IN", 3)
        kernel = rs.partial(rs.kn.moment_sums, columns=["x"], centre=np.array([0.0]), reps=None)
        assert lg.count_tasks(table) > 9
        assert lg.summed_vectors(table, kernel, None, 1)[0].tolist() == [400.0, 400.0, 400.0, 79800.0, float(sum(i * i for i in range(400)))]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gate_passes_and_fails_by_rule(cohort):
    w = wt.fit_weights(cohort, ["x", "b"])
    bal = wt.balance_table(w.df, ["x", "b"])
    boot = cohort.sparkSession.createDataFrame([("s", "y", "difference", 100), ("s", "z", "difference", 90), ("s", "z", "ratio", 1)], "analysis string, outcome string, estimand string, n_success long")
    gate = lambda **k: {r["rule"]: (r["severity"], r["passes"]) for r in au.study_gate(w.df, bal, boot, au.GateLimits(**k)).collect()}
    assert gate() == {
        "n": ("warning", 0), "n_treated": ("error", 1), "n_control": ("error", 1), "max_weight": ("warning", 1), "non_finite_weights": ("error", 1),
        "max_post_smd": ("error", 1), "bootstrap_success": ("warning", 0),
    }
    flipped = gate(rows=10, arm=10**6, smd=-1.0, weight=0.1, success=0.9)
    assert {k: v for k, (_, v) in flipped.items()} == {
        "n": 1, "n_treated": 0, "n_control": 0, "max_weight": 0, "non_finite_weights": 1, "max_post_smd": 0, "bootstrap_success": 1,
    }
    broken = w.df.withColumn("SW_A", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("SW_A")))
    assert [r["passes"] for r in au.study_gate(broken, bal, boot).where("rule = 'non_finite_weights'").collect()] == [0]
    nothing = au.study_gate(w.df.where("id < 0"), bal.where("false"), boot.where("false")).collect()
    assert all(r["passes"] == 0 for r in nothing if r["rule"] != "non_finite_weights")


def test_changed_rows_and_their_sizes(spark):
    df = spark.createDataFrame(
        [(1, 98.6, 37.0), (2, 98.6, 39.0), (3, 37.0, 37.05), (4, None, 36.0), (5, 36.0, None), (6, None, None)], "id int, temp_max_pre72 double, new_temp_max_pre72 double"
    )
    out = ft.repair_change(df, {"temp_max_pre72": ("temp_max_pre72", "new_temp_max_pre72")}, ["id"])
    assert sorted((r["id"], r["old"], r["new"], r["change"]) for r in out.where("change is not null").collect()) == [(2, 37.0, 39.0, 2.0), (3, 37.0, 37.05, 0.05)]
    assert sorted(r["id"] for r in out.collect()) == [2, 3, 4, 5]
    assert tuple(ft.change_sizes(out).first()) == ("temp_max_pre72", 4, 1, 1, 1, 1, 2.0)


def test_parts_without_rows_say_nothing(spark):
    """A part of a file between two row groups has no rows; Arrow finds no type for an empty list column."""
    from functools import partial

    from tideline.operators import kernels as kn

    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.random() < 0.5), float(rng.normal()), int(rng.random() < 0.3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, A int, x double, y int").repartition(1)
    few = df.repartition(4, "A").where("A = 1").union(df.repartition(4, "A").where("A = 0"))
    assert min(few.rdd.glom().map(len).collect()) == 0
    fits = sv.fit_models(few, [sv.Model.over("m", ["x"])])
    got = sv.model_rows(few, fits, "y", 4)
    assert got[0]["n"] == 60 and np.allclose(fits.beta[0], sv.fit_models(df, [sv.Model.over("m", ["x"])]).beta[0])
    plan = kn.Plan(fits.plans[0].design, "A")
    for kernel in (partial(kn.model_moments, plans=[plan], centres=[np.zeros(1)], reps=None), partial(kn.model_newton, plans=[plan], beta=fits.beta, reps=None, live=np.array([0]))):
        assert list(kernel(iter([]))) == []


def test_python_tasks_read_the_columns_of_the_models_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i}", int(rng.random() < 0.5), float(rng.normal()), int(rng.random() < 0.3), 1, "long text") for i in range(80)]
    df = spark.createDataFrame(rows, "id string, A int, x double, y int, ok int, note string")
    facts = sv.profile_models(df, [sv.Model.over("m", ["x"], rows="ok")])
    plans, _ = sv._plans([sv.Model.over("m", ["x"], rows="ok")], facts)
    assert sv.slim(df, plans, "y").dtypes == [("x", "double"), ("A", "double"), ("ok", "double"), ("y", "double")]
    seen = []
    original = sv.summed_rows
    sv.summed_rows = lambda read, *a: seen.append(read.columns) or original(read, *a)
    try:
        fits = sv.fit_models(df, [sv.Model.over("m", ["x"], rows="ok")])
        sv.model_intervals(df, fits, "y", ["id"], 3, 1, 1).collect()
    finally:
        sv.summed_rows = original
    assert seen and not any("note" in c or "id" in c for c in seen)


def test_replicates_together_are_those_taken_one_by_one():
    """Missing values, values that some replicates clip, squares and restricted rows; runs of rows shorter than a batch."""
    from tideline.operators import kernels as kn
    from tideline.operators.logit import build_design

    rng = np.random.default_rng(6)
    n, reps = 400, np.arange(3, 23)
    d = pd.DataFrame({"x": rng.normal(5, 2, n), "z": rng.exponential(1, n), "b": rng.integers(0, 2, n) * 1.0, "A": rng.integers(0, 2, n) * 1.0, "k": rng.integers(0, 2, n) * 1.0})
    d["y"] = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 2, n))
    d.loc[:3, "x"] = [300.0, -200.0, 1e5, 21.1]
    d.loc[::9, "z"] = np.nan
    d["_h1"], d["_h2"] = rng.integers(0, 2**32, n), rng.integers(0, 2**32, n)
    mean = np.column_stack([rng.normal(5, 0.1, len(reps)), rng.normal(1, 0.1, len(reps)), np.zeros(len(reps))])
    sd = np.column_stack([rng.normal(2, 0.1, len(reps)), rng.normal(1, 0.1, len(reps)), np.ones(len(reps))])
    flags = [False, False, True]
    plans = [kn.Plan(build_design(["x", "z", "b"], flags, mean + 0.1, mean, sd, squares), "A", rows) for squares, rows in (((), None), ((1,), "k"), ((), "k"))]
    beta = [rng.normal(0, 0.3, p.design.width) for p in plans for _ in reps]
    live = np.sort(rng.choice(len(beta), 40, replace=False))
    share, valid = rng.random(len(beta)), rng.random(len(beta)) < 0.8
    whole, kn.BLOCK = kn.BLOCK, 16 * len(reps)
    try:
        newton = pd.concat(kn.model_newton(iter([d[:150], d[150:]]), plans, beta, reps, live)).set_index("rep")["vec"]
        effects = pd.concat(kn.model_effects(iter([d]), plans, beta, share, reps, "y", valid)).set_index(["model", "rep"])
    finally:
        kn.BLOCK = whole
    assert set(newton.index) == set(live) and len(effects) == valid.sum()
    for f in range(len(beta)):
        i, r = divmod(f, len(reps))
        part = d if plans[i].rows is None else d[d["k"] == 1]
        one = kn.Design(*[x[[r]] if isinstance(x, np.ndarray) and x.ndim == 2 else x for x in vars(plans[i].design).values()])
        if f in newton.index:
            want = next(kn.newton_sums(iter([part]), one, np.array([beta[f]]), reps[[r]], np.array([0])))["vec"].iloc[0]
            assert np.allclose(newton[f], want, rtol=1e-10, atol=1e-9)
        if valid[f]:
            none = np.zeros((1, 0, 2))
            want = next(kn.effect_sums(iter([part]), one, np.array([beta[f]]), share[[f]], reps[[r]], ["y"], none, ["stabilized", "overlap"], np.array([True])))
            assert np.allclose(effects.loc[(i, reps[r])], want[want["analysis"] == "stabilized"][["w0", "wy0", "w1", "wy1"]].iloc[0].astype(float), rtol=1e-10)


def test_staged_tables_hold_what_the_models_read(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.5), float(rng.normal()), int(rng.random() < 0.3), "long text") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, A int, x double, y int, note string")
    staged = []
    monkeypatch.setattr(se, "stage_border", lambda t: staged.append(t.columns) or stage_border(t))
    se.ablation(df, {"all": ({}, ["x"]), "doubled": ({"x": F.col("x") * 2}, ["x"])}, "y").collect()
    got = se.sensitivity_set(df, {"even": se.Subset(F.col("id") % 2 == 0)}, ["x"], "y", boot=se.Boot(("id",), 2, 1)).collect()
    assert got[0]["n"] == 120
    assert [sorted(c) for c in staged] == [["A", "_swap1_x", "x", "y"], ["A", "_rows0", "id", "x", "y"]]
