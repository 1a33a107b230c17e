import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import kernels as kn
from tideline.operators import logit as lg
from tideline.operators import order_stats as os_
from tideline.operators import resample as rs
from tideline.operators import weighting as wt


def newton(x, y, m=None, alpha=0.0):
    m = np.ones(len(y)) if m is None else m
    b = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        n = m.sum()
        g = x.T @ (m * (y - mu)) - alpha * n * b
        h = (x * (m * mu * (1 - mu))[:, None]).T @ x + alpha * n * np.eye(x.shape[1])
        b = b + np.linalg.pinv(h, hermitian=True) @ g
    return b


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 600
    x1, x2 = rng.normal(50, 10, n), rng.integers(0, 2, n).astype(float)
    p = 1 / (1 + np.exp(-(0.05 * (x1 - 50) + 0.8 * x2 - 0.3)))
    a = (rng.random(n) < p).astype(int)
    y = (rng.random(n) < 0.2 + 0.1 * a).astype(int)
    d = pd.DataFrame({"id": np.arange(n), "A": a, "x1": x1, "x2": x2, "y": y, "z": rng.normal(0, 1, n) + a})
    d.loc[d.id % 17 == 0, "x1"] = np.nan
    return d


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, A int, x1 double, x2 double, y int, z double")


def prepared(d):
    mu, sd = d.x1.mean(), d.x1.std(ddof=0)
    z = ((d.x1.fillna(mu) - mu) / sd).clip(-8, 8)
    return np.column_stack([np.ones(len(d)), z, d.x2])


def test_exact_quantiles_with_hot_value_and_hot_group(spark):
    """A third of all rows share one value; one group holds most rows and takes the narrowing path."""
    rng = np.random.default_rng(1)
    big = np.concatenate([np.full(30_000, 3.25), rng.normal(0, 5, 60_000)])
    small = rng.integers(0, 4, 37).astype(float)
    pdf = pd.DataFrame({"g": ["big"] * len(big) + ["small"] * len(small), "v": np.concatenate([big, small])})
    probs = [0.0, 0.01, 0.025, 0.25, 0.5, 0.6, 0.975, 1.0]
    df = spark.createDataFrame(pdf).repartition(6)
    got = os_.exact_quantiles(df, ["g"], "v", probs, [f"q{i}" for i in range(len(probs))], accuracy=1000).toPandas().set_index("g")
    for g, v in (("big", big), ("small", small)):
        assert np.allclose(got.loc[g, [f"q{i}" for i in range(len(probs))]].to_numpy(float), np.quantile(v, probs), rtol=0, atol=1e-12)
    assert got.loc["big", "n"] == len(big)
    one = os_.exact_quantiles(df, [], "v", [0.5], ["m"]).first()
    assert abs(one["m"] - np.median(pdf.v)) < 1e-12


def test_logit_matches_dense_newton(spark, frame):
    w = wt.fit_weights(to_spark(spark, frame), ["x1", "x2", "absent"])
    x = prepared(frame)
    beta = newton(x, frame.A.to_numpy(float))
    assert np.allclose(w.fit.beta[0], beta, atol=1e-8) and w.fit.method == ["glm"]
    got = w.df.toPandas().sort_values("id")
    ps = np.clip(1 / (1 + np.exp(-x @ beta)), 0.001, 0.999)
    pn = frame.A.mean()
    assert np.allclose(got.ps_den, ps, atol=1e-9)
    assert np.allclose(got.SW_A, np.where(frame.A == 1, pn / ps, (1 - pn) / (1 - ps)), atol=1e-8)
    assert abs(got.SW_A.sum() - len(frame)) < 0.2 * len(frame) ** 0.5


def test_ridge_penalises_the_intercept(spark, frame):
    w = wt.fit_weights(to_spark(spark, frame), ["x1", "x2"], ridge_only=True)
    assert np.allclose(w.fit.beta[0], newton(prepared(frame), frame.A.to_numpy(float), alpha=0.001), atol=1e-8)


def test_separated_data_falls_back_or_clips(spark):
    pdf = pd.DataFrame({"id": range(200), "A": [int(i >= 100) for i in range(200)], "x1": [float(i) for i in range(200)], "x2": 0.0, "y": 0, "z": 0.0})
    w = wt.fit_weights(to_spark(spark, pdf), ["x1"])
    low, high = w.df.agg(F.min("ps_den"), F.max("ps_den")).first()
    assert 0.001 <= low < high <= 0.999 and np.all(np.isfinite(w.fit.beta))


def test_collinear_design_still_fits(spark, frame):
    df = to_spark(spark, frame).withColumn("x1b", F.col("x1"))
    a = wt.fit_weights(df, ["x1", "x1b", "x2"]).df.select("id", "ps_den").toPandas().sort_values("id")
    b = wt.fit_weights(df, ["x1", "x2"]).df.select("id", "ps_den").toPandas().sort_values("id")
    assert np.allclose(a.ps_den, b.ps_den, atol=1e-7)
    kept, pairs = wt.duplicate_columns(df, ["id"], ["x1", "x1b", "z"])
    assert kept == ["x1", "z"] and pairs == [("x1", "x1b")]
    assert wt.design_rank(df.fillna(0.0), ["x1", "x1b", "x2"])["rank_deficiency"] == 1


def test_overlap_weights_bounds(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.2), (1, 0.8), (0, 0.8)], "A int, ps_den double")
    assert [round(r[0], 12) for r in df.select(wt.overlap_weight("A", "ps_den")).collect()] == [0.8, 0.2, 0.2, 0.8]


def test_balance_and_effects_match_numpy(spark, frame):
    w = wt.fit_weights(to_spark(spark, frame), ["x1", "x2"])
    d = w.df.toPandas()
    x = d.x1.fillna(d.x1.mean())
    t, c = d.A == 1, d.A == 0
    wm = lambda v, k: np.average(v, weights=k)
    var = lambda v, k: np.average((v - wm(v, k)) ** 2, weights=k)
    after = (wm(x[t], d.SW_A[t]) - wm(x[c], d.SW_A[c])) / np.sqrt((var(x[t], d.SW_A[t]) + var(x[c], d.SW_A[c])) / 2)
    got = {r["variable"]: r for r in wt.balance_table(w.df, ["x1", "x2"]).collect()}
    assert abs(got["x1"]["signed_after"] - after) < 1e-9
    assert abs(got["x1"]["signed_before"] - (x[t].mean() - x[c].mean()) / np.sqrt((x[t].var(ddof=0) + x[c].var(ddof=0)) / 2)) < 1e-9
    eff = wt.effect_table(w.df, {"y": "risk", "z": "mean"}, {"w": "SW_A", "none": None}).toPandas().set_index(["analysis", "outcome"])
    rt, rc = wm(d.y[t], d.SW_A[t]), wm(d.y[c], d.SW_A[c])
    assert np.allclose(eff.loc[("w", "y"), ["treated", "control", "difference", "ratio"]].to_numpy(float), [rt, rc, rt - rc, rt / rc])
    assert np.isnan(eff.loc[("none", "z"), "ratio"])


def test_weight_tails_keep_top_rows_only(spark, frame):
    w = wt.fit_weights(to_spark(spark, frame), ["x1", "x2"])
    tails = wt.weight_tails(w.df)
    plan = tails._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    d = w.df.toPandas()
    top = d[d.A == 1].SW_A.sort_values(ascending=False)
    got = {r["group"]: r for r in tails.collect()}["deescalated_stopped"]
    assert abs(got["top_5_weight_share"] - top.head(5).sum() / top.sum()) < 1e-12


def test_multiplicities_are_poisson_one():
    rng = np.random.default_rng(0)
    m = kn.multiplicities(rng.integers(0, 2**32, 20_000), rng.integers(0, 2**32, 20_000), np.arange(10))
    assert abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.03
    assert abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) < 0.03


def brute_replicates(frame, hashes, reps, pairs):
    out = {}
    m_all = kn.multiplicities(hashes._h1.to_numpy(), hashes._h2.to_numpy(), np.arange(reps))
    for r in range(reps):
        d = frame.loc[frame.index.repeat(m_all[:, r].astype(int))].reset_index(drop=True)
        x = prepared(d)
        b = newton(x, d.A.to_numpy(float))
        ps = np.clip(1 / (1 + np.exp(-x @ b)), 0.001, 0.999)
        pn = d.A.mean()
        sw = np.where(d.A == 1, pn / ps, (1 - pn) / (1 - ps))
        weights = {"stabilized": sw, "overlap": np.where(d.A == 1, 1 - ps, ps)}
        for lo, hi in pairs:
            weights[f"trunc_{lo:g}_{hi:g}"] = np.clip(sw, *np.quantile(sw, [lo / 100, hi / 100]))
        for name, w in weights.items():
            for o in ("y", "z"):
                t = np.average(d[o][d.A == 1], weights=w[d.A == 1])
                c = np.average(d[o][d.A == 0], weights=w[d.A == 0])
                out[(r, name, o)] = (t, c)
    return out


def test_bootstrap_matches_expanded_resamples_and_ignores_partitioning(spark, frame):
    pairs, reps = ((1.0, 99.0), (2.5, 97.5)), 4
    df = to_spark(spark, frame)
    hashes = df.select("id", *[c.alias(k) for k, c in rs.row_hashes(["id"], 11).items()]).toPandas().sort_values("id").reset_index(drop=True)
    want = brute_replicates(frame.reset_index(drop=True), hashes, reps, pairs)
    tables = []
    for parts in (1, 7):
        got, diag = rs.bootstrap_table(
            df.repartition(parts), ["id"], ["x1", "x2"], {"y": "risk", "z": "mean"}, reps, 11, pairs=pairs, overlap=True
        )
        assert diag["n_failed"] == 0
        tables.append({(r["rep"], r["analysis"], r["outcome"]): (r["treated"], r["control"]) for r in got.collect()})
    for got in tables:
        assert set(got) == set(want)
        assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k])) < 1e-8


def test_small_task_budget_gives_the_same_replicates(spark, frame, monkeypatch):
    df = to_spark(spark, frame)
    run = lambda: {
        (r["rep"], r["outcome"]): round(r["difference"], 10)
        for r in rs.bootstrap_table(df, ["id"], ["x1", "x2"], {"y": "risk"}, 5, 3)[0].collect()
    }
    whole = run()
    monkeypatch.setattr(rs, "TASK_BUDGET", 18)
    assert run() == whole


def test_intervals_cover_replicates(spark, frame):
    table, _ = rs.bootstrap_table(to_spark(spark, frame), ["id"], ["x1"], {"y": "risk", "z": "mean"}, 12, 5)
    ci = rs.interval_table(table, 12).toPandas().set_index(["outcome", "estimand"])
    diff = [r["difference"] for r in table.where("outcome = 'y'").collect()]
    assert np.allclose(ci.loc[("y", "difference"), ["lower_95", "upper_95"]].to_numpy(float), np.quantile(diff, [0.025, 0.975]))
    assert ("z", "ratio") not in ci.index and ci.loc[("y", "ratio"), "n_success"] == 12


def test_design_profile_drops_useless_columns(spark, frame):
    df = to_spark(spark, frame).withColumns({"k": F.lit(2.0), "e": F.lit(None).cast("double")})
    design, _ = lg.mean_prepared(df, ["k", "x1", "e", "x2"])
    assert design.columns == ["x1", "x2"]
    assert [r["type"] for r in lg.standardisation_table(design)] == ["continuous_standardized", "binary"]


def test_counts_reach_the_resolution_of_the_draw():
    assert len(kn.POISSON_CDF) == 12 and 1 - kn.POISSON_CDF[-1] > 2.0**-32
    m = kn.multiplicities(np.arange(200_000), np.arange(200_000)[::-1].copy(), np.arange(3))
    assert abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.02


def test_small_cohort_is_fitted_without_a_row_guard(spark, frame):
    from tideline.operators import sensitivity as se

    few = to_spark(spark, frame.head(80))
    got = se.guarded_summary(few, ["x2"], "few", "y", boot=se.Boot(("id",), 20, 1)).first()
    assert got["status"] == "ok" and got["n"] == 80 and got["rd_lower_95"] <= got["rd_upper_95"] and got["rr_lower_95"] <= got["rr_upper_95"]
    assert se.sensitivity_set(few, {"few": few}, ["x2"], "y").first()["status"] == "not_run"


def test_worst_column_of_differences_that_are_equal_as_reported(spark):
    rows = [("w", "balance", 0.0000052), ("w", "price", 0.0000049), ("w", "zip", 0.0000031), ("v", "price", 0.3), ("v", "balance", 0.4)]
    table = spark.createDataFrame(rows, "weighting string, variable string, after double")
    got = {r["weighting"]: (r["max_post_smd"], r["worst_balanced_variable"]) for r in wt.worst_balance(table, 6).collect()}
    assert got == {"w": (0.000005, "price"), "v": (0.4, "balance")}
    assert {r["worst_balanced_variable"] for r in wt.worst_balance(table).collect()} == {"balance"}
