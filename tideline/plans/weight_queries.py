"""Score models, weights, balance, effects, bootstrap and sensitivity tables over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import audits as au
from ..operators import outcomes as oc
from ..operators import reports as rp
from ..operators import sensitivity as se
from ..operators import weighting as wt
from ..operators.logit import mean_prepared, median_prepared, standardisation_table
from ..operators.resample import bootstrap_table, interval_table
from ..session import stage_border
from . import micro_queries as mq
from . import roles as ro
from . import site_date as sd
from .newton_sql import replicate_score, replicates, score
from .registry import query

CONT, BINS = ["price", "balance"], ["closed"]
COVS = ["price", "balance", "closed"]
FITTED = ro.with_sql(ro.UNITS_SQL, score("units", CONT, BINS))


def _units(spark, folder):
    return stage_border(ro.units(spark, folder))


def _fitted(spark, folder, **kw):
    return wt.fit_weights(_units(spark, folder), COVS, **kw)


@query(
    "ps_prepare",
    "M3",
    ro.with_sql(ro.UNITS_SQL)
    + """SELECT 'price' AS original_variable, 'price_z' AS ps_variable, 'continuous_standardized' AS type, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS sd FROM units
    UNION ALL SELECT 'balance', 'balance_z', 'continuous_standardized', round(avg(balance), 4), round(stddev_pop(balance), 4) FROM units
    UNION ALL SELECT 'closed', 'closed', 'binary', NULL, NULL UNION ALL SELECT 'building', 'building', 'binary', NULL, NULL""",
)
def ps_prepare(spark, folder):
    rows = ro.units(spark, folder).withColumns({"constant": F.lit(3.0), "empty": F.lit(None).cast("double")})
    design, _ = mean_prepared(rows, ["price", "constant", "balance", "empty", "closed", "absent", "building"])
    out = spark.createDataFrame(
        standardisation_table(design), "original_variable string, ps_variable string, type string, mean double, sd double"
    )
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query(
    "ps_prepare_median",
    "M4 C22",
    ro.with_sql(ro.UNITS_SQL)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, round(any_value(f), 4) AS fill, round(avg(coalesce({c}, f)), 4) AS mean, round(stddev_pop(coalesce({c}, f)), 4) AS sd
        FROM units, (SELECT median({c}) AS f FROM units)"""
        for c in CONT
    ),
)
def ps_prepare_median(spark, folder):
    design = median_prepared(_units(spark, folder), BINS, CONT)
    rows = [
        (c, *[float(x[0, j]) for x in (design.fill, design.mean, design.sd)]) for j, c in enumerate(design.columns) if c in CONT
    ]
    out = spark.createDataFrame(rows, "variable string, fill double, mean double, sd double")
    return out.withColumns({c: F.round(c, 4) for c in ("fill", "mean", "sd")})


def _rounded(w):
    return w.df.select("unit", "A", F.round("ps_den", 6).alias("ps_den"), F.round("SW_A", 6).alias("SW_A"))


PER_UNIT = "SELECT unit, A, round(ps_den, 6) AS ps_den, round(SW_A, 6) AS SW_A FROM w"


@query("iptw_logit", "M5 M7 F16", FITTED + PER_UNIT)
def iptw_logit(spark, folder):
    return _rounded(_fitted(spark, folder))


@query("ridge_logit", "M6", ro.with_sql(ro.UNITS_SQL, score("units", CONT, BINS, ridge=0.001)) + PER_UNIT)
def ridge_logit(spark, folder):
    return _rounded(_fitted(spark, folder, ridge_only=True))


@query("iptw_median_fill", "M4 M5 M7", ro.with_sql(ro.UNITS_SQL, score("units", CONT, BINS, fill="median")) + PER_UNIT)
def iptw_median_fill(spark, folder):
    return _rounded(wt.fit_weights(_units(spark, folder), site_b=(BINS, CONT)))


@query("quadratic_ps", "M10", ro.with_sql(ro.UNITS_SQL, score("units", CONT, BINS, squares=["price"])) + PER_UNIT)
def quadratic_ps(spark, folder):
    return _rounded(_fitted(spark, folder, quadratic=["price"]))


@query(
    "overlap_weights",
    "M8 M11 M1",
    FITTED
    + """SELECT A, count(*) AS n, round(sum(ow), 6) AS total, round(pow(sum(ow), 2) / sum(ow * ow), 4) AS ess, round(max(ow), 6) AS max_weight,
       round(sum(ow * y) / sum(ow), 6) AS risk FROM (SELECT *, CASE WHEN A = 1 THEN 1 - ps_den ELSE ps_den END AS ow FROM w) GROUP BY A""",
)
def overlap_weights(spark, folder):
    df = _fitted(spark, folder).df.withColumn("ow", wt.overlap_weight("A", "ps_den"))
    return df.groupBy("A").agg(
        F.count("*").alias("n"), F.round(F.sum("ow"), 6).alias("total"), F.round(wt.effective_size(F.col("ow")), 4).alias("ess"),
        F.round(F.max("ow"), 6).alias("max_weight"), F.round(F.sum(F.col("ow") * F.col("y")) / F.sum("ow"), 6).alias("risk"),
    )


TRUNC = """t AS MATERIALIZED (SELECT *, CASE WHEN A = 1 THEN 1 - ps_den ELSE ps_den END AS OW_A,
   greatest((SELECT quantile_cont(SW_A, 0.01) FROM w), least((SELECT quantile_cont(SW_A, 0.99) FROM w), SW_A)) AS T1,
   greatest((SELECT quantile_cont(SW_A, 0.025) FROM w), least((SELECT quantile_cont(SW_A, 0.975) FROM w), SW_A)) AS T2 FROM w)"""
STRATEGY = {"Primary stabilized IPTW": "SW_A", "Overlap weighting": "OW_A", "IPTW truncated 1/99": "T1", "IPTW truncated 2.5/97.5": "T2"}


def _risk(w: str, y: str, arm: int) -> str:
    return f"sum({w} * {y}) FILTER (WHERE A = {arm}) / sum({w}) FILTER (WHERE A = {arm})"


def effects_sql(weights: dict, outcomes: dict, source: str) -> str:
    rows = []
    for label, w in weights.items():
        for y, kind in outcomes.items():
            t, c = _risk(w, y, 1), _risk(w, y, 0)
            ratio = f"round(({t}) / ({c}), 6)" if kind == "risk" else "NULL::DOUBLE"
            rows.append(
                f"SELECT '{label}' AS analysis, '{y}' AS outcome, '{kind}' AS kind, round({t}, 6) AS treated, round({c}, 6) AS control, round({t} - ({c}), 6) AS difference, {ratio} AS ratio FROM {source}"
            )
    return " UNION ALL ".join(rows)


EFFECT_COLS = ("treated", "control", "difference", "ratio")


@query(
    "effect_matrix",
    "M28 M14 M9",
    FITTED.rstrip() + ", " + TRUNC + "\n" + effects_sql({**STRATEGY, "Unadjusted": "1.0"}, {"y": "risk", "yc": "mean"}, "t"),
)
def effect_matrix(spark, folder):
    df, weights = wt.add_strategies(_fitted(spark, folder).df)
    out = wt.effect_table(df, {"y": "risk", "yc": "mean"}, {**weights, "Unadjusted": None})
    return out.withColumns({c: F.round(c, 6) for c in EFFECT_COLS})


@query(
    "weight_truncation",
    "M9 A11 F14",
    FITTED.rstrip() + ", " + TRUNC
    + "\nSELECT A, round(min(T1), 6) AS min_1_99, round(max(T1), 6) AS max_1_99, round(min(T2), 6) AS min_25_975, round(max(T2), 6) AS max_25_975, round(avg(T1), 6) AS mean_1_99, round(avg(T2), 6) AS mean_25_975 FROM t GROUP BY A",
)
def weight_truncation(spark, folder):
    df = wt.add_truncated(_fitted(spark, folder).df, [(1.0, 99.0), (2.5, 97.5)])
    one, two = wt.truncated_name(1.0, 99.0), wt.truncated_name(2.5, 97.5)
    return df.groupBy("A").agg(
        *[
            F.round(f(c), 6).alias(f"{k}_{tag}")
            for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c, tag in ((one, "1_99"), (two, "25_975"))
        ]
    )


def smd_sql(x: str, binary: bool, w: str, source: str) -> str:
    """(before, after) for one filled expression."""
    out = []
    for weight in ("1.0", w):
        m = {a: f"(sum({weight} * x) FILTER (WHERE A = {a}) / sum({weight}) FILTER (WHERE A = {a}))" for a in (1, 0)}
        v = {
            a: f"({m[a]} * (1 - {m[a]}))" if binary else f"(sum({weight} * x * x) FILTER (WHERE A = {a}) / sum({weight}) FILTER (WHERE A = {a}) - {m[a]} * {m[a]})"
            for a in (1, 0)
        }
        out.append(f"({m[1]} - {m[0]}) / sqrt(({v[1]} + {v[0]}) / 2)")
    return f"SELECT round({out[0]}, 6) AS signed_before, round({out[1]}, 6) AS signed_after FROM (SELECT *, {x} AS x FROM {source})"


# Centred, so that the textbook variance keeps its digits.
FILLED = {
    "price": ("price - (SELECT avg(price) FROM units)", False),
    "balance": ("coalesce(balance, (SELECT avg(balance) FROM units)) - (SELECT avg(balance) FROM units)", False),
    "closed": ("closed", True),
    "building": ("building", True),
}


def balance_sql(weights: dict, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS weighting, '{v}' AS variable, signed_before, signed_after, abs(signed_before) AS before, abs(signed_after) AS after FROM ({smd_sql(x, b, w, source)})"
        for label, w in weights.items() for v, (x, b) in FILLED.items()
    )


BALANCE_SQL = FITTED.rstrip() + ", " + TRUNC + f", bal AS ({balance_sql(STRATEGY, 't')})\n"


def _balance(spark, folder):
    df, weights = wt.add_strategies(_fitted(spark, folder).df)
    out = wt.balance_table(df, [*COVS, "building", "absent"], weights)
    return out.withColumns({c: F.round(c, 6) for c in ("signed_before", "signed_after", "before", "after")})


@query("balance_table", "M2 M15", BALANCE_SQL + "SELECT * FROM bal")
def balance_table(spark, folder):
    return _balance(spark, folder)


@query(
    "worst_covariate",
    "O5 O7",
    BALANCE_SQL + "SELECT weighting, max(after) AS max_post_smd, arg_max(variable, (after, variable)) AS worst_balanced_variable FROM bal GROUP BY 1",
)
def worst_covariate(spark, folder):
    return wt.worst_balance(_balance(spark, folder))


@query(
    "top_imbalanced",
    "O7 O1",
    BALANCE_SQL + "SELECT weighting, variable, after FROM bal ORDER BY after DESC, variable, weighting LIMIT 25",
)
def top_imbalanced(spark, folder):
    return _balance(spark, folder).select("weighting", "variable", "after").orderBy(F.desc("after"), "variable", "weighting").limit(25)


COMPARED = {("Deduplicated primary PS" if w == "SW_A" else k): w for k, w in STRATEGY.items()} | {"Quadratic PS sensitivity": "SWQ"}


@query(
    "weighting_comparison",
    "M26 M11 O5 M29",
    FITTED.rstrip() + ", " + score("units", CONT, BINS, name="wq", squares=["price"]) + ", " + TRUNC
    + ", tq AS MATERIALIZED (SELECT t.*, q.SW_A AS SWQ FROM t JOIN (SELECT unit, SW_A FROM wq) q USING (unit))"
    + f", bal AS ({balance_sql(COMPARED, 'tq')}), eff AS ("
    + effects_sql(COMPARED, {"y": "risk"}, "tq")
    + "), ess AS ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS analysis, round(pow(sum({w}) FILTER (WHERE A = 1), 2) / sum({w} * {w}) FILTER (WHERE A = 1), 4) AS ess_treated, round(pow(sum({w}) FILTER (WHERE A = 0), 2) / sum({w} * {w}) FILTER (WHERE A = 0), 4) AS ess_control, round(max({w}), 6) AS max_weight FROM tq"
        for k, w in COMPARED.items()
    )
    + """) SELECT e.analysis, treated, control, difference, ratio, m.max_post_smd, CASE WHEN m.max_post_smd > 0 THEN m.worst_balanced_variable END AS worst_balanced_variable, ess_treated, ess_control, max_weight,
      'price_copy=price, closed_copy=closed' AS pruned FROM eff e
      JOIN (SELECT weighting, max(after) AS max_post_smd, arg_max(variable, (after, variable)) AS worst_balanced_variable FROM bal WHERE variable <> 'building' GROUP BY 1) m ON m.weighting = e.analysis
      JOIN ess ON ess.analysis = e.analysis""",
)
def weighting_comparison(spark, folder):
    rows = ro.units(spark, folder).withColumns({"price_copy": F.col("price"), "closed_copy": F.col("closed")})
    out, pruned = se.weighting_comparison(rows, ["unit"], [*CONT, *BINS, "price_copy", "closed_copy"], "y", ["price"], digits=6)
    digits = {"ess_treated": 4, "ess_control": 4}
    # Overlap weights balance the model columns exactly; rounding noise has no worst column.
    out = out.withColumn("worst_balanced_variable", F.when(F.col("max_post_smd") > 0, F.col("worst_balanced_variable")))
    out = out.withColumns({c: F.round(c, digits.get(c, 6)) for c in out.columns if c not in ("analysis", "worst_balanced_variable")})
    return out.withColumn("pruned", F.lit(", ".join(f"{b}={a}" for a, b in pruned)))


def table_one_sql(w: str) -> str:
    rows = []
    for v, (x, b) in {
        "price": ("price - (SELECT median(price) FROM units)", False),
        "balance": ("coalesce(balance, (SELECT median(balance) FROM units)) - (SELECT median(balance) FROM units)", False),
        "closed": ("closed", True),
    }.items():
        shift = "0.0" if b else f"(SELECT median({v}) FROM units)"
        m = {a: f"(sum({w} * x) FILTER (WHERE A = {a}) / sum({w}) FILTER (WHERE A = {a}))" for a in (1, 0)}
        var = {
            a: f"({m[a]} * (1 - {m[a]}))" if b else f"(sum({w} * x * x) FILTER (WHERE A = {a}) / sum({w}) FILTER (WHERE A = {a}) - {m[a]} * {m[a]})"
            for a in (1, 0)
        }
        smd = f"({m[1]} - {m[0]}) / sqrt(({var[1]} + {var[0]}) / 2)"
        rows.append(
            f"SELECT '{v}' AS variable, '{'binary' if b else 'continuous'}' AS type, round({m[1]} + {shift}, 4) AS treated, round({m[0]} + {shift}, 4) AS continued, round({smd}, 6) AS SMD, round(abs({smd}), 6) AS abs_SMD FROM (SELECT *, {x} AS x FROM w)"
        )
    return " UNION ALL ".join(rows)


@query(
    "table_one",
    "M16 M2",
    FITTED + f"SELECT 'none' AS weighting, * FROM ({table_one_sql('1.0')}) UNION ALL SELECT 'SW_A', * FROM ({table_one_sql('SW_A')})",
)
def table_one(spark, folder):
    df = _fitted(spark, folder).df
    parts = [
        wt.table_one(df, CONT, BINS, weight=w).withColumn("weighting", F.lit(w or "none")) for w in (None, "SW_A")
    ]
    out = parts[0].unionByName(parts[1])
    return out.withColumns({"treated": F.round("treated", 4), "continued": F.round("continued", 4), "SMD": F.round("SMD", 6), "abs_SMD": F.round("abs_SMD", 6)})


SUMMARY = """count(*) AS n, round(pow(sum(SW_A), 2) / sum(SW_A * SW_A), 4) AS effective_sample_size, round(avg(SW_A), 6) AS mean_weight, round(min(SW_A), 6) AS min_weight, round(max(SW_A), 6) AS max_weight,
  round(quantile_cont(SW_A, 0.01), 6) AS p01_weight, round(quantile_cont(SW_A, 0.05), 6) AS p05_weight, round(quantile_cont(SW_A, 0.5), 6) AS median_weight,
  round(quantile_cont(SW_A, 0.95), 6) AS p95_weight, round(quantile_cont(SW_A, 0.99), 6) AS p99_weight"""
GROUPED = """SELECT CASE WHEN grouping(A) = 1 THEN 'overall' WHEN A = 1 THEN 'deescalated_stopped' ELSE 'continued_broad' END AS "group" """


@query("weight_summary", "M12 M11 A11", FITTED + f"{GROUPED}, {SUMMARY} FROM w GROUP BY GROUPING SETS ((), (A))")
def weight_summary(spark, folder):
    out = wt.weight_summary(_fitted(spark, folder).df)
    return out.withColumns({c: F.round(c, 4 if c.startswith("eff") else 6) for c in out.columns if c not in ("group", "n")})


@query(
    "weight_tails",
    "M13 W6",
    FITTED
    + """SELECT CASE WHEN A = 1 THEN 'deescalated_stopped' ELSE 'continued_broad' END AS "group", count(*) AS n, round(pow(sum(SW_A), 2) / sum(SW_A * SW_A), 4) AS effective_sample_size,
      round(max(SW_A), 6) AS max_weight, round(quantile_cont(SW_A, 0.99), 6) AS p99_weight, round(min(ps_den), 6) AS ps_min, round(quantile_cont(ps_den, 0.01), 6) AS ps_p01, round(quantile_cont(ps_den, 0.05), 6) AS ps_p05,
      count(*) FILTER (WHERE ps_den < 0.01) AS n_ps_lt_0_01, count(*) FILTER (WHERE ps_den < 0.025) AS n_ps_lt_0_025, count(*) FILTER (WHERE ps_den < 0.05) AS n_ps_lt_0_05, """
    + ", ".join(f"round(sum(SW_A) FILTER (WHERE rk <= {k}) / sum(SW_A), 6) AS top_{k}_weight_share" for k in wt.TAIL_SIZES)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY A ORDER BY SW_A DESC) AS rk FROM w) GROUP BY A",
)
def weight_tails(spark, folder):
    out = wt.weight_tails(_fitted(spark, folder).df)
    whole = {"group", "n", "n_ps_lt_0_01", "n_ps_lt_0_025", "n_ps_lt_0_05"}
    return out.withColumns({c: F.round(c, 4 if c.startswith("eff") else 6) for c in out.columns if c not in whole})


@query(
    "missing_by_arm",
    "Q18",
    ro.with_sql(ro.UNITS_SQL)
    + " UNION ALL ".join(
        f"SELECT A, '{v}' AS variable, count(*) AS n, count(*) - count({v}) AS missing_n, round((count(*) - count({v})) / count(*), 6) AS missing_prop FROM units GROUP BY A"
        for v in ("price", "balance", "closed")
    ),
)
def missing_by_arm(spark, folder):
    return wt.missing_by_arm(ro.units(spark, folder), COVS).withColumn("missing_prop", F.round("missing_prop", 6))


@query(
    "crude_rates",
    "A18",
    ro.with_sql(ro.UNITS_SQL) + "SELECT A, count(y) AS n, sum(y)::DOUBLE AS events, round(avg(y), 6) AS rate FROM units GROUP BY A",
)
def crude_rates(spark, folder):
    return wt.crude_rates(ro.units(spark, folder), "y").withColumn("rate", F.round("rate", 6))


@query(
    "duplicate_covariates",
    "M29",
    ro.with_sql(ro.UNITS_SQL)
    + """, b AS MATERIALIZED (SELECT unit, price, coalesce(balance, (SELECT avg(balance) FROM units)) AS balance, price AS price_copy, closed, 1 - closed AS opened, closed AS closed_copy FROM units),
      names AS (SELECT unnest(['price', 'balance', 'price_copy', 'closed', 'opened', 'closed_copy']) AS v, unnest(range(6)) AS i),
      tall AS MATERIALIZED (SELECT unit, v, val FROM (SELECT unit, price::DOUBLE AS price, balance::DOUBLE AS balance, price_copy::DOUBLE AS price_copy,
        closed::DOUBLE AS closed, opened::DOUBLE AS opened, closed_copy::DOUBLE AS closed_copy FROM b) UNPIVOT INCLUDE NULLS (val FOR v IN (price, balance, price_copy, closed, opened, closed_copy)))
      SELECT x.v AS variable_1, y.v AS variable_2 FROM names x JOIN names y ON x.i < y.i JOIN tall p ON p.v = x.v JOIN tall q ON q.v = y.v AND q.unit = p.unit
      GROUP BY ALL HAVING count(*) FILTER (p.val IS DISTINCT FROM q.val) = 0""",
)
def duplicate_covariates(spark, folder):
    rows = ro.units(spark, folder).withColumns(
        {"price_copy": F.col("price"), "opened": 1 - F.col("closed"), "closed_copy": F.col("closed")}
    )
    _, pairs = wt.duplicate_columns(rows, ["unit"], ["price", "balance", "price_copy", "closed", "opened", "closed_copy"])
    return spark.createDataFrame(pairs, "variable_1 string, variable_2 string")


@query(
    "design_rank",
    "M30",
    "SELECT count(*) AS n_rows, 4::BIGINT AS n_ps_columns, 5::BIGINT AS n_columns_with_intercept, 3::BIGINT AS rank_with_intercept, 2::BIGINT AS rank_deficiency FROM orders",
)
def design_rank(spark, folder):
    # 1 = closed + opened and a copied price leave rank 3 of 5 columns.
    rows = ro.units(spark, folder).withColumns({"price_copy": F.col("price") * 2.0, "opened": 1 - F.col("closed")})
    got = wt.design_rank(rows, ["price", "closed", "opened", "price_copy"])
    return spark.createDataFrame([got], "n_rows long, n_ps_columns long, n_columns_with_intercept long, rank_with_intercept long, rank_deficiency long")


# ---- sensitivity sets ----
MODELS = {"M1": (["closed"], []), "M2": (["closed"], ["price"]), "M3": (["closed"], ["price", "balance"]), "M4": (["closed", "building"], ["price", "balance"])}


def summary_sql(label: str, name: str, variables: dict[str, tuple[str, bool]], method: str = "glm") -> str:
    t, c = _risk("SW_A", "y", 1), _risk("SW_A", "y", 0)
    bal = " UNION ALL ".join(f"SELECT '{v}' AS variable, round(abs(signed_after), 6) AS after FROM ({smd_sql(x, b, 'SW_A', name)})" for v, (x, b) in variables.items())
    ess = lambda a: f"round(pow(sum(SW_A) FILTER (WHERE A = {a}), 2) / sum(SW_A * SW_A) FILTER (WHERE A = {a}), 4)"
    return f"""SELECT '{label}' AS analysis, round({t}, 6) AS treated, round({c}, 6) AS control, round({t} - ({c}), 6) AS difference, round(({t}) / ({c}), 6) AS ratio,
      (SELECT max(after) FROM ({bal})) AS max_post_smd, count(*) AS n, count(*) FILTER (WHERE A = 1) AS n_treated, count(*) FILTER (WHERE A = 0) AS n_control,
      {ess(1)} AS ess_treated, {ess(0)} AS ess_control, round(max(SW_A), 6) AS max_weight, round(min(ps_den), 6) AS ps_min, round(max(ps_den), 6) AS ps_max,
      {len(variables)} AS n_vars_used FROM {name}"""


SUMMARY_COLS = [
    "analysis", "treated", "control", "difference", "ratio", "max_post_smd", "n", "n_treated", "n_control", "ess_treated", "ess_control",
    "max_weight", "ps_min", "ps_max", "n_vars_used",
]


def _summary(df):
    whole = {"analysis", "n", "n_treated", "n_control", "n_vars_used", "status"}
    keep = SUMMARY_COLS + [c for c in (*se.INTERVALS, "status") if c in df.columns]
    return df.select(*[c if c in whole else F.round(c, 4 if c.startswith("ess") else 6).alias(c) for c in keep])


REPS, SEED = 6, 20260426
#: Replicates of the contrasts' limits, as many as the study draws (``site_hour.HourConfig.reps``).
CONTRAST_REPS = 1000
LIMITS = {"rd_lower_95": ("difference", 0.025), "rd_upper_95": ("difference", 0.975), "rr_lower_95": ("ratio", 0.025), "rr_upper_95": ("ratio", 0.975)}


def intervals_sql(label: str, base: str, cont: list[str], bins: list[str], reps: int = REPS) -> str:
    """One row: the bootstrap limits of a model fitted on ``base``."""
    limits = ", ".join(f"round(quantile_cont({x}, {q}), 6) AS {c}" for c, (x, q) in LIMITS.items())
    t, c = _risk("m * SW_A", "y", 1), _risk("m * SW_A", "y", 0)
    parts = [replicates(base, "unit", SEED, reps), replicate_score(base, cont, bins, SEED, reps)]
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT '{label}' AS analysis, {limits} FROM (SELECT {t} - ({c}) AS difference, ({t}) / ({c}) AS ratio FROM w GROUP BY rep))"


@query(
    "progressive_models",
    "M22",
    ro.with_sql(ro.UNITS_SQL, *[score("units", cont, bins, name=f"w{m}") for m, (bins, cont) in MODELS.items()])
    + "SELECT * FROM ("
    + " UNION ALL ".join(summary_sql(m, f"w{m}", {v: FILLED[v] for v in [*cont, *bins]}) for m, (bins, cont) in MODELS.items())
    + ") JOIN ("
    + " UNION ALL ".join(intervals_sql(m, "units", cont, bins) for m, (bins, cont) in MODELS.items())
    + ") USING (analysis)",
)
def progressive_models(spark, folder):
    models = {m: [*cont, *bins] for m, (bins, cont) in MODELS.items()}
    return _summary(se.progressive_models(ro.units(spark, folder), models, "y", boot=se.Boot(("unit",), REPS, SEED)))


def centred(source: str) -> dict:
    return {
        "price": (f"price - (SELECT avg(price) FROM {source})", False),
        "balance": (f"coalesce(balance, (SELECT avg(balance) FROM {source})) - (SELECT avg(balance) FROM {source})", False),
        "closed": ("closed", True),
    }


NEAR = "Exclude ICU/hospital discharge within 24 h after landmark"
STRICT = "Strict test-name culture-only"
EVENTUAL = "Eventual culture-negative from specimens collected by 72 h"
SUBSETS = {
    "urgent_vs_rest": "SELECT * REPLACE (CAST(priority = '1-URGENT' AS INTEGER) AS A) FROM units WHERE priority <> '2-HIGH'",
    "high_vs_rest": "SELECT * REPLACE (CAST(priority = '2-HIGH' AS INTEGER) AS A) FROM units WHERE priority <> '1-URGENT'",
    NEAR: "SELECT units.* FROM units JOIN (SELECT * FROM clocks WHERE NOT last_time <= analysis_time0 + INTERVAL 24 HOUR) c ON c.subject = units.subject",
    STRICT: "SELECT units.* FROM units JOIN (SELECT * FROM flags WHERE is_strict_sampled = 1 AND is_strict_positive_by_decision = 0) c ON c.subject = units.subject",
    EVENTUAL: "SELECT units.* FROM units JOIN (SELECT * FROM flags WHERE is_sampled = 1 AND is_positive_eventually = 0) c ON c.subject = units.subject",
}
SHORT = {k: f"k{i}" for i, k in enumerate(SUBSETS)}
CLOCKS = ro.PEOPLE_SQL.replace("people AS", "clocks AS", 1)


def _flagged_units(spark, folder):
    """Units with the discharge and culture flags of their customer."""
    near = oc.add_near_discharge(ro.people(spark, folder), "analysis_time0", "last_time", "last_time").select("subject", "near_discharge_24h_after_landmark")
    cultures = mq.two_clock_eligibility(spark, folder).select("subject", "is_strict_eligible", "is_eventually_negative")
    return ro.units(spark, folder).join(near, "subject").join(cultures, "subject")


@query(
    "subtype_contrasts",
    "M24 M23",
    ro.with_sql(
        ro.UNITS_SQL, mq.MICRO, mq.FLAGS, CLOCKS, *[f"s_{SHORT[k]} AS MATERIALIZED ({v})" for k, v in SUBSETS.items()],
        *[score(f"s_{SHORT[k]}", CONT, BINS, name=f"w_{SHORT[k]}") for k in SUBSETS]
    )
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT * REPLACE (n_treated::DOUBLE AS n_treated, n_control::DOUBLE AS n_control, n_vars_used::DOUBLE AS n_vars_used), 'ok' AS status FROM ({summary_sql(k, f'w_{SHORT[k]}', centred(f's_{SHORT[k]}'))})"
        for k in SUBSETS
    )
    + " UNION ALL SELECT 'tiny', NULL, NULL, NULL, NULL, NULL, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not_run' FROM units WHERE unit < 0) LEFT JOIN ("
    + " UNION ALL ".join(intervals_sql(k, f"s_{SHORT[k]}", CONT, BINS, CONTRAST_REPS) for k in SUBSETS)
    + ") USING (analysis)",
)
def subtype_contrasts(spark, folder):
    p = F.col("priority")
    subsets = {
        "urgent_vs_rest": se.Subset(p != "2-HIGH", (p == "1-URGENT").cast("int")),
        "high_vs_rest": se.Subset(p != "1-URGENT", (p == "2-HIGH").cast("int")),
        **se.named_subsets(),
        "tiny": se.Subset(F.col("unit") < 0),
    }
    out = _summary(se.sensitivity_set(_flagged_units(spark, folder), subsets, COVS, "y", boot=se.Boot(("unit",), CONTRAST_REPS, SEED)))
    return out.withColumns({c: F.col(c).cast("double") for c in ("n_treated", "n_control", "n_vars_used")})


_broad = f"regexp_matches(lower(drug_name), '{lx.SITE_B_BROAD_PATTERN}')"
_systemic = f"NOT regexp_matches(lower(drug_name), '{lx.SITE_B_NON_SYSTEMIC_PATTERN}') AND upper(trim(coalesce(drug_route, ''))) NOT IN ({', '.join(repr(r) for r in lx.SITE_B_BAD_ROUTES)})"
VARIANTS_SQL = f"""rx AS MATERIALIZED (SELECT subject, adm, od + INTERVAL 510 MINUTE AS order_ts, coalesce(sd, od) AS start_day,
    coalesce(CASE WHEN l_linenumber % 4 <> 0 THEN coalesce(sd, od) + CAST(l_quantity % 2 AS INTEGER) END, coalesce(sd, od)) AS end_day, {_broad} AND {_systemic} AS is_broad FROM begun),
anchors AS (SELECT subject, min(order_ts) AS anchor FROM rx WHERE is_broad AND order_ts >= adm AND order_ts < adm + INTERVAL 24 HOUR GROUP BY 1),
landmarks AS MATERIALIZED (SELECT *, (dis IS NULL OR dis > analysis) AND (died IS NULL OR died > analysis) AS is_strict FROM (
    SELECT e.*, anchor, anchor + INTERVAL 72 HOUR AS decision_ts, anchor + INTERVAL 96 HOUR AS analysis_ts, CAST(anchor + INTERVAL 72 HOUR AS DATE) AS decision, CAST(anchor + INTERVAL 96 HOUR AS DATE) AS analysis FROM anchors JOIN encounter e USING (subject))
  WHERE (dis IS NULL OR dis >= analysis) AND (died IS NULL OR died >= analysis)),
by_order AS (SELECT DISTINCT c.subject FROM landmarks c JOIN rx USING (subject) WHERE is_broad AND start_day <= analysis AND end_day >= decision),
by_admin AS (SELECT DISTINCT c.subject FROM landmarks c JOIN given g USING (subject) WHERE {_broad} AND {_systemic} AND g.sd < analysis_ts
    AND coalesce(CASE WHEN l_linenumber % 2 = 0 THEN g.sd + 1 END, g.sd) + INTERVAL 86399 SECOND >= decision_ts),
variants AS MATERIALIZED (SELECT c.*, subject AS unit, CASE WHEN subject IN (SELECT subject FROM by_order) THEN 0 ELSE 1 END AS A_order, CASE WHEN subject IN (SELECT subject FROM by_admin) THEN 0 ELSE 1 END AS A_admin,
    CASE WHEN died BETWEEN analysis AND analysis + 30 THEN 1 ELSE 0 END AS death_30d, CASE WHEN subject % 10 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS building,
    CASE WHEN died BETWEEN analysis AND analysis + 30 THEN 0.0 ELSE 30.0 - CASE WHEN dis IS NULL THEN 0.0 ELSE least(30.0, greatest(0.0, dis - analysis)) END END::DOUBLE AS hospital_free_days_30d
  FROM landmarks c JOIN customer ON c_custkey = subject)"""
_variant = lambda landmark, exposure: f"(SELECT unit, A_{exposure} AS A, balance, building, death_30d, hospital_free_days_30d FROM variants{' WHERE is_strict' if landmark == 'strict' else ''})"
_numbered = {k: (i, *v) for i, (k, v) in enumerate(sd.VARIANTS.items())}
DATE_OUTCOMES = {"death_30d": "risk", "hospital_free_days_30d": "mean"}


@query(
    "robustness_variants",
    "M27",
    ro.with_sql(
        ro.DRUG_LINES_SQL, ro.DATE_SITE_SQL, VARIANTS_SQL, *[f"v{i} AS MATERIALIZED {_variant(mark, by)}" for i, mark, by in _numbered.values()],
        *[score(f"v{i}", ["balance"], ["building"], name=f"wv{i}", fill="median") for i, *_ in _numbered.values()],
    )
    + " UNION ALL ".join(effects_sql({k: "SW_A"}, DATE_OUTCOMES, f"wv{i}") for k, (i, *_) in _numbered.items()),
)
def robustness_variants(spark, folder):
    cust = ro.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("patid"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("balance"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"),
    )
    cohorts = stage_border(sd.variant_cohorts(ro.date_site(spark, folder)).join(cust, "patid"))
    return sd.robustness(cohorts, ["building"], ["balance"], DATE_OUTCOMES).withColumns({c: F.round(c, 6) for c in EFFECT_COLS})


# ---- bootstrap ----
BOOT = ro.with_sql(ro.UNITS_SQL, replicates("units", "unit", SEED, REPS), replicate_score("units", CONT, BINS, SEED, REPS))
BOOT_T = """, e AS MATERIALIZED (SELECT w.*, CASE WHEN A = 1 THEN 1 - ps_den ELSE ps_den END AS OW_A FROM (SELECT rep, m, unit, A, y, yc, ps_den, SW_A FROM w) w),
  q AS MATERIALIZED (SELECT rep, quantile_cont(SW_A, 0.01) AS q1, quantile_cont(SW_A, 0.99) AS q2, quantile_cont(SW_A, 0.025) AS q3, quantile_cont(SW_A, 0.975) AS q4
     FROM (SELECT rep, SW_A, unnest(range(m)) AS copy FROM w) GROUP BY rep),
  v AS MATERIALIZED (SELECT e.*, greatest(q1, least(q2, SW_A)) AS T1, greatest(q3, least(q4, SW_A)) AS T2 FROM e JOIN q USING (rep))"""
BOOT_W = {"stabilized": "SW_A", "overlap": "OW_A", "trunc_1_99": "T1", "trunc_2.5_97.5": "T2"}


def boot_sql(weights: dict, outcomes: dict, source: str) -> str:
    rows = []
    for label, w in weights.items():
        for y, kind in outcomes.items():
            t, c = _risk(f"m * {w}", y, 1), _risk(f"m * {w}", y, 0)
            ratio = f"({t}) / ({c})" if kind == "risk" else "NULL::DOUBLE"
            rows.append(
                f"SELECT rep, '{label}' AS analysis, '{y}' AS outcome, '{kind}' AS kind, {t} AS treated, {c} AS control, {t} - ({c}) AS difference, {ratio} AS ratio FROM {source} GROUP BY rep"
            )
    return " UNION ALL ".join(rows)


def _boot(spark, folder, **kw):
    table, _ = bootstrap_table(ro.units(spark, folder), ["unit"], COVS, {"y": "risk", "yc": "mean"}, REPS, SEED, **kw)
    return table


def _rounded_boot(df):
    return df.withColumns({c: F.round(c, 6) for c in EFFECT_COLS}).withColumn("rep", F.col("rep").cast("long"))


@query(
    "bootstrap_replicates",
    "M17 M18",
    BOOT + "SELECT rep, analysis, outcome, kind, round(treated, 6) AS treated, round(control, 6) AS control, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM ("
    + boot_sql({"stabilized": "SW_A"}, {"y": "risk", "yc": "mean"}, "w") + ")",
)
def bootstrap_replicates(spark, folder):
    return _rounded_boot(_boot(spark, folder))


@query(
    "bootstrap_strategies",
    "M19",
    BOOT.rstrip() + BOOT_T
    + "\nSELECT rep, analysis, outcome, kind, round(treated, 6) AS treated, round(control, 6) AS control, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM ("
    + boot_sql(BOOT_W, {"y": "risk", "yc": "mean"}, "v") + ")",
)
def bootstrap_strategies(spark, folder):
    return _rounded_boot(_boot(spark, folder, pairs=((1.0, 99.0), (2.5, 97.5)), overlap=True))


@query(
    "bootstrap_median_fill",
    "M20",
    ro.with_sql(ro.UNITS_SQL, replicates("units", "unit", SEED, REPS), replicate_score("units", CONT, BINS, SEED, REPS, fill="median"))
    + "SELECT rep, analysis, outcome, kind, round(treated, 6) AS treated, round(control, 6) AS control, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM ("
    + boot_sql({"stabilized": "SW_A"}, {"y": "risk", "yc": "mean"}, "w") + ")",
)
def bootstrap_median_fill(spark, folder):
    return _rounded_boot(_boot(spark, folder, prepare="median", binary=BINS))


@query(
    "bootstrap_median_strategies",
    "M20 M19",
    ro.with_sql(ro.UNITS_SQL, replicates("units", "unit", SEED, REPS), replicate_score("units", CONT, BINS, SEED, REPS, fill="median")).rstrip() + BOOT_T
    + "\nSELECT rep, analysis, outcome, kind, round(treated, 6) AS treated, round(control, 6) AS control, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM ("
    + boot_sql(BOOT_W, {"y": "risk", "yc": "mean"}, "v") + ")",
)
def bootstrap_median_strategies(spark, folder):
    return _rounded_boot(_boot(spark, folder, prepare="median", binary=BINS, pairs=((1.0, 99.0), (2.5, 97.5)), overlap=True))


@query(
    "bootstrap_ci",
    "M21 M17",
    BOOT
    + f"""SELECT analysis, outcome, estimand, round(quantile_cont(x, 0.025), 6) AS lower_95, round(quantile_cont(x, 0.975), 6) AS upper_95, count(x) AS n_success, {REPS} AS n_requested FROM (
      UNPIVOT (SELECT analysis, outcome, treated, control, difference, ratio FROM ({boot_sql({"stabilized": "SW_A"}, {"y": "risk", "yc": "mean"}, "w")})) ON treated, control, difference, ratio INTO NAME estimand VALUE x) GROUP BY ALL""",
)
def bootstrap_ci(spark, folder):
    out = interval_table(_boot(spark, folder), REPS)
    return out.withColumns({"lower_95": F.round("lower_95", 6), "upper_95": F.round("upper_95", 6)})


# ---- reports ----
@query(
    "score_distribution",
    "M34 A10",
    FITTED
    + "SELECT A, count(*) AS n, round(avg(ps_den), 6) AS mean, round(stddev_samp(ps_den), 6) AS sd, round(min(ps_den), 6) AS minimum, round(max(ps_den), 6) AS maximum, "
    + ", ".join(f"round(quantile_cont(ps_den, {p}), 6) AS p{round(p * 100):02d}" for p in rp.DESCRIBE_PROBS)
    + " FROM w GROUP BY A",
)
def score_distribution(spark, folder):
    out = rp.describe_by(_fitted(spark, folder).df, "A", "ps_den")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("A", "n")})


@query(
    "shared_histogram",
    "M34",
    ro.with_sql(ro.UNITS_SQL)
    + """, e AS (SELECT min(price) AS lo, (max(price) - min(price)) / 31 AS width FROM units)
      SELECT A, CAST(least(floor((price - lo) / width), 30) AS INTEGER) AS bin, count(*) AS n, round(any_value(lo) + bin * any_value(width), 4) AS edge_lo, round(any_value(lo) + (bin + 1) * any_value(width), 4) AS edge_hi
      FROM units, e GROUP BY A, bin""",
)
def shared_histogram(spark, folder):
    out = rp.shared_histogram(ro.units(spark, folder), "price", 31)
    return out.withColumns({"edge_lo": F.round("edge_lo", 4), "edge_hi": F.round("edge_hi", 4)})


@query(
    "duration_descriptives",
    "M35",
    ro.with_sql(ro.UNITS_SQL)
    + f"""{GROUPED}, count(yc) AS n, round(avg(yc), 6) AS mean, round(stddev_samp(yc), 6) AS sd, quantile_cont(yc, 0.25) AS p25, quantile_cont(yc, 0.5) AS median, quantile_cont(yc, 0.75) AS p75
      FROM units GROUP BY GROUPING SETS ((), (A))""",
)
def duration_descriptives(spark, folder):
    out = rp.duration_summary(ro.units(spark, folder), "yc")
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(
    "baseline_table",
    "M36 F17 Q1",
    ro.with_sql(ro.UNITS_SQL)
    + """, b AS (SELECT *, CASE WHEN unit % 4 = 0 THEN NULL ELSE price END AS seen, CASE WHEN priority = '1-URGENT' AND unit % 300 = 0 THEN 1 ELSE 0 END AS rare FROM units),
      g AS (SELECT *, unnest(['overall', CASE WHEN A = 1 THEN 'deescalated_stopped' ELSE 'continued_broad' END]) AS grp FROM b)
      SELECT grp AS "group", 'seen' AS variable, 'continuous' AS type, count(seen) AS n, format('{:.1f} [{:.1f}, {:.1f}]', quantile_cont(seen, 0.5), quantile_cont(seen, 0.25), quantile_cont(seen, 0.75)) AS shown FROM g GROUP BY grp
      UNION ALL SELECT grp, 'closed', 'binary', CAST(sum(closed) AS BIGINT), CASE WHEN sum(closed) < 11 THEN '<11' ELSE format('{:d} ({:.1f}%)', CAST(sum(closed) AS BIGINT), sum(closed) * 100.0::DOUBLE / count(*)) END FROM g GROUP BY grp
      UNION ALL SELECT grp, 'rare', 'binary', CAST(sum(rare) AS BIGINT), CASE WHEN sum(rare) < 11 THEN '<11' ELSE format('{:d} ({:.1f}%)', CAST(sum(rare) AS BIGINT), sum(rare) * 100.0::DOUBLE / count(*)) END FROM g GROUP BY grp""",
)
def baseline_table(spark, folder):
    rows = ro.units(spark, folder).withColumns(
        {
            "seen": F.col("price"), "seen_missing": (F.col("unit") % 4 == 0).cast("int"),
            "rare": ((F.col("priority") == "1-URGENT") & (F.col("unit") % 300 == 0)).cast("int"),
        }
    )
    return rp.baseline_table(rows, ["seen"], ["closed", "rare"])


@query(
    "outcome_summary",
    "M37",
    ro.with_sql(ro.UNITS_SQL)
    + """SELECT 'y' AS outcome, 'binary' AS type, count(y) AS n, sum(y)::DOUBLE AS events, round(avg(y), 6) AS mean, NULL::DOUBLE AS sd, NULL::DOUBLE AS p25, NULL::DOUBLE AS median, NULL::DOUBLE AS p75, min(y)::DOUBLE AS minimum, max(y)::DOUBLE AS maximum FROM units
      UNION ALL SELECT 'yc', 'continuous', count(yc), NULL, round(avg(yc), 6), round(stddev_samp(yc), 6), quantile_cont(yc, 0.25), quantile_cont(yc, 0.5), quantile_cont(yc, 0.75), min(yc), max(yc) FROM units""",
)
def outcome_summary(spark, folder):
    out = rp.outcome_summary(ro.units(spark, folder), ["y"], ["yc"])
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


GATES = {"design": au.GateLimits(), "tight": au.GateLimits(rows=10**9, arm=10**9, smd=0.0, weight=1.0, success=1.01)}
_gate = lambda tag, g: f"""SELECT '{tag}' AS limits, rule, severity, observed, bound, CAST(CASE WHEN rule IN ('max_post_smd', 'max_weight', 'non_finite_weights') THEN observed <= bound ELSE observed >= bound END AS INTEGER) AS passes FROM (
  SELECT 'n' AS rule, 'warning' AS severity, n::DOUBLE AS observed, {float(g.rows)}::DOUBLE AS bound FROM gate_facts UNION ALL SELECT 'n_treated', 'error', n_treated, {float(g.arm)} FROM gate_facts
  UNION ALL SELECT 'n_control', 'error', n_control, {float(g.arm)} FROM gate_facts UNION ALL SELECT 'max_weight', 'warning', round(max_weight, 6), {g.weight} FROM gate_facts
  UNION ALL SELECT 'non_finite_weights', 'error', bad, 0.0 FROM gate_facts UNION ALL SELECT 'max_post_smd', 'error', (SELECT max(after) FROM bal WHERE weighting = 'Primary stabilized IPTW'), {g.smd}
  UNION ALL SELECT 'bootstrap_success', 'warning', (SELECT min(k) / max(k) FROM gate_boot), {g.success})"""  # noqa: E731


@query(
    "run_gate",
    "Q20",
    "WITH gate_boot AS MATERIALIZED (SELECT outcome, count(difference) AS k FROM ("
    + BOOT + boot_sql({"stabilized": "SW_A"}, {"y": "risk", "yc": "mean"}, "w") + ") GROUP BY 1),\n"
    + BALANCE_SQL.removeprefix("WITH ").rstrip()
    + ", gate_facts AS MATERIALIZED (SELECT count(*) AS n, count(*) FILTER (WHERE A = 1) AS n_treated, count(*) FILTER (WHERE A = 0) AS n_control, max(SW_A) AS max_weight, count(*) FILTER (WHERE NOT isfinite(SW_A)) AS bad FROM w)\n"
    + " UNION ALL ".join(_gate(tag, g) for tag, g in GATES.items()),
)
def run_gate(spark, folder):
    df = stage_border(_fitted(spark, folder).df)
    balance = stage_border(wt.balance_table(df, [*COVS, "building"]))
    intervals = stage_border(interval_table(_boot(spark, folder), REPS))
    rows = [au.study_gate(df, balance, intervals, g).withColumn("limits", F.lit(tag)) for tag, g in GATES.items()]
    return se.union_rows(rows).withColumn("observed", F.round("observed", 6))


@query(
    "parity_check",
    "Q19",
    ro.with_sql(ro.UNITS_SQL)
    + """, e AS (SELECT A, 'n' AS metric, count(*)::DOUBLE AS expected FROM units GROUP BY A UNION ALL SELECT A, 'risk', round(avg(y), 3) FROM units GROUP BY A UNION ALL SELECT 2, 'n', 5.0),
      o AS (SELECT A, 'n' AS metric, count(*)::DOUBLE AS observed FROM units GROUP BY A UNION ALL SELECT A, 'risk', avg(y) FROM units GROUP BY A)
      SELECT e.A, e.metric, expected, round(observed, 6) AS observed, CASE WHEN e.metric = 'n' THEN 0.0 ELSE 0.001 END::DOUBLE AS tolerance,
        CASE WHEN abs(observed - expected) <= CASE WHEN e.metric = 'n' THEN 0.0 ELSE 0.001 END THEN 1 ELSE 0 END AS passes FROM e LEFT JOIN o USING (A, metric)""",
)
def parity_check(spark, folder):
    by = ro.units(spark, folder).groupBy("A").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("risk"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("x")) for k in ("n", "risk")])).alias("c")
    long = by.select("A", cells).select("A", "c.metric", F.col("c.x").alias("observed"))
    want = long.select("A", "metric", F.when(F.col("metric") == "risk", F.round("observed", 3)).otherwise(F.col("observed")).alias("expected"))
    want = want.unionByName(spark.createDataFrame([(2, "n", 5.0)], "A int, metric string, expected double"))
    out = au.parity_check(long, want, ["A", "metric"], F.when(F.col("metric") == "n", 0.0).otherwise(0.001))
    return out.withColumn("observed", F.round("observed", 6))
