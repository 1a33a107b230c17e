"""Propensity weights, balance, effects and weight diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clip, finite
from ..functions.text import col
from . import kernels as kn
from .logit import (
    Fit,
    add_scores,
    fit_designs,
    mean_prepared,
    median_prepared,
    prepared_columns,
    profile_columns,
)
from .order_stats import column_quantiles, exact_quantiles

ARM_NAMES = {1: "deescalated_stopped", 0: "continued_broad"}


@dataclass
class Weighted:
    """A cohort with ``ps_den``, ``ps_num`` and ``SW_A``, and how it was fitted."""

    df: DataFrame
    design: kn.Design
    fit: Fit
    prevalence: float


def stabilised_weight(treat: Column | str, ps: Column | str, prevalence: float) -> Column:
    pn = min(max(prevalence, kn.SCORE_FLOOR), kn.SCORE_CEIL)
    return F.when(col(treat) == 1, F.lit(pn) / col(ps)).otherwise(F.lit(1.0 - pn) / (F.lit(1.0) - col(ps)))


def overlap_weight(treat: Column | str, ps: Column | str) -> Column:
    p = clip(ps, kn.SCORE_FLOOR, kn.SCORE_CEIL)
    return F.when(col(treat) == 1, F.lit(1.0) - p).otherwise(p)


def treated_share(df: DataFrame, treat: str) -> tuple[int, float]:
    row = df.agg(F.count("*").alias("n"), F.avg(F.col(treat).cast("double")).alias("p"), F.countDistinct(treat).alias("k")).first()
    if row["k"] != 2:
        raise ValueError("treatment must have two levels")
    return row["n"], row["p"]


def fit_weights(
    df: DataFrame,
    covariates: Sequence[str] = (),
    treat: str = "A",
    quadratic: Sequence[str] = (),
    site_b: tuple[Sequence[str], Sequence[str]] | None = None,
    ridge_only: bool = False,
    suffix: str = "",
) -> Weighted:
    """Fit the score and add ``ps_den``, ``ps_num``, ``SW_A`` (with ``suffix``).

    ``site_b`` = (binary, continuous) switches to median preparation with nothing dropped.
    ``df`` should be a table or a stage border: each Newton step rescans it.
    """
    n, share = treated_share(df, treat)
    if site_b is None:
        design, _ = mean_prepared(df, covariates, quadratic)
    else:
        design = median_prepared(df, *site_b)
    slim = df.select(F.col(treat).cast("double").alias("A"), *[c for c in design.columns if c != "A"])
    fit = fit_designs(slim, design, np.array([float(n)]), force_ridge=ridge_only, share=np.array([share]))
    out = add_scores(df, design, fit.beta[0], f"ps_den{suffix}")
    pn = min(max(share, kn.SCORE_FLOOR), kn.SCORE_CEIL)
    out = out.withColumns(
        {f"ps_num{suffix}": F.lit(float(pn)), f"SW_A{suffix}": stabilised_weight(treat, f"ps_den{suffix}", share)}
    )
    return Weighted(out, design, fit, share)


def truncation_limits(df: DataFrame, pairs: Sequence[tuple[float, float]], weight: str = "SW_A") -> dict[tuple[float, float], tuple[float, float]]:
    """Exact percentiles over both arms together for every (low, high) pair."""
    probs = sorted({p / 100.0 for pair in pairs for p in pair})
    row = exact_quantiles(df, [], weight, probs, [f"q{i}" for i in range(len(probs))]).first()
    at = {p: row[f"q{i}"] for i, p in enumerate(probs)}
    return {(lo, hi): (at[lo / 100.0], at[hi / 100.0]) for lo, hi in pairs}


def truncated_name(low: float, high: float, weight: str = "SW_A") -> str:
    return f"{weight}_trunc_{low:g}_{high:g}".replace(".", "_")


def add_truncated(df: DataFrame, pairs: Sequence[tuple[float, float]], weight: str = "SW_A") -> DataFrame:
    limits = truncation_limits(df, pairs, weight)
    return df.withColumns({truncated_name(*p, weight): clip(weight, lo, hi) for p, (lo, hi) in limits.items()})


def add_strategies(df: DataFrame, pairs: Sequence[tuple[float, float]] = ((1.0, 99.0), (2.5, 97.5)), treat: str = "A") -> tuple[DataFrame, dict[str, str]]:
    """Stabilised, overlap and truncated weights with their labels."""
    out = add_truncated(df.withColumn("OW_A", overlap_weight(treat, "ps_den")), pairs)
    names = {"Primary stabilized IPTW": "SW_A", "Overlap weighting": "OW_A"}
    names |= {f"IPTW truncated {lo:g}/{hi:g}": truncated_name(lo, hi) for lo, hi in pairs}
    return out, names


def weighted_average(sw: Column, swx: Column) -> Column:
    """Null when the weights do not add up to something positive."""
    return F.when(sw > 0, swx / sw)


def effect_table(
    df: DataFrame,
    outcomes: Mapping[str, str],
    weights: Mapping[str, str | None],
    treat: str = "A",
) -> DataFrame:
    """One scan for all weights x outcomes: arm means, difference, ratio (risks only).

    ``outcomes`` maps a column to ``risk`` or ``mean``; a weight of None is the plain mean.
    """
    ys = {f"_y{j}": finite(y) for j, y in enumerate(outcomes)}
    ws = {f"_w{i}": F.lit(1.0) if w is None else finite(w) for i, w in enumerate(weights.values())}
    slim = df.select(F.col(treat).alias("_a"), *[c.alias(k) for k, c in {**ys, **ws}.items()])
    aggs, rows = [], []
    for i, label in enumerate(weights):
        for j, (y, kind) in enumerate(outcomes.items()):
            aggs += [
                F.sum(F.when(F.col(f"_y{j}").isNotNull(), F.col(f"_w{i}"))).alias(f"w{i}_{j}"),
                F.sum(F.col(f"_w{i}") * F.col(f"_y{j}")).alias(f"s{i}_{j}"),
            ]
            rows.append(
                F.struct(
                    F.lit(label).alias("analysis"), F.lit(y).alias("outcome"), F.lit(kind).alias("kind"),
                    weighted_average(F.col(f"w{i}_{j}"), F.col(f"s{i}_{j}")).alias("x"),
                )
            )
    arms = slim.groupBy("_a").agg(*aggs).select("_a", F.explode(F.array(*rows)).alias("r")).select("_a", "r.*")
    long = arms.groupBy("analysis", "outcome", "kind").agg(
        F.max(F.when(F.col("_a") == 1, F.col("x"))).alias("treated"), F.max(F.when(F.col("_a") == 0, F.col("x"))).alias("control")
    )
    return with_contrasts(long)


def with_contrasts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "difference": F.col("treated") - F.col("control"),
            "ratio": F.when((F.col("kind") == "risk") & (F.col("control") > 0), F.col("treated") / F.col("control")),
        }
    )


def effective_size(w: Column) -> Column:
    return F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w))


def balance_table(
    df: DataFrame,
    variables: Sequence[str],
    weights: Mapping[str, str] | None = None,
    treat: str = "A",
    prepared: Mapping[str, Column] | None = None,
    zero_when_equal: bool = False,
) -> DataFrame:
    """Standardised differences before and after weighting for all variables in one job.

    Long format with several ``weights``: (weighting, variable, before, after, signed_*).
    ``prepared`` supplies model columns (then every variable is treated as continuous and a
    zero spread gives null unless the means agree).
    """
    weights = weights or {"SW_A": "SW_A"}
    if prepared is None:
        present = [v for v in variables if v in df.columns]
        prof = profile_columns(df, present)
        used = [v for v in present if prof.usable(v)]
        binary = {v: prof.binary[v] for v in used}
        value = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0 if binary[v] else float(prof.mean[v]))) for v in used}
        # Centring at the mean keeps the sums of squares well conditioned.
        centre = {v: 0.0 if binary[v] else float(prof.mean[v]) for v in used}
    else:
        used = list(variables)
        binary = {v: False for v in used}
        value, centre = {v: prepared[v] for v in used}, {v: 0.0 for v in used}
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.lit(binary[v]).alias("is_binary"), (value[v] - centre[v]).alias("x"))
            for v in used
        ]
    )
    w_cols = {f"_w{i}": finite(c) for i, c in enumerate(weights.values())}
    long = df.select(F.col(treat).alias("_a"), *[c.alias(k) for k, c in w_cols.items()], F.explode(cells).alias("_c")).select(
        "_a", *w_cols, "_c.*"
    )
    aggs = []
    for tag, arm in (("t", 1), ("c", 0)):
        here = F.col("_a") == arm
        for name, w in {"u": F.lit(1.0), **{k: F.col(k) for k in w_cols}}.items():
            aggs += [
                F.sum(F.when(here, w)).alias(f"{tag}{name}0"),
                F.sum(F.when(here, w * F.col("x"))).alias(f"{tag}{name}1"),
                F.sum(F.when(here, w * F.col("x") * F.col("x"))).alias(f"{tag}{name}2"),
            ]
    sums = long.groupBy("variable", "is_binary").agg(*aggs)

    def smd(name: str) -> Column:
        m = {t: F.try_divide(F.col(f"{t}{name}1"), F.col(f"{t}{name}0")) for t in "tc"}
        var = {
            t: F.when(F.col("is_binary"), m[t] * (1 - m[t])).otherwise(
                F.greatest(F.try_divide(F.col(f"{t}{name}2"), F.col(f"{t}{name}0")) - m[t] * m[t], F.lit(0.0))
            )
            for t in "tc"
        }
        sd = F.sqrt((var["t"] + var["c"]) / 2.0)
        empty = F.when(m["t"] == m["c"], F.lit(0.0)) if zero_when_equal else F.lit(0.0)
        # A spread this far below the scale of the column is rounding of an exact zero.
        return F.when(sd.isNull() | (sd < 1e-12), empty).otherwise((m["t"] - m["c"]) / sd)

    rows = [
        F.struct(F.lit(label).alias("weighting"), smd("u").alias("signed_before"), smd(f"_w{i}").alias("signed_after"))
        for i, label in enumerate(weights)
    ]
    out = sums.select("variable", F.explode(F.array(*rows)).alias("r")).select("variable", "r.*")
    return out.withColumns({"before": F.abs("signed_before"), "after": F.abs("signed_after")})


def worst_balance(balance: DataFrame, digits: int | None = None) -> DataFrame:
    """Largest remaining difference and its variable per weighting; of equal ones the last by name.

    With ``digits`` differences are compared, and equal, as they are reported: rounded.
    """
    if digits is not None:
        balance = balance.withColumn("after", F.round("after", digits))
    return balance.groupBy("weighting").agg(
        F.max("after").alias("max_post_smd"),
        F.max_by("variable", F.struct("after", "variable")).alias("worst_balanced_variable"),
    )


def group_labels(df: DataFrame, treat: str = "A") -> DataFrame:
    """Each row once for its arm and once for ``overall`` (a two-row grouping set)."""
    arm = F.when(F.col(treat) == 1, F.lit(ARM_NAMES[1])).otherwise(F.lit(ARM_NAMES[0]))
    return df.withColumn("group", F.explode(F.array(F.lit("overall"), arm)))


def weight_summary(df: DataFrame, weight: str = "SW_A", treat: str = "A") -> DataFrame:
    probs = [0.01, 0.05, 0.5, 0.95, 0.99]
    names = ["p01_weight", "p05_weight", "median_weight", "p95_weight", "p99_weight"]
    rows = group_labels(df.select(treat, F.col(weight).cast("double").alias("w")), treat)
    basic = rows.groupBy("group").agg(
        F.count("*").alias("n"), effective_size(F.col("w")).alias("effective_sample_size"),
        F.avg("w").alias("mean_weight"), F.min("w").alias("min_weight"), F.max("w").alias("max_weight"),
    )
    quant = exact_quantiles(rows, ["group"], "w", probs, names, bounded_groups=True).drop("n")
    return basic.join(quant, "group", "left")


TAIL_SIZES = (1, 5, 10, 20, 50, 100)


def weight_tails(df: DataFrame, weight: str = "SW_A", ps: str = "ps_den", treat: str = "A") -> DataFrame:
    """Tail diagnostics per arm, with the weight share of the largest k rows.

    The ranked part keeps at most 100 rows per arm: the rank filter is pushed below the shuffle.
    """
    base = df.select(F.col(treat).alias("A"), F.col(weight).cast("double").alias("w"), F.col(ps).cast("double").alias("ps"))
    basic = base.groupBy("A").agg(
        F.count("*").alias("n"), effective_size(F.col("w")).alias("effective_sample_size"), F.max("w").alias("max_weight"),
        F.sum("w").alias("_total"), F.min("ps").alias("ps_min"),
        F.count_if(F.col("ps") < 0.01).alias("n_ps_lt_0_01"), F.count_if(F.col("ps") < 0.025).alias("n_ps_lt_0_025"),
        F.count_if(F.col("ps") < 0.05).alias("n_ps_lt_0_05"),
    )
    ranked = base.withColumn("rk", F.row_number().over(Window.partitionBy("A").orderBy(F.desc("w")))).where(F.col("rk") <= max(TAIL_SIZES))
    tops = ranked.groupBy("A").agg(*[F.sum(F.when(F.col("rk") <= k, F.col("w"))).alias(f"_top{k}") for k in TAIL_SIZES])
    q_w = exact_quantiles(base, ["A"], "w", [0.99], ["p99_weight"], bounded_groups=True).drop("n")
    q_p = exact_quantiles(base, ["A"], "ps", [0.01, 0.05], ["ps_p01", "ps_p05"], bounded_groups=True).drop("n")
    out = basic.join(tops, "A").join(q_w, "A").join(q_p, "A")
    out = out.withColumns({f"top_{k}_weight_share": F.try_divide(F.col(f"_top{k}"), F.col("_total")) for k in TAIL_SIZES})
    group = F.when(F.col("A") == 1, F.lit(ARM_NAMES[1])).otherwise(F.lit(ARM_NAMES[0]))
    return out.select(group.alias("group"), *[c for c in out.columns if c != "A" and not c.startswith("_")])


def strategy_table(df: DataFrame, covariates: Sequence[str], weights: Mapping[str, str], outcome: str, treat: str = "A", digits: int | None = None) -> DataFrame:
    """One row per weighting: risks, balance (see ``worst_balance`` for ``digits``), effective sizes and maximum weight."""
    eff = effect_table(df, {outcome: "risk"}, weights, treat).drop("outcome", "kind")
    worst = worst_balance(balance_table(df, covariates, weights, treat), digits).withColumnRenamed("weighting", "analysis")
    aggs, rows = [], []
    for i, (label, w) in enumerate(weights.items()):
        for tag, arm in (("t", 1), ("c", 0)):
            aggs.append(effective_size(F.when(F.col(treat) == arm, F.col(w))).alias(f"{tag}{i}"))
        aggs.append(F.max(w).alias(f"m{i}"))
        rows.append(
            F.struct(
                F.lit(label).alias("analysis"), F.col(f"t{i}").alias("ess_treated"), F.col(f"c{i}").alias("ess_control"),
                F.col(f"m{i}").alias("max_weight"),
            )
        )
    sizes = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return eff.join(worst, "analysis").join(sizes, "analysis")


def table_one(df: DataFrame, continuous: Sequence[str], binary: Sequence[str], treat: str = "A", weight: str | None = None) -> DataFrame:
    """Arm means and standardised difference; median fill for continuous, 0 for binary."""
    cont, bins = [c for c in continuous if c in df.columns], [c for c in binary if c in df.columns]
    rows = column_quantiles(df, cont, [0.5], ["med"]).collect() if cont else []
    med = {r["variable"]: r["med"] for r in rows}
    fill = {c: float(med.get(c) or 0.0) for c in cont} | {c: 0.0 for c in bins}
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"), F.lit("continuous" if c in cont else "binary").alias("type"),
                F.lit(fill[c]).alias("shift"),
                (F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) - F.lit(fill[c])).alias("x"),
            )
            for c in [*cont, *bins]
        ]
    )
    w = F.lit(1.0) if weight is None else finite(weight)
    long = df.select(F.col(treat).alias("_a"), w.alias("_w"), F.explode(cells).alias("_c")).select("_a", "_w", "_c.*")
    aggs = []
    for tag, arm in (("t", 1), ("c", 0)):
        here = F.col("_a") == arm
        aggs += [
            F.sum(F.when(here, F.col("_w"))).alias(f"{tag}0"),
            F.sum(F.when(here, F.col("_w") * F.col("x"))).alias(f"{tag}1"),
            F.sum(F.when(here, F.col("_w") * F.col("x") * F.col("x"))).alias(f"{tag}2"),
        ]
    sums = long.groupBy("variable", "type", "shift").agg(*aggs)
    m = {t: F.try_divide(F.col(f"{t}1"), F.col(f"{t}0")) for t in "tc"}
    full = {t: m[t] + F.col("shift") for t in "tc"}
    var = {
        t: F.when(F.col("type") == "binary", full[t] * (1 - full[t])).otherwise(
            F.greatest(F.try_divide(F.col(f"{t}2"), F.col(f"{t}0")) - m[t] * m[t], F.lit(0.0))
        )
        for t in "tc"
    }
    sd = F.sqrt((var["t"] + var["c"]) / 2.0)
    smd = F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise((m["t"] - m["c"]) / sd)
    return sums.select(
        "variable", "type", full["t"].alias("treated"), full["c"].alias("continued"), smd.alias("SMD"), F.abs(smd).alias("abs_SMD")
    )


def missing_by_arm(df: DataFrame, variables: Sequence[str], treat: str = "A") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).isNull().alias("gone")) for v in variables])
    long = df.select(F.col(treat).alias("A"), F.explode(cells).alias("c"))
    return (
        long.groupBy("A", "c.variable")
        .agg(F.count("*").alias("n"), F.count_if("c.gone").alias("missing_n"))
        .withColumn("missing_prop", F.col("missing_n") / F.col("n"))
    )


def crude_rates(df: DataFrame, outcome: str, treat: str = "A") -> DataFrame:
    y = F.col(outcome).cast("double")
    return df.groupBy(F.col(treat).alias("A")).agg(
        F.count(y).alias("n"), F.sum(y).alias("events"), F.avg(y).alias("rate")
    )


def duplicate_columns(df: DataFrame, id_cols: Sequence[str], variables: Sequence[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Exact duplicates after filling, first occurrence kept.

    An order-independent hash per column proposes pairs in one scan; a second scan counts
    differing rows for the proposed pairs only, so a hash collision cannot drop a column.
    """
    present = [v for v in variables if v in df.columns]
    prof = profile_columns(df, present)
    used = [v for v in present if prof.usable(v)]
    filled = {
        v: F.coalesce(F.col(v).cast("double"), F.lit(0.0 if prof.binary[v] else float(prof.mean[v]))) for v in used
    }
    digest = df.agg(*[F.bit_xor(F.xxhash64(*id_cols, filled[v])).alias(f"h{i}") for i, v in enumerate(used)]).first()
    groups: dict[int, list[str]] = {}
    for i, v in enumerate(used):
        groups.setdefault(digest[f"h{i}"], []).append(v)
    pairs = [(g[i], g[j]) for g in groups.values() for i in range(len(g)) for j in range(i + 1, len(g))]
    if pairs:
        diff = df.agg(*[F.count_if(filled[a] != filled[b]).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
        pairs = [p for i, p in enumerate(pairs) if diff[f"d{i}"] == 0]
    dropped = {b for _, b in pairs}
    order = {v: i for i, v in enumerate(used)}
    return [v for v in used if v not in dropped], sorted(pairs, key=lambda p: (order[p[0]], order[p[1]]))


def design_rank(df: DataFrame, variables: Sequence[str]) -> dict:
    """Rank of [1, X] (missing as 0) from a Spark-aggregated, scaled Gram matrix."""
    present = [v for v in variables if v in df.columns]
    filled = [F.lit(1.0)] + [F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in present]
    p = len(filled)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(F.count("*").alias("n"), *[F.sum(filled[i] * filled[j]).alias(f"g{i}_{j}") for i, j in cells]).first()
    gram = np.zeros((p, p))
    for i, j in cells:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    rank = int(np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-10, hermitian=True))
    return {
        "n_rows": row["n"], "n_ps_columns": len(present), "n_columns_with_intercept": p,
        "rank_with_intercept": rank, "rank_deficiency": p - rank,
    }


def model_balance(w: Weighted, weights: Mapping[str, str], treat: str = "A") -> DataFrame:
    """Balance of the prepared model columns (date-level site rule)."""
    return balance_table(w.df, w.design.columns, weights, treat, prepared_columns(w.design), zero_when_equal=True)
