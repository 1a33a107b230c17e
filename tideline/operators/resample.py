"""Bootstrap with the score refitted in every replicate.

Rows get Poisson(1) counts from a hash of their id, the seed and the replicate number, so a
replicate is the same whatever the partitioning or task retries.  All replicates of a batch
share each scan; tasks emit sums, never rows (apart from the quantile slivers, which are bounded).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_border
from . import kernels as kn
from .logit import BOOTSTRAP_MAX_ITER, TASK_BUDGET, build_design, count_tasks, fit_designs, profile_columns, summed_vectors
from .weighting import with_contrasts

PAIRS = ((1.0, 99.0), (2.5, 97.5))
BINS = 2048
#: Drawn rows of a target that one task ranks.
SLIVER = 4096


def row_hashes(ids: Sequence[str], seed: int) -> dict:
    """Two 32-bit hashes per row from the md5 of id columns and seed."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return {"_h1": word(1), "_h2": word(9)}


def replicate_quantiles(
    table: DataFrame, series: kn.Series, reps: np.ndarray, probs: Sequence[float], lo: np.ndarray, hi: np.ndarray, tasks: int | None = None
) -> np.ndarray:
    """Exact weighted quantiles, shape (series, replicates, probabilities).

    The two ranks of every quantile are targets of their own.  A histogram pass cuts the keys that may hold a target
    into ``BINS`` runs and keeps the run that holds it, again and again, until at most ``SLIVER`` drawn rows are left;
    a last pass ranks those.  Keys have 64 bits, so six passes end in a single value, however the values are spread.
    ``lo`` and ``hi`` are (series,) bounds of the values.
    """
    n_s, n_r, n_p = series.size, len(reps), len(probs)
    shape = (n_s, n_r, 2 * n_p)
    a, b = (np.broadcast_to(kn.ordered_keys(np.asarray(x, dtype=float))[:, None, None], shape).copy() for x in (lo, hi))
    start, left = np.zeros(shape), np.full(shape, np.inf)
    p, n, rank = np.asarray(probs)[None, None, :], None, None
    live = np.ones(shape, dtype=bool)
    while live.any():
        # Where all targets of a series still share one range (as at first), it is counted once.
        same = n is None
        ask = live.copy()
        if same:
            ask[..., 1:] = False
        sums = summed_vectors(table, partial(kn.histogram_sums, series=series, reps=reps, lo=a, hi=b, bins=BINS, live=ask), reps, n_r, tasks)
        sums = sums.reshape(n_r, n_s, 2 * n_p, BINS + 1).transpose(1, 0, 2, 3)
        if same:
            sums = np.broadcast_to(sums[..., :1, :], (*shape, BINS + 1))
            n = sums[..., 0, :].sum(-1)[..., None]
            rank = np.concatenate([np.floor(p * (n - 1)), np.ceil(p * (n - 1))], -1)
        upto = np.cumsum(sums, -1)
        at = (upto[..., 1:] > rank[..., None]).argmax(-1)
        width = kn.bin_widths(a, b, BINS)
        before, after = (np.take_along_axis(upto, at[..., None] + k, -1)[..., 0] for k in (0, 1))
        low = a + at.astype(np.uint64) * width
        start, left = np.where(live, before, start), np.where(live, after - before, left)
        a, b = np.where(live, low, a), np.where(live, np.minimum(b, low + (width - np.uint64(1))), b)
        live &= (left > SLIVER) & (b > a) & (n > 0)
    single = b == a
    value = np.where(single, kn.key_values(a), np.nan)
    open_ = ~single & (n > 0)
    if open_.any():
        found = _ranked_slivers(table, series, reps, a, b, open_, start, rank)
        value[open_] = found[open_]
    x, y = value[..., :n_p], value[..., n_p:]
    return np.where(n > 0, x + (y - x) * (p * (n - 1) - rank[..., :n_p]), np.nan)


def _ranked_slivers(table, series, reps, a, b, open_, start, rank) -> np.ndarray:
    """The value at its rank of every open target; a group holds at most ``SLIVER`` rows."""
    schema = T.StructType(
        [T.StructField(c, T.IntegerType()) for c in "srk"] + [T.StructField("v", T.DoubleType()), T.StructField("m", T.LongType())]
    )
    rows = table.mapInPandas(partial(kn.sliver_rows, series=series, reps=reps, lo=a, hi=b, live=open_), schema)
    rows = rows.groupBy("s", "r", "k").agg(F.collect_list(F.struct("v", "m")).alias("held"))
    targets = table.sparkSession.createDataFrame(
        [(int(s), int(r), int(k), float(start[s, r, k]), float(rank[s, r, k])) for s, r, k in zip(*np.nonzero(open_))],
        "s int, r int, k int, start double, rank double",
    )
    # Drawn rows up to and including each value, until the first beyond the rank.
    step = lambda acc, x: F.when(acc["upto"] > F.col("rank"), acc).otherwise(
        F.struct((acc["upto"] + x["m"]).alias("upto"), x["v"].alias("v"))
    )
    first = F.struct(F.col("start").alias("upto"), F.lit(None).cast("double").alias("v"))
    picked = F.aggregate(F.array_sort("held"), first, step)["v"]
    out = np.full(a.shape, np.nan)
    for row in rows.join(F.broadcast(targets), ["s", "r", "k"]).select("s", "r", "k", picked.alias("v")).collect():
        out[row["s"], row["r"], row["k"]] = row["v"]
    return out


def bootstrap_table(
    df: DataFrame,
    ids: Sequence[str],
    covariates: Sequence[str],
    outcomes: Mapping[str, str],
    reps: int,
    seed: int,
    treat: str = "A",
    pairs: Sequence[tuple[float, float]] = (),
    overlap: bool = False,
    prepare: str = "mean",
    binary: Sequence[str] | None = None,
) -> tuple[DataFrame, dict]:
    """Replicate table (rep, analysis, outcome, kind, treated, control, difference, ratio) and diagnostics.

    One fit per replicate serves every outcome and weight.  ``prepare='median'`` refills with the
    replicate's median and drops nothing; ``mean`` is the hour-level rule.
    """
    covariates = [c for c in covariates if c in df.columns]
    names = list(outcomes)
    slim = df.select(
        F.col(treat).cast("double").alias("A"),
        *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*covariates, *names]) if c != treat],
        *[c.alias(k) for k, c in row_hashes(ids, seed).items()],
    )
    table = stage_border(slim)
    prof = profile_columns(table, covariates)
    used = list(covariates) if prepare == "median" else [c for c in covariates if prof.usable(c)]
    is_binary = [(c in binary) if binary is not None else prof.binary[c] for c in used]
    centre = np.array([prof.mean[c] or 0.0 for c in used])
    p = 1 + len(used)
    # 0/1 columns are filled with 0 whatever their median is.
    spread = [j for j, zero_one in enumerate(is_binary) if not zero_one] if prepare == "median" else []
    size = max(1, min(reps, TASK_BUDGET // max(p * p, len(pairs) * 4 * BINS, len(spread) * 2 * BINS, 1)))
    tasks = count_tasks(table)
    strategies = ["stabilized"] + (["overlap"] if overlap else []) + [f"trunc_{lo:g}_{hi:g}" for lo, hi in pairs]
    parts, methods, failed = [], [], 0
    for at in range(0, reps, size):
        batch = np.arange(at, min(at + size, reps))
        sums = summed_vectors(table, partial(kn.moment_sums, columns=used, centre=centre, reps=batch), batch, len(batch), tasks)
        k = len(used)
        n, treated = sums[:, 0], sums[:, 1]
        seen, s1, s2 = sums[:, 2 : 2 + k], sums[:, 2 + k : 2 + 2 * k], sums[:, 2 + 2 * k :]
        valid = (treated > 0) & (treated < n)
        failed += int((~valid).sum())
        safe = np.where(seen > 0, seen, 1.0)
        mean = centre + s1 / safe
        sd = np.sqrt(np.maximum(s2 / safe - (s1 / safe) ** 2, 0.0))
        fill = mean
        if prepare == "median" and used:
            fill = np.zeros((len(batch), len(used)))
            if spread:
                series = kn.Series([used[j] for j in spread])
                lo, hi = (np.array([v if v is not None else 0.0 for v in (d[used[j]] for j in spread)]) for d in (prof.low, prof.high))
                found = replicate_quantiles(table, series, batch, [0.5], lo, hi, tasks)[:, :, 0].T
                fill[:, spread] = np.where(np.isnan(found), 0.0, found)
            gap, lost = fill - centre, n[:, None] - seen
            total = np.maximum(n[:, None], 1.0)
            m1 = (s1 + lost * gap) / total
            sd = np.sqrt(np.maximum((s2 + lost * gap * gap) / total - m1 * m1, 0.0))
            mean = centre + m1
        design = build_design(used, is_binary, fill, mean, sd)
        share = treated / np.maximum(n, 1.0)
        fit = fit_designs(table, design, n, batch, BOOTSTRAP_MAX_ITER, valid, share=share, tasks=tasks)
        limits = np.zeros((len(batch), len(pairs), 2))
        if pairs:
            probs = [x / 100.0 for pair in pairs for x in pair]
            weight = kn.Series([], design, fit.beta, share)
            # Stabilised weights are bounded by the score clip.
            bounds = np.array([0.0]), np.array([1.0 / kn.SCORE_FLOOR])
            limits = replicate_quantiles(table, weight, batch, probs, *bounds, tasks)[0].reshape(len(batch), len(pairs), 2)
        kernel = partial(
            kn.effect_sums, design=design, beta=fit.beta, prevalence=share, reps=batch, outcomes=names, limits=limits,
            names=["stabilized", "overlap", *[f"trunc_{lo:g}_{hi:g}" for lo, hi in pairs]], valid=valid,
        )
        schema = "rep int, analysis string, outcome string, w0 double, wy0 double, w1 double, wy1 double"
        parts.append(table.mapInPandas(kernel, schema))
        methods += [m for m, ok in zip(fit.method, valid) if ok]
    everything = parts[0]
    for more in parts[1:]:
        everything = everything.unionByName(more)
    kinds = F.create_map(*[F.lit(x) for kv in outcomes.items() for x in kv])
    summed = everything.where(F.col("analysis").isin(*strategies)).groupBy("rep", "analysis", "outcome").agg(
        *[F.sum(c).alias(c) for c in ("w0", "wy0", "w1", "wy1")]
    )
    long = summed.select(
        "rep", "analysis", "outcome", kinds[F.col("outcome")].alias("kind"),
        F.when(F.col("w1") > 0, F.col("wy1") / F.col("w1")).alias("treated"),
        F.when(F.col("w0") > 0, F.col("wy0") / F.col("w0")).alias("control"),
    )
    diag = {"n_requested": reps, "n_failed": failed, "n_regularized": sum(m != "glm" for m in methods)}
    return with_contrasts(long), diag


ESTIMANDS = ("treated", "control", "difference", "ratio")


def interval_table(replicates: DataFrame, requested: int, level: float = 0.95) -> DataFrame:
    """Percentile intervals per (analysis, outcome, estimand); a group holds one value per replicate."""
    tail = (1.0 - level) / 2.0
    cells = F.array(*[F.struct(F.lit(e).alias("estimand"), F.col(e).alias("x")) for e in ESTIMANDS])
    long = replicates.select("analysis", "outcome", F.explode(cells).alias("c")).select("analysis", "outcome", "c.*")
    usable = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    return (
        long.groupBy("analysis", "outcome", "estimand")
        .agg(
            F.percentile(usable, F.lit(tail)).alias("lower_95"),
            F.percentile(usable, F.lit(1.0 - tail)).alias("upper_95"),
            F.count(usable).alias("n_success"),
        )
        .withColumn("n_requested", F.lit(requested))
        .where(F.col("n_success") > 0)
    )
