"""Binomial logit by Newton steps on Spark-aggregated sums, with ridge fallback.

Each step is one scan: tasks turn their partition into a gradient and Hessian triangle per
replicate, Spark adds those up, and only replicates x p^2 numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as kn
from .order_stats import column_medians

MAX_ITER = 200
BOOTSTRAP_MAX_ITER = 150
RIDGE_ALPHA = 0.001
# Relative deviance change that ends the iteration; the last step is still applied, so the
# coefficients are good to about the square of what this leaves.
REL_TOL = 1e-10
Z_LIMIT = 8.0
# Numbers a task may hold for its replicates before they are split into batches.
TASK_BUDGET = 8_000_000


@dataclass
class Profile:
    """Per-column facts from one scan."""

    n: int
    seen: dict[str, int]
    mean: dict[str, float]
    sd: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    binary: dict[str, bool]

    def usable(self, c: str) -> bool:
        return self.seen[c] > 0 and self.low[c] < self.high[c]


def profile_columns(df: DataFrame, columns: Sequence[str]) -> Profile:
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"k{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
            F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), F.count_if(~x.isin(0.0, 1.0)).alias(f"o{i}"),
        ]
    row = df.agg(*aggs).first()
    pick = lambda tag: {c: row[f"{tag}{i}"] for i, c in enumerate(columns)}
    other = pick("o")
    seen = pick("k")
    return Profile(
        row["n"], seen, pick("m"), pick("s"), pick("l"), pick("h"), {c: seen[c] > 0 and other[c] == 0 for c in columns}
    )


def build_design(
    columns: Sequence[str], binary: Sequence[bool], fill: np.ndarray, mean: np.ndarray, sd: np.ndarray, squares: Sequence[int] = ()
) -> kn.Design:
    """``fill``, ``mean``, ``sd`` are (replicates, columns); 0/1 columns pass through unscaled."""
    flags = np.asarray(binary, dtype=bool)
    fill, mean, sd = (np.array(x, dtype=float, copy=True) for x in (fill, mean, sd))
    fill[:, flags], mean[:, flags], sd[:, flags] = 0.0, 0.0, 1.0
    sd[~(sd > 0)] = 1.0
    lo, hi = np.where(flags, 0.0, -Z_LIMIT), np.where(flags, 1.0, Z_LIMIT)
    return kn.Design(list(columns), fill, mean, sd, lo, hi, list(squares))


def mean_prepared(df: DataFrame, candidates: Sequence[str], quadratic: Sequence[str] = ()) -> tuple[kn.Design, Profile]:
    """Absent, all-null and constant columns drop; mean fill, z-score, clip at 8."""
    present = [c for c in candidates if c in df.columns]
    prof = profile_columns(df, present)
    used = [c for c in present if prof.usable(c)]
    binary = [prof.binary[c] for c in used]
    mean = np.array([[prof.mean[c] for c in used]], dtype=float).reshape(1, len(used))
    sd = np.array([[prof.sd[c] for c in used]], dtype=float).reshape(1, len(used))
    squares = [used.index(c) for c in quadratic if c in used and not prof.binary[c]]
    return build_design(used, binary, mean, mean, sd, squares), prof


def median_prepared(df: DataFrame, binary: Sequence[str], continuous: Sequence[str]) -> kn.Design:
    """Nothing drops; median fill, then z-score of the filled column (zero spread divides by 1)."""
    medians = column_medians(df, continuous)
    fill = {c: (0.0 if medians[c] is None else medians[c]) for c in continuous}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))) for c in continuous]
    row = df.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]
    ).first()
    nb = len(binary)
    as_row = lambda tag: np.array([[0.0] * nb + [row[f"{tag}{i}"] for i in range(len(continuous))]])
    return build_design(
        [*binary, *continuous],
        [True] * nb + [False] * len(continuous),
        np.array([[0.0] * nb + [fill[c] for c in continuous]]),
        as_row("m"),
        as_row("s"),
    )


def standardisation_table(design: kn.Design) -> list[dict]:
    """One row per model column: kind, mean and sd (null for 0/1 columns)."""
    rows = []
    for j, c in enumerate(design.columns):
        zero_one = design.hi[j] == 1.0
        rows.append(
            {
                "original_variable": c,
                "ps_variable": c if zero_one else f"{c}_z",
                "type": "binary" if zero_one else "continuous_standardized",
                "mean": None if zero_one else float(design.mean[0, j]),
                "sd": None if zero_one else float(design.sd[0, j]),
            }
        )
    return rows


def prepared_columns(design: kn.Design) -> dict[str, Column]:
    """The single-replicate design as Spark expressions (for balance of model columns)."""
    out = {}
    for j, c in enumerate(design.columns):
        x = F.coalesce(F.col(c).cast("double"), F.lit(float(design.fill[0, j])))
        z = (x - F.lit(float(design.mean[0, j]))) / F.lit(float(design.sd[0, j]))
        out[c] = F.greatest(F.lit(float(design.lo[j])), F.least(F.lit(float(design.hi[j])), z))
    return out


_VEC = T.StructType([T.StructField("rep", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])


#: Vectors that are added in one group.
FAN_IN = 32


def _added(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sums of ``vec`` per key: whole vectors move, not their elements."""
    listed = parts.groupBy(*keys).agg(F.collect_list("vec").alias("all"))
    later = F.slice("all", 2, F.size("all"))
    total = F.aggregate(later, F.col("all")[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return listed.select(*keys, total.alias("vec"))


def count_tasks(df: DataFrame) -> int:
    """Tasks of a scan of ``df`` (of those that have rows, the last one's place)."""
    return 1 + (df.select(F.spark_partition_id().alias("at")).agg(F.max("at")).first()[0] or 0)


def summed_rows(df: DataFrame, kernel, tasks: int | None = None) -> dict[int, np.ndarray]:
    """Add the tasks' vectors per number on Spark, ``FAN_IN`` at a time.

    ``tasks`` (see ``count_tasks``) sets the number of levels, so a group never holds more than ``FAN_IN`` vectors.
    """
    parts = df.mapInPandas(kernel, _VEC).withColumn("part", F.spark_partition_id())
    left = count_tasks(df) if tasks is None else tasks
    while left > FAN_IN:
        parts = _added(parts.withColumn("part", F.expr(f"part div {FAN_IN}")), ["rep", "part"])
        left = -(-left // FAN_IN)
    return {row["rep"]: np.array(row["vec"]) for row in _added(parts, ["rep"]).collect()}


def summed_vectors(df: DataFrame, kernel, reps: np.ndarray | None, n_rep: int, tasks: int | None = None) -> np.ndarray:
    """The same as (replicates, length)."""
    rows = summed_rows(df, kernel, tasks)
    at = {int(r): i for i, r in enumerate(range(n_rep) if reps is None else reps)}
    out = np.zeros((n_rep, len(next(iter(rows.values()))) if rows else 0))
    for rep, vec in rows.items():
        out[at[rep]] = vec
    return out


@dataclass
class Fit:
    beta: np.ndarray
    converged: np.ndarray
    method: list[str]
    passes: int
    reps: np.ndarray | None = None
    extra: dict = field(default_factory=dict)


def newton_steps(sums_of, start: Sequence[np.ndarray], n_rows, live, max_iter: int, ridge: float):
    """Newton from ``start`` for the fits in ``live``; ``sums_of(beta, live)`` gives their sums, in one scan for all."""
    beta = [np.array(b, dtype=float) for b in start]
    done = np.zeros(len(beta), dtype=bool)
    last = np.full(len(beta), np.inf)
    live = np.array(sorted(live), dtype=int)
    passes = 0
    while len(live) and passes < max_iter:
        sums = sums_of(beta, live)
        passes += 1
        still = []
        for p in sorted({len(beta[r]) for r in live}):
            same = np.array([r for r in live if len(beta[r]) == p])
            found = np.array([sums[r] for r in same])
            at = np.array([beta[r] for r in same])
            grad, dev = found[:, :p], found[:, -1]
            hess = np.zeros((len(same), p, p))
            i, j = np.triu_indices(p)
            hess[:, i, j] = hess[:, j, i] = found[:, p:-1]
            objective = dev
            if ridge:
                pull = ridge * np.asarray(n_rows, dtype=float)[same]
                grad = grad - pull[:, None] * at
                hess = hess + pull[:, None, None] * np.eye(p)
                objective = dev + pull * (at * at).sum(1)
            ok = np.isfinite(objective) & np.isfinite(hess).all((1, 2))
            step = np.full(at.shape, np.nan)
            step[ok] = (np.linalg.pinv(hess[ok], hermitian=True) @ grad[ok][:, :, None])[:, :, 0]
            ok &= np.isfinite(step).all(1)
            for r, move, value in zip(same[ok], step[ok], objective[ok], strict=True):
                beta[r] = beta[r] + move
                if abs(value - last[r]) <= REL_TOL * (abs(value) + 0.1):
                    done[r] = True
                else:
                    still.append(r)
                last[r] = value
        live = np.array(sorted(still), dtype=int)
    return beta, done, passes


def newton_fits(sums_of, start: Sequence[np.ndarray], n_rows, keep: np.ndarray, max_iter: int, alpha: float = RIDGE_ALPHA, force_ridge: bool = False):
    """Coefficients, convergence, method and passes; fits that do not converge get the ridge."""
    live = [] if force_ridge else list(np.flatnonzero(keep))
    beta, done, passes = newton_steps(sums_of, start, n_rows, live, max_iter, 0.0)
    again = [r for r in np.flatnonzero(keep) if not done[r]]
    method = ["glm"] * len(beta)
    if again:
        zero = [np.zeros_like(b) if r in set(again) else b for r, b in enumerate(beta)]
        ridged, fixed, more = newton_steps(sums_of, zero, n_rows, again, MAX_ITER, alpha)
        passes += more
        for r in again:
            beta[r], done[r], method[r] = ridged[r], fixed[r], "regularized_glm"
    return beta, done, method, passes


def intercept_only(width: int, share: float) -> np.ndarray:
    """Start at the fit without covariates."""
    inner = min(max(share, kn.SCORE_FLOOR), kn.SCORE_CEIL)
    start = np.zeros(width)
    start[0] = np.log(inner / (1.0 - inner))
    return start


def fit_designs(
    df: DataFrame, design: kn.Design, n_rows: np.ndarray, reps: np.ndarray | None = None, max_iter: int = MAX_ITER,
    valid: np.ndarray | None = None, alpha: float = RIDGE_ALPHA, force_ridge: bool = False, share: np.ndarray | None = None, tasks: int | None = None,
) -> Fit:
    """Fit every replicate of ``design``; those that do not converge get the ridge.

    ``share`` (treated share per replicate) starts the iteration at the intercept-only fit.
    """
    n_rep = len(n_rows)
    tasks = count_tasks(df) if tasks is None else tasks
    keep = np.ones(n_rep, dtype=bool) if valid is None else valid
    start = [np.zeros(design.width) if share is None else intercept_only(design.width, x) for x in (range(n_rep) if share is None else share)]

    def sums_of(beta, live):
        return summed_vectors(df, partial(kn.newton_sums, design=design, beta=beta, reps=reps, live=live), reps, n_rep, tasks)

    beta, done, method, passes = newton_fits(sums_of, start, n_rows, keep, max_iter, alpha, force_ridge)
    return Fit(np.array(beta), done, method, passes, reps)


def add_scores(df: DataFrame, design: kn.Design, beta: np.ndarray, out: str = "ps_den") -> DataFrame:
    """Fitted probability, clipped to [0.001, 0.999], as a plain column expression."""
    cols = prepared_columns(design)
    names = list(design.columns)
    terms = [cols[c] * F.lit(float(beta[1 + j])) for j, c in enumerate(names)]
    terms += [cols[names[j]] * cols[names[j]] * F.lit(float(beta[1 + len(names) + k])) for k, j in enumerate(design.squares)]
    eta = sum(terms, F.lit(float(beta[0])))
    eta = F.greatest(F.lit(-kn.ETA_LIMIT), F.least(F.lit(kn.ETA_LIMIT), eta))
    ps = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    return df.withColumn(out, F.greatest(F.lit(kn.SCORE_FLOOR), F.least(F.lit(kn.SCORE_CEIL), ps)))
