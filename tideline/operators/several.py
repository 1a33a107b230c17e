"""Several score models over one table, fitted together: each pass of the fit is one scan for all of them.

A model has its own covariates (any columns of the table), treatment column, rows (a 0/1 column) and squared terms.
Nested models, recoded contrasts, restricted cohorts and corrected covariates are all models of one table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_border
from . import kernels as kn
from .logit import BOOTSTRAP_MAX_ITER, FAN_IN, MAX_ITER, TASK_BUDGET, _added, build_design, count_tasks, intercept_only, newton_fits, summed_rows
from .resample import interval_table, row_hashes
from .weighting import with_contrasts


#: Rows of models times replicates that a task of a bootstrap scan reads.
TASK_DRAWS = 50_000_000


@dataclass(frozen=True)
class Model:
    """``columns`` maps a variable to the table column that holds it; ``squares`` are variables that enter squared too."""

    name: str
    columns: Mapping[str, str]
    treat: str = "A"
    rows: str | None = None
    squares: Sequence[str] = ()

    @classmethod
    def over(cls, name: str, variables: Sequence[str], swaps: Mapping[str, str] | None = None, **rest) -> Model:
        return cls(name, {v: (swaps or {}).get(v, v) for v in variables}, **rest)


@dataclass(frozen=True)
class Facts:
    """A column over the rows of a model."""

    n: int
    seen: int
    mean: float | None
    sd: float | None
    low: float | None
    high: float | None
    binary: bool

    @property
    def usable(self) -> bool:
        return self.seen > 0 and self.low < self.high


@dataclass
class Fits:
    """Fitted models with what their summary needs."""

    models: list[Model]
    plans: list[kn.Plan]
    variables: list[list[str]]
    facts: dict[tuple[str | None, str], Facts]
    beta: list[np.ndarray] = field(default_factory=list)
    method: list[str] = field(default_factory=list)
    passes: int = 0

    def of(self, i: int, column: str) -> Facts:
        return self.facts[(self.models[i].rows, column)]

    def share(self, i: int) -> float:
        return self.of(i, self.models[i].treat).mean


def profile_models(df: DataFrame, models: Sequence[Model]) -> dict[tuple[str | None, str], Facts]:
    """Facts of every (rows, column) that some model needs, in one scan."""
    wanted = sorted({(m.rows or "", c) for m in models for c in (*m.columns.values(), m.treat) if c in df.columns})
    cells = []
    for i, (rows, c) in enumerate(wanted):
        cell = F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x"))
        cells.append(cell if not rows else F.when(F.col(rows) == 1, cell))
    long = df.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*")
    x = F.when(~F.isnan("x"), F.col("x"))
    got = long.groupBy("i").agg(
        F.count("*").alias("n"), F.count(x).alias("seen"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.count_if(~x.isin(0.0, 1.0)).alias("other"),
    )
    none = {(rows or None, c): Facts(0, 0, None, None, None, None, False) for rows, c in wanted}
    return none | {
        (wanted[r["i"]][0] or None, wanted[r["i"]][1]): Facts(r["n"], r["seen"], r["mean"], r["sd"], r["low"], r["high"], r["seen"] > 0 and r["other"] == 0)
        for r in got.collect()
    }


def runnable(facts: Mapping[tuple[str | None, str], Facts], model: Model, minimum_rows: int = 0) -> bool:
    """Enough rows, and both arms among them."""
    arm = facts[(model.rows, model.treat)]
    return arm.n >= max(minimum_rows, 1) and arm.usable


def _plans(models: Sequence[Model], facts) -> tuple[list[kn.Plan], list[list[str]]]:
    """Absent, all-null and constant columns drop; mean fill, z-score, clip (see ``mean_prepared``)."""
    plans, names = [], []
    for m in models:
        used = [v for v, c in m.columns.items() if (m.rows, c) in facts and facts[(m.rows, c)].usable]
        of = [facts[(m.rows, m.columns[v])] for v in used]
        mean, sd = (np.array([[getattr(f, k) for f in of]], dtype=float).reshape(1, len(used)) for k in ("mean", "sd"))
        squares = [used.index(v) for v in m.squares if v in used and not facts[(m.rows, m.columns[v])].binary]
        design = build_design([m.columns[v] for v in used], [f.binary for f in of], mean, mean, sd, squares)
        plans.append(kn.Plan(design, m.treat, m.rows))
        names.append(used)
    return plans, names


def slim(df: DataFrame, plans: Sequence[kn.Plan], *more: str) -> DataFrame:
    """The columns that the plans read, and some more, as doubles: whatever else a table holds stays out of the Python tasks."""
    wanted = dict.fromkeys(c for p in plans for c in (*p.design.columns, p.treat, p.rows) if c is not None) | dict.fromkeys(more)
    return df.select(*[F.col(c).cast("double").alias(c) for c in wanted])


def fit_models(df: DataFrame, models: Sequence[Model], facts: Mapping | None = None, tasks: int | None = None) -> Fits:
    """Fit all models; a Newton step is one scan of ``df``, a table or stage border."""
    facts = profile_models(df, models) if facts is None else facts
    plans, names = _plans(models, facts)
    out = Fits(list(models), plans, names, facts)
    tasks = count_tasks(df) if tasks is None else tasks
    start = [intercept_only(p.design.width, out.share(i)) for i, p in enumerate(plans)]
    rows = np.array([out.of(i, m.treat).n for i, m in enumerate(models)], dtype=float)
    read = slim(df, plans)
    sums_of = lambda beta, live: summed_rows(read, partial(kn.model_newton, plans=plans, beta=beta, reps=None, live=live), tasks)
    out.beta, _, out.method, out.passes = newton_fits(sums_of, start, rows, np.ones(len(plans), dtype=bool), MAX_ITER)
    return out


def model_intervals(df: DataFrame, fits: Fits, outcome: str, ids: Sequence[str], reps: int, seed: int, tasks: int) -> DataFrame:
    """Percentile intervals of all models (``analysis`` is the model's number); all replicates of a batch share each scan."""
    plans, n_models = fits.plans, len(fits.models)
    # Hashed once, not in every pass.
    kept = slim(df, plans, outcome).columns
    hashed = df.withColumns(row_hashes(ids, seed)).select(*[F.col(c).cast("double").alias(c) for c in kept], "_h1", "_h2")
    # A pass costs rows x replicates, so small tables are dealt out too.
    drawn_rows = sum(fits.of(i, m.treat).n for i, m in enumerate(fits.models)) * reps
    hashed = stage_border(hashed.repartition(max(tasks, -(-drawn_rows // TASK_DRAWS)), "_h1"))
    tasks = count_tasks(hashed)
    centres = [np.array([fits.of(i, c).mean for c in p.design.columns], dtype=float) for i, p in enumerate(plans)]
    size = max(1, min(reps, TASK_BUDGET // max(1, sum(p.design.width**2 for p in plans))))
    parts = None
    for at in range(0, reps, size):
        batch = np.arange(at, min(at + size, reps))
        n_rep = len(batch)
        sums = summed_rows(hashed, partial(kn.model_moments, plans=plans, centres=centres, reps=batch), tasks)
        drawn, n, share, valid = [], np.zeros(n_models * n_rep), np.zeros(n_models * n_rep), np.zeros(n_models * n_rep, dtype=bool)
        for i, plan in enumerate(plans):
            block = np.array([sums[i * n_rep + r] for r in range(n_rep)])
            k = len(plan.design.columns)
            here = slice(i * n_rep, (i + 1) * n_rep)
            n[here], treated = block[:, 0], block[:, 1]
            share[here] = treated / np.maximum(block[:, 0], 1.0)
            valid[here] = (treated > 0) & (treated < block[:, 0])
            seen, s1, s2 = (block[:, 2 + j * k : 2 + (j + 1) * k] for j in range(3))
            safe = np.where(seen > 0, seen, 1.0)
            mean = centres[i] + s1 / safe
            sd = np.sqrt(np.maximum(s2 / safe - (s1 / safe) ** 2, 0.0))
            flags = [fits.of(i, c).binary for c in plan.design.columns]
            drawn.append(kn.Plan(build_design(plan.design.columns, flags, mean, mean, sd, plan.design.squares), plan.treat, plan.rows))
        start = [intercept_only(drawn[f // n_rep].design.width, share[f]) for f in range(n_models * n_rep)]
        sums_of = lambda beta, live: summed_rows(hashed, partial(kn.model_newton, plans=drawn, beta=beta, reps=batch, live=live), tasks)  # noqa: B023, E731
        beta, *_ = newton_fits(sums_of, start, n, valid, BOOTSTRAP_MAX_ITER)
        kernel = partial(kn.model_effects, plans=drawn, beta=beta, share=share, reps=batch, outcome=outcome, valid=valid)
        found = hashed.mapInPandas(kernel, "model int, rep int, w0 double, wy0 double, w1 double, wy1 double")
        parts = found if parts is None else parts.unionByName(found)
    summed = parts.groupBy("model", "rep").agg(*[F.sum(c).alias(c) for c in ("w0", "wy0", "w1", "wy1")])
    long = summed.select(
        "rep", F.col("model").alias("analysis"), F.lit(outcome).alias("outcome"), F.lit("risk").alias("kind"),
        F.when(F.col("w1") > 0, F.col("wy1") / F.col("w1")).alias("treated"), F.when(F.col("w0") > 0, F.col("wy0") / F.col("w0")).alias("control"),
    )
    return interval_table(with_contrasts(long), reps)


def model_rows(df: DataFrame, fits: Fits, outcome: str, tasks: int) -> list[dict]:
    """Sizes, risks, balance, effective sizes, weight and score range of every model, in one scan; a few numbers each.

    Balance is that of the model's usable variables as they are: 0 for a missing 0/1 value, else the mean.
    """
    checked = []
    for i, names in enumerate(fits.variables):
        columns = [fits.models[i].columns[v] for v in names]
        checked.append((columns, np.array([0.0 if fits.of(i, c).binary else fits.of(i, c).mean for c in columns])))
    share = np.array([fits.share(i) for i in range(len(fits.models))])
    kernel = partial(kn.model_summaries, plans=fits.plans, beta=fits.beta, share=share, outcome=outcome, checked=checked)
    read = slim(df, fits.plans, outcome, *[c for columns, _ in checked for c in columns])
    parts = stage_border(read.mapInPandas(kernel, "rep int, vec array<double>, w_max double, ps_low double, ps_max double").withColumn("part", F.spark_partition_id()))
    top = {r["rep"]: r for r in parts.groupBy("rep").agg(*[F.max(c).alias(c) for c in ("w_max", "ps_low", "ps_max")]).collect()}
    sums, left = parts.select("rep", "vec", "part"), tasks
    while left > FAN_IN:
        sums, left = _added(sums.withColumn("part", F.expr(f"part div {FAN_IN}")), ["rep", "part"]), -(-left // FAN_IN)
    out = []
    for r in _added(sums, ["rep"]).collect():
        i = r["rep"]
        model, names = fits.models[i], fits.variables[i]
        k = len(names)
        arms = np.array(r["vec"]).reshape(2, 5 + 2 * k)
        n, w, ww, wok, wy = arms[:, :5].T
        risk = [float(wy[a] / wok[a]) if wok[a] > 0 else None for a in (0, 1)]
        mean, square = arms[:, 5 : 5 + k] / w[:, None], arms[:, 5 + k :] / w[:, None]
        flags = np.array([fits.of(i, model.columns[v]).binary for v in names], dtype=bool)
        var = np.where(flags, mean * (1 - mean), np.maximum(square - mean * mean, 0.0))
        sd = np.sqrt(var.mean(axis=0))
        after = np.abs(np.where(sd < 1e-12, 0.0, (mean[1] - mean[0]) / np.where(sd < 1e-12, 1.0, sd)))
        worst = max(((float(after[j]), v) for j, v in enumerate(names)), default=(None, None))
        gap = None if None in risk else risk[1] - risk[0]
        out.append(
            {
                "analysis": model.name, "treated": risk[1], "control": risk[0], "difference": gap, "ratio": risk[1] / risk[0] if gap is not None and risk[0] > 0 else None,
                "max_post_smd": worst[0], "worst_balanced_variable": worst[1], "n": int(n.sum()), "n_treated": int(n[1]), "n_control": int(n[0]),
                "ess_treated": float(w[1] ** 2 / ww[1]), "ess_control": float(w[0] ** 2 / ww[0]), "max_weight": top[i]["w_max"], "ps_min": -top[i]["ps_low"],
                "ps_max": top[i]["ps_max"], "den_method": fits.method[i], "n_vars_used": k, "_at": i,
            }
        )
    return sorted(out, key=lambda row: row["_at"])
