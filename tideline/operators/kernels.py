"""Small numpy kernels run inside ``mapInPandas`` tasks.

A task sees one partition, never a group, and emits sums whose size depends only on the number
of replicates and columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd

# Integer-hash multipliers.
MASK32 = 0xFFFFFFFF
WEYL = 0x9E3779B9
MIX = 0x45D9F3B
# Cumulative Poisson(1) probabilities that a 32-bit draw can tell from one: counts go up to 12, the next one is rarer
# than a step of the draw.
POISSON_CDF = tuple(x for x in accumulate(math.exp(-1.0) / math.factorial(k) for k in range(16)) if x < 1.0 - 2.0**-32)
ETA_LIMIT = 35.0
SCORE_FLOOR, SCORE_CEIL = 0.001, 0.999


#: The same limits as 32-bit numbers: a draw x / 2^32 reaches a probability where x reaches its limit.
_LIMITS = tuple(np.uint32(math.ceil(x * 2.0**32)) for x in POISSON_CDF)


def mix32(x: np.ndarray) -> np.ndarray:
    """Mix of 32-bit numbers, whose products wrap."""
    for _ in range(2):
        x = ((x >> np.uint32(16)) ^ x) * np.uint32(MIX)
    return (x >> np.uint32(16)) ^ x


def multiplicities(h1: np.ndarray, h2: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Poisson(1) counts, rows by replicates, from two 32-bit row hashes only."""
    step = (reps.astype(np.uint64) * np.uint64(WEYL) & np.uint64(MASK32)).astype(np.uint32)
    x = mix32(h1.astype(np.uint32)[:, None] + step[None, :])
    x = mix32(x ^ h2.astype(np.uint32)[:, None])
    count = np.zeros(x.shape, np.uint8)
    for limit in _LIMITS:
        count += x >= limit
    return count.astype(float)


@dataclass
class Design:
    """How raw columns become model columns, per replicate (first axis)."""

    columns: list[str]
    fill: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    squares: list[int] = field(default_factory=list)

    @property
    def width(self) -> int:
        return 1 + len(self.columns) + len(self.squares)

    def matrix(self, raw: np.ndarray, r: int) -> np.ndarray:
        x = np.where(np.isnan(raw), self.fill[r], raw)
        z = np.clip((x - self.mean[r]) / self.sd[r], self.lo, self.hi)
        return np.column_stack([np.ones(len(z)), z, *[z[:, j] ** 2 for j in self.squares]])


def _read(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return pdf[columns].to_numpy(dtype=float, na_value=np.nan) if columns else np.zeros((len(pdf), 0))


def _counts(pdf: pd.DataFrame, reps: np.ndarray | None) -> np.ndarray:
    if reps is None:
        return np.ones((len(pdf), 1))
    return multiplicities(pdf["_h1"].to_numpy(), pdf["_h2"].to_numpy(), reps)


def _scores(design: Design, raw: np.ndarray, beta: np.ndarray, r: int) -> np.ndarray:
    eta = np.clip(design.matrix(raw, r) @ beta[r], -ETA_LIMIT, ETA_LIMIT)
    return np.clip(1.0 / (1.0 + np.exp(-eta)), SCORE_FLOOR, SCORE_CEIL)


def stabilised(a: np.ndarray, ps: np.ndarray, prevalence: float | np.ndarray) -> np.ndarray:
    pn = np.clip(prevalence, SCORE_FLOOR, SCORE_CEIL)
    return np.where(a == 1, pn / ps, (1.0 - pn) / (1.0 - ps))


def _emit(reps: np.ndarray | None, totals: np.ndarray) -> pd.DataFrame:
    ids = np.arange(len(totals)) if reps is None else reps
    return pd.DataFrame({"rep": ids.astype("int32"), "vec": [row for row in totals]})


def moment_sums(batches: Iterator[pd.DataFrame], columns: list[str], centre: np.ndarray, reps: np.ndarray | None):
    """Per replicate: n, treated n, then per column the count, sum and sum of squares about ``centre``."""
    n_rep = 1 if reps is None else len(reps)
    total = np.zeros((n_rep, 2 + 3 * len(columns)))
    for pdf in batches:
        m = _counts(pdf, reps)
        raw = _read(pdf, columns) - centre
        seen = ~np.isnan(raw)
        x = np.where(seen, raw, 0.0)
        a = pdf["A"].to_numpy(dtype=float)
        total += np.column_stack([m.sum(0), m.T @ a, m.T @ seen, m.T @ x, m.T @ (x * x)])
    yield _emit(reps, total)


def newton_sums(batches: Iterator[pd.DataFrame], design: Design, beta: np.ndarray, reps: np.ndarray | None, live: np.ndarray):
    """Gradient, upper Hessian triangle and deviance for the replicates still iterating."""
    p = design.width
    upper = np.triu_indices(p)
    total = np.zeros((len(beta), p + len(upper[0]) + 1))
    for pdf in batches:
        m = _counts(pdf, reps)
        raw = _read(pdf, design.columns)
        y = pdf["A"].to_numpy(dtype=float)
        for r in live:
            use = m[:, r] > 0
            if not use.any():
                continue
            z = design.matrix(raw[use], r)
            w, t = m[use, r], y[use]
            eta = np.clip(z @ beta[r], -ETA_LIMIT, ETA_LIMIT)
            mu = 1.0 / (1.0 + np.exp(-eta))
            total[r, :p] += z.T @ (w * (t - mu))
            hess = (z * (w * mu * (1.0 - mu))[:, None]).T @ z
            total[r, p:-1] += hess[upper]
            total[r, -1] += 2.0 * np.sum(w * (np.logaddexp(0.0, eta) - t * eta))
    out = _emit(reps, total)
    yield out.iloc[live]


@dataclass
class Series:
    """Values to take replicate quantiles of: raw columns, or the stabilised weight."""

    columns: list[str]
    design: Design | None = None
    beta: np.ndarray | None = None
    prevalence: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.columns) if self.design is None else 1

    def values(self, pdf: pd.DataFrame, raw: np.ndarray, s: int, r: int) -> np.ndarray:
        if self.design is None:
            return raw[:, s]
        a = pdf["A"].to_numpy(dtype=float)
        return stabilised(a, _scores(self.design, raw, self.beta, r), self.prevalence[r])

    @property
    def reads(self) -> list[str]:
        return self.columns if self.design is None else self.design.columns


def ordered_keys(v: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles."""
    bits = (v + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def key_values(keys: np.ndarray) -> np.ndarray:
    """The doubles behind ``ordered_keys``."""
    sign = np.uint64(1 << 63)
    return np.where(keys & sign, keys & ~sign, ~keys).view(np.float64)


def bin_widths(lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """Keys per bin when the keys from ``lo`` to ``hi`` are dealt into at most ``bins`` bins."""
    return (hi - lo) // np.uint64(bins) + np.uint64(1)


def histogram_sums(batches, series: Series, reps, lo: np.ndarray, hi: np.ndarray, bins: int, live: np.ndarray):
    """Counts per bin of the keys ``lo`` to ``hi`` for every live (series, replicate, target), plus the count below.

    ``lo``, ``hi`` (keys) and ``live`` have shape (series, replicates, targets); bins hold equally many keys, so a far
    value costs no more than a few steps of the exponent.
    """
    n_s, n_r, n_t = lo.shape
    width = bin_widths(lo, hi, bins)
    total = np.zeros((n_r, n_s, n_t, bins + 1))
    for pdf in batches:
        m, raw = _counts(pdf, reps), _read(pdf, series.reads)
        for s in range(n_s):
            for r in np.flatnonzero(live[s].any(axis=1)):
                v = series.values(pdf, raw, s, r)
                use = ~np.isnan(v) & (m[:, r] > 0)
                key, w = ordered_keys(v[use]), m[use, r]
                for k in np.flatnonzero(live[s, r]):
                    a = lo[s, r, k]
                    total[r, s, k, 0] += w[key < a].sum()
                    inside = (key >= a) & (key <= hi[s, r, k])
                    at = ((key[inside] - a) // width[s, r, k]).astype(np.int64)
                    total[r, s, k, 1:] += np.bincount(at, weights=w[inside], minlength=bins)
    yield _emit(reps, total.reshape(n_r, -1))


def sliver_rows(batches, series: Series, reps, lo: np.ndarray, hi: np.ndarray, live: np.ndarray):
    """Distinct values with their counts whose key lies in [lo, hi] of a live (series, replicate, target)."""
    n_s, n_r, n_t = lo.shape
    for pdf in batches:
        m, raw = _counts(pdf, reps), _read(pdf, series.reads)
        for s in range(n_s):
            for r in np.flatnonzero(live[s].any(axis=1)):
                v = series.values(pdf, raw, s, r)
                use = ~np.isnan(v) & (m[:, r] > 0)
                v, w = v[use], m[use, r]
                key = ordered_keys(v)
                for k in np.flatnonzero(live[s, r]):
                    keep = (key >= lo[s, r, k]) & (key <= hi[s, r, k])
                    if keep.any():
                        # Equal values leave the task as one row.
                        found, back = np.unique(v[keep], return_inverse=True)
                        times = np.bincount(back, w[keep], minlength=len(found)).astype("int64")
                        yield pd.DataFrame({"s": np.int32(s), "r": np.int32(r), "k": np.int32(k), "v": found, "m": times})


def effect_sums(
    batches, design: Design, beta, prevalence, reps, outcomes: list[str], limits: np.ndarray, names: list[str], valid: np.ndarray
):
    """Weighted outcome sums per replicate, strategy, outcome and arm.

    Strategies: stabilised, overlap, then one truncated weight per pair in ``limits``
    (replicates, pairs, 2).
    """
    n_r, n_t, n_o = len(beta), len(names), len(outcomes)
    total = np.zeros((n_r, n_t, n_o, 2, 2))
    for pdf in batches:
        m, raw = _counts(pdf, reps), _read(pdf, design.columns)
        y = _read(pdf, outcomes)
        a = pdf["A"].to_numpy(dtype=float)
        for r in np.flatnonzero(valid):
            ps = _scores(design, raw, beta, r)
            sw = stabilised(a, ps, prevalence[r])
            weights = [sw, np.where(a == 1, 1.0 - ps, ps)]
            weights += [np.clip(sw, lo, hi) for lo, hi in limits[r]]
            for t, w in enumerate(weights):
                for arm in (0, 1):
                    wm = np.where(a == arm, w * m[:, r], 0.0)
                    ok = ~np.isnan(y)
                    total[r, t, :, arm, 0] += wm @ ok
                    total[r, t, :, arm, 1] += wm @ np.where(ok, y, 0.0)
    ids = np.arange(n_r) if reps is None else reps
    for r in np.flatnonzero(valid):
        yield pd.DataFrame(
            {
                "rep": np.int32(ids[r]),
                "analysis": np.repeat(names, n_o),
                "outcome": np.tile(outcomes, n_t),
                "w0": total[r, :, :, 0, 0].ravel(), "wy0": total[r, :, :, 0, 1].ravel(),
                "w1": total[r, :, :, 1, 0].ravel(), "wy1": total[r, :, :, 1, 1].ravel(),
            }
        )


@dataclass
class Plan:
    """One of several models over a table: its design over table columns, its treatment, the 0/1 column of its rows."""

    design: Design
    treat: str
    rows: str | None = None


class _Table:
    """Columns of a batch, each converted once for all models."""

    def __init__(self, pdf: pd.DataFrame, reps: np.ndarray | None):
        self.pdf, self.m, self.held = pdf, _counts(pdf, reps), {}

    def column(self, name: str) -> np.ndarray:
        if name not in self.held:
            self.held[name] = self.pdf[name].to_numpy(dtype=float, na_value=np.nan)
        return self.held[name]

    def use(self, plan: Plan) -> np.ndarray:
        return np.ones(len(self.pdf), dtype=bool) if plan.rows is None else self.column(plan.rows) == 1

    def raw(self, columns: list[str], use: np.ndarray) -> np.ndarray:
        return np.column_stack([self.column(c)[use] for c in columns]) if columns else np.zeros((int(use.sum()), 0))


def _fits(plans: list[Plan], reps: np.ndarray | None) -> int:
    return 1 if reps is None else len(reps)


#: Numbers of a block of rows by replicates, so that blocks stay in a core's cache however many replicates there are.
BLOCK = 1 << 17


def _tables(batches, reps: np.ndarray | None) -> Iterator[_Table]:
    """The batches, in short runs of rows where many replicates draw them."""
    for pdf in batches:
        step = max(len(pdf), 1) if reps is None else max(16, BLOCK // max(len(reps), 1))
        for at in range(0, max(len(pdf), 1), step):
            yield _Table(pdf.iloc[at : at + step], reps)


class Joint:
    """Replicates of one model that read the rows together.

    A replicate's column is linear in the value (0 where it is missing) and in a 1 for a missing value, so that rows
    no replicate clips have one matrix for all replicates: intercept, values about a common centre, missing values.
    Rows that some replicate clips, and all rows of a design with squares, get the columns of each replicate.
    """

    def __init__(self, design: Design, reps: np.ndarray, beta: Sequence[np.ndarray]):
        self.design, self.beta, k = design, np.array(beta).reshape(len(reps), design.width), len(design.columns)
        self.fill, self.mean, self.sd = (x[reps] for x in (design.fill, design.mean, design.sd))
        self.centre, self.scale = self.mean.mean(0), self.sd.mean(0)
        self.low, self.high = (design.lo * self.sd + self.mean).max(0), (design.hi * self.sd + self.mean).min(0)
        seen = (self.centre - self.mean) / self.sd
        lost = np.clip((self.fill - self.mean) / self.sd, design.lo, design.hi)
        self.to_own = np.zeros((len(reps), design.width, 1 + 2 * k))
        self.to_own[:, 0, 0] = 1.0
        for j in range(k):
            self.to_own[:, 1 + j, 0], self.to_own[:, 1 + j, 1 + j], self.to_own[:, 1 + j, 1 + k + j] = seen[:, j], self.scale[j] / self.sd[:, j], (lost - seen)[:, j]
        self.shared_beta = np.einsum("rpq,rp->qr", self.to_own, self.beta)
        self.sums = np.zeros((len(reps), 1 + 2 * k)), np.zeros((len(reps), 1 + 2 * k, 1 + 2 * k))
        self.own_sums = np.zeros((len(reps), design.width)), np.zeros((len(reps), design.width, design.width))
        self.deviance = np.zeros(len(reps))

    def parts(self, raw: np.ndarray) -> Iterator[tuple]:
        """(rows, columns, places of shared columns or None, linear predictor by replicate) of the rows, in parts."""
        missing = np.isnan(raw)
        plain = (missing | (raw >= self.low) & (raw <= self.high)).all(1) & (not self.design.squares)
        if plain.any():
            rows = slice(None) if plain.all() else np.flatnonzero(plain)
            gone = missing[rows]
            held = np.flatnonzero(gone.any(0))
            x = np.column_stack([np.ones(len(gone)), np.where(gone, 0.0, (raw[rows] - self.centre) / self.scale), gone[:, held]])
            at = np.concatenate([np.arange(1 + raw.shape[1]), 1 + raw.shape[1] + held])
            yield rows, x, at, _limited(x @ self.shared_beta[at])
        others, step = np.flatnonzero(~plain), max(1, BLOCK // self.to_own[:, :, 0].size)
        for rows in (others[i : i + step] for i in range(0, len(others), step)):
            value = np.where(missing[rows][:, None, :], self.fill, raw[rows][:, None, :])
            z = np.clip((value - self.mean) / self.sd, self.design.lo, self.design.hi)
            x = np.concatenate([np.ones((*z.shape[:2], 1)), z, z[..., self.design.squares] ** 2], -1)
            yield rows, x, None, _limited(np.einsum("nrp,rp->nr", x, self.beta))

    def add(self, raw: np.ndarray, y: np.ndarray, counts: np.ndarray) -> None:
        """Add the rows to gradient, Hessian and deviance."""
        for rows, x, at, eta in self.parts(raw):
            # Few arrays of rows by replicates: they are what the pass costs.
            w, t = counts[rows], y[rows]
            odds = np.negative(eta)
            np.exp(odds, out=odds)
            odds += 1.0
            # log(1 + e^eta) - t eta, with log(1 + e^eta) = eta + log(1 + e^-eta).
            eta *= (1.0 - t)[:, None]
            eta += np.log(odds)
            eta *= w
            self.deviance += 2.0 * eta.sum(0)
            mu = np.reciprocal(odds, out=odds)
            wmu = np.multiply(w, mu, out=eta)
            pull = w * t[:, None]
            pull -= wmu
            np.subtract(1.0, mu, out=mu)
            curve = np.multiply(wmu, mu, out=mu)
            if at is not None:
                i, j = np.triu_indices(len(at))
                both = ((x[:, i] * x[:, j]).T @ curve).T
                self.sums[0][:, at] += (x.T @ pull).T
                self.sums[1][:, at[i], at[j]] += both
            else:
                self.own_sums[0][:] += np.einsum("nr,nrp->rp", pull, x)
                self.own_sums[1][:] += np.einsum("nrp,nrq->rpq", x * curve[..., None], x)

    def vectors(self) -> np.ndarray:
        """Gradient, upper Hessian triangle and deviance of every replicate, in its own columns."""
        upper = self.sums[1]
        whole = upper + np.triu(upper, 1).transpose(0, 2, 1)
        grad = np.einsum("rpq,rq->rp", self.to_own, self.sums[0]) + self.own_sums[0]
        hess = self.to_own @ whole @ self.to_own.transpose(0, 2, 1) + self.own_sums[1]
        i, j = np.triu_indices(self.design.width)
        return np.column_stack([grad, hess[:, i, j], self.deviance])


def _limited(eta: np.ndarray) -> np.ndarray:
    return np.clip(eta, -ETA_LIMIT, ETA_LIMIT, out=eta)


def _joint(plans: list[Plan], beta: list[np.ndarray], n_rep: int, fits: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """(model, its fits, their places among the replicates drawn, ``Joint``) of every model, and the replicates drawn."""
    fits = np.asarray(fits, dtype=int)
    drawn, out = np.unique(fits % n_rep), []
    for i in np.unique(fits // n_rep):
        own = fits[fits // n_rep == i]
        at = np.searchsorted(drawn, own % n_rep)
        out.append((i, own, slice(None) if len(at) == len(drawn) else at, Joint(plans[i].design, own % n_rep, [beta[f] for f in own])))
    return out, drawn


def model_moments(batches, plans: list[Plan], centres: list[np.ndarray], reps: np.ndarray | None):
    """``moment_sums`` of every model and replicate; fit number = model x replicates + replicate."""
    n_rep, total = _fits(plans, reps), {}
    for t in _tables(batches, reps):
        for i, plan in enumerate(plans):
            use = t.use(plan)
            m, raw, a = t.m[use], t.raw(plan.design.columns, use) - centres[i], t.column(plan.treat)[use]
            seen = ~np.isnan(raw)
            x = np.where(seen, raw, 0.0)
            sums = m.T @ np.column_stack([np.ones(len(a)), a, seen, x, x * x])
            total[i] = total.get(i, 0.0) + sums
    rows = [(i * n_rep + r, v) for i, s in total.items() for r, v in enumerate(s)]
    # A part of a file between two row groups has no rows, and an empty column no type.
    if rows:
        yield pd.DataFrame({"rep": np.array([f for f, _ in rows], "int32"), "vec": [v for _, v in rows]})


def model_newton(batches, plans: list[Plan], beta: list[np.ndarray], reps: np.ndarray | None, live: np.ndarray):
    """``newton_sums`` of every fit still iterating, models and replicates alike, in one pass over the rows."""
    models, drawn = _joint(plans, beta, _fits(plans, reps), live)
    some = False
    for t in _tables(batches, None if reps is None else reps[drawn]):
        some = True
        for i, _, at, joint in models:
            use = t.use(plans[i])
            joint.add(t.raw(plans[i].design.columns, use), t.column(plans[i].treat)[use], t.m[use][:, at])
    if some:
        yield pd.concat(
            [pd.DataFrame({"rep": own.astype("int32"), "vec": list(joint.vectors())}) for _, own, _, joint in models], ignore_index=True
        )


def _model_weights(t: _Table, plan: Plan, use: np.ndarray, beta: np.ndarray, share: float, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Treatment, score and stabilised weight of the model's rows."""
    eta = np.clip(plan.design.matrix(t.raw(plan.design.columns, use), r) @ beta, -ETA_LIMIT, ETA_LIMIT)
    ps = np.clip(1.0 / (1.0 + np.exp(-eta)), SCORE_FLOOR, SCORE_CEIL)
    a = t.column(plan.treat)[use]
    return a, ps, stabilised(a, ps, share)


def model_effects(batches, plans: list[Plan], beta: list[np.ndarray], share: np.ndarray, reps: np.ndarray, outcome: str, valid: np.ndarray):
    """Weighted outcome sums of every fit: w and wy of the control, then of the treated arm."""
    models, drawn = _joint(plans, beta, _fits(plans, reps), np.flatnonzero(valid))
    total = {}
    for t in _tables(batches, reps[drawn]):
        for i, own, at, joint in models:
            use = t.use(plans[i])
            a, y, m = t.column(plans[i].treat)[use], t.column(outcome)[use], t.m[use][:, at]
            arms = [a == arm for arm in (0, 1)]
            kinds = np.column_stack([x for here in arms for x in (here & ~np.isnan(y), np.where(here & ~np.isnan(y), y, 0.0))]).astype(float)
            part = np.zeros((len(own), 4))
            for rows, _, _, eta in joint.parts(t.raw(plans[i].design.columns, use)):
                ps = np.clip(1.0 / (1.0 + np.exp(-eta)), SCORE_FLOOR, SCORE_CEIL)
                part += (stabilised(a[rows][:, None], ps, share[own]) * m[rows]).T @ kinds[rows]
            total[i] = total.get(i, 0.0) + part
    fits = [(int(i), int(reps[f % len(reps)]), *v) for i, own, _, _ in models if i in total for f, v in zip(own, total[i])]
    yield pd.DataFrame(fits, columns=["model", "rep", "w0", "wy0", "w1", "wy1"]).astype({"model": "int32", "rep": "int32"})


def model_summaries(batches, plans: list[Plan], beta: list[np.ndarray], share: np.ndarray, outcome: str, checked: list[tuple[list[str], np.ndarray]]):
    """Sums of every model over its arms (control, treated), and the extremes of weights and scores.

    Per arm: rows, w, w^2, w and wy of rows with an outcome, then wx and wx^2 of the checked columns about the value
    given for them, which also stands for a missing one.
    """
    total, high = {}, {}
    for pdf in batches:
        t = _Table(pdf, None)
        for i, plan in enumerate(plans):
            use = t.use(plan)
            if not use.any():
                continue
            a, ps, sw = _model_weights(t, plan, use, beta[i], share[i], 0)
            y = t.column(outcome)[use]
            ok = ~np.isnan(y)
            columns, about = checked[i]
            x = np.nan_to_num(t.raw(columns, use) - about, nan=0.0)
            vec = []
            for arm in (0, 1):
                here = a == arm
                w = np.where(here, sw, 0.0)
                vec += [here.sum(), w.sum(), (w * w).sum(), w[ok].sum(), (w * np.where(ok, y, 0.0)).sum(), *(w @ x), *(w @ (x * x))]
            total[i] = total.get(i, 0.0) + np.array(vec, dtype=float)
            top = np.array([sw.max(), -ps.min(), ps.max()])
            high[i] = np.maximum(high.get(i, -np.inf), top)
    if total:
        yield pd.DataFrame(
            {"rep": np.array(list(total), "int32"), "vec": list(total.values())} | {c: [high[i][k] for i in total] for k, c in enumerate(("w_max", "ps_low", "ps_max"))}
        )
