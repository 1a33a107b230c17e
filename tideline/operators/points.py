"""Point events joined to entity windows and reduced in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def inside(ts: Column | str, lo: Column | str, hi: Column | str, closed: str = "both") -> Column:
    """``both``: [lo, hi]; ``left``: [lo, hi)."""
    t = col(ts)
    if closed == "both":
        return (t >= col(lo)) & (t <= col(hi))
    if closed == "left":
        return (t >= col(lo)) & (t < col(hi))
    raise ValueError(f"unknown closed rule: {closed}")


def measure(kind: str, value: Column | str, ts: Column | str, where: Column, tie: Column | str | None = None) -> Column:
    """Aggregate of ``value`` over rows satisfying ``where``.

    ``first``/``last`` order by time and then by ``tie`` (default: the value itself), so the
    answer does not depend on row order.
    """
    v = F.when(where, col(value))
    if kind in ("min", "max", "sum"):
        return getattr(F, kind)(v)
    if kind == "count":
        return F.count(v)
    if kind in ("first", "last"):
        order = F.when(where & col(value).isNotNull(), F.struct(col(ts), col(tie if tie is not None else value)))
        return (F.min_by if kind == "first" else F.max_by)(col(value), order)
    raise ValueError(f"unknown measure: {kind}")


def window_measures(
    events: DataFrame,
    cohort: DataFrame,
    on: str | Sequence[str],
    measures: Mapping[str, Column],
    window_cols: Sequence[str] = (),
    zero_fill: Sequence[str] = (),
) -> DataFrame:
    """Cohort plus one column per measure; each source is scanned and joined once."""
    keys = [on] if isinstance(on, str) else list(on)
    joined = events.join(cohort.select(*keys, *window_cols), keys, "inner")
    reduced = joined.groupBy(*keys).agg(*[c.alias(k) for k, c in measures.items()])
    out = cohort.join(reduced, keys, "left")
    return out.fillna(0, subset=list(zero_fill)) if zero_fill else out


def complete_triplets(
    events: DataFrame, keys: Sequence[str], component: str, value: str, parts: Mapping[str, tuple[float, float]], total: str
) -> DataFrame:
    """One row per key with every part present: max per part, then the sum."""
    ok = F.lit(False)
    for name, (lo, hi) in parts.items():
        ok = ok | ((F.col(component) == name) & F.col(value).between(lo, hi))
    wide = events.where(ok).groupBy(*keys).agg(
        *[F.max(F.when(F.col(component) == name, F.col(value))).alias(name) for name in parts]
    )
    names = list(parts)
    lo, hi = sum(b[0] for b in parts.values()), sum(b[1] for b in parts.values())
    summed = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return wide.dropna(subset=names).withColumn(total, summed).where(F.col(total).between(lo, hi))
