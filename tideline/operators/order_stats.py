"""Exact quantiles with linear interpolation that never hold a large group in one task.

Groups are counted first.  Those of up to ``FEW`` times the accuracy rows are aggregated whole; for larger ones:

1. ``percentile_approx`` (a bounded, mergeable sketch) proposes a bracket for each requested rank.
2. One scan counts rows below each bracket and keeps the distinct values inside it (the sliver), as a stage table.
3. The counts tell whether a bracket holds its rank; a group with a bracket that does not is counted value by value.
4. A sliver with many distinct values is cut into bins by a sketch of its values, and only the bins that hold the rank
   stay, until at most ``SLIVER`` distinct values are left for one task to rank.

The sketches only decide how much is kept; the ranks are counted, so results are exact.  NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_border

ACCURACY = 10_000
#: Rows of a group that is aggregated whole, per unit of accuracy: 200,000 values at the default.
FEW = 20
#: Distinct values of a sliver that one task ranks, and bins into which a longer sliver is cut.
SLIVER, CUTS = 20_000, 256


def _brackets(base: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Rows of each group and a proposed bracket per probability; a group of few rows is its own bracket."""
    slack = 3.0 / accuracy
    points = [x for p in probs for x in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", points, accuracy).alias("_b"))
    inf = float("inf")
    # Here a rank is worth more than the slack.
    few = F.col("_n") < 4 * accuracy
    for i, p in enumerate(probs):
        lo = F.lit(-inf) if p - slack <= 0 else F.when(few, F.lit(-inf)).otherwise(F.col("_b")[2 * i])
        hi = F.lit(inf) if p + slack >= 1 else F.when(few, F.lit(inf)).otherwise(F.col("_b")[2 * i + 1])
        sketch = sketch.withColumns({f"_lo{i}": lo, f"_hi{i}": hi})
    return sketch.drop("_b")


def _sliver(base: DataFrame, sketch: DataFrame, keys: Sequence[str], n_probs: int) -> DataFrame:
    """(keys, _v, _m): distinct values in any bracket with their counts; all others collapse to one null row per group."""
    k = range(n_probs)
    here = [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in k]
    in_any = here[0]
    for h in here[1:]:
        in_any = in_any | h
    below = [F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_c{i}") for i in k]
    bounds = [F.first(f"_{side}{i}").alias(f"_{side}{i}") for i in k for side in ("lo", "hi")]
    return base.join(sketch, list(keys)).groupBy(*keys, F.when(in_any, F.col("_v")).alias("_v")).agg(
        F.count("*").alias("_m"), F.first("_n").alias("_n"), *below, *bounds
    )


def _cells(sliver: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Values (keys, i, v, m) and targets (keys, i, n, below, inside, width, lo, hi) of each probability."""
    k = range(len(probs))
    held = [F.when(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.struct(F.lit(i).alias("_i"), F.col("_v").alias("_x"), F.col("_m").alias("_w"))) for i in k]
    values = sliver.select(*keys, F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("_y")).select(*keys, "_y.*")
    inside = [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in k]
    heads = sliver.groupBy(*keys).agg(
        F.max("_n").alias("n"), *[F.sum(f"_c{i}").alias(f"c{i}") for i in k],
        *[F.sum(F.when(inside[i], F.col("_m")).otherwise(0)).alias(f"m{i}") for i in k], *[F.count_if(inside[i]).alias(f"d{i}") for i in k],
    )
    rank = lambda f, i: f(F.lit(float(probs[i])) * (F.col("n") - 1))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("_i"), F.col("n").alias("n"), F.col(f"c{i}").alias("_below"), F.col(f"m{i}").alias("_inside"), F.col(f"d{i}").alias("_width"),
                rank(F.floor, i).alias("_from"), rank(F.ceil, i).alias("_to"),
            )
            for i in k
        ]
    )
    return values, heads.select(*keys, F.explode(rows).alias("_y")).select(*keys, "_y.*")


def _narrowed(values: DataFrame, targets: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keeps the bins of each sliver that hold its ranks; a bin is a run between values of the sliver's own sketch."""
    cell = [*keys, "_i"]
    grid = values.groupBy(*cell).agg(F.percentile_approx("_x", [j / CUTS for j in range(CUTS + 1)], 10 * CUTS).alias("_cuts"))
    binned = values.join(grid, cell).select(*cell, "_x", "_w", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias("_bin"))
    counts = binned.groupBy(*cell, "_bin").agg(F.sum("_w").alias("_w"), F.count("*").alias("_d"))
    # At most CUTS + 1 rows of a cell.
    before = F.sum("_w").over(Window.partitionBy(*cell).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w")
    placed = counts.withColumn("_before", before).join(targets, cell)
    start = F.col("_below") + F.col("_before")
    kept = stage_border(placed.where((start <= F.col("_to")) & (start + F.col("_w") > F.col("_from"))))
    new = kept.groupBy(*cell).agg(
        F.first("n").alias("n"), (F.first("_below") + F.min("_before")).alias("_below"), F.sum("_w").alias("_inside"), F.sum("_d").alias("_width"),
        F.first("_from").alias("_from"), F.first("_to").alias("_to"),
    )
    return stage_border(binned.join(kept.select(*cell, "_bin"), [*cell, "_bin"]).select(*cell, "_x", "_w")), stage_border(new)


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    accuracy: int = ACCURACY,
    bounded_groups: bool = False,
    sliver: int = SLIVER,
) -> DataFrame:
    """One row per group: ``n`` values that are neither null nor NaN and one column per probability.

    ``bounded_groups`` states that the number of groups is fixed by the query (arms, columns),
    which makes the bracket table small enough to broadcast.
    """
    names = list(names or [f"q{round(p * 1000):04d}" for p in probs])
    keys = list(groups) or ["_all"]
    number = F.col(value).cast("double")
    base = df.where(number.isNotNull() & ~F.isnan(number)).select(*([F.col(g) for g in groups] or [F.lit(1).alias("_all")]), number.alias("_v"))
    limit = FEW * accuracy
    sizes = stage_border(base.groupBy(*keys).agg(F.count("*").alias("_n")))
    n_large = sizes.where(F.col("_n") > limit).count()
    whole = None
    if n_large < sizes.count() or not n_large:
        small = base if not n_large else base.join(sizes.where(F.col("_n") > limit).select(*keys), keys, "left_anti")
        at = small.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        whole = at.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)])
    if n_large:
        large = base if whole is None else base.join(sizes.where(F.col("_n") > limit).select(*keys), keys, "left_semi")
        narrowed = _narrowed_quantiles(large, keys, probs, names, accuracy, bounded_groups or not groups, sliver)
        whole = narrowed if whole is None else whole.unionByName(narrowed)
    return whole if groups else whole.drop("_all")


def _narrowed_quantiles(
    base: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str], accuracy: int, bounded_groups: bool, sliver: int
) -> DataFrame:
    """Quantiles of groups of any size by verified brackets."""
    sketch = _brackets(base, keys, probs, accuracy)
    if bounded_groups:
        sketch = F.broadcast(sketch)
    found = stage_border(_sliver(base, sketch, keys, len(probs)))
    values, targets = _cells(found, keys, probs)
    missed = (F.col("_below") > F.col("_from")) | (F.col("_to") >= F.col("_below") + F.col("_inside"))
    state = targets.agg(F.max("_width").alias("_width"), F.count_if(missed).alias("missed")).first()
    if state["missed"]:
        wrong = stage_border(targets.where(missed).select(*keys).distinct())
        whole = base.join(wrong, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
        for i in range(len(probs)):
            whole = whole.withColumns({f"_lo{i}": F.lit(float("-inf")), f"_hi{i}": F.lit(float("inf"))})
        found = stage_border(found.join(wrong, keys, "left_anti").unionByName(_sliver(base, whole, keys, len(probs))))
        values, targets = _cells(found, keys, probs)
        state = targets.agg(F.max("_width").alias("_width")).first()
    width = state["_width"] or 0
    while width > sliver:
        values, targets = _narrowed(values, targets, keys)
        before, width = width, targets.agg(F.max("_width")).first()[0] or 0
        if width >= before:  # a handful of values, each a bin of its own
            break
    cell = [*keys, "_i"]
    upto = Window.partitionBy(*cell).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.join(targets, cell).withColumn("_upto", F.col("_below") + F.sum("_w").over(upto))
    hit = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_x")))
    picked = ranked.groupBy(*cell).agg(F.first("n").alias("n"), F.first("_from").alias("_from"), hit("_from").alias("_a"), hit("_to").alias("_z"))
    prob = F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")]
    at = picked.select(*keys, "_i", "n", (F.col("_a") + (F.col("_z") - F.col("_a")) * (prob * (F.col("n") - 1) - F.col("_from"))).alias("_y"))
    return at.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_i") == i, F.col("_y"))).alias(name) for i, name in enumerate(names)])


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = (), name: str = "variable", value: str = "value") -> DataFrame:
    """Wide columns to long (variable, value) rows as doubles."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select("*", f"_p.{name}", f"_p.{value}").drop("_p")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of many columns (optionally per arm) in one pass set: one row per (by, variable)."""
    long = unpivot(df, columns, keep=by)
    return exact_quantiles(long, [*by, "variable"], "value", probs, names, bounded_groups=True)


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of the named columns; p numbers reach the driver."""
    rows = column_quantiles(df, columns, [0.5], ["median"]).select("variable", "median").collect()
    found = {r["variable"]: r["median"] for r in rows}
    return {c: found.get(c) for c in columns}
