"""Report tables: group profiles, durations, distributions, histograms, baseline tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..session import stage_border
from .order_stats import column_quantiles, exact_quantiles, unpivot
from .weighting import group_labels


def group_profile(df: DataFrame, group: str, measures: Mapping[str, Column]) -> DataFrame:
    """Rows per group, share of all rows, and the given aggregates.

    The share's window runs over the group rows, not the data.
    """
    per = df.groupBy(group).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in measures.items()])
    return per.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def duration_summary(df: DataFrame, value: str, treat: str = "A") -> DataFrame:
    """n, mean, sd and quartiles overall and per arm."""
    rows = group_labels(df.select(treat, F.col(value).cast("double").alias("x")), treat)
    basic = rows.groupBy("group").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    quart = exact_quantiles(rows, ["group"], "x", [0.25, 0.5, 0.75], ["p25", "median", "p75"], bounded_groups=True).drop("n")
    return basic.join(quart, "group", "left")


def outcome_summary(df: DataFrame, binary: Sequence[str], continuous: Sequence[str]) -> DataFrame:
    """One row per outcome: events for binary ones, spread and quartiles for continuous ones."""
    names = [*binary, *continuous]
    long = unpivot(df, names)
    basic = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.sum("value").alias("_s"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("_sd"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
    )
    quart = column_quantiles(df, list(continuous), [0.25, 0.5, 0.75], ["p25", "median", "p75"]).drop("n")
    is_binary = F.col("variable").isin(*binary)
    return basic.join(quart, "variable", "left").select(
        F.col("variable").alias("outcome"), F.when(is_binary, "binary").otherwise("continuous").alias("type"), "n",
        F.when(is_binary, F.col("_s")).alias("events"), "mean", F.when(~is_binary, F.col("_sd")).alias("sd"),
        "p25", "median", "p75", "minimum", "maximum",
    )


DESCRIBE_PROBS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def describe_by(df: DataFrame, group: str, value: str, bounded: bool = False) -> DataFrame:
    """count, mean, std, min, nine percentiles and max per group."""
    basic = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    names = [f"p{round(p * 100):02d}" for p in DESCRIBE_PROBS]
    quant = exact_quantiles(df, [group], value, DESCRIBE_PROBS, names, bounded_groups=bounded).drop("n")
    return basic.join(quant, group, "left")


def item_summary(df: DataFrame, item: str, entity: str, value: str) -> DataFrame:
    """Per item: rows, distinct entities, range and percentiles.

    Rows reduce to one per item and entity first, so the distinct count multiplies no rows.
    """
    df = stage_border(df.select(item, entity, value))
    pairs = df.groupBy(item, entity).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    basic = pairs.groupBy(item).agg(
        F.sum("n").alias("n"), F.count(entity).alias("n_entities"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
    )
    probs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    names = ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]
    return basic.join(exact_quantiles(df, [item], value, probs, names).drop("n"), item, "left")


def shared_histogram(df: DataFrame, value: str, bins: int, treat: str = "A") -> DataFrame:
    """Counts per arm on one set of equal-width edges over the overall range."""
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = float(row["lo"]), float(row["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    at = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(F.col(treat).alias("A"), at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumns(
        {"edge_lo": F.lit(lo) + F.col("bin") * F.lit(width), "edge_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(width)}
    )


def baseline_table(df: DataFrame, continuous: Sequence[str], binary: Sequence[str], treat: str = "A", minimum: int = cells.MIN_CELL) -> DataFrame:
    """Display rows per arm and overall: median [q1, q3] of observed values, n (%) of flags.

    A value imputed for a continuous variable (its ``_missing`` flag is 1) counts as missing.
    """
    observed = {
        c: F.when(F.col(f"{c}_missing") == 1, None).otherwise(F.col(c)) if f"{c}_missing" in df.columns else F.col(c)
        for c in continuous
    }
    shown = group_labels(df.select(treat, *[x.cast("double").alias(c) for c, x in observed.items()], *binary), treat)
    quart = column_quantiles(shown, list(continuous), [0.25, 0.5, 0.75], ["q25", "q50", "q75"], by=["group"])
    cont = quart.select(
        "group", "variable", F.lit("continuous").alias("type"), F.col("n").cast("long").alias("n"),
        cells.median_iqr(F.col("q50"), F.col("q25"), F.col("q75")).alias("shown"),
    )
    flags = unpivot(shown, list(binary), keep=["group"]).groupBy("group", "variable").agg(
        F.sum("value").cast("long").alias("n"), F.count("value").alias("total")
    )
    bins = flags.select(
        "group", "variable", F.lit("binary").alias("type"), "n", cells.n_percent(F.col("n"), F.col("total"), minimum).alias("shown")
    )
    return cont.unionByName(bins)
