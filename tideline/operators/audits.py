"""Data-semantics audits: schema, clocks, code maps, coverage, reconciliation, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions.cells import MIN_CELL, shown, suppress
from ..functions.text import col, flag
from .order_stats import exact_quantiles


def schema_profile(df: DataFrame, source: str) -> DataFrame:
    """Type, rows and null share per column from one scan."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(source).alias("source"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                F.col("_n").alias("n_rows"), (F.col("_n") - F.col(c)).alias("n_null"),
            )
            for c, t in df.dtypes
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "null_fraction", F.try_divide(F.col("n_null").cast("double"), F.col("n_rows"))
    )


def category_counts(df: DataFrame, columns: Sequence[str], top: int = 25, source: str = "") -> DataFrame:
    """Most frequent values per column with a missing bucket.

    Counts are reduced first; the rank filter keeps ``top`` rows per column below the shuffle.
    """
    from pyspark.sql import Window

    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")).alias("category"))
            for c in columns
        ]
    )
    counts = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column_name", "category").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "category")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def frequent_values(df: DataFrame, keys: Sequence[str], extra: Mapping[str, Column] | None = None, minimum: int = MIN_CELL, top: int | None = None) -> DataFrame:
    """Groups with at least ``minimum`` rows, most frequent first."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (extra or {}).items()])
    out = out.where(F.col("n") >= minimum)
    return out.orderBy(F.desc("n"), *keys).limit(top) if top else out


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cell counts with missing as its own level."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def source_overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Entities in both, only the first, only the second source."""
    a = first.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = second.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(
        F.count_if(in_a).alias("in_first"), F.count_if(in_b).alias("in_second"), F.count_if(in_a & in_b).alias("in_both"),
        F.count_if(in_a & ~in_b).alias("only_first"), F.count_if(~in_a & in_b).alias("only_second"),
    )


def code_name_agreement(df: DataFrame, by_name: Column, by_code: Column, excluded: Column, entity: str, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count_if(by_name & by_code).alias("name_and_code"), F.count_if(by_name & ~by_code).alias("name_only"),
        F.count_if(~by_name & by_code).alias("code_only"), F.count_if(excluded).alias("excluded"),
        F.countDistinct(F.when(by_code, F.col(entity))).alias("code_entities"),
    )


def exploded_matches(df: DataFrame, name: Column | str, patterns: Mapping[str, str], out: str = "agent") -> DataFrame:
    """One row per (row, matching pattern): all patterns in one scan."""
    hits = F.array_compact(F.array(*[F.when(col(name).rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return df.withColumn(out, F.explode(hits))


NUMERIC_RANGES = {"numeric_0_23": 23, "numeric_0_1439": 1439, "numeric_0_2359": 2359, "numeric_0_86399": 86399}


def time_encoding(df: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """How each clock's time field is written and which decodings would read it.

    ``fields`` maps a clock to (date column, time column); all clocks share one scan.
    """
    aggs: dict[str, Column] = {}
    for clock, (date, time) in fields.items():
        raw = F.trim(F.col(time).cast("string"))
        num = raw.try_cast("double")
        hour, minute = F.floor(num / 100), F.pmod(num, F.lit(100.0))
        dated = F.col(date).isNotNull()
        parts = {
            "n_rows": F.count("*"),
            "nonnull_rows": F.count_if(raw.isNotNull() & (raw != "")),
            "colon_rows": F.count_if(raw.contains(":")),
            "numeric_rows": F.count(num),
            "integer_like_rows": F.count_if(F.abs(num - F.round(num, 0)) < 1e-9),
            "numeric_min": F.min(num),
            "numeric_max": F.max(num),
        }
        parts |= {k: F.count_if(num.between(0, hi)) for k, hi in NUMERIC_RANGES.items()}
        parts |= {
            "reads_text": F.count(
                F.when(dated & raw.contains(":"), F.concat_ws(" ", F.col(date).cast("string"), raw)).try_cast("timestamp_ntz")
            ),
            "reads_minutes": F.count_if(dated & num.between(0, 1439)),
            "reads_seconds": F.count_if(dated & num.between(0, 86399)),
            "reads_hhmm": F.count_if(dated & num.between(0, 2359) & hour.between(0, 23) & minute.between(0, 59)),
        }
        aggs |= {f"{clock}__{k}": c for k, c in parts.items()}
    names = [k.split("__", 1)[1] for k in aggs if k.startswith(f"{next(iter(fields))}__")]
    wide = df.agg(*[c.alias(k) for k, c in aggs.items()])
    rows = F.array(
        *[F.struct(F.lit(clock).alias("clock"), *[F.col(f"{clock}__{k}").alias(k) for k in names]) for clock in fields]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def clock_completeness(df: DataFrame, clock_cols: Sequence[str], entity: str) -> DataFrame:
    """Rows and entities with each clock."""
    cells = F.array(*[F.struct(F.lit(c).alias("clock"), F.col(c).alias("t")) for c in clock_cols])
    long = df.select(entity, F.explode(cells).alias("c")).where(F.col("c.t").isNotNull())
    return long.groupBy("c.clock").agg(F.count("*").alias("rows_with_clock"), F.countDistinct(entity).alias("entities_with_clock"))


def clock_pairs(df: DataFrame, clock_cols: Sequence[str], entity: str) -> DataFrame:
    """Absolute minute offsets between every two clocks of a row, and the same-day share.

    The pairs are pairs of columns of one row, a fixed number per row.
    """
    pairs = [(a, b) for i, a in enumerate(clock_cols) for b in clock_cols[i + 1 :]]
    cells = F.array(
        *[F.struct(F.lit(a).alias("clock_a"), F.lit(b).alias("clock_b"), F.col(a).alias("t1"), F.col(b).alias("t2")) for a, b in pairs]
    )
    long = df.select(entity, F.explode(cells).alias("c")).select(entity, "c.*").where("t1 is not null and t2 is not null")
    long = long.withColumn("gap", F.abs(clocks.boundaries_crossed("minute", "t1", "t2")))
    keys = ["clock_a", "clock_b"]
    basic = long.groupBy(*keys).agg(
        F.count("*").alias("paired_rows"), F.countDistinct(entity).alias("paired_entities"),
        F.avg("gap").alias("mean_abs_minutes"), F.count_if(F.to_date("t1") == F.to_date("t2")).alias("same_date_rows"),
    )
    quant = exact_quantiles(long, keys, "gap", [0.5, 0.95], ["median_abs_minutes", "p95_abs_minutes"], bounded_groups=True).drop("n")
    return basic.join(quant, keys, "left").withColumn(
        "same_date_share", F.try_divide(F.col("same_date_rows").cast("double"), F.col("paired_rows"))
    )


# Edges in days of the anchor-offset bins.
OFFSET_BINS = (
    ("lt_minus30d", None, -30), ("minus30_to_minus1d", -30, -1), ("minus1_to_0d", -1, 0), ("day0_to1", 0, 1),
    ("day1_to3", 1, 3), ("day3_to7", 3, 7), ("ge7d", 7, None),
)


def offset_bins(df: DataFrame, ts: str, anchor: str, group: Sequence[str]) -> DataFrame:
    """Rows per offset bin around the anchor."""
    aggs = []
    for name, lo, hi in OFFSET_BINS:
        ok = F.col(ts).isNotNull()
        if lo is not None:
            ok = ok & (F.col(ts) >= clocks.plus(anchor, days=lo))
        if hi is not None:
            ok = ok & (F.col(ts) < clocks.plus(anchor, days=hi))
        aggs.append(F.count_if(ok).alias(name))
    return df.groupBy(*group).agg(*aggs)


def window_coverage(
    events: DataFrame, cohort: DataFrame, on: str, ts: str, anchor: str, concept: str, windows: Mapping[str, tuple[int, int]], unit: str = "hours"
) -> DataFrame:
    """Distinct entities with a concept in each half-open window, and the share of the cohort.

    Events meet the cohort once; windows are flags per (entity, concept), reduced before counting.
    """
    joined = events.join(cohort.select(on, anchor), on, "inner")
    t = F.col(ts)
    flags = [
        F.max(((t >= clocks.plus(anchor, **{unit: lo})) & (t < clocks.plus(anchor, **{unit: hi}))).cast("int")).alias(w)
        for w, (lo, hi) in windows.items()
    ]
    per = joined.groupBy(on, concept).agg(*flags)
    wide = per.groupBy(concept).agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in windows])
    cells = F.array(*[F.struct(F.lit(w).alias("window"), F.col(w).alias("n_entities")) for w in windows])
    long = wide.select(concept, F.explode(cells).alias("c")).select(concept, "c.*")
    out = long.withColumn("cohort_n", F.lit(cohort.count()))
    return out.withColumn("share", F.try_divide(F.col("n_entities").cast("double"), F.col("cohort_n")))


def feasibility_grid(
    events: DataFrame, cohort: DataFrame, on: str, ts: str, anchor: str, concept: str, windows: Mapping[str, tuple[int, int]], outcomes: Mapping[str, Column],
    unit: str = "hours", minimum: int = MIN_CELL,
) -> DataFrame:
    """Concept x window x outcome: cohort entities with the concept in the window and the outcome observed, small counts hidden.

    Both window ends count.  ``outcomes`` are conditions over cohort columns; ``cohort_n`` is the cohort with the outcome.
    Events meet the cohort once and are reduced to one row per entity and concept before the grid is added up.
    """
    marks = {f"_o{i}": flag(c) for i, c in enumerate(outcomes.values())}
    known = cohort.select(on, anchor, *[c.alias(k) for k, c in marks.items()])
    t = F.col(ts)
    inside = {
        f"_w{j}": F.max(flag((t >= clocks.plus(anchor, **{unit: lo})) & (t <= clocks.plus(anchor, **{unit: hi})))) for j, (lo, hi) in enumerate(windows.values())
    }
    per = events.select(on, concept, ts).join(known, on, "inner").groupBy(on, concept).agg(
        *[c.alias(k) for k, c in inside.items()], *[F.max(k).alias(k) for k in marks]
    )
    wide = per.groupBy(concept).agg(*[F.sum(F.col(w) * F.col(o)).alias(f"{w}{o}") for w in inside for o in marks])
    sizes = known.agg(*[F.coalesce(F.sum(o), F.lit(0)).alias(o) for o in marks]).first()
    cells = [
        F.struct(
            F.lit(w).alias("window"), F.lit(o).alias("outcome"), F.col(f"_w{j}_o{i}").alias("n_entities"), F.lit(sizes[f"_o{i}"]).cast("long").alias("cohort_n")
        )
        for j, w in enumerate(windows) for i, o in enumerate(outcomes)
    ]
    long = wide.select(concept, F.explode(F.array(*cells)).alias("c")).select(concept, "c.*")
    return suppress(long, "n_entities", minimum).withColumn("cohort_n", shown("cohort_n", minimum))


def join_key_diagnostic(facts: DataFrame, cohort: DataFrame, rules: Mapping[str, Sequence[str]], entity: str, flags: Mapping[str, Column]) -> DataFrame:
    """Distinct cohort entities reached under each join key, overall and per row condition.

    Facts are reduced to one row per key before the join, so a key never multiplies.
    """
    out = None
    for name, keys in rules.items():
        per = facts.groupBy(*keys).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in flags.items()])
        got = cohort.join(per, list(keys), "inner")
        row = got.agg(*[F.countDistinct(F.when(F.col(k) == 1, F.col(entity))).alias(k) for k in flags]).withColumn("join_rule", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def parity_check(observed: DataFrame, expected: DataFrame, keys: Sequence[str], tolerance: Column) -> DataFrame:
    """Observed against expected by key: pass where the gap is within the tolerance (0 = exact)."""
    both = expected.join(observed, list(keys), "left")
    gap = F.abs(F.col("observed") - F.col("expected"))
    return both.withColumns(
        {"tolerance": tolerance, "passes": F.coalesce(gap <= tolerance, F.lit(False)).cast("int")}
    )


def run_gate(facts: DataFrame, rules: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """Rule table over a one-row summary: rule -> (column, '<=' or '>=', bound)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"), F.col(c).cast("double").alias("observed"), F.lit(float(bound)).alias("bound"),
                F.coalesce(F.col(c) <= bound if op == "<=" else F.col(c) >= bound, F.lit(False)).cast("int").alias("passes"),
            )
            for name, (c, op, bound) in rules.items()
        ]
    )
    return facts.select(F.explode(rows).alias("r")).select("r.*")


@dataclass(frozen=True)
class GateLimits:
    """Fixed limits of a run: rows, rows per arm, remaining difference, largest weight, share of successful replicates."""

    rows: float = 1000.0
    arm: float = 100.0
    smd: float = 0.10
    weight: float = 50.0
    success: float = 0.95


def study_gate(
    weighted: DataFrame, balance: DataFrame, intervals: DataFrame, limits: GateLimits | None = None, treat: str = "A", weight: str = "SW_A"
) -> DataFrame:
    """Rules over the weighted cohort, the balance after weighting and the bootstrap counts of the outcomes.

    (rule, severity, observed, bound, passes): errors are too few treated or continued rows, weights that are not finite
    and a difference above the limit; warnings a small cohort, a large weight and an outcome with markedly fewer
    successful replicates than the best one.  A figure that is missing does not pass.
    """
    limits = limits or GateLimits()
    one, w = F.col(treat) == 1, F.col(weight).cast("double")
    facts = weighted.agg(
        F.count("*").alias("n"), F.count_if(one).alias("n_treated"), F.count_if(~one).alias("n_control"), F.max(w).alias("max_weight"),
        F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))).alias("non_finite_weights"),
    )
    worst = balance.agg(F.max("after").alias("max_post_smd"))
    counts = intervals.where("estimand = 'difference'").groupBy("analysis", "outcome").agg(F.min("n_success").alias("k"))
    success = counts.agg((F.min("k") / F.max("k")).alias("bootstrap_success"))
    rules = {
        "n": (facts, "warning", ">=", limits.rows), "n_treated": (facts, "error", ">=", limits.arm), "n_control": (facts, "error", ">=", limits.arm),
        "max_weight": (facts, "warning", "<=", limits.weight), "non_finite_weights": (facts, "error", "<=", 0.0),
        "max_post_smd": (worst, "error", "<=", limits.smd), "bootstrap_success": (success, "warning", ">=", limits.success),
    }
    out = None
    for frame in (facts, worst, success):
        cells = [
            F.struct(
                F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(name).cast("double").alias("observed"), F.lit(float(bound)).alias("bound"),
                F.coalesce(F.col(name) <= bound if op == "<=" else F.col(name) >= bound, F.lit(False)).cast("int").alias("passes"),
            )
            for name, (source, severity, op, bound) in rules.items() if source is frame
        ]
        part = frame.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out


def suppressed_counts(df: DataFrame, keys: Sequence[str], minimum: int = MIN_CELL) -> DataFrame:
    return suppress(df.groupBy(*keys).agg(F.count("*").alias("n")), "n", minimum)


def field_completeness(df: DataFrame, columns: Sequence[str], both: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Present values per field and per pair of fields, one row."""
    aggs = [F.count("*").alias("n_rows"), *[F.count(c).alias(f"{c}_present") for c in columns]]
    aggs += [F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}_and_{b}") for a, b in both]
    return df.agg(*aggs)
