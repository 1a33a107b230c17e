"""Small-cell suppression and display formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

# Fixed value: counts below this are withheld.
MIN_CELL = 11


def shown(count: Column | str, minimum: int = MIN_CELL) -> Column:
    return F.when(col(count) >= minimum, col(count))


def suppress(df: DataFrame, count_col: str = "n", minimum: int = MIN_CELL) -> DataFrame:
    """Withhold small counts and say so in ``suppressed``."""
    return df.withColumn("suppressed", (F.col(count_col) < minimum).cast("int")).withColumn(
        count_col, shown(count_col, minimum)
    )


def n_percent(n: Column, total: Column, minimum: int = MIN_CELL) -> Column:
    body = F.format_string("%d (%.1f%%)", n.cast("long"), (F.try_divide(n * 100.0, total)).cast("double"))
    return F.when(n < minimum, F.lit(f"<{minimum}")).otherwise(body)


def median_iqr(q50: Column, q25: Column, q75: Column) -> Column:
    return F.format_string("%.1f [%.1f, %.1f]", q50, q25, q75)
