"""Numeric helpers that keep nulls null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Plausible ranges (closed) per concept, hour-level site.
LAB_RANGES = {
    "lactate": (0.1, 30.0),
    "creatinine": (0.1, 30.0),
    "wbc": (0.1, 200.0),
    "platelet": (1.0, 2000.0),
    "bilirubin": (0.01, 80.0),
}
VITAL_RANGES = {
    "heart_rate": (20.0, 250.0),
    "resp_rate": (1.0, 90.0),
    "spo2": (20.0, 100.0),
    "map": (20.0, 200.0),
    "gcs_total": (3.0, 15.0),
    "fio2": (0.2, 100.0),
}
BASELINE_TEMPERATURE_RANGE = (20.0, 110.0)

# Score bands as (upper bound, points) for rising scores and
# (lower bound, points) for falling scores; the last entry is the remainder.
CREATININE_BANDS = ((1.2, 0), (2.0, 1), (3.5, 2), (5.0, 3), (None, 4))
BILIRUBIN_BANDS = ((1.2, 0), (2.0, 1), (6.0, 2), (12.0, 3), (None, 4))
PLATELET_BANDS = ((150.0, 0), (100.0, 1), (50.0, 2), (20.0, 3), (None, 4))
GCS_BANDS = ((15.0, 0), (13.0, 1), (10.0, 2), (6.0, 3), (None, 4))


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that leaves null alone (``least``/``greatest`` would skip it)."""
    x = col(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(x.isNotNull(), out)


def in_range(c: Column | str, bounds: tuple[float, float]) -> Column:
    """The value if inside the closed range, else null."""
    return F.when(col(c).between(bounds[0], bounds[1]), col(c))


def banded(c: Column | str, bands: Sequence[tuple[float | None, int]], rising: bool = True) -> Column:
    """First matching band; null scores 0."""
    x = col(c)
    out = F.when(x.isNull(), F.lit(0))
    for bound, points in bands:
        if bound is None:
            return out.otherwise(F.lit(points))
        out = out.when(x < bound if rising else x >= bound, F.lit(points))
    return out.otherwise(F.lit(0))


def fahrenheit_to_celsius(c: Column | str) -> Column:
    return (col(c) - 32.0) * 5.0 / 9.0


def temperature_by_size(c: Column | str, above: float = 70.0) -> Column:
    return F.when(col(c) > above, fahrenheit_to_celsius(c)).otherwise(col(c))


def temperature_by_label(c: Column | str, label: Column | str) -> Column:
    """Unit words in the label decide; an unlabelled value above 60 is Fahrenheit."""
    name = F.lower(F.coalesce(col(label), F.lit("")))
    is_f = name.rlike("fahrenheit|temperaturef")
    is_c = name.rlike(r"celsius|\(c\)")
    return F.when(is_f | (~is_f & ~is_c & (col(c) > 60)), fahrenheit_to_celsius(c)).otherwise(col(c))


def temperature_by_unit(c: Column | str, unit: Column | str) -> Column:
    u = F.upper(F.trim(F.coalesce(col(unit).cast("string"), F.lit(""))))
    return F.when(u.isin("F", "FAHRENHEIT", "[DEGF]"), fahrenheit_to_celsius(c)).otherwise(col(c))


def oxygen_fraction(c: Column | str) -> Column:
    return F.when(col(c) > 1.5, col(c) / 100.0).otherwise(col(c))


def mean_pressure(sbp: Column | str, dbp: Column | str) -> Column:
    """(S + 2 D) / 3, null unless both inputs and the result are plausible."""
    value = (col(sbp) + 2 * col(dbp)) / 3.0
    ok = col(sbp).between(40, 300) & col(dbp).between(20, 200) & value.between(20, 200)
    return F.when(ok, value)


def height_cm(c: Column | str) -> Column:
    return F.when((col(c) > 40) & (col(c) < 90), col(c) * 2.54).otherwise(col(c))


def body_mass_index(weight_kg: Column | str, height: Column | str) -> Column:
    return F.try_divide(col(weight_kg), F.pow(col(height) / 100.0, F.lit(2.0)))


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
