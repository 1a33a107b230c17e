from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tideline.functions import cells, clocks, numbers as nb
from tideline.functions.text import collapse_spaces, first_match, icd_normalised, prefix_before


def one(df, *cols):
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql(
        "select date'2024-01-02' d, 1430 hhmm, 2575 bad, '14:30' t, '14:30:05.5' tf, '25:00' tb, '52200' secs, cast(null as string) nul, cast(null as double) x"
    )


def test_text_and_numeric_clocks_agree(row):
    a, b, bad, worse = one(row, clocks.combine_hhmm("d", "hhmm"), clocks.combine_text("d", "t"), clocks.combine_hhmm("d", "bad"), clocks.combine_text("d", "tb"))
    assert a == b == datetime(2024, 1, 2, 14, 30)
    assert bad == worse == datetime(2024, 1, 2)


def test_missing_time_is_midnight_or_null(row):
    got = one(row, clocks.combine_text("d", "nul"), clocks.decode_clock("d", "nul"), clocks.decode_clock("d", "nul", True), clocks.decode_clock_or_midnight("d", "nul"))
    assert list(got) == [datetime(2024, 1, 2), None, None, datetime(2024, 1, 2)]


def test_seconds_since_midnight(row):
    got = one(row, clocks.decode_clock("d", "secs"), clocks.decode_clock("d", "secs", True), clocks.decode_clock("d", "tf", True), clocks.span_stop("d"))
    assert got[0] == got[1] == datetime(2024, 1, 2, 14, 30)
    assert got[2] == datetime(2024, 1, 2, 14, 30, 5, 500000)
    assert got[3] == datetime(2024, 1, 2, 23, 59, 59)


def test_boundaries_differ_from_elapsed_hours(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:59:00' a, timestamp_ntz'2024-01-01 01:01:00' b")
    marks, hours = one(df, clocks.boundaries_crossed("hour", "a", "b"), clocks.hours_between("a", "b"))
    assert marks == 1 and abs(hours - 2 / 60) < 1e-12


def test_clip_keeps_null(row):
    assert one(row, nb.clip("x", 0.0, 1.0))[0] is None
    assert one(row, nb.clip(F.lit(7.0), 0.0, 1.0))[0] == 1.0


def test_bands_and_units(row):
    got = one(
        row, nb.banded(F.lit(1.2), nb.CREATININE_BANDS), nb.banded(F.lit(5.0), nb.CREATININE_BANDS), nb.banded(F.lit(150.0), nb.PLATELET_BANDS, False),
        nb.banded(F.lit(19.0), nb.PLATELET_BANDS, False), nb.banded("x", nb.GCS_BANDS, False), nb.temperature_by_size(F.lit(98.6)),
        nb.temperature_by_label(F.lit(61.0), F.lit("skin (C)")), nb.oxygen_fraction(F.lit(40.0)), nb.mean_pressure(F.lit(120.0), F.lit(60.0)),
        nb.mean_pressure(F.lit(20.0), F.lit(60.0)), nb.height_cm(F.lit(70.0)),
    )
    assert list(got[:5]) == [1, 4, 0, 4, 0]
    assert abs(got[5] - 37.0) < 1e-9 and got[6] == 61.0 and got[7] == 0.4 and got[8] == 80.0 and got[9] is None
    assert abs(got[10] - 177.8) < 1e-9


def test_text_helpers(row):
    got = one(
        row, icd_normalised(F.lit("i50.2")), icd_normalised(F.lit("I50.2")), collapse_spaces(F.lit("  a \t b ")),
        first_match(F.lit("xay"), {"one": ["q"], "two": ["a"], "three": ["x"]}), prefix_before(F.lit("Panel A | organism")),
    )
    assert list(got) == ["502", "I502", "a b", "two", "panel a"]


def test_small_cells(spark):
    df = spark.createDataFrame([("a", 10), ("b", 11)], "k string, n int")
    got = {r["k"]: (r["n"], r["suppressed"]) for r in cells.suppress(df).collect()}
    assert got == {"a": (None, 1), "b": (11, 0)}
    shown = one(df.limit(1), cells.n_percent(F.lit(5), F.lit(50)), cells.n_percent(F.lit(25), F.lit(50)), cells.median_iqr(F.lit(2.0), F.lit(1.0), F.lit(3.0)))
    assert list(shown) == ["<11", "25 (50.0%)", "2.0 [1.0, 3.0]"]
