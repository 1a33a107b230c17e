import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import order_stats as os_

PROBS = [0, 0.01, 0.25, 0.5, 0.9, 1]


@pytest.fixture(scope="module")
def values(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("A"), (F.xxhash64("id") / 1e12).alias("v"))
    return df, df.toPandas()


def held(df, want, **settings):
    got = os_.exact_quantiles(df, ["A"], "v", PROBS, **settings).collect()
    assert len(got) == 2
    for r in got:
        mine = want[want.A == r["A"]].v
        assert r["n"] == len(mine) and np.allclose(list(r)[2:], np.quantile(mine, PROBS), rtol=1e-12)


def test_narrow_slivers_are_exact(values):
    held(*values, sliver=400, accuracy=20)


def test_a_wrong_bracket_is_noticed(values, monkeypatch):
    real = os_._brackets

    def wrong(base, keys, probs, accuracy):
        moved = {f"_lo{i}": F.lit(1e6 + i) for i in range(len(probs))} | {f"_hi{i}": F.lit(1e6 + i + 0.5) for i in range(len(probs))}
        return real(base, keys, probs, accuracy).withColumns(moved)

    monkeypatch.setattr(os_, "_brackets", wrong)
    held(*values)


def test_nan_is_missing_and_an_empty_table_has_no_groups(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", float("nan")), ("x", None), ("x", 3.0), ("y", None)], "a string, v double")
    assert [tuple(r) for r in os_.exact_quantiles(df, ["a"], "v", [0.5]).collect()] == [("x", 2, 2.0)]
    assert os_.exact_quantiles(df.where("a = 'z'"), ["a"], "v", [0.5]).count() == 0
