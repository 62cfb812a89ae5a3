"""Percentiles by refinement against sorted values."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkwell.operators import ranks, report


@given(st.lists(st.floats(), min_size=1, max_size=30))
def test_order(values):
    x = np.array(values)
    places = ranks.ordered(x)
    back = ranks.valued(places)
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(back.tolist(), values, strict=True))
    assert np.array_equal(np.sort(x), ranks.valued(np.sort(places)), equal_nan=True)


def exact(values, shares):
    x = np.sort(np.array(values))
    out = []
    for s in shares:
        low = int(s * (len(x) - 1))
        part = s * (len(x) - 1) - low
        out.append(x[low] if not part else (1 - part) * x[low] + part * x[min(low + 1, len(x) - 1)])
    return out


SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("few", [0, 5, 1 << 16])
def test_percentiles(spark, monkeypatch, few):
    """In two, three and four passes: close values, ties, signs, infinities, nulls."""
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(few)
    for values in ([3.5], [2.0] * 50, [1 + k * 2.0**-50 for k in range(40)], [-0.0, 0.0, -1e-300, 5e-324, -math.inf, math.inf, 1e308], rng.normal(0, 1, 500).tolist()):
        table = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        assert ranks.percentiles(table, "x", SHARES) == pytest.approx(exact(values, SHARES), nan_ok=True, rel=1e-15)


def test_none_and_other_types(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert ranks.percentiles(empty, "x", (0.5,)) == [None]
    found = report.describe(empty, "x").first()
    assert (found["count"], found.p50, found.max) == (0, None, None)
    whole = spark.range(11).withColumn("d", report.F.col("id").cast("decimal(9,2)"))
    assert ranks.percentiles(whole, "id", (0.25, 0.5)) == [2.5, 5.0] and ranks.percentiles(whole, "d", (0.5,)) == [5.0]
    assert math.isnan(ranks.percentiles(spark.createDataFrame([(1.0,), (math.nan,)], "x double"), "x", (1.0,))[0])


def test_many_values(spark):
    """Ten million different values: what reaches the driver a pass stays bounded."""
    seen, counted = [], ranks._counted

    def spied(*a):
        seen.append(counted(*a))
        return seen[-1]

    ranks._counted = spied
    try:
        got = ranks.percentiles(spark.range(10_000_000).selectExpr("cast(id * 7919 % 10000000 AS double) AS x"), "x", (0.25, 0.5, 0.999))
    finally:
        ranks._counted = counted
    assert got == [2499999.75, 4999999.5, pytest.approx(9989999.001)]
    assert len(seen) <= 4 and max(map(len, seen)) <= 6 << ranks.BITS
