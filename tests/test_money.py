from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobscope.functions.money import money_avg, money_sum


def totals(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "amount double")
    return tuple(df.agg(money_sum(df.amount), money_avg(df.amount)).first())


@pytest.mark.parametrize(
    "values, total, mean",
    [
        ([0.1] * 10, 1.0, 0.1),
        ([0.01, 0.02], 0.03, 0.02),  # a half rounds away from zero
        ([-0.01, -0.02], -0.03, -0.02),
        ([1.0, None], 1.0, 1.0),
        ([None], None, None),
        ([], None, None),
        ([0.125, 0.125], 0.25, 0.13),  # three decimals
        ([5.0, -5.0], 0.0, 0.0),
    ],
)
def test_cases(spark, values, total, mean):
    assert totals(spark, values) == (total, mean)


@pytest.mark.parametrize(
    "values, total",
    [
        ([1.0, math.nan], math.nan),
        ([1.0, math.inf], math.inf),
        ([-math.inf, 1.0], -math.inf),
        ([math.inf, -math.inf, 1.0], math.nan),
        ([1e300, 1.0], math.inf),  # 10^20 and more count as infinite
        ([9.9e19, 0.01], 9.9e19),
        ([-1e20, None], -math.inf),
        ([0.0000004, 0.0000004], 0.0),  # six places are kept
    ],
)
def test_values_a_sum_cannot_hold(spark, values, total):
    for got in totals(spark, values)[: 1 if math.isfinite(total) else 2]:
        assert got == total or (math.isnan(got) and math.isnan(total))


AMOUNTS = [0.1, 0.2, 1e16, -1e16, 0.125, 2.345, 1e-7, 9e13, -3.0, 1e20, math.nan]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(AMOUNTS), min_size=1, max_size=12), st.randoms())
def test_order_of_rows_does_not_matter(spark, values, draw):
    """Decimal places, sizes and NaN side by side: one answer for every order and partitioning."""
    shuffled = values[:]
    draw.shuffle(shuffled)
    assert repr(totals(spark, values)) == repr(totals(spark, shuffled))
    if not any(math.isnan(v) or abs(v) >= 1e20 for v in values):
        places = Decimal("0.000001")
        exact = sum(Decimal(repr(v)).quantize(places, ROUND_HALF_UP) for v in values)
        assert totals(spark, values)[0] == float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))
        mean = (exact * 100 / len(values)).quantize(Decimal(1), ROUND_HALF_UP)
        assert totals(spark, values)[1] == pytest.approx(float(mean) / 100, rel=1e-15)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-10**7, 10**7), min_size=1, max_size=30))
def test_exact_for_any_cents(spark, cents):
    got_sum, got_avg = totals(spark, [c / 100 for c in cents])
    mean = (Decimal(sum(cents)) / len(cents)).quantize(Decimal(1), ROUND_HALF_UP)
    assert got_sum == sum(cents) / 100
    assert got_avg == float(mean) / 100
