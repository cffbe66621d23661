"""Roundings that SQL makes of scaled values."""

from __future__ import annotations

from datetime import date

from tapeworks.operators import contraction, income


def test_patterns_round_scaled_values():
    assert contraction.cents(49502.255) == 49502.26 and contraction.cents(12.345) == 12.34
    assert contraction.mills(1.0005) == 1.001 and contraction.mills(2.4994) == 2.499


def test_equal_years_are_no_growth_whatever_the_order_of_adding(spark):
    rows = [("A", date(1998, 3, 1), 0.3), ("A", date(1999, 3, 1), 0.1), ("A", date(1999, 6, 1), 0.2), ("A", date(2000, 3, 1), 0.3)]
    df = spark.createDataFrame(rows, "symbol string, date date, dividend double")
    assert income.dividend_growth_calendar(df, 2001).first().growth_years == 0
    assert income.stability_score(df, 2001).first().spread == 0


def test_growth_by_whole_cents_of_many_addends(spark):
    """0.1 + 0.7, 0.8 and eight times 0.1 are equal years in any order of adding; a cent more is growth."""
    rows = [("A", date(1997, m, 1), x) for m, x in enumerate((0.1, 0.7), 1)] + [("A", date(1998, 1, 1), 0.8)] + [("A", date(1999, m, 1), 0.1) for m in range(1, 9)] + [("A", date(2000, 1, 1), 0.81)]
    for order in (rows, rows[::-1]):
        got = income.dividend_growth_calendar(spark.createDataFrame(order, "symbol string, date date, dividend double"), 2001).first()
        assert (got.growth_years, got.no_cut) == (1, True)
