"""Pairs are screened and measured in the tasks that hold both series; copies of a series are exact ties."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from tapeworks.operators import pairs

DAY = date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    base = np.cumsum(rng.normal(0, 1, 300))
    series = {f"s{i}": 100 + base + np.cumsum(rng.normal(0, 0.3, 300)) for i in range(4)}
    series |= {"t0": series["s0"], "t1": series["s1"]}
    rows = [(s, DAY + timedelta(i), float(v)) for s, x in series.items() for i, v in enumerate(x) if s[0] == "t" or s in ("s0", "s1") or rng.random() > 0.05]
    return spark.createDataFrame(rows, "symbol string, date date, close double").cache()


def test_pairs_in_one_task_equal_their_spreads(panel):
    chosen = pairs.pair_statistics(panel, least_corr=0.3, block=2)
    spread = pairs.pair_spread(chosen, panel)
    for fast, plain, value in ((pairs.pair_half_lives(panel, 0.3), pairs.half_life(spread), "phi"), (pairs.pair_signals(panel, 0.3), pairs.pair_signal(spread), "z"), (pairs.pair_unit_roots(panel, 0.3), pairs.pair_adf(spread), "adf")):
        got, want = ({(r.a, r.b): r[value] for r in df.collect()} for df in (fast, plain))
        assert set(got) == set(want) and len(got) > 3
        for k, v in want.items():
            if k not in (("s0", "t0"), ("s1", "t1")):  # copies: their spread is nothing but 0
                assert got[k] == pytest.approx(v, rel=1e-6)


def test_copies_have_no_spread_and_tie_by_name(panel):
    got = {(r.a, r.b): r for r in pairs.pair_half_lives(panel, 0.3).collect()}
    assert got["s0", "t0"].phi is None and got["s1", "t1"].half_life is None
    stats = {(r.a, r.b): r for r in pairs.pair_statistics(panel).collect()}
    assert stats["s0", "t0"].beta == 1.0 and stats["s1", "t1"].beta == 1.0
    returns = panel.withColumnRenamed("close", "ret")
    assert [(r.a, r.b) for r in pairs.top_return_pairs(returns, k=2).collect()] == [("s0", "t0"), ("s1", "t1")]


def rows_at_the_right(rng, count: int = 60, width: int = 80):
    n = rng.integers(0, width + 1, count)
    here = np.arange(width) >= width - n[:, None]
    x = np.cumsum(rng.choice([-1.0, 0, 0, 1.0], (count, width)), axis=1)  # few values: stretches without spread
    return np.where(here, x, 0.0), here


def test_batches_equal_one_series_at_a_time():
    x, here = rows_at_the_right(np.random.default_rng(3))
    z = pairs.ratio_zs(x, here, 6)
    tests = pairs.unit_root_tests(x, here, 30)
    for mark in (False, True):
        found = [[] for _ in x]
        for rows, start, end, side in pairs.backtest_rows(z, 1.5, 0.5, 2.0, mark):
            for r, p, q, s in zip(rows.tolist(), start.tolist(), end.tolist(), side.tolist(), strict=True):
                found[r].append((p, q, s, s * (x[r, q] - x[r, p])))
        for k in range(len(x)):
            one, lead = x[k][here[k]], len(x[k]) - int(here[k].sum())
            plain = pairs.ratio_z(one, 6)
            np.testing.assert_allclose(z[k][here[k]], plain, rtol=1e-9, atol=1e-12)
            want = pairs.backtest_pair_series(z[k][here[k]], one, 1.5, 0.5, 2.0, mark)
            assert found[k] == [(p + lead, q + lead, s, gain) for p, q, s, gain, _ in want]
    for k in range(len(x)):
        t, p, hit = pairs.unit_root_test(x[k][here[k]], 30)
        assert (tests["adf"][k], tests["p_value"][k]) == pytest.approx((t, p), rel=1e-7, nan_ok=True) and tests["cointegrated"][k] == hit


def test_single_precision_leaves_no_pair_out(spark):
    """Series whose common dates hold next to nothing of their spread, and pairs right at the limit."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1e-3, 300)
    rows = [(f"s{i}", DAY + timedelta(k), float(1e6 * (k == i) + base[k] + rng.normal(0, 1e-3))) for i in range(12) for k in range(300) if k == i or k > 11]
    panel = spark.createDataFrame(rows, "symbol string, date date, close double")
    exact = {(r.a, r.b): r.corr for r in pairs.pair_statistics(panel, least_bars=200).collect()}
    assert len(exact) == 66
    limit = sorted(exact.values())[30]
    got = {(r.a, r.b) for r in pairs.pair_statistics(panel, least_bars=200, least_corr=limit).collect()}
    assert got == {k for k, v in exact.items() if v >= limit} and len(got) == 36
