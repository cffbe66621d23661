"""Ladder scores, weeks around reports, income over years, accounts and logs against plain Python."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import events, income, ladders, screens, textchecks
from tapeworks.sources.bars import weekday_freshness

DAY = date(2020, 1, 6)  # a Monday


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(3)
    ma8 = np.clip(0.5 + np.cumsum(rng.normal(0, 0.02, 260)), 0.05, 0.95).round(6)
    return pd.DataFrame({"date": [DAY + timedelta(i) for i in range(260)], "raw": np.clip(ma8 + rng.normal(0, 0.01, 260), 0, 1), "ma8": ma8, "ma200": pd.Series(ma8).expanding().mean().round(6), "market_ret": rng.normal(0, 0.01, 260), "trend": rng.choice([1, -1], 260)})


def test_bearish_score_by_table(spark):
    cases = [(False, 1, 0.6, 0.5, 85), (False, -1, 0.6, 0.5, 50), (False, -1, 0.4, 0.5, 40), (True, 1, 0.4, 0.5, 30), (True, 1, 0.6, 0.5, 45), (True, -1, 0.2, 0.5, 5), (True, -1, 0.3, 0.5, 10), (None, 1, 0.3, 0.5, 85)]
    rows = spark.createDataFrame([(DAY + timedelta(i), s, t, a, b) for i, (s, t, a, b, _) in enumerate(cases)], "date date, signal boolean, trend int, ma8 double, ma200 double")
    got = ladders.bearish_score(rows, F.col("signal")).orderBy("date").collect()
    assert [r["score"] for r in got] == [c[-1] for c in cases]
    assert [r["streak"] for r in got] == [0, 0, 1, 0, 0, 1, 2, 0]
    assert ladders.bearish_score(rows.limit(0), F.col("signal")).count() == 0


def test_cycle_score(spark, walk):
    x = walk["ma8"].tolist()
    marks = {}
    for i in range(len(x)):
        near = x[max(0, i - 10) : i + 11]
        if x[i] in (max(near), min(near)):
            marks[i] = "peak" if x[i] == max(near) else "trough"
    got = {r["date"]: r for r in ladders.cycle_score(spark.createDataFrame(walk)).collect()}
    ages = {("trough", True): (85, 75, 65), ("trough", False): (30, 35, 40), ("peak", True): (60, 45, 50), ("peak", False): (20, 15, 10)}
    for i in range(len(x)):
        at = max((m for m in marks if i - 119 <= m <= i), default=None)
        want = 50
        if at is not None and i >= 9:
            age = i - at
            want = ages[marks[at], i >= 5 and x[i] > x[i - 5]][0 if age <= 20 else 1 if age <= 60 else 2] + (10 if marks[at] == "trough" and x[at] < 0.4 else 0)
        assert got[walk["date"][i]]["score"] == want


def test_divergence_score(spark, walk):
    walk = walk.assign(ma8=walk["ma8"].where(walk.index >= 7))
    idx = np.exp(np.cumsum(np.log1p(walk["market_ret"].to_numpy())))[7:]
    b = walk["ma8"].to_numpy()[7:]

    def score(i: int, n: int) -> int:
        at = max(0, i - n + 1)
        p, c = (idx[i] / idx[at] - 1) * 100, b[i] - b[at]
        for limit, breadth, v in ((3, -0.05, 10), (1, -0.03, 25)):
            if p > limit and c < breadth:
                return v
        for limit, breadth, v in ((-3, 0.05, 80), (-1, 0.03, 65)):
            if p < limit and c > breadth:
                return v
        if abs(p) < 0.5 and abs(c) < 0.01:
            return 50
        return 70 if p > 1e-9 and c > 1e-9 else 30 if p <= 1e-9 and c <= 1e-9 else 50

    got = ladders.divergence_score(spark.createDataFrame(walk.astype(object).where(walk.notna(), None), "date date, raw double, ma8 double, ma200 double, market_ret double, trend int")).orderBy("date").collect()
    assert len(got) == len(b)
    for i, r in enumerate(got):
        long, short = score(i, 60), score(i, 20)
        assert (r["long"], r["short"]) == (long, short)
        assert r["score"] == (50 if i < 19 else pytest.approx(round(0.6 * long + 0.4 * short, 1)))
        assert r["early_warning"] == (i >= 19 and short <= 25 and long >= 50)


def test_momentum_smooths_by_recursion_and_counts_sectors(spark, walk):
    series, slopes = spark.createDataFrame(walk), np.diff(walk["raw"].to_numpy())
    smooth = [slopes[0]]
    for v in slopes[1:]:
        smooth.append(0.5 * v + 0.5 * smooth[-1])
    sectors = spark.createDataFrame([(walk["date"][50], "a", 0.1), (walk["date"][50], "b", None), (walk["date"][50], "c", -0.1), (walk["date"][50], "d", 0.2)], "date date, sector string, slope double")
    got = ladders.momentum_score(series, sectors).orderBy("date").collect()
    assert np.allclose([r["smooth"] for r in got], smooth, rtol=0, atol=1e-15)
    assert [r["acceleration"] is None for r in got[:11]] == [True] * 9 + [False] * 2
    assert got[12]["acceleration"] == pytest.approx(np.mean(smooth[8:13]) - np.mean(smooth[3:8]), abs=1e-9)
    assert got[100]["acceleration"] == pytest.approx(np.mean(smooth[91:101]) - np.mean(smooth[81:91]), abs=1e-9)
    assert got[49]["wide"] == 50.0 and got[48]["wide"] is None
    points = [(-0.06, 0), (-0.02, 9), (-0.02, 10), (-0.01, 34), (-0.01, 35), (0, 54), (0, 55), (0.01, 74), (0.01, 75), (0.02, 94), (0.02, 95), (0.03, 100)]
    for r in got:
        s = r["smooth"]
        piece = max(k for k in range(0, 12, 2) if k == 0 or s >= points[k][0])
        (x0, y0), (x1, y1) = points[piece], points[piece + 1]
        level = min(100, max(0, y0 + (s - x0) / (x1 - x0) * (y1 - y0))) if piece else max(0, 9 + (s + 0.02) / 0.01 * 9)
        a = r["acceleration"]
        faster = 50 if a is None else 90 if a > 0.005 else 75 if a > 0.001 else 50 if a > -0.001 else 25 if a > -0.005 else 10
        assert abs(r["score"] - (0.5 * level + 0.3 * faster + 0.2 * (50 if r["wide"] is None else r["wide"]))) <= 0.5 + 1e-6


def test_percentile_scores(spark):
    rows = spark.createDataFrame([(None, 0), (1.0, 0), (1.0, 15), (1.0, 44), (1.0, 45), (1.0, 94), (1.0, 95)], "rs double, pct long")
    assert [r["score"] for r in ladders.percentile_score(rows, "rs", "pct").collect()] == [0, 20, 40, 50, 60, 90, 100]


def test_weeks_around_an_event(spark):
    days = [DAY + timedelta(i) for i in range(32) if (DAY + timedelta(i)).weekday() < 5][:-2]  # ends on a Wednesday
    bars = spark.createDataFrame([("A", d, float(i), i + 2.0, i - 1.0, i + 1.0, 10.0, "x") for i, d in enumerate(days)], "symbol string, date date, open double, high double, low double, close double, volume double, week string").drop("week")
    got = {r["week"]: r for r in events.event_weeks(bars, spark.createDataFrame([("A", days[7]), ("A", days[7]), ("B", days[0])], "symbol string, event date"), 1, 6).collect()}
    assert sorted(got) == [DAY + timedelta(7 * k) for k in range(5)][: len(got)] and len(got) >= 4
    own = got[DAY + timedelta(7)]
    assert (own["sessions"], own["open"], own["close"], own["partial"], own["green"]) == (3, 7.0, 10.0, True, True)
    last = max(got)
    assert [got[w]["partial"] for w in sorted(got)] == [False, True] + [False] * (len(got) - 3) + [True] and got[last]["sessions"] < 5


def test_income_over_years(spark):
    paid = {"S": [1.0, 1.0, 0.97, 1.1], "C": [1.0, 1.2, 0.9, 1.0], "W": [1.0, 3.0, 3.0, 3.3], "T": [1.0, 1.0]}
    rows = [(k, date(2000 + y, m, 1), v / 2) for k, vs in paid.items() for y, v in enumerate(vs) for m in (3, 9)]
    got = {r["symbol"]: r for r in income.stability_score(spark.createDataFrame(rows, "symbol string, date date, dividend double"), 2004).collect()}
    assert set(got) == {"S", "C", "W"}
    assert (got["S"]["growth_years"], got["S"]["stable"], got["S"]["growing"], got["S"]["score"]) == (3, True, True, 100.0)
    assert (got["C"]["growth_years"], got["C"]["growing"], got["C"]["score"]) == (1, False, 50.0)
    assert got["W"]["spread"] == pytest.approx(2.3 / 2.575 * 100) and got["W"]["score"] == pytest.approx(round(40 - 89.3 * 0.4 + 60, 1))
    rows = [(k, date(2000 + y, m, 1), v) for k, vs in {"up": [1, 2, 1.5, 3], "twice": [1, 0.9, 0.8, 3], "down": [2, 3, 4, 1], "short": [1, 2]}.items() for y, v in enumerate(vs) for m in (1, 4, 7, 10)]
    got = {r["symbol"]: r["positive"] for r in income.positive_trend(spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "symbol string, period date, v double"), "v").collect()}
    assert got == {"up": True, "twice": False, "down": False, "short": False}
    rows = [("A", date(2000 + q // 4, q % 4 * 3 + 1, 1), 10.0 + q, 5 + q) for q in range(12)] + [("Z", date(2000, 1, 1), 0.0, 2)]
    got = {r["symbol"]: r for r in income.ownership_trend(spark.createDataFrame(rows, "symbol string, quarter date, shares double, holders long")).collect()}
    assert got["A"]["shares_trend_pct"] == pytest.approx(7 / 14 * 100) and got["A"]["holders_trend"] == 7 and got["Z"]["shares_trend_pct"] is None


def test_calendar_and_accounts(spark):
    rows = spark.createDataFrame([("A", DAY, "AMC", "x", 2e10), ("B", DAY, "bmo", None, 1e9), ("C", DAY, None, "x", None), ("D", DAY, "amc", "y", 3e10), ("E", DAY + timedelta(1), "bmo", "y", 1e10)], "symbol string, date date, timing string, sector string, market_cap double")
    stats = {(r["kind"], r["name"]): r["n"] for r in income.calendar_stats(rows).collect()}
    assert stats == {("total", "total"): 5, ("total", "large_cap"): 3, ("total", "mid_cap"): 2, ("sector", "x"): 2, ("sector", "y"): 2, ("sector", "N/A"): 1, ("peak", str(DAY)): 4}
    assert [r["symbol"] for r in income.calendar_order(rows).orderBy("date", "place").collect()] == ["B", "D", "A", "C", "E"]
    assert income.calendar_order(rows.limit(0)).count() == 0
    held = spark.createDataFrame([("a", "X", 30.0), ("a", "X", 30.0), ("a", "Y", 20.0), ("a", "Z", 20.0), ("a", "N", -5.0)], "account string, symbol string, value double")
    got = {r["account"]: r for r in income.account_summary(held, spark.createDataFrame([("a", 100.0), ("b", 7.0), ("c", None)], "account string, cash double"), top=2).collect()}
    assert got["a"]["equity"] == 200.0 and got["a"]["cash_pct"] == 50.0 and got["a"]["positions"] == 3
    assert [tuple(x) for x in got["a"]["largest"]] == [("X", 60.0, 30.0), ("Y", 20.0, 10.0)]
    assert got["b"]["cash_pct"] == 100.0 and got["b"]["largest"] == [] and got["c"]["cash_pct"] is None


def test_logs_and_freshness(spark):
    calls = [("s", i, n) for i, n in enumerate("abcabcabc")] + [("t", i, n) for i, n in enumerate("abcabca")] + [("s", 99, "__error"), ("s", 98, None)]
    got = {(r["sid"], r["sequence"]): r["n"] for r in textchecks.session_sequences(spark.createDataFrame(calls, "sid string, at int, name string"), "sid", ["at"], "name").collect()}
    assert got == {("s", "a>b>c"): 3}
    texts = ["Please automate this", " \nImprove the skill 'x'", "ワークフローを作る", "nothing", "Please automate this", None]
    got = textchecks.automation_requests(spark.createDataFrame([(1, "user", x) for x in texts], "conv_id int, role string, text string")).collect()
    assert sorted(r["request"] for r in got) == sorted([texts[0], texts[2]])
    rows = spark.createDataFrame([("fri", date(2020, 1, 3)), ("wed", date(2020, 1, 1)), ("none", None)], "source string, date date")
    got = {r["source"]: (r["age"], r["is_stale"]) for r in weekday_freshness(rows, "source", "2020-01-05").collect()}
    assert got == {"fri": (0, False), "wed": (2, False), "none": (None, True)}
    assert dict((r["source"], r["is_stale"]) for r in weekday_freshness(rows, "source", "2020-01-06").collect())["wed"]


def test_trade_summary(spark):
    close = [10.0, 11.0, 12.0, 9.0, 9.9, 8.0]
    bars = spark.createDataFrame([(s, DAY + timedelta(i), c) for s in "AB" for i, c in enumerate(close)], "symbol string, date date, close double")
    trades = spark.createDataFrame([("A", DAY, DAY + timedelta(2), 0.2), ("A", DAY + timedelta(3), DAY + timedelta(4), -0.1)], "symbol string, entry date, exit date, ret double")
    got = {r["symbol"]: r for r in screens.trade_summary(trades, bars, 3).collect()}
    assert got["A"].asDict() == {"symbol": "A", "trades": 2, "win_rate": 0.5, "mean_return": 0.05, "total_return": 0.08, "hold_return": -0.3333, "mean_bars": 1.5}
    assert got["B"]["trades"] == 0 and got["B"]["win_rate"] is None and got["B"]["total_return"] == 0.0
    assert screens.trade_summary(trades, bars, 99).first()["hold_return"] == 0.0
