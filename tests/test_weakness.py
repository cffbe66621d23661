"""Weakness of highs and rallies, uncomparable bars, stagnating strategies and the pair scan against plain Python."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tapeworks.operators import folds, income, pairs, patterns, screens

DAY = date(2020, 1, 6)


def test_weakness_by_plain_rules(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150))).round(3)
    rows = pd.DataFrame({"symbol": "A", "date": [DAY + timedelta(i) for i in range(150)], "open": close * (1 + rng.normal(-0.002, 0.01, 150)), "high": (close * 1.01).round(1), "low": close * 0.98, "close": close, "volume": rng.integers(50, 150, 150).astype(float)})
    got = screens.weakness(spark.createDataFrame(rows)).orderBy("date").toPandas()
    high, volume, start = rows["high"].tolist(), rows["volume"].tolist(), rows["open"].tolist()
    for i in range(150):
        h = high[max(0, i - 19) : i + 1]
        tops = [h[k] for k in range(1, len(h) - 1) if h[k] > h[k - 1] and h[k] > h[k + 1]]
        assert got["lower_highs"][i] == (i >= 19 and len(tops) > 1 and tops[-1] < tops[-2])
        c = close[max(0, i - 14) : i + 1][::-1].tolist()
        at = c.index(max(c))
        assert got["failed_rally"][i] == (i >= 14 and 3 <= at <= 10 and (c[0] / c[at] - 1) * 100 < -2)
        gaps = [start[k] / close[k - 1] - 1 <= -0.005 and volume[k] > 1.1 * volume[k - 1] for k in range(max(1, i - 4), i + 1)]
        assert got["gap_down"][i] == (i >= 5 and any(gaps))
    assert got[["lower_highs", "failed_rally", "gap_down"]].any().all()
    assert screens.weakness(spark.createDataFrame(rows).limit(0)).count() == 0


def test_uncomparable_bars_are_reported(spark):
    rows = [("A", DAY + timedelta(i), c, v) for i, (c, v) in enumerate([(1.0, 5.0), (None, 5.0), (1.0, 5.0), (1.0, 5.0), (1.0, 0.0)])] + [("B", DAY, None, None)]
    got = patterns.skipped_pairs(spark.createDataFrame(rows, "symbol string, date date, close double, volume double")).collect()
    assert sorted((r["date"] - DAY).days for r in got) == [1, 2, 4]


def test_stagnation_triggers_and_advice(spark):
    fine = {"expectancy_score": 18, "risk": 12, "robustness": 12, "expectancy": 0.8, "profit_factor": 2.0, "max_drawdown": 10.0, "red_flags": "", "slippage_tested": True}
    cases = {
        "rises": ([50, 56, 61], {}, "continue", set()),
        "flat": ([60, 62, 61], {}, "pivot", {"plateau"}),
        "edge": ([60, 63, 61], {}, "continue", set()),
        "fits": ([40, 50, 60], {"risk": 15, "robustness": 9, "red_flags": "small_sample,over_optimized"}, "pivot", {"overfitting"}),
        "costs": ([40, 50, 60], {"expectancy": 0.2, "profit_factor": 1.1}, "pivot", {"cost_defeat"}),
        "untested": ([40, 50, 60], {"expectancy": 0.2, "profit_factor": 1.1, "slippage_tested": False}, "continue", set()),
        "no_losses": ([40, 50, 60], {"expectancy": 0.2, "profit_factor": None}, "continue", set()),
        "tail": ([40, 50, 60], {"max_drawdown": 36.0}, "pivot", {"tail_risk"}),
        "quits": ([80, 40, 28, 20], {}, "abandon", set()),
        "recovers": ([29, 20, 26], {}, "continue", set()),
        "two": ([20, 10], {"risk": None}, "continue", set()),
    }
    rows = [(k, i, v, *{**fine, **(change if i == len(totals) - 1 else {})}.values()) for k, (totals, change, _, _) in cases.items() for i, v in enumerate(totals)]
    kinds = "strategy string, i int, total int, expectancy_score int, risk int, robustness int, expectancy double, profit_factor double, max_drawdown double, red_flags string, slippage_tested boolean"
    got = {r["strategy"]: r for r in screens.stagnation(spark.createDataFrame(rows, kinds)).collect()}
    for k, (_, _, advice, fired) in cases.items():
        assert (got[k]["advice"], {t for t in ("plateau", "overfitting", "cost_defeat", "tail_risk") if got[k][t]}) == (advice, fired), k


def test_pair_scan(spark):
    rng = np.random.default_rng(9)
    market = np.cumsum(rng.normal(0, 0.02, 160))
    own = {s: np.cumsum(rng.normal(0, 0.004, 160)) for s in "ABC"} | {"X": np.cumsum(rng.normal(0, 0.05, 160))}
    price = {s: 50 * np.exp(own[s] + (0 if s == "X" else market)) for s in own}
    rows = [(s, DAY + timedelta(i), float(price[s][i])) for s in price for i in range(160) if not (s == "C" and i < 70)]
    got = {(r["a"], r["b"]): r for r in pairs.scan_pairs(spark.createDataFrame(rows, "symbol string, date date, close double"), trades=1).collect()}
    assert set(got) == {("A", "B")}  # C has too few sessions, X does not move with the others
    x, y = price["A"], price["B"]
    ratio, held, profits = np.log(x / y), None, []
    for i in range(19, 160):
        w = ratio[i - 19 : i + 1]
        z = (ratio[i] - w.mean()) / w.std()
        if held is None:
            held = (i, -1 if z > 0 else 1) if abs(z) >= 2 else None
        elif abs(z) >= 4 or abs(z) <= 0.5:
            profits.append(held[1] * ((x[i] / x[held[0]] - 1) - (y[i] / y[held[0]] - 1)))
            held = None
    if held:
        profits.append(held[1] * ((x[-1] / x[held[0]] - 1) - (y[-1] / y[held[0]] - 1)))
    r = got["A", "B"]
    assert r["trades"] == len(profits) and r["bars"] == 160
    assert r["total_profit"] == pytest.approx(sum(round(v, 4) for v in profits), abs=1e-6) and r["win_rate"] == pytest.approx(np.mean(np.array(profits) > 0))
    assert r["corr"] == pytest.approx(np.corrcoef(x[1:] / x[:-1], y[1:] / y[:-1])[0, 1])
    assert pairs.scan_pairs(spark.createDataFrame(rows, "symbol string, date date, close double"), trades=99).count() == 0


def test_yields_and_signals(spark):
    pays = [("A", DAY + timedelta(91 * i), 1.0, None, DAY + timedelta(91 * 11 + 20)) for i in range(12)] + [("B", DAY + timedelta(91 * i), 1.0, "Special pay" if i == 6 else None, DAY + timedelta(91 * 11 + 200)) for i in range(12)]
    basis = folds.fold(spark.createDataFrame(pays, "symbol string, date date, dividend double, label string, as_of date"), "dividends")
    got = {r["symbol"]: r for r in income.dividend_yields(basis, spark.createDataFrame([("A", 50.0), ("B", 0.0)], "symbol string, price double")).collect()}
    assert (got["A"]["suspended"], got["A"]["annualized"], got["A"]["yield_pct"], got["A"]["specials"]) == (False, 4.0, 8.0, 0)
    assert (got["B"]["suspended"], got["B"]["yield_pct"], got["B"]["specials"]) == (True, None, 1)
    yields = spark.createDataFrame([(s, 2000 + i, v) for s in "WTN" for i, v in enumerate([9.0, 3.0, 3.0, 3.0, 3.0, 4.0])], "symbol string, year int, yield_pct double")
    held = spark.createDataFrame([("W", 100.0, None, 3.0), ("T", 50.0, 3.0, 1.0), ("N", 50.0, None, None), ("X", 50.0, 1.0, 1.0)], "symbol string, price double, declared double, profile double")
    got = {r["symbol"]: r for r in income.yield_signal(held, yields).collect()}
    assert {k: r["signal"] for k, r in got.items()} == {"W": "WAIT", "T": "TRIGGERED", "N": "ASSUMPTION-REQUIRED", "X": "ASSUMPTION-REQUIRED"}
    assert (got["W"]["mean_yield"], got["W"]["target_yield"], got["W"]["buy_price"], got["W"]["drop_needed"], got["W"]["current_yield"]) == (3.2, 3.7, 81.08, 18.92, 3.0)
    assert got["T"]["drop_needed"] == 0.0 and got["X"]["observations"] == 0
