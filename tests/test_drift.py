"""Drift after reports against plain Python."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np

from tapeworks.operators import drift

DAY = date(2020, 1, 6)
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, event string"


def cents(x: float, digits: int = 2) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def monday(d: date) -> date:
    return d - timedelta(d.weekday())


def plain(bars: list[tuple], event: date, as_of: date, gap: float | None, watch: int, before: int, floors, tiers) -> dict | None:
    """The rules told once more for a single review; bars: (date, open, high, low, close, volume), oldest first."""
    seen = [b for b in bars if b[0] <= as_of]
    weeks: dict[date, list[tuple]] = {}
    for b in seen:
        m = monday(b[0])
        if m >= monday(event) - timedelta(7 * before) and not (m == monday(event) and b[0] < event):
            weeks.setdefault(m, []).append(b)
    if not weeks:
        return None
    line = [(m, weeks[m]) for m in sorted(weeks, reverse=True)]
    last = line[0][1][-1][0]
    if sum(b[0] <= last for b in seen) < 5:
        return None
    green = [d[-1][4] >= d[0][1] for _, d in line]
    o, h, lo, c = ([cents(f(d)) for _, d in line] for f in (lambda d: d[0][1], lambda d: max(b[2] for b in d), lambda d: min(b[3] for b in d), lambda d: d[-1][4]))
    vol = [sum(b[5] for b in d) for _, d in line]
    known = [m for m, _ in line]
    if monday(event) in known:
        end = age = known.index(monday(event))
    else:
        end, age = len(line) - 1, max(0, (known[0] - event).days // 7)
    red = None if age > watch else next((i for i in range(end) if not green[i]), None)
    stage = "EXPIRED" if age > watch else "MONITORING" if red is None else "BREAKOUT" if green[0] and c[0] > h[red] else "SIGNAL_READY"
    price = line[0][1][-1][4]
    above = 0.0 if red is None else (price - h[red]) / h[red] * 100
    usual = [v for v in vol[1:5] if v > 0]
    confirmed = above > 0 and bool(usual) and vol[0] > sum(usual) / len(usual)
    wick = 0.0 if red is None or h[red] == lo[red] else (min(o[red], c[red]) - lo[red]) / (h[red] - lo[red]) * 100
    tail = [b for b in seen if b[0] <= last][-20:]
    shares = sum(b[5] for b in tail) / len(tail)
    money = [b[5] * b[4] for b in tail if b[5] > 0]
    dollars = sum(money) / len(money) if money else shares * price
    passed = (dollars >= floors[0]) + (shares >= floors[1]) + (price >= floors[2])
    setup = next((s for t, s in ((10, 50), (7, 40), (5, 30), (3, 20)) if gap is not None and gap >= t), 10)
    setup += {"BREAKOUT": 50, "SIGNAL_READY": 45 if wick > 30 else 40, "MONITORING": 25 if age <= 2 else 15, "EXPIRED": 0}[stage]
    scores = {
        "setup": setup, "breakout": 0 if above <= 0 else 100 if above >= 3 and confirmed else 85 if above >= 2 and confirmed else 70 if above >= 1 else 55,
        "liquidity": (100 if dollars > tiers[0] else 85 if dollars > tiers[1] else 70) if passed == 3 else 40 if passed == 2 else 15, "risk_reward": 25 if red is None or lo[red] >= price else 70}
    total = round(scores["setup"] * 0.3 + scores["breakout"] * 0.25 + scores["liquidity"] * 0.25 + scores["risk_reward"] * 0.2, 1)
    rating = "Strong Setup" if total >= 85 else "Good Setup" if total >= 70 else "Developing" if total >= 55 else "Weak"
    return {"stage": stage, "weeks": age, "red_week": None if red is None else known[red], "confirmed": confirmed, **scores, "composite": total, "rating": rating, "weakest": min(scores, key=scores.get), "breakout_pct": cents(above)}


def test_reviews_by_plain_rules(spark):
    rng = np.random.default_rng(7)
    bars, lines = [], {}
    for symbol in "ABCDEF":
        close = 20 * np.exp(np.cumsum(rng.normal(0.002, 0.02, 260)))
        days = [DAY + timedelta(i) for i in range(260) if (DAY + timedelta(i)).weekday() < 5 and rng.random() > 0.15 and not 100 <= i <= 104]
        lines[symbol] = [(d, c * (1 + rng.normal(0, 0.015)), c * 1.03, c * 0.97, c, float(rng.integers(0, 3) * 50)) for d, c in ((d, float(close[(d - DAY).days])) for d in days)]
        bars += [(symbol, *b, "clash") for b in lines[symbol]]
    bars += [("A", DAY + timedelta(3), None, 1.0, 1.0, 1.0, 1.0, "x"), (None, DAY, 1.0, 1.0, 1.0, 1.0, 1.0, "x")]
    reviews = [(s, DAY + timedelta(int(k)), DAY + timedelta(int(k + n)), gap) for s in "ABCDEF" for k in (0, 30, 60, 102, 103, 150) for n in (0, 2, 9, 20, 33, 60) for gap in [[12.0, 8.0, 6.0, 3.0, -1.0, None][int(rng.integers(6))]]]
    floors, tiers = (700.0, 35.0, 10.0), (1500.0, 1200.0)
    frame = spark.createDataFrame(reviews + [reviews[0], (None, DAY, DAY, 1.0), ("A", DAY, DAY - timedelta(1), 1.0), ("A", None, DAY, 1.0), ("none", DAY, DAY, 1.0)], "symbol string, event date, as_of date, gap double")
    table = spark.createDataFrame(bars, SCHEMA)
    got = {(r["symbol"], r["event"], r["as_of"]): r for r in drift.drift_setups(table, frame, floors=floors, tiers=tiers).collect()}
    want = {r[:3]: plain(lines[r[0]], r[1], r[2], r[3], 5, 13, floors, tiers) for r in reviews}
    want = {k: v for k, v in want.items() if v}
    assert got.keys() == want.keys() and len(got) > 150
    for key, row in want.items():
        assert {c: got[key][c] for c in row} == row, key
    assert {r["stage"] for r in got.values()} == {"MONITORING", "SIGNAL_READY", "BREAKOUT", "EXPIRED"}
    assert len({r["rating"] for r in got.values()}) >= 3
    assert any(r["red_week"] and r["red_week"] < r["event"] - timedelta(7) for r in got.values())  # no bar in the event's week
    assert drift.drift_setups(table.limit(0), frame).count() == 0
    assert drift.drift_setups(table, frame.limit(0)).count() == 0
