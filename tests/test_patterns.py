"""Turning points, contraction patterns and the walk forward against plain loops and hand-made paths."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import contraction, vcp
from tapeworks.operators.contraction import Limits

START = dt.date(2015, 1, 1)


def legs(*points: tuple[int, float]) -> np.ndarray:
    """A path through (bar, price), straight between."""
    return np.interp(np.arange(points[-1][0] + 1), [i for i, _ in points], [p for _, p in points])


def turns_by_state(h, low, step, lead):
    """A bar at a time: one running extreme and the side looked for."""
    i0 = max(range(min(lead, len(h))), key=lambda i: (h[i], -i))
    side, ext, at, out = 1, h[i0], i0, []
    for i in range(i0 + 1, len(h)):
        x, y = (h[i], low[i]) if side > 0 else (-low[i], -h[i])
        e = ext * side
        if x > e:
            ext, at = x * side, i
        elif e - y >= step:
            out.append((at, side))
            side = -side
            ext, at = (low[i] if side < 0 else h[i]), i
    return out


@pytest.mark.parametrize("seed", range(8))
def test_turns_equal_a_walk_over_bars(seed):
    rng = np.random.default_rng(seed)
    c = 50 + np.cumsum(rng.choice([-1.0, -0.5, 0, 0.5, 1.0], 300))  # few values: many ties
    h, low = c + rng.choice([0, 0.5], 300), c - rng.choice([0, 0.5], 300)
    for step in (0.5, 1.5, 4.0, 1000.0):
        assert contraction.turning_points(h, low, step, 14) == turns_by_state(h, low, step, 14)
    assert contraction.turning_points(h, low, 0, 14) == [] == contraction.turning_points(h[:0], low[:0], 1, 14)


def test_an_open_extreme_is_no_turn():
    c = legs((0, 100), (20, 120), (40, 105), (60, 118))  # the rise at the end has turned nowhere yet
    assert contraction.turning_points(c, c, 3, 14) == [(20, 1), (40, -1)]
    assert contraction.turning_points(legs((0, 100), (30, 130)), legs((0, 100), (30, 130)), 3, 14) == []


def test_fixed_window_swings_step_in():
    x = legs((0, 10), (10, 20), (20, 10), (30, 20), (40, 10))
    assert contraction.window_swings(x).tolist() == [10, 30] and contraction.window_swings(-x).tolist() == [20]
    assert contraction.window_swings(np.full(30, 1.0)).size == 0 == contraction.window_swings(x[:9]).size
    flat = np.zeros(120)
    tops, bottoms = contraction.swings(x, x, x, Limits(swing_ranges=1000.0))
    assert tops.tolist() == [10, 30] and bottoms.tolist() == [20]
    assert contraction.detect(flat + 5, flat + 5, flat + 5, flat)["pivot"] is None


def test_an_outside_bar_is_a_high_and_a_low():
    h, low = np.full(40, 10.0), np.full(40, 9.0)
    h[20], low[20] = 12.0, 7.0
    tops, bottoms = contraction.swings(h, low, low, Limits(swing_ranges=1000.0))
    assert tops.tolist() == [20] == bottoms.tolist()


VCP = legs((0, 70), (30, 100), (45, 80), (60, 99), (70, 91), (80, 98.5), (88, 94.5), (96, 98), (102, 94), (110, 97))


def test_a_pattern_by_its_rules():
    v = np.linspace(2000, 1000, len(VCP))
    found = contraction.detect(VCP, VCP, VCP, v)
    depths = [x["depth_pct"] for x in found["chain"]]
    assert depths[:3] == [20.0, 8.08, 4.06] and found["first_high_at"] == 30
    assert found["contractions"] == len(depths) == 4 and depths[3] > 0.75 * depths[2]  # 4.08 after 4.06: it does not shrink
    assert not found["valid"] and found["score"] == 40
    shorter = contraction.detect(VCP[:96], VCP[:96], VCP[:96], v[:96])
    assert shorter["valid"] and shorter["score"] == 90 and shorter["pivot"] == 98.5 and shorter["last_low"] == 94.5
    assert shorter["volume_declining"] and not shorter["wide"] and shorter["right_side"] > 0
    assert not contraction.detect(VCP[:96], VCP[:96], VCP[:96], v[::-1][:96])["volume_declining"]


@pytest.mark.parametrize(
    ("depths", "span", "want"),
    [([20, 10, 5], 40, (True, 80)), ([20, 15], 40, (True, 60)), ([20, 15.2], 40, (False, 30)), ([7.9, 4], 40, (False, 30)), ([8, 4], 14, (False, 30)), ([36, 9], 40, (True, 60)), ([20, 5, 1.2], 40, (True, 100)), ([20, 10, 5, 2.5], 40, (True, 100)), ([20], 40, (False, 0)), ([20, 18, 17, 16], 50, (False, 40))],
)
def test_verdicts_at_their_boundaries(depths, span, want):
    assert contraction.verdict(depths, span, Limits()) == want


def test_pullbacks_keep_their_distance_and_shoulder():
    h = np.full(60, 100.0)
    tops, bottoms = np.array([5, 20, 40]), np.array([8, 12, 30, 50])
    assert contraction.pullbacks(5, tops, bottoms, h, 5) == [(5, 12), (20, 30), (40, 50)]  # 8 is too near, 12 is not
    assert contraction.pullbacks(5, tops, np.array([8, 30]), h, 5) == []  # 30 lies past the swing high at 20
    h[20] = 94.0
    assert contraction.pullbacks(5, tops, bottoms, h, 5) == [(5, 12)]


def panel(n: int, symbols: str = "ABC", seed: int = 5) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        base = np.tile(VCP[:96], n // 96 + 1)[:n] + rng.normal(0, 0.2, n)
        rows.append(pd.DataFrame({"symbol": s, "date": [START + dt.timedelta(days=i) for i in range(n)], "open": base, "high": base + 0.3, "low": base - 0.3, "close": base, "volume": rng.integers(500, 1500, n).astype(float)}))
    return pd.concat(rows)


def test_walk_forward_in_stretches_and_without_the_future(spark):
    rows = panel(420)
    bars = spark.createDataFrame(rows)
    bench = bars.groupBy("date").agg(F.avg("close").alias("bench"))
    whole = vcp.walk_forward(bars, bench).toPandas().sort_values(["symbol", "as_of"], ignore_index=True)
    assert len(whole) > 3 and set(whole["outcome"]) <= {"breakout", "stop_hit", "timeout", "insufficient_data"}
    cut = vcp.walk_forward(bars, bench, stretch=37).toPandas().sort_values(["symbol", "as_of"], ignore_index=True)
    pd.testing.assert_frame_equal(whole, cut)
    # one task, one symbol, every cursor: the same patterns, the earliest date of each
    want = {}
    for s, g in rows.groupby("symbol"):
        h, low, c, v = (g[x].to_numpy() for x in ("high", "low", "close", "volume"))
        for end in range(120, len(c) + 1, 5):
            found = contraction.detect(h[:end], low[:end], c[:end], v[:end], contraction.SCREEN)
            if found["valid"]:
                days = g["date"].to_numpy()[end - 120 : end]
                want.setdefault((s, days[found["first_high_at"]], days[found["last_low_at"]], found["pivot"]), g["date"].iat[end - 1])
    assert {(r.symbol, r.first_high_date, r.last_low_date, r.pivot): r.as_of for r in whole.itertuples()} == want
    # what is known at a date does not change with later bars
    past = START + dt.timedelta(days=300)
    early = vcp.walk_forward(bars.where(F.col("date") <= past), bench).toPandas()
    known = ["symbol", "as_of", "composite", "state", "pivot", "first_high_date", "last_low_date"]
    pd.testing.assert_frame_equal(early[known].sort_values(known[:2], ignore_index=True), whole[whole["as_of"] <= past][known].reset_index(drop=True))


def test_screen_zones(spark):
    bars = spark.createDataFrame(panel(300, "AB"))
    bench = bars.groupBy("date").agg(F.avg("close").alias("bench"))
    got = vcp.vcp_screen(bars, bench).collect()
    assert len(got) == 2 and all(r.zone_b > 0 and r.volume >= 0 for r in got)
    assert vcp.vcp_screen(bars.limit(0), bench).count() == 0 == vcp.walk_forward(bars.limit(0), bench).count()
