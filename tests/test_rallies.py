"""Rally states by week and of two indices against plain Python."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np

from tapeworks.operators import folds, rallies

DAY = date(2020, 1, 6)
PRIORITY = ["FTD_WINDOW", "RALLY_ATTEMPT", "FTD_INVALIDATED", "CORRECTION", "RALLY_FAILED", "NO_SIGNAL"]


def plain_state(line: list[tuple]) -> dict:
    """One index: state, and of a follow-through its place, volume and the five days after; line: (date, h, l, c, v)."""
    line = line[-60:]
    h, low, c, v = (np.array([b[k] for b in line]) for k in (1, 2, 3, 4))
    got = folds.rally_state(h, low, c, v)
    out = {"state": got["state"], "found": got["ftd_day"] > 0, "day": got["ftd_day"], "gain": got["gain"]}
    if not out["found"]:
        return out
    at = len(line) - got["rally_day"] + got["ftd_day"] - 1
    assert round((line[at][3] / line[at - 1][3] - 1) * 100, 2) == got["gain"] and line[at][4] > line[at - 1][4]
    usual = [b[4] for b in line[max(0, at - 50) : at] if b[4] > 0]
    dist = [k for k in range(1, 6) if at + k < len(line) and line[at + k - 1][4] > 0 and (line[at + k][3] / line[at + k - 1][3] - 1) * 100 <= -0.2 and line[at + k][4] > line[at + k - 1][4]]
    return out | {"date": line[at][0], "heavy": bool(usual) and line[at][4] > sum(usual) / len(usual), "watched": min(5, len(line) - 1 - at), "dist": dist}


def plain_market(a: dict, b: dict) -> dict:
    held = [x["state"] == "FTD_CONFIRMED" for x in (a, b)]
    state = "FTD_CONFIRMED" if any(held) else next(p for p in PRIORITY if p in (a["state"], b["state"]))
    index = "both" if all(held) else "first" if held[0] else "second" if held[1] else None
    if state == "FTD_INVALIDATED":
        index = "first" if a["state"] == state else "second"
    of = next((x for x in (a, b) if x["found"]), None)
    quality, signal, exposure, reviewed = 0, "No FTD", "0-25%", state
    if of and of["state"] == "FTD_INVALIDATED":
        signal, reviewed = "Failed/Invalidated", "FTD_INVALIDATED"
    elif of:
        quality = 60 if of["day"] <= 7 else 50
        quality += 15 if of["gain"] >= 2 else 10 if of["gain"] >= 1.5 else 5
        quality += 10 * of["heavy"] + 15 * all(held)
        if of["watched"]:
            quality += 10 if not of["dist"] else -30 if of["dist"][0] <= 2 else -15 if of["dist"][0] == 3 else -5
        quality = max(0, min(100, quality - 20 * (len(of["dist"]) >= 2)))
        signal, exposure = ("Strong FTD", "75-100%") if quality >= 80 else ("Moderate FTD", "50-75%") if quality >= 60 else ("Weak FTD", "25-50%") if quality >= 40 else ("Failed/Weak", "0-25%")
    return {"first_state": a["state"], "second_state": b["state"], "state": state, "dual": all(held), "ftd_index": index, "reviewed": reviewed, "quality": quality, "signal": signal, "exposure": exposure}


def test_weeks_of_two_indices_by_plain_rules(spark):
    rng = np.random.default_rng(11)
    lines, rows = {}, []
    for symbol in "ABCDEFGH":
        close = (100 * np.exp(np.cumsum(rng.normal(0, 0.013, 330)))).tolist()
        days = [i for i in range(330) if i % 7 < 5 and rng.random() > 0.04 and not (symbol == "B" and i > 250)]
        lines[symbol] = [(DAY + timedelta(i), close[i] * 1.006, close[i] * 0.994, close[i], float(rng.integers(0, 40) * 10)) for i in days]
        rows += [(symbol, *b, "clash") for b in lines[symbol]]
    rows += [("A", DAY, None, 1.0, 1.0, 1.0, "x"), (None, DAY, 1.0, 1.0, 1.0, 1.0, "x")]
    bars = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double, volume double, week string")
    weekly = {(r["symbol"], r["week"]): r for r in rallies.weekly_rallies(bars).collect()}
    want: dict[tuple, dict] = {}
    for symbol, line in lines.items():
        for i, b in enumerate(line):
            week = b[0] - timedelta(b[0].weekday())
            if i + 1 == len(line) or line[i + 1][0] - timedelta(line[i + 1][0].weekday()) != week:
                want[symbol, week] = plain_state(line[: i + 1])
    assert weekly.keys() == want.keys()
    for key, w in want.items():
        r = weekly[key]
        assert (r["state"], r["ftd_date"], r["monitored"], r["distributions"], r["earliest"]) == (w["state"], w.get("date"), w.get("watched", 0), len(w.get("dist", [])), next(iter(w.get("dist", [])), None)), key
    pairs = [("m1", "A", "B"), ("m2", "C", "D"), ("m3", "E", "F"), ("m4", "G", "H"), ("m5", "B", "none"), ("m6", None, "C"), ("m7", "none", None), ("m1", "A", "B")]
    got = rallies.market_states(rallies.weekly_rallies(bars), spark.createDataFrame(pairs, "market string, first string, second string")).collect()
    nothing, found = {"state": "NO_SIGNAL", "found": False}, {(r["market"], r["week"]): r for r in got}
    assert len(found) == len(got)
    expected = {(m, week): plain_market(want.get((a, week), nothing), want.get((b, week), nothing)) for m, a, b in set(pairs) for s, week in want if s in (a, b)}
    assert found.keys() == expected.keys()
    for key, e in expected.items():
        assert {c: found[key][c] for c in e} == e, key
    assert {"FTD_CONFIRMED", "FTD_INVALIDATED", "FTD_WINDOW", "RALLY_ATTEMPT", "CORRECTION"} <= {r["state"] for r in got}
    assert {"No FTD", "Failed/Invalidated", "Strong FTD", "Moderate FTD"} <= {r["signal"] for r in got}
    assert any(r["dual"] for r in got) and {"first", "second", "both", None} == {r["ftd_index"] for r in got}
    assert rallies.weekly_rallies(bars.limit(0)).count() == 0


def test_follow_up_by_hand():
    """A fall, then a rise: day 5 follows through, the second day after it is sold on volume above its low, a newer swing low."""
    close = np.array([100, 101, 102, 103, 104, 102, 100, 98, 96, 94, 94.5, 95, 95.2, 95.4, 97.5, 98, 97.6, 98, 99])
    volume = np.array([100.0] * 14 + [150, 140, 160, 100, 100])
    days = np.array([DAY + timedelta(i) for i in range(len(close))])
    got = rallies.follow_up(days, close * 1.002, close * 0.998, close, volume)
    assert got["state"] == "FTD_CONFIRMED" and got["ftd_date"] == days[14] and got["volume_above"] is True
    assert (got["monitored"], got["distributions"], got["earliest"]) == (4, 1, 2)
