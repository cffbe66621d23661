"""Ordered folds: work whose state depends on the step before. One numpy function per fold, run per key by Spark.

FOLDS names each fold with its output columns, so that a job can choose one by name; groups are one symbol's bars.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tapeworks.operators import contraction


def ema(x: np.ndarray, n: int, seed_first: bool = False) -> np.ndarray:
    """Exponential mean: seeded with the mean of the first n values (plain running mean before), or with the first."""
    a = 2.0 / (n + 1)
    out = np.empty(len(x))
    if seed_first or len(x) < n:
        start, value = 0, x[0] if len(x) else np.nan
        if not seed_first:
            return np.cumsum(x) / np.arange(1, len(x) + 1)
    else:
        out[: n - 1] = np.cumsum(x[: n - 1]) / np.arange(1, n)
        start, value = n - 1, x[:n].mean()
    for i in range(start, len(x)):
        value = value if i == start else a * x[i] + (1 - a) * value
        out[i] = value
    return out


def rsi(x: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's index; 100 where no change was negative; nan before n changes."""
    out = np.full(len(x), np.nan)
    d = np.diff(x)
    if len(d) < n:
        return out
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    g, b = up[:n].mean(), down[:n].mean()
    for i in range(n, len(d) + 1):
        if i > n:
            g, b = (g * (n - 1) + up[i - 1]) / n, (b * (n - 1) + down[i - 1]) / n
        out[i] = 100.0 if b == 0 else 100 - 100 / (1 + g / b)
    return out


def _arrays(g: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(g[x].to_numpy(float) for x in ("open", "high", "low", "close", "volume"))


def fold_indicators(g: pd.DataFrame) -> pd.DataFrame:
    """Exponential means of both seeds and the relative strength index of every bar."""
    c = g["close"].to_numpy(float)
    return pd.DataFrame({"symbol": g["symbol"], "date": g["date"], "ema21": ema(c, 21), "ema10_first": ema(c, 10, True), "rsi14": rsi(c, 14)})


def _as_of(g: pd.DataFrame, end: int, limits: contraction.Limits) -> dict:
    """The pattern of the bars before row `end`, with dates for the window's bars."""
    _, h, low, c, v = (x[max(0, end - limits.window) : end] for x in _arrays(g))
    days = g["date"].to_numpy()[max(0, end - limits.window) : end]
    found = contraction.detect(h, low, c, v, limits)
    chain = [{"high_date": days[x["high_at"]], "low_date": days[x["low_at"]], **{k: x[k] for k in ("high", "low", "depth_pct", "bars", "volume")}} for x in found.pop("chain")]
    first, last = (None if found[k] is None else days[found[k]] for k in ("first_high_at", "last_low_at"))
    return {"symbol": g["symbol"].iat[0], "date": days[-1], **found, "first_high_date": first, "last_low_date": last, "chain": chain}


def fold_swings(g: pd.DataFrame) -> pd.DataFrame:
    """Confirmed turning points of the last 120 bars."""
    limits = contraction.Limits()
    _, h, low, c, _ = (x[-limits.window :] for x in _arrays(g))
    days = g["date"].to_numpy()[-limits.window :]
    turns = contraction.turning_points(h, low, limits.swing_ranges * contraction.mean_range(h, low, c, limits.range_bars), limits.range_bars)
    rows = [{"symbol": g["symbol"].iat[0], "date": days[i], "kind": "high" if s > 0 else "low", "price": float(h[i] if s > 0 else low[i])} for i, s in turns]
    return pd.DataFrame(rows, columns=["symbol", "date", "kind", "price"])


def fold_vcp(g: pd.DataFrame) -> pd.DataFrame:
    """Contraction pattern of the last 120 bars, by the detector's own limits."""
    return pd.DataFrame([_as_of(g, len(g), contraction.Limits())])[PATTERN_COLUMNS]


def fold_vcp_screen(g: pd.DataFrame) -> pd.DataFrame:
    """The same by the screen's stricter limits."""
    return pd.DataFrame([_as_of(g, len(g), contraction.SCREEN)])[PATTERN_COLUMNS]


def fold_cursors(g: pd.DataFrame) -> pd.DataFrame:
    """Valid patterns at the rows marked `cursor` of a stretch of one symbol, each from its own 120 bars up to there; only
    those rows' patterns whose window lies in the stretch are asked for."""
    rows = [_as_of(g, i + 1, contraction.SCREEN) | {"bar": int(g["bar"].iat[i])} for i in np.flatnonzero(g["cursor"].to_numpy(bool)).tolist()]
    rows = [r for r in rows if r["valid"]]
    return pd.DataFrame(rows, columns=[*PATTERN_COLUMNS, "bar"])


# A swing low's least fall in % and down days, a follow-through's days, least gain in % and tiers.
RALLY = {"fall": 3.0, "down_days": 3, "first": 4, "last": 10, "gain": 1.25, "recommended": 1.5, "strong": 2.0}


def swing_lows(c: np.ndarray, most: int = 6) -> list[int]:
    """Latest lows first: a close no neighbour undercuts, 3 % below the highest of 40 closes, with three down days since."""
    found = []
    for i in range(len(c) - 1, 3, -1):
        before = c[max(0, i - 40) : i]
        top = max(0, i - 40) + int(np.argmax(before))
        beside = (c[i - 1] > 0 and c[i - 1] < c[i]) or (i + 1 < len(c) and 0 < c[i + 1] < c[i])
        if c[i] > 0 and c[top] > 0 and (c[i] / c[top] - 1) * 100 <= -RALLY["fall"] and int((np.diff(c[top : i + 1]) < 0).sum()) >= RALLY["down_days"] and not beside:
            found.append(i)
            if len(found) == most:
                break
    return found


def rally_attempt(h: np.ndarray, low: np.ndarray, c: np.ndarray, at: int) -> tuple[bool, int, int]:
    """(failed, first day's index or -1, days so far) of the attempt after a swing low.

    It fails on a close below the swing low's, or on day 2 or 3 below the first day's low."""
    i = np.arange(at + 1, len(c))
    under = i[c[i] < c[at]]
    start = i[(c[i] > c[i - 1]) | ((h[i] > low[i]) & (c[i] - low[i] >= 0.5 * (h[i] - low[i])))]
    if not len(start) or (len(under) and under[0] <= start[0]):
        return bool(len(under)), -1, 0
    one = int(start[0])
    early = np.arange(one + 1, min(one + 3, len(c)))
    return bool(len(under)) or bool((c[early] < low[one]).any()), one, len(c) - one


def follow_through(c: np.ndarray, v: np.ndarray, one: int) -> tuple[int, float]:
    """(index, gain in %) of the first strong day on rising volume on days 4 to 10 of an attempt, or (-1, 0)."""
    for k in range(one + RALLY["first"] - 1, min(one + RALLY["last"], len(c))):
        gain = round((c[k] / c[k - 1] - 1) * 100, 2) if c[k - 1] > 0 else 0.0
        if gain >= RALLY["gain"] and v[k] > v[k - 1] > 0:
            return k, gain
    return -1, 0.0


def rally_state(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray) -> dict:
    """State of up to 60 bars, the attempt's day and the follow-through day with its gain and tier.

    The latest swing low decides; without a follow-through there, older ones may hold one: confirmed while no later close
    is below its low, and the search ends at the first that was undercut."""
    out = {"state": "NO_SIGNAL", "rally_day": 0, "ftd_day": -1, "gain": 0.0, "tier": None}
    lows = swing_lows(c) if len(c) >= 10 else []
    for k, at in enumerate(lows):
        failed, one, days = rally_attempt(h, low, c, at)
        ftd, gain = follow_through(c, v, one) if one >= 0 and not failed and days >= RALLY["first"] else (-1, 0.0)
        held = ftd >= 0 and not (c[ftd + 1 :] < low[ftd]).any()
        if k == 0:
            state = "CORRECTION" if one < 0 else "RALLY_ATTEMPT" if days < RALLY["first"] else "RALLY_FAILED" if days > RALLY["last"] else "FTD_WINDOW"
            out["state"], out["rally_day"] = "RALLY_FAILED" if failed else state, days
        if ftd < 0:
            continue
        if held or k == 0 or out["state"] not in ("RALLY_ATTEMPT", "FTD_WINDOW"):
            tier = "strong" if gain >= RALLY["strong"] else "recommended" if gain >= RALLY["recommended"] else "minimum"
            out = {"state": "FTD_CONFIRMED" if held else "FTD_INVALIDATED", "rally_day": days, "ftd_day": ftd - one + 1, "gain": gain, "tier": tier}
        break
    return out


def fold_rally(g: pd.DataFrame) -> pd.DataFrame:
    """Rally state of the last 60 bars."""
    _, h, low, c, v = (x[-60:] for x in _arrays(g))
    return pd.DataFrame([{"symbol": g["symbol"].iat[0], **rally_state(h, low, c, v)}])


def fold_mean_reversion(g: pd.DataFrame, low_rsi: float = 35, high_rsi: float = 55, stop: float = 0.92, bars: int = 15) -> pd.DataFrame:
    """Trades that buy a low index and sell at a high one, at the stop (named first) or after `bars`."""
    c = g["close"].to_numpy(float)
    index, at, rows = rsi(c), -1, []
    for i in range(len(c)):
        if np.isnan(index[i]):
            continue
        if at < 0:
            at = i if index[i] < low_rsi else -1
            continue
        why = "stop" if c[i] <= c[at] * stop else "target" if index[i] > high_rsi else "time" if i - at >= bars else ""
        if why:
            rows.append({"symbol": g["symbol"].iat[0], "entry": g["date"].iat[at], "exit": g["date"].iat[i], "ret": c[i] / c[at] - 1, "reason": why})
            at = -1
    return pd.DataFrame(rows, columns=["symbol", "entry", "exit", "ret", "reason"])


# Cadences by the median gap in days with pays a year and usual days, words of a special pay, multiples of
# the trailing median, and the limits of policy flags.
CADENCES = ((45, "monthly", 12), (135, "quarterly", 4), (240, "semiannual", 2), (450, "annual", 1))
CADENCE_DAYS = {"monthly": 30, "quarterly": 91, "semiannual": 182}
SPECIAL_WORDS = ("special", "supplemental", "one-time", "one time", "extra")
DIVIDEND = {"extreme": 3.0, "outlier": 1.5, "revert": 1.2, "variable": 0.35, "equal": 0.005, "grace": 45, "least": 4}


def cadence(days: np.ndarray) -> tuple[str, int]:
    """(name, pays a year) from the pay days; irregular where three or more gaps spread over 0.6 of their median."""
    gaps = np.diff(days)
    gaps = gaps[gaps > 0]
    if not len(gaps):
        return "irregular", 0
    middle = float(np.median(gaps))
    name, pays = next(((n, p) for most, n, p in CADENCES if middle <= most), ("irregular", 1))
    return ("irregular" if len(gaps) >= 3 and gaps.std() > middle * 0.6 else name), pays


def special_pays(x: np.ndarray, named: np.ndarray, pays: int) -> np.ndarray:
    """Pays named special, and those far above the median of the regular ones before: at once from three times on, from
    one and a half times on if one of the next two falls back. Order matters: a special pay is no part of later medians."""
    special = named.copy()
    for i in np.flatnonzero(~named):
        near = np.arange(max(0, i - max(pays or 4, 8)), i)
        regular = x[near][~special[near]]
        middle = float(np.median(regular)) if len(regular) >= DIVIDEND["least"] else 0.0
        after = np.arange(i + 1, min(i + 3, len(x)))
        back = bool((x[after][~named[after]] <= DIVIDEND["revert"] * middle).any())
        special[i] = middle > 0 and (x[i] > DIVIDEND["extreme"] * middle or (x[i] > DIVIDEND["outlier"] * middle and back))
    return special


def dividend_basis(days: np.ndarray, x: np.ndarray, named: np.ndarray, as_of: int | None = None) -> dict:
    """Basis of one payer's positive pays in order of days (days as numbers)."""
    name, pays = cadence(days)
    special = special_pays(x, named, pays)
    r, rd = x[~special], days[~special]
    out = {"status": "OK", "cadence": name, "pays_per_year": pays, "specials": int(special.sum()), "annualized": None, "regular_ttm": None, "ttm": None, "variable": False, "cut": False, "frozen": False, "suspended": False}
    if len(r) < DIVIDEND["least"]:
        return out | {"status": "ASSUMPTION-REQUIRED"}
    year = days[-1] - 366
    window = r[-max(pays or 4, 8) :]
    raised = np.flatnonzero(np.diff(r) > DIVIDEND["equal"]) + 1
    usual = CADENCE_DAYS.get(name, 365)
    if pays and len(r) > pays:
        move = r[-1] - r[-1 - pays]
        since = rd[-1] - rd[raised[-1]] if len(raised) else 10_000
        out["cut"] = bool(move < -DIVIDEND["equal"])
        out["frozen"] = bool(abs(move) <= DIVIDEND["equal"] and since > usual + DIVIDEND["grace"])
    out["variable"] = bool(window.mean() > 0 and window.std() / window.mean() > DIVIDEND["variable"])
    out["suspended"] = as_of is not None and bool(as_of - rd[-1] > usual + DIVIDEND["grace"])
    return out | {"annualized": round(float(r[-1]) * pays, 4) if pays else None, "regular_ttm": round(float(r[rd > year].sum()), 4), "ttm": round(float(x[days > year].sum()), 4)}


def fold_dividends(g: pd.DataFrame) -> pd.DataFrame:
    """Dividend basis of each payer; a column label, if any, names special pays, a column as_of the day that tells a
    suspension (its latest value)."""
    g = g[g["dividend"] > 0].sort_values("date")
    days = pd.to_datetime(g["date"]).to_numpy().astype("datetime64[D]").astype(int)
    label = g["label"].fillna("").str.lower() if "label" in g.columns else pd.Series([""] * len(g))
    named = np.array([any(w in t for w in SPECIAL_WORDS) for t in label], bool)
    day = g["as_of"].dropna().max() if "as_of" in g.columns and len(g) else None
    as_of = None if day is None or pd.isna(day) else int(np.datetime64(day, "D").astype(int))
    found = dividend_basis(days, g["dividend"].to_numpy(float), named, as_of) if len(g) else {"status": "NO-DIVIDEND"}
    names = [c.split()[0] for c in FOLDS["dividends"][2].split(", ")]
    return pd.DataFrame([{"symbol": g["symbol"].iat[0] if len(g) else None, **found}], columns=names)


PATTERN = "symbol string, date date, valid boolean, score long, contractions long, pivot double, last_low double, last_depth double, range_compression double, wide boolean, right_side double, volume_declining boolean, first_high_date date, last_low_date date, chain array<struct<high_date: date, low_date: date, high: double, low: double, depth_pct: double, bars: long, volume: long>>"
PATTERN_COLUMNS = [c.split()[0] for c in PATTERN.split(", chain")[0].split(", ")] + ["chain"]

FOLDS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str, str]] = {
    "indicators": (fold_indicators, "symbol", "symbol string, date date, ema21 double, ema10_first double, rsi14 double"),
    "swings": (fold_swings, "symbol", "symbol string, date date, kind string, price double"),
    "vcp": (fold_vcp, "symbol", PATTERN),
    "vcp_screen": (fold_vcp_screen, "symbol", PATTERN),
    "cursors": (fold_cursors, "symbol, stretch", PATTERN + ", bar long"),
    "rally": (fold_rally, "symbol", "symbol string, state string, rally_day long, ftd_day long, gain double, tier string"),
    "mean_reversion": (fold_mean_reversion, "symbol", "symbol string, entry date, exit date, ret double, reason string"),
    "dividends": (fold_dividends, "symbol", "symbol string, status string, cadence string, pays_per_year long, specials long, annualized double, regular_ttm double, ttm double, variable boolean, cut boolean, frozen boolean, suspended boolean"),
}


def fold(rows: DataFrame, name: str) -> DataFrame:
    """One registered fold over each key's rows, in date order where there is a date."""
    run, key, schema = FOLDS[name]

    def ordered(g: pd.DataFrame) -> pd.DataFrame:
        return run(g.sort_values("date", ignore_index=True) if "date" in g.columns else g)

    return rows.groupBy(*key.split(", ")).applyInPandas(ordered, schema)
