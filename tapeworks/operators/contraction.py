"""Contraction patterns of one window of bars: confirmed turning points, chains of pullbacks, their verdict and measures.

All of it works on numpy arrays of some hundred bars; Spark decides which windows exist and where they are worked on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Limits of a pattern, its scores by the number of pullbacks, and the additions and deductions.
MOST_PULLBACKS, STARTS, SHOULDER_PCT, LEAST_SPAN = 4, 3, 5.0, 15
SCORES = {2: 60, 3: 80, 4: 90}
TIGHT_PCT, TIGHT_BONUS, SHRINK_MEAN, SHRINK_BONUS, DEEP_PCT, DEEP_LOSS = 5.0, 10, 0.4, 10, 30.0, 10
INVALID_EACH, INVALID_MOST, LOOSE_BARS = 15, 40, 10


@dataclass(frozen=True)
class Limits:
    """What a screen may set: the stricter depth and ratio are the screen's, 8.0 and 0.75 the detector's own."""

    window: int = 120
    swing_ranges: float = 1.5
    range_bars: int = 14
    least_bars: int = 5
    least_pullbacks: int = 2
    first_depth: float = 8.0
    ratio: float = 0.75
    loose_depth: float = 15.0


SCREEN = Limits(first_depth=10.0, ratio=0.70)


def mean_range(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> float:
    """Mean of the last n true ranges; 0 with fewer than n + 1 bars."""
    if len(c) < n + 1:
        return 0.0
    before = c[-n - 1 : -1]
    return float(np.maximum(h[-n:] - low[-n:], np.maximum(np.abs(h[-n:] - before), np.abs(low[-n:] - before))).mean())


def turning_points(h: np.ndarray, low: np.ndarray, step: float, lead: int) -> list[tuple[int, int]]:
    """(bar, 1 for a high or -1 for a low) of every turn that a move of step or more against it has confirmed.

    Leg by leg: a leg starts where the turn before was confirmed (the first one at the highest of the lead bars), and ends
    at the first bar that sets no new extreme and is step away from the extreme so far. The extreme of a leg that never
    ends is no turn.
    """
    if step <= 0 or not len(h):
        return []
    found, at, side = [], int(np.argmax(h[:lead])), 1
    while True:
        along, against = (h, low) if side > 0 else (-low, -h)
        extreme = np.maximum.accumulate(along[at:])[:-1]
        ends = np.flatnonzero((along[at + 1 :] <= extreme) & (extreme - against[at + 1 :] >= step))
        if not len(ends):
            return found
        end = at + 1 + int(ends[0])
        found.append((at + int(np.argmax(along[at:end])), side))
        at, side = end, -side


def window_swings(x: np.ndarray, n: int = 5) -> np.ndarray:
    """Bars strictly above the n bars on both sides."""
    if len(x) < 2 * n + 1:
        return np.zeros(0, int)
    near = np.lib.stride_tricks.sliding_window_view(x, 2 * n + 1)
    return np.flatnonzero((near[:, [n]] > np.delete(near, n, axis=1)).all(1)) + n


def swings(h: np.ndarray, low: np.ndarray, c: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bars of the swing highs and lows: confirmed turns, or where either kind is missing those of the fixed window."""
    turns = turning_points(h, low, limits.swing_ranges * mean_range(h, low, c, limits.range_bars), limits.range_bars)
    tops, bottoms = (np.array([i for i, s in turns if s == side], int) for side in (1, -1))
    return (tops, bottoms) if len(tops) and len(bottoms) else (window_swings(h), window_swings(-low))


def pullbacks(start: int, tops: np.ndarray, bottoms: np.ndarray, h: np.ndarray, least_bars: int) -> list[tuple[int, int]]:
    """(high bar, low bar) of up to four pullbacks in turn from a swing high.

    A pullback ends at the next swing low, or if that is too near at the first one far enough, unless a swing high lies
    before it. The next starts at the swing high after that low, if it is within 5 % of the first.
    """
    found: list[tuple[int, int]] = []
    at = start
    while len(found) < MOST_PULLBACKS and abs(h[at] - h[start]) <= h[start] * SHOULDER_PCT / 100:
        after = tops[tops > at]
        far = bottoms[bottoms >= at + least_bars]
        early = ((bottoms > at) & (bottoms < at + least_bars)).any()
        if not len(far) or (early and len(after) and far[0] > after[0]):
            break
        found.append((at, int(far[0])))
        after = tops[tops > far[0]]
        if not len(after):
            break
        at = int(after[0])
    return found


def cents(x: float) -> float:
    """Two decimals, half of a scaled value to even, as round_even in SQL."""
    return float(np.round(x, 2))


def mills(x: float) -> float:
    """Three decimals, half of a scaled value up, as round in SQL."""
    return float(np.floor(x * 1000 + 0.5) / 1000)


def verdict(depths: list[float], span: int, limits: Limits) -> tuple[bool, int]:
    """(valid, score) of a chain by its depths in %."""
    shrink = [b / a for a, b in zip(depths, depths[1:], strict=False) if a > 0]
    if len(depths) < limits.least_pullbacks:
        return False, 0
    if depths[0] < limits.first_depth or span < LEAST_SPAN or any(r > limits.ratio for r in shrink):
        return False, min(INVALID_MOST, INVALID_EACH * len(depths))
    score = SCORES.get(len(depths), 20) + TIGHT_BONUS * (depths[-1] < TIGHT_PCT)
    shrink = [mills(r) for r in shrink]
    score += SHRINK_BONUS * bool(shrink and sum(shrink) / len(shrink) < SHRINK_MEAN) - DEEP_LOSS * (depths[0] > DEEP_PCT)
    return True, max(0, min(100, score))


EMPTY = {"valid": False, "score": 0, "contractions": 0, "pivot": None, "last_low": None, "last_depth": None, "first_high_at": None, "last_low_at": None, "range_compression": None, "wide": False, "right_side": None, "volume_declining": False, "chain": []}


def detect(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, limits: Limits = Limits()) -> dict:  # noqa: B008
    """The best pattern of the window's end: verdict, pivot, last low, measures, and the chain of pullbacks with bars of
    the window, prices, depth in %, length and mean volume.

    Fewer than 30 bars or no swings give the empty pattern. Chains start at the three highest swing highs; a valid one comes
    first, then the higher score, then the longer one, then the higher start.
    """
    h, low, c, v = (x[-limits.window :] for x in (h, low, c, v))
    if len(c) < 30:
        return dict(EMPTY)
    tops, bottoms = swings(h, low, c, limits)
    if not len(tops) or not len(bottoms):
        return dict(EMPTY)
    best: tuple | None = None
    for start in tops[np.argsort(-h[tops], kind="stable")][:STARTS].tolist():
        chain = pullbacks(start, tops, bottoms, h, limits.least_bars)
        depths = [cents((h[a] - low[b]) / h[a] * 100) if h[a] > 0 else 0.0 for a, b in chain]
        valid, score = verdict(depths, chain[-1][1] - chain[0][0] if chain else 0, limits)
        if best is None or (valid, score, len(chain)) > best[0]:
            best = ((valid, score, len(chain)), chain, depths)
    (valid, score, many), chain, depths = best
    short, long = mean_range(h, low, c, 10), mean_range(h, low, c, 50)
    out = dict(EMPTY, valid=valid, score=score, contractions=many, pivot=cents(h[chain[-1][0]]) if chain else float(h[tops[-1]]), range_compression=mills(short / long) if short > 0 and long > 0 else None)
    if chain:
        volumes = [int(v[a : b + 1].mean()) for a, b in chain]
        out["chain"] = [{"high_at": a, "low_at": b, "high": cents(h[a]), "low": cents(low[b]), "depth_pct": d, "bars": b - a, "volume": m} for (a, b), d, m in zip(chain, depths, volumes, strict=True)]
        out |= {"last_low": out["chain"][-1]["low"], "last_depth": depths[-1], "first_high_at": chain[0][0], "last_low_at": chain[-1][1], "volume_declining": many > 1 and all(x > y for x, y in zip(volumes, volumes[1:], strict=False))}
    if many >= limits.least_pullbacks:
        out["wide"] = depths[-1] > limits.loose_depth and chain[-1][1] - chain[-1][0] < LOOSE_BARS
        out["right_side"] = mills(float(h[-15:].max() - low[-15:].min()) / long) if long > 0 else None
    return out
