"""Short-sale trigger machines over a session's five-minute bars: each is a small table from phase to rule.

A machine's state is a plain dict of fixed fields, so that a batch fold and a stream's stored state are the same thing.
Terminal and unknown phases have no rule. Every bar first moves what all machines share: extremes, mean price, count.
"""

from __future__ import annotations

from collections.abc import Callable

# The volume that confirms an opening-range break, the entry's distance below the broken low, and the stop's
# distance above the session's high in daily true ranges.
ORL_VOLUME, ENTRY_BELOW, STOP_RANGES = 1.2, 0.05, 0.25

#: Fields of a state with their types; `at` is the last bar's time, mark_* what a phase remembers of an earlier bar.
FIELDS = {
    "at": "string", "phase": "string", "n": "long", "pv": "double", "v": "double", "high": "double", "low": "double", "mark_low": "double", "mark_high": "double", "mark_v": "double",
    "armed_at": "string", "triggered_at": "string", "invalidated_at": "string", "reason": "string", "entry": "double", "stop": "double", "skip_reason": "string",
}
STATE = ", ".join(f"{k} {t}" for k, t in FIELDS.items())


def fresh() -> dict:
    return dict.fromkeys(FIELDS) | {"at": "", "phase": "armed", "n": 0, "pv": 0.0, "v": 0.0}


class Bar:
    """A bar with what the session knew when it closed: mean price (vwap), extremes, and the highest high before it."""

    __slots__ = ("at", "before", "c", "h", "low", "o", "v", "vwap")

    def __init__(self, at: str, o: float, h: float, low: float, c: float, v: float):
        self.at, self.o, self.h, self.low, self.c, self.v = at, o, h, low, c, v
        self.vwap, self.before = c, h


def _trigger(s: dict, bar: Bar, entry: float, stop: float) -> None:
    s |= {"phase": "triggered", "triggered_at": bar.at, "entry": round(entry - ENTRY_BELOW, 4), "stop": round(stop, 4)}


def _invalidate(s: dict, bar: Bar, reason: str) -> None:
    s |= {"phase": "invalidated", "invalidated_at": bar.at, "reason": reason}


def _orl_armed(s: dict, bar: Bar, atr: float | None) -> None:
    if s["n"] == 0:
        s |= {"mark_low": bar.low, "mark_high": bar.h, "mark_v": bar.v}
    elif bar.c < s["mark_low"] and bar.v >= ORL_VOLUME * s["mark_v"]:
        _trigger(s, bar, bar.c, s["high"] + STOP_RANGES * atr)


def _orl_triggered(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.c > s["mark_low"] and bar.c > bar.vwap:
        _invalidate(s, bar, "post_trigger_close_reclaimed_orl_and_vwap")


def _red_armed(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.c < bar.o:
        s |= {"phase": "red_marked", "mark_low": bar.low, "mark_high": bar.h}


def _red_marked(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.h > s["mark_high"]:  # wins over a break of the low on the same bar
        _invalidate(s, bar, "red_high_taken_out")
    elif bar.low < s["mark_low"]:
        _trigger(s, bar, s["mark_low"], s["mark_high"])


def _red_triggered(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.h > s["mark_high"]:
        _invalidate(s, bar, "post_trigger_red_high_taken_out")


def _fail_armed(s: dict, bar: Bar, atr: float | None) -> None:
    if s["n"] and bar.c < bar.vwap and bar.before > bar.c:
        s["phase"] = "first_crack_seen"


def _fail_cracked(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.c >= bar.vwap:
        s |= {"phase": "vwap_retest_seen", "mark_high": bar.h}


def _fail_retested(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.h < s["mark_high"] and bar.c < bar.vwap:
        s |= {"phase": "rejection_confirmed", "mark_low": bar.low}


def _fail_rejected(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.low < s["mark_low"]:
        _trigger(s, bar, s["mark_low"], s["mark_high"])


def _fail_triggered(s: dict, bar: Bar, atr: float | None) -> None:
    if bar.c > bar.vwap:
        _invalidate(s, bar, "post_trigger_close_above_vwap")


MACHINES: dict[str, dict[str, Callable[[dict, Bar, float | None], None]]] = {
    "orl": {"armed": _orl_armed, "triggered": _orl_triggered},
    "first_red": {"armed": _red_armed, "red_marked": _red_marked, "triggered": _red_triggered},
    "vwap_fail": {"armed": _fail_armed, "first_crack_seen": _fail_cracked, "vwap_retest_seen": _fail_retested, "rejection_confirmed": _fail_rejected, "triggered": _fail_triggered},
}


def step(s: dict, bar: Bar, kind: str, atr: float | None) -> None:
    """Move a state by one bar, in place."""
    s["pv"] += bar.c * bar.v
    s["v"] += bar.v
    bar.vwap = s["pv"] / s["v"] if s["v"] > 0 else bar.c
    bar.before = bar.h if s["high"] is None else s["high"]
    s["high"] = bar.h if s["high"] is None else max(s["high"], bar.h)
    s["low"] = bar.low if s["low"] is None else min(s["low"], bar.low)
    if s["n"] == 0:
        s["armed_at"] = bar.at
    rule = None if s["skip_reason"] else MACHINES[kind].get(s["phase"])
    if rule:
        rule(s, bar, atr)
    s["n"] += 1
    s["at"] = bar.at
