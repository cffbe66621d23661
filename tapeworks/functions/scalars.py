"""Scalar building blocks: Column -> Column, with thresholds as parameters. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x held between lo and hi; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def part(x: Column, by: float) -> Column:
    """x / by held between 0 and 1, null as 0."""
    return F.coalesce(clamp(x / F.lit(by), 0.0, 1.0), F.lit(0.0))


def linear_score(x: Column, lo: float, hi: float) -> Column:
    """[lo, hi] to [0, 100], clamped; null gives 0."""
    return F.coalesce(clamp((x - F.lit(lo)) / F.lit(hi - lo) * 100, 0.0, 100.0), F.lit(0.0))


def step_score(x: Column, ladder: Sequence[tuple[float, float]], below: float, null: float | None = None) -> Column:
    """Score of the first (threshold, score) with x >= threshold; `below` under all, `null` for null."""
    out = F.when(x.isNull(), F.lit(null).cast("double"))
    for threshold, score in ladder:
        out = out.when(x >= F.lit(threshold), F.lit(float(score)))
    return out.otherwise(F.lit(float(below)))


def interpolated(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear through the points, flat outside."""
    (x0, y0), out = points[0], None
    out = F.when(x <= x0, F.lit(float(y0)))
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, F.lit(float(ya)) + (x - a) / (b - a) * (yb - ya))
    return out.otherwise(F.when(x.isNotNull(), F.lit(float(points[-1][1]))))


def industry_momentum(x: Column) -> Column:
    """Sigmoid of a move's size around 5 %."""
    return 100 / (1 + F.exp(-0.15 * (F.abs(x) - 5)))


def theme_momentum(x: Column) -> Column:
    """Sigmoid of the logarithm of a move's size around 15 %."""
    return 100 / (1 + F.exp(-2.0 * (F.log(1 + F.abs(x)) - F.log(F.lit(16.0)))))


def log10_liquidity(adv: Column) -> Column:
    """log10 of dollar volume from [7, 8.5] to [0, 10]; 0 without volume."""
    return F.when(adv > 0, clamp((F.log10(adv) - 7) / 1.5 * 10, 0.0, 10.0)).otherwise(0.0)


def cagr(start: Column, end: Column, years: float) -> Column:
    """Yearly growth in %, two decimals; null if a value or the years are not positive."""
    return F.when((start > 0) & (end > 0) & F.lit(years > 0), F.round((F.pow(end / start, F.lit(1.0 / years)) - 1) * 100, 2))


#: Words for the time of day of an earnings report.
BEFORE_OPEN = ("bmo", "pre-market", "before market open")
AFTER_CLOSE = ("amc", "after-market", "after market close")


def normalize_timing(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*BEFORE_OPEN), "bmo").when(t.isin(*AFTER_CLOSE), "amc").otherwise("unknown")


#: Words for the side of a signal.
LONG_WORDS = ("long", "bull", "bullish", "buy", "accumulation", "increase", "up")
SHORT_WORDS = ("short", "bear", "bearish", "sell", "distribution", "decrease", "down")


def normalize_direction(text: Column, default: str = "NEUTRAL") -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*LONG_WORDS), "LONG").when(t.isin(*SHORT_WORDS), "SHORT").otherwise(default)


#: Letter grades as scores.
GRADES = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "F": 0.2}


def normalize_score(text: Column) -> Column:
    """0-1, 0-100 or a letter grade to 0-1; anything else, and null, gives 0."""
    x = text.try_cast("double")
    out = F.when(x < 0, 0.0).when(x <= 1, x).when(x <= 100, x / 100).when(x.isNotNull(), 1.0)
    for grade, score in GRADES.items():
        out = out.when(F.upper(text) == grade, score)
    return out.otherwise(0.0)


def horizon_bucket(text: Column) -> Column:
    """A horizon to short, medium, long or unknown: a number with D, W (short up to 12), M (short up to 3, medium up to
    6) or Y, else the first phrase that occurs."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)\s*[dwmy]$", 1).try_cast("int")
    unit = F.regexp_extract(t, r"^\d+\s*([dwmy])$", 1)
    out = F.when(unit == "d", "short").when(unit == "w", F.when(n <= 12, "short").otherwise("medium")).when(unit == "m", F.when(n <= 3, "short").when(n <= 6, "medium").otherwise("long")).when(unit == "y", "long")
    return out.when(t.rlike("day|week|1-3 months|1-2 months|short"), "short").when(t.rlike("3-6 months|6 months|3 months|medium"), "medium").when(t.rlike("6-12 months|12 months|year|long"), "long").otherwise("unknown")


def horizons_overlap(a: Column, b: Column) -> Column:
    return (a == b) | (a == "unknown") | (b == "unknown")


def ticker_array(text: Column) -> Column:
    """Comma text to sorted distinct upper-case symbols."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct values; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared values over the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def first_family(text: Column, families: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The first family one of whose keywords occurs."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.when(F.lit(False), "")
    for name, words in families:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = out.when(hit, name)
    return out.otherwise(F.lit(default).cast("string"))


def sanitize_identifier(text: Column) -> Column:
    """Lower case, other characters to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def recency_factor(day: Column, as_of: Column) -> Column:
    """1.00, 0.95, 0.90, 0.85 by age in days: under 1, up to 3, up to 7, older; null counts as old."""
    age = F.datediff(as_of, day)
    return F.when(age < 1, 1.0).when(age <= 3, 0.95).when(age <= 7, 0.9).otherwise(0.85)


def trading_days_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays after a, up to and with b; 0 if b is not later."""

    def upto(d: Column) -> Column:
        n = F.datediff(d, F.lit("1969-12-29").cast("date"))  # a Monday
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))

    return F.greatest(F.lit(0), upto(b) - upto(a)).cast("long")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", day), 2))


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the sha256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def daily_limit(ref: Column, up: float, down: float) -> tuple[Column, Column]:
    return ref * (1 - down), ref * (1 + up)


def sessions_to_reach(ref: Column, target: Column, cap: float) -> Column:
    """Sessions at the limit from ref to target, at least one; null unless both are positive."""
    return F.when((ref > 0) & (target > 0), F.greatest(F.lit(1), F.ceil(F.log(target / ref) / F.log(F.lit(1 + cap)))).cast("long"))


def market_cap_tier(cap: Column) -> Column:
    return F.when(cap >= 200e9, "Mega").when(cap >= 10e9, "Large").when(cap >= 2e9, "Mid").when(cap > 0, "Small").otherwise("Unknown")


def position_size(account: float, risk_pct: float, entry: Column, stop: Column, max_position_pct: float) -> tuple[Column, Column]:
    """(shares, what binds): fixed-fractional risk against the position cap."""
    risk = F.floor(F.lit(account * risk_pct / 100) / (entry - stop))
    cap = F.floor(F.lit(account * max_position_pct / 100) / entry)
    ok = (entry > stop) & (entry > 0)
    return F.when(ok, F.least(risk, cap)).otherwise(0).cast("long"), F.when(ok, F.when(risk <= cap, "risk").otherwise("position"))


def trade_prices(pivot: Column, stop: Column, buffer: float = 0.001, slip: float = 0.02) -> dict[str, Column]:
    """Entry above the pivot, worst entry, risk in % of the worst entry, and targets at two and three times the risk."""
    entry, worst = pivot * (1 + buffer), pivot * (1 + slip)
    return {"entry": F.round(entry, 2), "worst": F.round(worst, 2), "risk_pct": F.round((worst - stop) / worst * 100, 4), "target_2r": F.round(worst + 2 * (worst - stop), 2), "target_3r": F.round(worst + 3 * (worst - stop), 2)}
