"""Rally states of indices at every week's end, the state of two indices taken together, and a follow-through's quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scalars import step_score
from tapeworks.operators.features import by
from tapeworks.operators.folds import rally_state

#: States without a confirmed follow-through in the order in which one of two indices decides; days watched
#: after it, the fall in % of a distribution day; the ladder of gains; signals by score with their exposure.
ORDER = ("FTD_WINDOW", "RALLY_ATTEMPT", "FTD_INVALIDATED", "CORRECTION", "RALLY_FAILED", "NO_SIGNAL")
WATCHED, FALL = 5, -0.2
GAIN_LADDER = [(2.0, 15), (1.5, 10), (1.25, 5)]
SIGNALS = ((80, "Strong FTD", "75-100%"), (60, "Moderate FTD", "50-75%"), (40, "Weak FTD", "25-50%"))

_FOUND = "state string, rally_day long, ftd_day long, gain double, tier string, ftd_date date, volume_above boolean, monitored long, distributions long, earliest long"


def follow_up(days: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> dict:
    """The rally state of one stretch of bars; with a follow-through its date, whether its volume exceeds the mean of the
    50 bars before (those with volume; null without any), and the distribution days among the five after."""
    out = rally_state(high, low, close, volume) | {"ftd_date": None, "volume_above": None, "monitored": 0, "distributions": 0, "earliest": None}
    if out["ftd_day"] < 0:
        return out
    at = len(close) - out["rally_day"] + out["ftd_day"] - 1
    usual = volume[max(0, at - 50) : at]
    usual = usual[usual > 0]
    after = np.arange(at + 1, min(at + 1 + WATCHED, len(close)))
    before = np.where(close[after - 1] > 0, close[after - 1], np.nan)
    sold = after[((close[after] / before - 1) * 100 <= FALL) & (volume[after] > volume[after - 1]) & (volume[after - 1] > 0)]
    out |= {"ftd_date": days[at], "volume_above": bool(volume[at] > usual.mean()) if len(usual) else None, "monitored": len(after), "distributions": len(sold)}
    return out | {"earliest": int(sold[0] - at) if len(sold) else None}


def weekly_rallies(bars: DataFrame, window: int = 60) -> DataFrame:
    """symbol, week (its Monday), date (its last bar) and the state of the last `window` bars there, for every week.

    A bounded frame carries each week's bars to the row that decides them, so no task holds a symbol's line in Python.
    Bars with a null symbol, date or price count as absent, a null volume as 0; of repeated days all bars count, in the
    order of close and volume. Fewer than ten bars give NO_SIGNAL; empty tables no rows; extra columns are ignored.
    """
    bar = ["date", "high", "low", "close", "volume"]
    days = bars.dropna(subset=["symbol", "date", "high", "low", "close"]).select("symbol", *[c if c == "date" else F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in bar])
    week = F.to_date(F.date_trunc("week", "date"))
    line = by().orderBy("date", "close", "volume")
    days = days.withColumn("week", week).withColumn("after", F.lead("week").over(line))
    days = days.withColumn("line", F.collect_list(F.struct(*bar)).over(line.rowsBetween(-(window - 1), 0))).where("after is null or after <> week")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for batch in batches:
            rows = []
            for symbol, week, date, *columns in batch.itertuples(index=False, name=None):
                rows.append({"symbol": symbol, "week": week, "date": date} | follow_up(*columns))
            yield pd.DataFrame(rows, columns=["symbol", "week", "date", *names])

    return days.select("symbol", "week", "date", *[F.col(f"line.{c}").alias(f"{c}_line") for c in bar]).mapInPandas(run, f"symbol string, week date, date date, {_FOUND}")


def _name(first: Column, second: Column) -> Column:
    return F.when(first & second, "both").when(first, "first").when(second, "second")


def market_states(rallies: DataFrame, markets: DataFrame) -> DataFrame:
    """The state of two indices by week. rallies: `weekly_rallies`; markets: market, first, second (symbols).

    One confirmed follow-through confirms the market, two do so dually; else the index that is further decides (ORDER).
    quality is of the first index with a follow-through: its day, gain, volume, the other's confirmation and distribution
    soon after; an undercut one scores 0, and `reviewed` then is FTD_INVALIDATED whatever the other index says. A week that
    one index lacks counts as NO_SIGNAL there, an index that is null or unknown in all weeks; a market without either has
    no row. Repeated markets give one row each week, by their greatest pair of names.
    """
    marks = markets.where("market is not null").groupBy("market").agg(F.max(F.struct("first", "second")).alias("of"))
    roles = marks.select("market", F.explode(F.array(F.struct(F.lit(1).alias("role"), F.col("of.first").alias("symbol")), F.struct(F.lit(2).alias("role"), F.col("of.second").alias("symbol")))).alias("r")).select("market", "r.*")
    found = F.struct("state", "ftd_day", "gain", "volume_above", "monitored", "distributions", "earliest")
    rows = rallies.join(roles, "symbol").groupBy("market", "week").agg(F.max(F.when(F.col("role") == 1, found)).alias("a"), F.max(F.when(F.col("role") == 2, found)).alias("b"))
    one, two = (F.coalesce(F.col(f"{x}.state"), F.lit("NO_SIGNAL")) for x in "ab")
    held = [s == "FTD_CONFIRMED" for s in (one, two)]
    undercut = [s == "FTD_INVALIDATED" for s in (one, two)]
    state = F.when(held[0] | held[1], "FTD_CONFIRMED")
    for name in ORDER:
        state = state.when((one == name) | (two == name), name)
    rows = rows.withColumn("first_state", one).withColumn("second_state", two).withColumn("state", state).withColumn("dual", held[0] & held[1])
    index = F.coalesce(_name(*held), F.when(F.col("state") == "FTD_INVALIDATED", F.when(undercut[0], "first").otherwise("second")))
    source = F.when(held[0] | undercut[0], F.col("a")).when(held[1] | undercut[1], F.col("b"))
    rows = rows.withColumn("index", index).withColumn("of", source)
    of = F.col("of")
    base = F.when(of["ftd_day"].between(4, 7), 60).when(of["ftd_day"].between(8, 10), 50).otherwise(40)
    early = of["earliest"]
    health = F.when(of["monitored"] == 0, 0).when(of["distributions"] == 0, 10).when(early <= 2, -30).when(early == 3, -15).otherwise(-5) - F.when(of["distributions"] >= 2, 20).otherwise(0)
    total = base + step_score(of["gain"], GAIN_LADDER, 0, 0) + F.when(of["volume_above"], 10).otherwise(0) + F.when(F.col("dual"), 15).otherwise(0) + health
    failed = of["state"] == "FTD_INVALIDATED"
    rows = rows.withColumn("quality", F.when(of.isNull() | failed, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("long"))
    signal, exposure = F.when(of.isNull(), "No FTD").when(failed, "Failed/Invalidated"), F.when(of.isNull() | failed, "0-25%")
    for floor, name, share in SIGNALS:
        signal, exposure = signal.when(F.col("quality") >= floor, name), exposure.when(F.col("quality") >= floor, share)
    reviewed = F.when(failed, "FTD_INVALIDATED").otherwise(F.col("state"))
    return rows.select("market", "week", "first_state", "second_state", "state", "dual", F.col("index").alias("ftd_index"), reviewed.alias("reviewed"), "quality", signal.otherwise("Failed/Weak").alias("signal"), exposure.otherwise("0-25%").alias("exposure"))
