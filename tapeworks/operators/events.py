"""Joins of bars with benchmarks, earnings and signals, and weekly and monthly bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import step_score, trading_days_between
from tapeworks.operators.features import by, frame, full

#: Periods in bars and their weights.
RS_PERIODS = ((63, 0.4), (126, 0.2), (189, 0.2), (252, 0.2))
MULTI_PERIODS = ((63, 0.4), (126, 0.3), (252, 0.3))


#: Weighted excess return in % and the score and rank that it earns.
RS_LADDER = [(50, 100, 99), (30, 95, 95), (20, 90, 90), (10, 80, 80), (5, 70, 70), (0, 60, 60), (-5, 50, 50), (-10, 40, 40), (-20, 20, 25)]


def relative_strength(bars: DataFrame, bench: DataFrame, periods: tuple[tuple[int, float], ...] = RS_PERIODS) -> DataFrame:
    """Weighted excess return in % over a benchmark joined by date, its score and rank estimate.

    A period of which more than half has passed counts from the first bar on, at half its weight; weights of periods
    that are missing are dealt to the others. Without any the return is null, score and rank are 0.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.join(bench, "date").withColumn("_i", F.row_number().over(w)).withColumn("_c", F.first("close").over(w)).withColumn("_b", F.first("bench").over(w))

    def change(now: str, then: Column) -> Column:
        return F.when(then > 0, (F.col(now) - then) / then * 100).otherwise(0.0)

    total, weight = F.lit(0.0), F.lit(0.0)
    for n, share in periods:
        whole, some = F.col("_i") > n, F.col("_i") > n // 2
        ex = F.when(whole, change("close", F.lag("close", n).over(w)) - change("bench", F.lag("bench", n).over(w))).otherwise(change("close", F.col("_c")) - change("bench", F.col("_b")))
        mine = F.when(whole, share).when(some, share * 0.5).otherwise(0.0)
        total, weight = total + ex * mine, weight + mine
    rows = rows.select("symbol", "date", total.alias("_t"), weight.alias("_w")).withColumn("rs", F.when(F.col("_w") > 0, F.col("_t") / F.col("_w")))
    score = step_score(F.col("rs"), [(x, y) for x, y, _ in RS_LADDER], 0, 0)
    rank = step_score(F.col("rs"), [(x, z) for x, _, z in RS_LADDER], 10, 0)
    return rows.select("symbol", "date", "rs", score.alias("score"), rank.alias("rank"))


def multi_period_rs(bars: DataFrame, bench: DataFrame, periods: tuple[tuple[int, float], ...] = MULTI_PERIODS) -> DataFrame:
    """Weighted return and excess return in % over the periods that each has, and rs: the excess, or without a
    benchmark the return itself."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.join(bench, "date", "left")
    own, ex = [], []
    for n, share in periods:
        mine = (F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1) * 100
        own.append((mine, share))
        ex.append((mine - (F.col("bench") / F.nullif(F.lag("bench", n).over(w), F.lit(0.0)) - 1) * 100, share))

    def mean(parts: list[tuple[Column, float]]) -> Column:
        total = sum((F.coalesce(c * s, F.lit(0.0)) for c, s in parts), F.lit(0.0))
        weight = sum((F.when(c.isNotNull(), s).otherwise(0.0) for c, s in parts), F.lit(0.0))
        return total / F.nullif(weight, F.lit(0.0))

    rows = rows.select("symbol", "date", mean(own).alias("performance"), mean(ex).alias("relative"))
    return rows.withColumn("rs", F.coalesce("relative", "performance"))


def earnings_gap(bars: DataFrame, earnings: DataFrame) -> DataFrame:
    """Gap of each report: before the open from the day before, else from the day's close to the next open."""
    rows = bars.select("symbol", "date", "open", "close", F.lag("close").over(by()).alias("pc"), F.lead("open").over(by()).alias("no"))
    gap = F.when(F.col("timing") == "bmo", F.col("open") / F.col("pc") - 1).otherwise(F.col("no") / F.col("close") - 1)
    out = earnings.join(rows, ["symbol", "date"], "left")
    warning = F.when(F.col("close").isNull(), "no bar").when(gap.isNull(), "no neighbour")
    return out.select("symbol", "date", "timing", gap.alias("gap"), warning.alias("warning"))


def earnings_trend(bars: DataFrame, earnings: DataFrame) -> DataFrame:
    """Return of the 20 bars up to the report, and mean volume of 20 bars over that of 60 (5 and 20 at least)."""
    v20, v60 = full(F.avg("volume"), "volume", 20, least=5), full(F.avg("volume"), "volume", 60, least=20)
    rows = bars.select("symbol", "date", (F.col("close") / F.lag("close", 20).over(by()) - 1).alias("pre_trend"), F.when(v60 > 0, v20 / v60).alias("volume_trend"))
    return earnings.join(rows, ["symbol", "date"]).select("symbol", "date", "pre_trend", "volume_trend")


#: Weights of the reaction's components, and the ladders of their scores in %.
REACTION = {"gap": 0.25, "trend": 0.30, "volume": 0.20, "ma200": 0.15, "ma50": 0.10}
REACTION_LADDERS = {
    "gap": ([(10, 100), (7, 85), (5, 70), (3, 55), (1, 35)], 15), "trend": ([(15, 100), (10, 85), (5, 70), (0, 50), (-5, 30)], 15), "volume": ([(2.0, 100), (1.5, 80), (1.2, 60), (1.0, 40)], 20),
    "ma200": ([(20, 100), (10, 85), (5, 70), (0, 55), (-5, 35)], 15), "ma50": ([(10, 100), (5, 80), (0, 60), (-5, 35)], 15),
}


def earnings_reaction(bars: DataFrame, earnings: DataFrame) -> DataFrame:
    """Score of each report from its gap, the trend and volume before it and its place over the 200 and 50 bar means,
    each by its ladder (0 where a value is missing); grade, weakest and strongest component (the first of equals)."""
    means = bars.select("symbol", "date", (F.col("close") / full(F.avg("close"), "close", 200) - 1).alias("d200"), (F.col("close") / full(F.avg("close"), "close", 50) - 1).alias("d50"))
    rows = earnings_gap(bars, earnings).join(earnings_trend(bars, earnings), ["symbol", "date"], "left").join(means, ["symbol", "date"], "left")
    value = {"gap": F.abs("gap") * 100, "trend": F.col("pre_trend") * 100, "volume": F.col("volume_trend"), "ma200": F.col("d200") * 100, "ma50": F.col("d50") * 100}
    rows = rows.select("symbol", "date", *[step_score(F.round(value[c], 9), *REACTION_LADDERS[c], 0).alias(c) for c in REACTION])
    score = F.round(sum((F.col(c) * w for c, w in REACTION.items()), F.lit(0.0)), 1)
    parts = F.array(*[F.struct(F.col(c).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(REACTION)])
    best = F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(REACTION)])
    rows = rows.withColumn("score", score).withColumn("weakest", F.array_min(parts)["c"]).withColumn("strongest", F.array_min(best)["c"])
    return rows.select("symbol", "date", "score", F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 55, "C").otherwise("D").alias("grade"), "weakest", "strongest")


def nearest_earnings(panel: DataFrame, earnings: DataFrame) -> DataFrame:
    """Last report on or before each row and the next after it, with trading days since and calendar days to.

    Both sides are laid on one time line per symbol, so no row meets more than its neighbours.
    """
    none = F.lit(None).cast("date")
    line = panel.select("symbol", "date", none.alias("event")).unionByName(earnings.select("symbol", "date", F.col("date").alias("event")).distinct())
    order = ["date", F.col("event").isNull()]
    before = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("symbol").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    rows = line.select("symbol", "date", "event", F.last("event", ignorenulls=True).over(before).alias("last_event"), F.first("event", ignorenulls=True).over(after).alias("next_event"))
    rows = rows.where("event is null")
    return rows.select("symbol", "date", "last_event", "next_event", trading_days_between(F.col("last_event"), F.col("date")).alias("days_since"), F.datediff("next_event", "date").alias("days_to"))


def holding_returns(signals: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (5, 20), slack: int = 4) -> DataFrame:
    """Return of each signal (id, symbol, date) to the first bar on or up to `slack` days after date + horizon."""
    target = signals.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("t", F.date_add("date", F.col("h")))
    days = target.withColumn("d", F.explode(F.sequence(F.col("t"), F.date_add("t", slack))))
    exits = days.join(bars.select("symbol", F.col("date").alias("d"), F.col("close").alias("exit")), ["symbol", "d"])
    exits = exits.groupBy("id", "symbol", "date", "h").agg(F.min_by("exit", "d").alias("exit"))
    entry = bars.select("symbol", "date", F.col("close").alias("entry"))
    out = exits.join(entry, ["symbol", "date"])
    return out.select("id", "h", (F.col("exit") / F.col("entry") - 1).alias("ret"))


def mae_mfe(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Worst and best close of each position (id, symbol, entry_date, exit_date) against its entry close."""
    days = bars.select("symbol", "date", "close")
    held = positions.withColumn("date", F.explode(F.sequence("entry_date", "exit_date"))).join(days, ["symbol", "date"])
    out = held.groupBy("id").agg(F.min("close").alias("lo"), F.max("close").alias("hi"), F.min_by("close", "date").alias("entry"))
    return out.select("id", (F.col("lo") / F.col("entry") - 1).alias("mae"), (F.col("hi") / F.col("entry") - 1).alias("mfe"))


def weekly_bars(bars: DataFrame) -> DataFrame:
    """ISO weeks: first open, last close, extremes, volume and sessions."""
    week = F.to_date(F.date_trunc("week", "date"))
    return bars.groupBy("symbol", week.alias("week")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("sessions")
    )


def event_weeks(bars: DataFrame, events: DataFrame, before: int = 4, after: int = 6) -> DataFrame:
    """ISO weeks around each event (symbol, event): first open, last close, extremes, volume, sessions, green (close not under
    open) and partial. The event's own week has only bars from the event on, and is partial with under five of them; a
    symbol's last week is partial if it ends before Friday.

    Bars meet events by (symbol, week), so an event brings at most before + 1 + after weeks of bars whatever the history."""
    week = F.to_date(F.date_trunc("week", "date"))
    last = bars.groupBy("symbol").agg(F.max("date").alias("_last"))
    spans = events.select("symbol", "event").distinct().withColumn("_of", F.to_date(F.date_trunc("week", "event"))).withColumn("_k", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    spans = spans.withColumn("week", F.date_add("_of", F.col("_k") * 7))
    rows = bars.withColumn("week", week).join(spans, ["symbol", "week"]).where((F.col("_k") != 0) | (F.col("date") >= F.col("event")))
    out = rows.groupBy("symbol", "event", "week").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("sessions"), F.first("_k").alias("_k"))
    open_week = (F.to_date(F.date_trunc("week", "_last")) == F.col("week")) & (F.weekday("_last") < 4)
    out = out.join(last, "symbol").withColumn("partial", open_week | ((F.col("_k") == 0) & (F.col("sessions") < 5)))
    return out.withColumn("green", F.col("close") >= F.col("open")).drop("_k", "_last")


def monthly_close(bars: DataFrame) -> DataFrame:
    """Last positive close of each month."""
    return bars.where("close > 0").groupBy("symbol", F.date_format("date", "yyyy-MM").alias("month")).agg(F.max_by("close", "date").alias("close"))


def ratio_series(monthly: DataFrame, top: str, bottom: str) -> DataFrame:
    """Month-aligned ratio of two symbols' closes."""
    a = monthly.where(F.col("symbol") == top).select("month", F.col("close").alias("a"))
    b = monthly.where(F.col("symbol") == bottom).select("month", F.col("close").alias("b"))
    return a.join(b, "month").where("b > 0").select("month", (F.col("a") / F.col("b")).alias("ratio"))


def sma_crossover(series: DataFrame, fast: int = 6, slow: int = 12) -> DataFrame:
    """Per symbol: the latest cross of the fast over the slow mean, bars since, and the gap in %."""
    w = Window.partitionBy("symbol").orderBy("month")

    def mean(n: int) -> Column:
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(f) == n, F.avg("close").over(f))

    rows = series.withColumn("f", mean(fast)).withColumn("s", mean(slow)).where("s is not null").withColumn("side", F.when(F.col("f") > F.col("s"), 1).otherwise(-1))
    rows = rows.withColumn("turn", (F.col("side") != F.lag("side").over(w))).withColumn("n", F.row_number().over(w))
    return rows.groupBy("symbol").agg(
        F.max("n").alias("bars"), F.max(F.when(F.col("turn"), F.col("n"))).alias("at"), F.max_by("side", F.when(F.col("turn"), F.col("n"))).alias("side"), F.max_by((F.col("f") / F.col("s") - 1) * 100, "n").alias("gap_pct")
    ).select("symbol", F.when(F.col("at").isNull(), "none").when(F.col("side") > 0, "golden").otherwise("death").alias("cross"), (F.col("bars") - F.col("at")).alias("bars_ago"), "gap_pct", (F.abs("gap_pct") < 1).alias("converging"))


def calendar_seasonality(bars: DataFrame, least: int = 6, win: float = 0.6, mean: float = 0.025) -> DataFrame:
    """Symbols and months with a high mean monthly return; a missing return counts as not positive."""
    w = Window.partitionBy("symbol").orderBy("month")
    rows = monthly_close(bars).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("m", F.substring("month", 6, 2))
    out = rows.groupBy("symbol", "m").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return out.where((F.col("n") >= least) & (F.col("win_rate") >= win) & (F.col("mean_ret") >= mean))


def pead_stage(bars: DataFrame, earnings: DataFrame, as_of: str, weeks: int = 5) -> DataFrame:
    """Stage of each symbol's last report: the latest red week after it, and whether a green week closed above its high."""
    last = earnings.where(F.col("date") <= F.lit(as_of).cast("date")).groupBy("symbol").agg(F.max("date").alias("event"))
    candles = weekly_bars(bars.where(F.col("date") <= F.lit(as_of).cast("date"))).join(last, "symbol").where("week >= date_trunc('week', event)")
    red = candles.where("close < open").groupBy("symbol").agg(F.max_by(F.struct("week", "high", "low"), "week").alias("red"))
    now = candles.groupBy("symbol").agg(F.max_by(F.struct("week", "open", "close"), "week").alias("now"))
    out = last.join(red, "symbol", "left").join(now, "symbol", "left").withColumn("age", F.floor(F.datediff(F.lit(as_of).cast("date"), "event") / 7))
    broke = (F.col("now.close") > F.col("now.open")) & (F.col("now.close") > F.col("red.high")) & (F.col("now.week") > F.col("red.week"))
    stage = F.when(F.col("age") > weeks, "EXPIRED").when(F.col("red").isNull(), "MONITORING").when(broke, "BREAKOUT").otherwise("SIGNAL_READY")
    return out.select("symbol", "event", "age", stage.alias("stage"))


def liquidity_score(adv: Column) -> Column:
    return step_score(adv, ((100e6, 100), (50e6, 80), (25e6, 60), (10e6, 40)), 0, 0)


def defensive_rotation(bars: DataFrame, defensive: list[str], offensive: list[str], periods: tuple[tuple[int, float], ...] = ((10, 0.2), (20, 0.5), (40, 0.3))) -> DataFrame:
    """Weighted lead of defensive over offensive mean returns by date."""
    rows = bars.where(F.col("symbol").isin(*defensive, *offensive)).withColumn("side", F.when(F.col("symbol").isin(*defensive), 1).otherwise(-1))
    rets = [(F.col("close") / F.lag("close", n).over(by()) - 1).alias(f"r{n}") for n, _ in periods]
    rows = rows.select("date", "side", *rets)
    parts = [(F.avg(F.when(F.col("side") == 1, F.col(f"r{n}"))) - F.avg(F.when(F.col("side") == -1, F.col(f"r{n}")))) * w for n, w in periods]
    return rows.groupBy("date").agg(sum(parts[1:], parts[0]).alias("rotation"))


def vol_ratio(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", (F.avg("volume").over(frame(20)) / F.avg("volume").over(frame(60))).alias("r"))
