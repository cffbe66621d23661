"""The market by date: breadth, volatility, regime, anomalies and the scanners that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp, part
from tapeworks.operators.features import by, full


def market_breadth(panel: DataFrame, short: str = "ma50", long: str = "ma200") -> DataFrame:
    """Share of symbols above their means, and the mean return, by date."""
    above = lambda ma: F.avg(F.when(F.col(ma).isNotNull(), F.when(F.col("close") > F.col(ma), 1.0).otherwise(0.0)))
    return panel.groupBy("date").agg(above(short).alias("b50"), above(long).alias("b200"), F.avg("ret_1d").alias("market_ret"), F.count("*").alias("symbols"))


def realized_vol_trend(market: DataFrame) -> DataFrame:
    """Yearly population deviation of 20 and 60 market returns (10 and 20 at least) and their ratio."""
    w = Window.orderBy("date")

    def rv(n: int, least: int) -> Column:
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("market_ret").over(f) >= least, F.stddev_pop("market_ret").over(f) * F.sqrt(F.lit(252.0)))

    rows = market.withColumn("rv20", rv(20, 10)).withColumn("rv60", rv(60, 20))
    return rows.withColumn("vol_trend", F.when(F.col("rv60") > 0, F.col("rv20") / F.col("rv60")))


def avg_pair_correlation(panel: DataFrame, days: int = 20, least: int = 5) -> DataFrame:
    """Mean correlation over symbol pairs of the last sessions' returns."""
    last = panel.select("date").distinct().orderBy(F.desc("date")).limit(days)
    rows = panel.where("ret_1d is not null").join(F.broadcast(last), "date").select("symbol", "date", F.col("ret_1d").alias("r"))
    other = rows.select(F.col("symbol").alias("symbol2"), "date", F.col("r").alias("r2"))
    pairs = rows.join(other, "date").where("symbol < symbol2").groupBy("symbol", "symbol2").agg(F.corr("r", "r2").alias("c"), F.count("*").alias("n"))
    return pairs.where((F.col("n") >= least) & ~F.isnan("c")).agg(F.avg("c").alias("avg_corr"))


def market_regime(summary: DataFrame) -> DataFrame:
    """Risk-on and risk-off scores and the label; summary: b50, corr, vol_trend, trend_up."""
    corr, vol, b = F.coalesce("corr", F.lit(0.5)), F.coalesce("vol_trend", F.lit(1.0)), F.col("b50")
    on = F.when(F.col("trend_up"), 25).otherwise(5) + 35 * part(b - 0.35, 0.45) + 20 * part(0.8 - corr, 0.6) + 20 * part(1.4 - vol, 0.8)
    off = F.when(F.col("trend_up"), 5).otherwise(20) + 30 * part(corr - 0.35, 0.45) + 30 * part(vol - 0.95, 0.8) + 20 * part(0.55 - b, 0.45)
    rows = summary.withColumn("risk_on", on).withColumn("risk_off", off)
    label = F.when((F.col("risk_off") >= 65) & (F.col("risk_off") - F.col("risk_on") >= 5), "RiskOff").when((F.col("risk_on") >= 65) & (F.col("risk_on") >= F.col("risk_off")), "RiskOn").otherwise("Neutral")
    return rows.withColumn("regime", label)


def tradable(features: DataFrame, min_price: float = 5.0, min_volume: float = 1e6) -> DataFrame:
    return features.where((F.col("close") >= min_price) & (F.col("vol_avg20") >= min_volume) & F.col("ma50").isNotNull() & F.col("ma200").isNotNull())


def regime_points(regime: Column, on: float, neutral: float, off: float) -> Column:
    return F.when(regime == "RiskOn", on).when(regime == "RiskOff", off).otherwise(neutral)


def breakout_score(regime: Column, boost: Column) -> Column:
    c = F.col
    high = part(c("close") / c("high20_prev") - 1, 0.08)
    raw = 40 * F.coalesce("rs_rank_pct", F.lit(0.0)) + 20 * part(c("rel_volume"), 3.0) + 20 * high + 10 * F.coalesce("close_pos", F.lit(0.0)) + regime_points(regime, 10, 5, -5) + boost - 15 * part(c("atr_pct") - 0.08, 0.07)
    return F.round(clamp(raw, 0.0, 100.0), 2)


def gap_score(regime: Column, boost: Column) -> Column:
    c = F.col
    raw = 35 * part(c("gap"), 0.12) + 25 * part(c("rel_volume"), 4.0) + 20 * F.coalesce("close_pos", F.lit(0.0)) + F.when(c("close") > c("ma50"), 10).otherwise(0) + F.when(c("close") > c("ma200"), 10).otherwise(0)
    return F.round(clamp(raw + regime_points(regime, 8, 4, -8) + boost - 10 * part(c("atr_pct") - 0.10, 0.08), 0.0, 100.0), 2)


def reversal_score(regime: Column, boost: Column) -> Column:
    c = F.col
    raw = 45 * part(-c("ret_1d"), 0.18) + 20 * part(c("rel_volume"), 4.0) + F.when(c("close") > c("ma200"), 15).otherwise(5) + regime_points(regime, 2, 7, 12) + boost - 12 * part(c("atr_pct") - 0.14, 0.10)
    return F.round(clamp(raw, 0.0, 100.0), 2)


def scan_breakout(rows: DataFrame, rel_volume: float = 1.5, close_pos: float = 0.55, rs: float = 0.7) -> DataFrame:
    hit = (F.col("close") > F.col("ma50")) & (F.col("ma50") > F.col("ma200")) & (F.col("close") > F.col("high20_prev")) & (F.col("rel_volume") >= rel_volume) & (F.col("close_pos") >= close_pos) & (F.col("rs_rank_pct") >= rs)
    return rows.where(hit).withColumn("score", breakout_score(F.col("regime"), F.col("boost")))


def scan_gap_up(rows: DataFrame, gap: float = 0.04, rel_volume: float = 2.0, close_pos: float = 0.5) -> DataFrame:
    hit = (F.col("gap") >= gap) & (F.col("rel_volume") >= rel_volume) & (F.col("close_pos") >= close_pos) & (F.col("close") > F.col("ma50"))
    return rows.where(hit).withColumn("score", gap_score(F.col("regime"), F.col("boost")))


def scan_panic_reversal(rows: DataFrame, drop: float = -0.07, rel_volume: float = 1.8) -> DataFrame:
    hit = (F.col("ret_1d") <= drop) & (F.col("rel_volume") >= rel_volume) & (F.col("close") > 0.85 * F.col("ma200"))
    return rows.where(hit).withColumn("score", reversal_score(F.col("regime"), F.col("boost") * 0.6))


def hint_boost(rows: DataFrame, hints: DataFrame, family: str) -> DataFrame:
    """boost: 12 for a hint of the family that names the symbol, 6 for one without symbols, 20 at most.

    Named hints are joined by symbol; those without symbols count once for all rows.
    """
    own = hints.where(F.col("family") == family)
    general = own.where(F.coalesce(F.size("symbols"), F.lit(0)) <= 0).count()  # one number
    named = own.select(F.explode(F.array_distinct("symbols")).alias("symbol")).groupBy("symbol").agg((F.count("*") * 12).alias("_named"))
    return rows.join(named, "symbol", "left").withColumn("boost", F.least(F.lit(20.0), F.coalesce("_named", F.lit(0)) + F.lit(6.0 * general))).drop("_named")


def anomalies(rows: DataFrame, metrics: list[str], limit: float = 2.0, k: int = 10) -> DataFrame:
    """The k largest |z| of the given z columns, as (symbol, metric, z)."""
    return rows.unpivot(["symbol"], metrics, "metric", "z").where(F.abs("z") >= limit).orderBy(F.desc(F.abs("z")), "symbol", "metric").limit(k)


def regime_shift(days: DataFrame) -> DataFrame:
    """Change of breadth over eight sessions and the sum of five market returns, by date."""
    w = Window.orderBy("date")
    return days.select("date", (F.col("b50") - F.lag("b50", 7).over(w)).alias("breadth_delta"), F.sum("market_ret").over(w.rowsBetween(-4, 0)).alias("ret5"))


def leader_follower(panel: DataFrame, as_of: str, move: float = 0.045, leaders: int = 6, pool: int = 120, sessions: int = 90, least: float = 0.25, per_leader: int = 5, quiet_below: float = 0.015, k: int = 4) -> DataFrame:
    """Quiet symbols whose returns followed a large mover's of the session before: best leader per follower, the k best.

    Sessions are the last `sessions` dates of the panel up to as_of. Followers and leaders are among the `pool` symbols of
    the largest mean value of their last 20 rows there; each leader keeps its `per_leader` best correlations, and of these
    the followers that moved less than `quiet_below` on the day."""
    day = F.lit(as_of).cast("date")
    dates = panel.select("date").distinct().where(F.col("date") <= day).orderBy(F.desc("date")).limit(sessions + 1)
    span = panel.join(F.broadcast(dates), "date")  # at most sessions + 1 dates
    first = dates.orderBy("date").limit(1).select(F.col("date").alias("_first"))
    n = dates.count()
    if n > sessions:
        span = span.join(F.broadcast(first), F.col("date") == F.col("_first"), "left_anti")
    last = span.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("_k <= 20")
    liquid = last.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("_v")).orderBy(F.desc("_v"), "symbol").limit(pool).select("symbol")
    span = span.join(F.broadcast(liquid), "symbol")  # at most `pool` symbols
    today = panel.where(F.col("date") == day)
    lead = today.where(F.abs("ret_1d") >= move).orderBy(F.desc(F.abs("ret_1d")), "symbol").limit(leaders).join(liquid, "symbol").select(F.col("symbol").alias("leader"), F.col("ret_1d").alias("leader_ret"))
    order = dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))  # as many rows as dates
    before = span.join(F.broadcast(lead), F.col("symbol") == F.col("leader")).join(F.broadcast(order), "date").select("leader", "leader_ret", F.col("next").alias("date"), F.col("ret_1d").alias("r1"))
    pairs = before.join(span.select("symbol", "date", F.col("ret_1d").alias("r2")), "date").where("leader <> symbol and r1 is not null and r2 is not null").groupBy("leader", "leader_ret", "symbol").agg(F.corr("r1", "r2").alias("corr"), F.count("*").alias("n"))
    pairs = pairs.where(F.round("corr", 9) >= least).withColumn("_k", F.row_number().over(Window.partitionBy("leader").orderBy(F.desc(F.round("corr", 9)), "symbol"))).where(F.col("_k") <= per_leader)
    quiet = today.where(F.abs("ret_1d") < quiet_below).select("symbol", "close", "ma50", "rel_volume")
    score = 40 * part(F.abs("leader_ret"), 0.12) + 35 * part(F.col("corr"), 0.60) + 15 * part(F.col("rel_volume"), 3.0) + F.when(F.col("close") > F.col("ma50"), 10).otherwise(4)
    rows = pairs.join(quiet, "symbol").withColumn("score", F.round(clamp(score, 0.0, 100.0), 2))
    rows = rows.withColumn("_b", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "leader"))).where("_b = 1")
    return rows.select("leader", "symbol", "corr", "n", "score").orderBy(F.desc("score"), "symbol").limit(k)


def vol20(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", full(F.avg("volume"), "volume", 20).alias("vol_avg20"))
