"""Swings, distribution days, candlestick patterns and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.features import by, frame, full


def fixed_window_swings(bars: DataFrame, k: int) -> DataFrame:
    """Rows strictly above (high) or below (low) the k bars on both sides."""
    back, ahead = by().rowsBetween(-k, -1), by().rowsBetween(1, k)
    both = (F.count("high").over(back) == k) & (F.count("high").over(ahead) == k)
    top = both & (F.col("high") > F.max("high").over(back)) & (F.col("high") > F.max("high").over(ahead))
    bottom = both & (F.col("low") < F.min("low").over(back)) & (F.col("low") < F.min("low").over(ahead))
    return bars.select("symbol", "date", "high", "low", top.alias("swing_high"), bottom.alias("swing_low")).where("swing_high or swing_low")


def peaks_troughs(bars: DataFrame, k: int = 20) -> DataFrame:
    """Closes equal to the largest or smallest of the k bars on both sides; ties all count."""
    f = by().rowsBetween(-k, k)
    whole = F.count("close").over(f) == 2 * k + 1
    rows = bars.withColumn("bar", F.row_number().over(by()))
    return rows.select("symbol", "date", "bar", "close", (whole & (F.col("close") == F.max("close").over(f))).alias("peak"), (whole & (F.col("close") == F.min("close").over(f))).alias("trough")).where("peak or trough")


def downtrends(bars: DataFrame, k: int = 20, depth_pct: float = 5.0, least: int = 3) -> DataFrame:
    """Each peak to the deepest trough before the next peak."""
    marks = peaks_troughs(bars, k)
    after = Window.partitionBy("symbol").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumn("peak_bar", F.max(F.when(F.col("peak"), F.col("bar"))).over(after))
    low = rows.where("trough and bar > peak_bar").groupBy("symbol", "peak_bar").agg(F.min_by(F.struct("bar", "date", "close"), F.struct("close", "bar")).alias("t"))
    top = marks.where("peak").select("symbol", F.col("bar").alias("peak_bar"), F.col("date").alias("peak_date"), F.col("close").alias("peak_close"))
    out = top.join(low, ["symbol", "peak_bar"]).select("symbol", "peak_date", "peak_close", F.col("t.date").alias("trough_date"), F.col("t.close").alias("trough_close"), (F.col("t.bar") - F.col("peak_bar")).alias("bars"))
    out = out.withColumn("depth_pct", (1 - F.col("trough_close") / F.col("peak_close")) * 100)
    return out.where((F.col("depth_pct") >= depth_pct) & (F.col("bars") >= least))


def distribution_days(bars: DataFrame, decline: float = -0.002, eps: float = 1e-12) -> DataFrame:
    """Closes down by the threshold or more on higher volume than the day before."""
    prev, vol = F.lag("close").over(by()), F.lag("volume").over(by())
    rows = bars.select("symbol", "date", "close", "high", "volume", (F.col("close") / prev - 1).alias("change"), vol.alias("prev_volume"), F.row_number().over(by()).alias("bar"))
    return rows.where((F.col("change") <= decline + eps) & (F.col("volume") > F.col("prev_volume"))).drop("prev_volume")


def skipped_pairs(bars: DataFrame) -> DataFrame:
    """Bars that distribution_days cannot compare: they or the bar before lack a positive close or volume. A symbol's first
    bar has none before and is not reported."""
    valid = F.coalesce((F.col("close") > 0) & (F.col("volume") > 0), F.lit(False))
    rows = bars.withColumn("_ok", valid).withColumn("_before", F.lag("_ok").over(by()))
    return rows.where(F.col("_before").isNotNull() & ~(F.col("_ok") & F.col("_before"))).select("symbol", "date", F.lit("missing_or_invalid_close_volume").alias("reason"))


def stalling_and_clustering(bars: DataFrame, n: int = 25) -> DataFrame:
    """In the last n sessions: distribution days, stalling days (0 to 0.1 % on higher volume), share in the last five."""
    prev, vol = F.lag("close").over(by()), F.lag("volume").over(by())
    change = F.col("close") / prev - 1
    rows = bars.select("symbol", "date", F.when((change <= -0.002) & (F.col("volume") > vol), 1).otherwise(0).alias("d"), F.when((change >= 0) & (change < 0.001) & (F.col("volume") > vol), 1).otherwise(0).alias("s"))
    d = F.sum("d").over(frame(n))
    return rows.select("symbol", "date", d.alias("distribution"), F.sum("s").over(frame(n)).alias("stalling"), F.when(d > 0, F.sum("d").over(frame(5)) / d).otherwise(0.0).alias("cluster"))


def dd_status(bars: DataFrame, decline: float = -0.002, expiry: int = 25, gain: float = 0.05) -> DataFrame:
    """Each distribution day's highest high since (the day included), first later session within `expiry` at or above
    close * (1 + gain), and status as of the last session: invalidated before expired before active."""
    numbered = bars.withColumn("bar", F.row_number().over(by()))
    days = distribution_days(bars, decline)
    last = numbered.groupBy("symbol").agg(F.max("bar").alias("last_bar"))
    later = numbered.select("symbol", F.col("bar").alias("b"), F.col("high").alias("h"))
    reach = days.withColumn("b", F.explode(F.sequence(F.col("bar"), F.col("bar") + expiry))).join(later, ["symbol", "b"])
    seen = reach.groupBy("symbol", "date", "bar", "close").agg(F.max("h").alias("high_since"), F.min(F.when((F.col("b") > F.col("bar")) & (F.col("h") >= F.col("close") * (1 + gain)), F.col("b"))).alias("hit"))
    out = seen.join(last, "symbol").withColumn("age", F.col("last_bar") - F.col("bar"))
    return out.select("symbol", "date", "age", "high_since", F.when(F.col("hit").isNotNull(), "invalidated").when(F.col("age") > expiry, "expired").otherwise("active").alias("status"))


def dd_risk(status: DataFrame) -> DataFrame:
    """Active distribution days by age and the risk level of each symbol."""

    def within(n: int) -> Column:
        return F.count_if((F.col("status") == "active") & (F.col("age") < n))

    out = status.groupBy("symbol").agg(within(5).alias("d5"), within(15).alias("d15"), within(25).alias("d25"))
    level = F.when((F.col("d25") >= 6) | (F.col("d15") >= 4), "SEVERE").when((F.col("d25") >= 5) | (F.col("d15") >= 3) | (F.col("d5") >= 2), "HIGH").when(F.col("d25") >= 3, "CAUTION").otherwise("NORMAL")
    return out.withColumn("risk", level)


#: Fixed values: (pattern, direction, reliability).
PATTERNS = (
    ("doji", 0, 0.3), ("hammer", 1, 0.6), ("hanging_man", -1, 0.5), ("inverted_hammer", 1, 0.5), ("shooting_star", -1, 0.6), ("bullish_marubozu", 1, 0.55),
    ("bearish_marubozu", -1, 0.55), ("bullish_engulfing", 1, 0.7), ("bearish_engulfing", -1, 0.7), ("piercing_line", 1, 0.6), ("dark_cloud_cover", -1, 0.6), ("bullish_harami", 1, 0.45),
    ("bearish_harami", -1, 0.45), ("tweezer_bottom", 1, 0.4), ("tweezer_top", -1, 0.4), ("morning_star", 1, 0.75), ("evening_star", -1, 0.75), ("three_white_soldiers", 1, 0.7), ("three_black_crows", -1, 0.7),
)


def candlestick_patterns(bars: DataFrame, doji: float = 0.1) -> DataFrame:
    """One row per pattern that completes on a bar: symbol, date, bar, close, pattern, direction, reliability.

    The trend before a pattern compares the first and the last of the five closes before its first candle, at 1 %.
    """
    rows = bars.withColumn("bar", F.row_number().over(by()))
    names = ("open", "high", "low", "close")
    for k in (1, 2):
        for x in names:
            rows = rows.withColumn(f"{x}{k}", F.lag(x, k).over(by()))
    for k in range(3):
        before = by().rowsBetween(-5 - k, -1 - k)
        move = (F.last("close").over(before) - F.first("close").over(before)) / F.abs(F.first("close").over(before))
        trend = F.when(F.count("close").over(before) < 2, 0).when(move > 0.01, 1).when(move < -0.01, -1).otherwise(0)
        rows = rows.withColumn(f"trend{k}", trend)

    class Candle:
        def __init__(self, k: str):
            self.o, self.h, self.l, self.c = (F.col(x + k) for x in names)
            self.body, self.span, self.mid = F.abs(self.c - self.o), self.h - self.l, (self.o + self.c) / 2
            self.up, self.down = self.c > self.o, self.c < self.o
            self.upper, self.lower = self.h - F.greatest(self.o, self.c), F.least(self.o, self.c) - self.l

    c, p, a = Candle(""), Candle("1"), Candle("2")
    t0, t1, t2 = F.col("trend0"), F.col("trend1"), F.col("trend2")
    some = c.span > 0
    small = some & (c.body > 0) & (c.body / c.span < 0.4)
    long_lower, long_upper = small & (c.lower >= 2 * c.body) & (c.upper <= 0.15 * c.span), small & (c.upper >= 2 * c.body) & (c.lower <= 0.15 * c.span)
    near = 0.001 * F.greatest(c.c, F.lit(1.0))
    spans = some & (p.span > 0)
    rules = {
        "doji": some & (c.body / c.span <= doji), "hammer": long_lower & (t0 == -1), "hanging_man": long_lower & (t0 == 1), "inverted_hammer": long_upper & (t0 == -1), "shooting_star": long_upper & (t0 == 1),
        "bullish_marubozu": some & (c.body / c.span >= 0.9) & c.up, "bearish_marubozu": some & (c.body / c.span >= 0.9) & c.down,
        "bullish_engulfing": p.down & c.up & (c.c >= p.o) & (c.o <= p.c) & (c.body > p.body), "bearish_engulfing": p.up & c.down & (c.o >= p.c) & (c.c <= p.o) & (c.body > p.body),
        "piercing_line": (t1 == -1) & p.down & c.up & (c.o < p.l) & (c.c > p.mid) & (c.c < p.o), "dark_cloud_cover": (t1 == 1) & p.up & c.down & (c.o > p.h) & (c.c < p.mid) & (c.c > p.o),
        "bullish_harami": p.down & c.up & (c.o > p.c) & (c.c < p.o) & (c.body < p.body), "bearish_harami": p.up & c.down & (c.o < p.c) & (c.c > p.o) & (c.body < p.body),
        "tweezer_bottom": spans & (t1 == -1) & (F.abs(p.l - c.l) <= near) & p.down & c.up, "tweezer_top": spans & (t1 == 1) & (F.abs(p.h - c.h) <= near) & p.up & c.down,
        "morning_star": (t2 == -1) & a.down & (p.body < a.body * 0.5) & c.up & (c.c > a.mid), "evening_star": (t2 == 1) & a.up & (p.body < a.body * 0.5) & c.down & (c.c < a.mid),
        "three_white_soldiers": a.up & p.up & c.up & (p.c > a.c) & (c.c > p.c) & (p.o > a.o) & (c.o > p.o), "three_black_crows": a.down & p.down & c.down & (p.c < a.c) & (c.c < p.c) & (p.o < a.o) & (c.o < p.o),
    }
    hits = [F.when(rules[name], F.struct(F.lit(name).alias("pattern"), F.lit(way).alias("direction"), F.lit(rel).alias("reliability"))) for name, way, rel in PATTERNS]
    return rows.select("symbol", "date", "bar", "close", "volume", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("symbol", "date", "bar", "close", "volume", "x.*")


def pattern_signal(bars: DataFrame, lookback: int = 3) -> DataFrame:
    """BUY / SELL / NEUTRAL of each symbol: the last bar's directional hits, else the decayed sum of recent bars."""
    last = bars.groupBy("symbol").agg(F.count("*").alias("last_bar"))
    hits = candlestick_patterns(bars).where("direction <> 0").join(last, "symbol").withColumn("age", F.col("last_bar") - F.col("bar")).where(F.col("age") < lookback)
    x = F.col("direction") * F.col("reliability")
    sums = hits.groupBy("symbol").agg(F.count_if(F.col("age") == 0).alias("now"), F.sum(F.when(F.col("age") == 0, x).otherwise(0.0)).alias("a"), F.sum(x * F.pow(F.lit(0.5), F.col("age"))).alias("b"))
    score = F.round(F.coalesce(F.when(F.col("now") > 0, F.col("a")).otherwise(F.col("b")), F.lit(0.0)), 9)
    out = last.join(sums, "symbol", "left").withColumn("score", score)
    return out.select("symbol", "score", F.when(F.col("last_bar") < 20, "NODATA").when(F.col("score") >= 0.5, "BUY").when(F.col("score") <= -0.5, "SELL").otherwise("NEUTRAL").alias("signal"))


def forward_return(bars: DataFrame, h: int) -> DataFrame:
    return bars.withColumn(f"fwd_{h}", F.when(F.col("close") > 0, F.lead("close", h).over(by()) / F.col("close") - 1))


def volume_bucket(bars: DataFrame, n: int = 20, high: float = 1.5) -> DataFrame:
    """high or normal against the mean volume of the n bars before; null without them."""
    base = full(F.avg("volume"), "volume", n, 1)
    return bars.withColumn("bucket", F.when(base > 0, F.when(F.col("volume") >= high * base, "high").otherwise("normal")))


def pattern_backtest(bars: DataFrame, horizons: tuple[int, ...] = (5, 10), by_volume: bool = False, least: int = 12) -> DataFrame:
    """Outcomes by pattern and horizon (and volume bucket, with null for all): n, hit rate, mean and signed mean return."""
    rows = bars
    for h in horizons:
        rows = forward_return(rows, h)
    rows = volume_bucket(rows).withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= least)
    cols = ["symbol", "date", "bucket", *[f"fwd_{h}" for h in horizons]]
    hits = candlestick_patterns(bars).where("direction <> 0").select("symbol", "date", "pattern", "direction").join(rows.select(*cols), ["symbol", "date"])
    both = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("ret")) for h in horizons]))
    hits = hits.select("pattern", "direction", "bucket", both.alias("x")).select("pattern", "direction", "bucket", "x.*").where("ret is not null")
    hit = F.avg(F.when(F.col("direction") * F.col("ret") > 0, 1.0).otherwise(0.0))
    stats = [F.count("*").alias("n"), hit.alias("hit_rate"), F.avg("ret").alias("mean_ret"), F.avg(F.col("ret") * F.col("direction")).alias("signed_ret")]
    if not by_volume:
        return hits.groupBy("pattern", "horizon").agg(*stats)
    split = hits.where("bucket is not null").groupBy("pattern", "horizon", "bucket").agg(*stats)
    return split.unionByName(hits.groupBy("pattern", "horizon").agg(*stats).withColumn("bucket", F.lit("all")))


def downtrend_stats(trends: DataFrame, sector: str = "sector", tier: str = "tier") -> DataFrame:
    """Count, median, mean and whole-number percentiles of duration: overall, by sector and by tier in one pass."""
    p = [F.floor(F.percentile("bars", F.lit(q))).cast("long").alias(f"p{int(q * 100)}") for q in (0.25, 0.75, 0.9)]
    out = trends.groupingSets([[], [sector], [tier]], sector, tier)
    return out.agg(F.count("*").alias("n"), F.percentile("bars", F.lit(0.5)).alias("median"), F.avg("bars").alias("mean"), *p, F.grouping_id().cast("int").alias("level"))
