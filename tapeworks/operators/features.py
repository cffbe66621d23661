"""Features of a daily bar panel: every frame shares one partitioning and ordering, so Spark sorts each symbol once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by() -> WindowSpec:
    """A symbol's rows in date order."""
    return Window.partitionBy("symbol").orderBy("date")


def frame(n: int, shift: int = 0):
    """The last n rows, `shift` rows back."""
    return by().rowsBetween(-(n - 1) - shift, -shift)


def full(agg: Column, of: Column | str, n: int, shift: int = 0, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null until `least` (all n) of them hold a value."""
    return F.when(F.count(of).over(frame(n, shift)) >= (least or n), agg.over(frame(n, shift)))


def sma(bars: DataFrame, n: int, col: str = "close") -> DataFrame:
    return bars.withColumn(f"sma_{n}", full(F.avg(col), col, n))


def true_range() -> Column:
    back = F.lag("close").over(by())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - back), F.abs(F.col("low") - back))


def atr(bars: DataFrame, n: int) -> DataFrame:
    """Mean of the last n true ranges; 0 with fewer than n + 1 bars."""
    rows = bars.withColumn("_tr", F.when(F.lag("close").over(by()).isNotNull(), true_range()))
    return rows.withColumn(f"atr_{n}", F.coalesce(full(F.avg("_tr"), "_tr", n), F.lit(0.0))).drop("_tr")


def daily_features(bars: DataFrame, ma: tuple[int, int, int] = (20, 50, 200), rs: int = 120) -> DataFrame:
    """Returns, moving averages, relative volume, prior extremes, close position, gap, relative strength and ATR."""
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    rows = bars.withColumn("prev_close", F.lag("close").over(by())).withColumn("_tr", F.greatest(h - low, F.abs(h - F.lag("close").over(by())), F.abs(low - F.lag("close").over(by()))))
    for n in ma:
        rows = rows.withColumn(f"ma{n}", full(F.avg("close"), "close", n))
    rows = rows.withColumn("vol_avg20", full(F.avg("volume"), "volume", 20))
    return rows.select(
        "*",
        (c / F.col("prev_close") - 1).alias("ret_1d"),
        F.when(F.col("vol_avg20") > 0, v / F.col("vol_avg20")).alias("rel_volume"),
        full(F.max("high"), "high", 20, 1).alias("high20_prev"),
        full(F.min("low"), "low", 20, 1).alias("low20_prev"),
        F.when(h > low, (c - low) / (h - low)).alias("close_pos"),
        (F.col("open") / F.col("prev_close") - 1).alias("gap"),
        (c / F.lag("close", rs).over(by()) - 1).alias(f"rs_{rs}"),
        full(F.avg("_tr"), "_tr", 14).alias("atr14"),
        (full(F.avg("_tr"), "_tr", 14) / c).alias("atr_pct"),
    ).drop("_tr")


def rolling_zscore(rows: DataFrame, col: str, n: int = 60, least: int = 30) -> DataFrame:
    """(x - mean) / population deviation of the last n rows; null with fewer than `least` values or no deviation."""
    f = frame(n)
    sd = F.stddev_pop(col).over(f)
    return rows.withColumn(f"{col}_z", F.when((F.count(col).over(f) >= least) & (sd > 0), (F.col(col) - F.avg(col).over(f)) / sd))


def historical_volatility(bars: DataFrame, n: int = 30) -> DataFrame:
    """Population deviation of the last n log returns, a year of 252 sessions."""
    rows = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(by())))
    return rows.withColumn("hv", full(F.stddev_pop("_r"), "_r", n) * F.sqrt(F.lit(252.0))).drop("_r")


def range_52w(bars: DataFrame, n: int = 252, volume_n: int = 50) -> DataFrame:
    """High, positive low and mean volume of the past year as of each date, and the distances to both."""
    f = frame(n)
    rows = bars.withColumn("year_high", F.max("high").over(f)).withColumn("year_low", F.min(F.when(F.col("low") > 0, F.col("low"))).over(f)).withColumn("avg_volume", F.avg("volume").over(frame(volume_n)))
    return rows.withColumn("from_high", (F.col("year_high") - F.col("close")) / F.col("year_high")).withColumn("from_low", (F.col("close") - F.col("year_low")) / F.col("close"))


def as_of_session(bars: DataFrame, as_of: str) -> DataFrame:
    """One row: the last session on or before a date."""
    return bars.where(F.col("date") <= F.lit(as_of).cast("date")).agg(F.max("date").alias("session"))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("_n = 1").drop("_n")


def trend_template(bars: DataFrame, short: int = 50, middle: int = 150, long: int = 200, back: int = 22) -> DataFrame:
    """Seven criteria of a rising trend, 14.3 points each, their sum, and the score after the penalty for a close far
    above the short mean; the penalty for one far above the long mean is reported only."""
    rows = bars
    for k, n in (("s", short), ("m", middle), ("l", long)):
        rows = rows.withColumn(f"_{k}", full(F.avg("close"), "close", n))
    rows = rows.withColumn("_hi", F.max("high").over(frame(252))).withColumn("_lo", F.min("low").over(frame(252))).withColumn("_back", F.lag("_l", back).over(by()))
    c = F.col("close")
    tests = [
        (c > F.col("_m")) & (c > F.col("_l")), F.col("_m") > F.col("_l"), F.col("_l") > F.col("_back"), (F.col("_s") > F.col("_m")) & (F.col("_s") > F.col("_l")),
        c > F.col("_s"), c >= F.col("_lo") * 1.25, c >= F.col("_hi") * 0.75,
    ]
    flags = [F.coalesce(t, F.lit(False)) for t in tests]
    score = sum((F.when(f, 14.3).otherwise(0.0) for f in flags), F.lit(0.0))
    near, far = (F.round((c - F.col(m)) / F.col(m) * 100, 9) for m in ("_s", "_l"))
    extended = F.coalesce(F.when(near >= 25, -20).when(near >= 18, -15).when(near >= 12, -10).when(near >= 8, -5), F.lit(0))
    long_extended = F.coalesce(F.when(far >= 70, -20).when(far >= 60, -15).when(far > 50, -10), F.lit(0))
    raw = F.round(F.least(score, F.lit(100.0)), 1)
    return rows.select("symbol", "date", "close", F.array(*flags).alias("criteria"), raw.alias("raw_score"), extended.alias("extended_penalty"), long_extended.alias("sma200_penalty"), F.round(F.greatest(F.lit(0.0), raw + extended), 1).alias("score"))


def period_return(bars: DataFrame, n: int, both_ends: bool = False) -> DataFrame:
    """Return over n bars; with both_ends the n bars include the first and the last."""
    return bars.withColumn(f"ret_{n}", F.col("close") / F.lag("close", n - 1 if both_ends else n).over(by()) - 1)


def volume_pattern(bars: DataFrame) -> DataFrame:
    """50-day mean volume, dry-up (ten bars before the last against it), last bar's ratio, net up days on high volume."""
    f50 = frame(50)
    rows = bars.withColumn("avg50", F.avg("volume").over(f50)).withColumn("_up", F.signum(F.col("close") - F.lag("close").over(by())))
    above = F.when(F.col("volume") > F.col("avg50"), F.col("_up")).otherwise(0.0)
    rows = rows.withColumn("_net", above)
    return rows.select("symbol", "date", "avg50", (F.avg("volume").over(frame(10, 1)) / F.col("avg50")).alias("dry_up"), (F.col("volume") / F.col("avg50")).alias("last_ratio"), F.sum("_net").over(frame(20)).alias("net_days"))


def supply_demand(bars: DataFrame, n: int = 60, least: int = 10) -> DataFrame:
    """Mean volume of up days over that of down days; null without `least` of each."""
    rows = bars.withColumn("_d", F.col("close") - F.lag("close").over(by()))
    f = frame(n)
    up, down = F.when(F.col("_d") > 0, F.col("volume")), F.when(F.col("_d") < 0, F.col("volume"))
    ok = (F.count(up).over(f) >= least) & (F.count(down).over(f) >= least)
    return rows.select("symbol", "date", F.when(ok, F.when(F.avg(down).over(f) > 0, F.avg(up).over(f) / F.avg(down).over(f)).otherwise(5.0)).alias("ratio"))


def streak(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """Length of the run of true flags that ends at each row."""
    off = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(by())
    rows = rows.withColumn("_run", off)
    return rows.withColumn(name, F.sum(F.when(F.col(flag), 1).otherwise(0)).over(Window.partitionBy("symbol", "_run").orderBy("date"))).drop("_run")


def acceleration(bars: DataFrame) -> DataFrame:
    """Returns over 3, 5, 10, 15 bars, trailing rising closes, mean daily return of 3 bars over that of 10."""
    back = F.lag("close").over(by())
    rows = bars.withColumn("_r", F.col("close") / back - 1).withColumn("_g", F.coalesce(F.col("close") > back, F.lit(False)))
    for n in (3, 5, 10, 15):
        rows = rows.withColumn(f"ret_{n}", F.col("close") / F.lag("close", n).over(by()) - 1)
    slow = full(F.avg("_r"), "_r", 10)
    rows = rows.withColumn("accel", F.when(slow != 0, full(F.avg("_r"), "_r", 3) / slow))
    return streak(rows, "_g", "green").drop("_r", "_g")


def ma_extension(bars: DataFrame) -> DataFrame:
    """Distance to the 10, 20 and 50 bar means in %, and to the 20 bar mean in true ranges."""
    rows = atr(bars, 14)
    for n in (10, 20, 50):
        rows = rows.withColumn(f"ext_{n}", (F.col("close") / full(F.avg("close"), "close", n) - 1) * 100)
    return rows.withColumn("ext_atr", F.when(F.col("atr_14") > 0, (F.col("close") - full(F.avg("close"), "close", 20)) / F.col("atr_14")))


def range_expansion(bars: DataFrame) -> DataFrame:
    """Mean true range of five bars over that of the twenty before."""
    rows = bars.withColumn("_tr", true_range())
    base = full(F.avg("_tr"), "_tr", 20, 5)
    return rows.withColumn("expansion", F.when(base > 0, F.avg("_tr").over(frame(5)) / base)).drop("_tr")


def liquidity_metrics(bars: DataFrame) -> DataFrame:
    """Mean dollar volume of 20 bars, the last volume over the mean of the 20 before, 20 over 60 bar volume."""
    prior = full(F.avg("volume"), "volume", 20, 1)
    long = F.avg("volume").over(frame(60))
    rows = bars.withColumn("_dv", F.col("close") * F.col("volume"))
    return rows.select("*", F.avg("_dv").over(frame(20)).alias("adv20"), F.when(prior > 0, F.col("volume") / prior).alias("volume_ratio"), F.when(long > 0, F.avg("volume").over(frame(20)) / long).alias("ratio_20_60")).drop("_dv")


def cross_rank(rows: DataFrame, col: str, name: str) -> DataFrame:
    """Average-rank percentile of a column among a day's rows; null stays null."""
    day = Window.partitionBy("date")
    x = F.col(col)
    below = F.rank().over(Window.partitionBy("date", x.isNull()).orderBy(x))
    ties = F.count(x).over(Window.partitionBy("date", col))
    return rows.withColumn(name, F.when(x.isNotNull(), (below + (ties - 1) / 2) / F.count(x).over(day)))


def universe_percentile(rows: DataFrame, col: str, name: str) -> DataFrame:
    """100 * share of a day's rows at or below, rounded half to even, capped at 74 / 84 / 94 for days of under 5 / 10 / 20 rows."""
    day = Window.partitionBy("date")
    n = F.count(col).over(day)
    share = F.bround(100 * F.count(col).over(Window.partitionBy("date").orderBy(col)) / n)
    cap = F.when(n < 5, 74).when(n < 10, 84).when(n < 20, 94).otherwise(100)
    return rows.withColumn(name, F.when(F.col(col).isNotNull(), F.least(share, cap)).otherwise(0).cast("long"))
