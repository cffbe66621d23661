"""Scores of breadth and relative strength by ladders of fixed values.

A breadth series has one row a date, so windows over dates need no partition key. Values are compared at nine decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp, step_score
from tapeworks.operators.breadth import by_date, cycle_markers, last_n, run_length

# Fixed values.
#: Percentile of relative strength -> score; under all 20.
PERCENTILES = [(95, 100), (85, 90), (75, 80), (60, 70), (45, 60), (30, 50), (15, 40)]
#: (signal, direction of the long mean) -> base of the bearish-signal score.
BEARISH = {(False, 1): 85, (False, -1): 50, (True, 1): 30, (True, -1): 10}
#: (marker, short mean rising) -> scores within 20 rows of the marker, within 60 and later.
CYCLE = {("trough", True): (85, 75, 65), ("trough", False): (30, 35, 40), ("peak", True): (60, 45, 50), ("peak", False): (20, 15, 10)}
#: Index change over and breadth change under these (or both with the other sign) -> score.
BEARISH_GAPS = [(3.0, -0.05, 10), (1.0, -0.03, 25)]
BULLISH_GAPS = [(-3.0, 0.05, 80), (-1.0, 0.03, 65)]
#: From a slope on: score there, and points more for each 0.01; under all 9 points less 9 for each 0.01.
SLOPES = [(0.02, 95, 5), (0.01, 75, 19), (0.0, 55, 19), (-0.01, 35, 19), (-0.02, 10, 24)]
#: Change of the mean slope above these -> score; under all 10.
ACCELERATIONS = [(0.005, 90), (0.001, 75), (-0.001, 50), (-0.005, 25)]


def percentile_score(rows: DataFrame, col: str, pct: str) -> DataFrame:
    """score of a percentile column; 0 where the strength `col` it ranks is null."""
    return rows.withColumn("score", F.when(F.col(col).isNull(), 0.0).otherwise(step_score(F.col(pct), PERCENTILES, 20)))


def bearish_score(series: DataFrame, signal: Column) -> DataFrame:
    """By date: base by signal and direction; an active signal gains 15 with a short mean over 0.5 and loses 5 under 0.25;
    without one the zone of a falling long mean over the short one costs 10. A null signal is none."""
    short = F.round("ma8", 9)
    rows = run_length(series, (F.col("trend") == -1) & (short < F.round("ma200", 9)), "streak").withColumn("active", F.coalesce(signal, F.lit(False)))
    base = F.coalesce(*[F.when((F.col("active") == on) & (F.col("trend") == way), F.lit(float(v))) for (on, way), v in BEARISH.items()])
    context = F.when(F.col("active") & (short > 0.5), 15).when(F.col("active") & (short < 0.25), -5).when(~F.col("active") & (F.col("streak") > 0), -10).otherwise(0)
    return rows.select("date", "active", "streak", clamp(base + context, 0.0, 100.0).alias("score"))


def cycle_score(series: DataFrame, k: int = 10, n: int = 120, deep: float = 0.4) -> DataFrame:
    """By date: the latest marker (cycle_markers), whether it is a trough under `deep` (10 points more), and the score by
    its age and the short mean's move over five rows; 50 without a marker or before the tenth row."""
    rows = cycle_markers(series, k, n).withColumn("up", F.coalesce("rising", F.lit(False)))
    extreme = F.coalesce((F.col("marker") == "trough") & (F.col("level") < deep), F.lit(False))
    ages = [F.when((F.col("marker") == kind) & (F.col("up") == up), F.when(F.col("since") <= 20, float(a)).when(F.col("since") <= 60, float(b)).otherwise(float(c))) for (kind, up), (a, b, c) in CYCLE.items()]
    score = F.when(F.col("i") < 10, 50.0).otherwise(F.coalesce(F.coalesce(*ages) + F.when(extreme, 10).otherwise(0), F.lit(50.0)))
    return rows.select("date", "marker", "since", "rising", extreme.alias("extreme"), clamp(score, 0.0, 100.0).alias("score"))


def divergence_score(series: DataFrame, long: int = 60, short: int = 20) -> DataFrame:
    """By date with a breadth value: scores of index change (%) against breadth change over the last `long` and `short` rows
    (both ends counted, fewer rows as they are), their blend 0.6 and 0.4, and an early warning: the short one at most 25
    while the long one is 50 or more. 50 and no warning before the row `short`."""
    rows = series.withColumn("idx", F.exp(F.sum(F.log(1 + F.coalesce("market_ret", F.lit(0.0)))).over(by_date()))).where("ma8 is not null")
    rows = rows.withColumn("i", F.row_number().over(by_date()))

    def score(n: int) -> Column:
        index = F.round((F.col("idx") / F.first("idx").over(last_n(n)) - 1) * 100, 9)
        breadth = F.round(F.col("ma8") - F.first("ma8").over(last_n(n)), 9)
        x = F.when(F.lit(False), 0.0)
        for i, b, v in BEARISH_GAPS:
            x = x.when((index > i) & (breadth < b), float(v))
        for i, b, v in BULLISH_GAPS:
            x = x.when((index < i) & (breadth > b), float(v))
        flat = (F.abs(index) < 0.5) & (F.abs(breadth) < 0.01)
        return x.when(flat, 50.0).when((index > 0) & (breadth > 0), 70.0).when((index <= 0) & (breadth <= 0), 30.0).otherwise(50.0)

    rows = rows.withColumn("long", score(long)).withColumn("short", score(short))
    early = F.col("i") < short
    whole = F.when(early, 50.0).otherwise(F.round(0.6 * F.col("long") + 0.4 * F.col("short"), 1))
    return rows.select("date", "long", "short", whole.alias("score"), (~early & (F.col("short") <= 25) & (F.col("long") >= 50)).alias("early_warning"))


def smoothed_slopes(series: DataFrame, reach: int = 64) -> DataFrame:
    """(date, slope, smooth): daily changes of the raw value and their exponential mean of span 3, seeded by the first.

    Its weights halve with each row, so what lies `reach` rows back is below a double's precision: the mean is folded over
    the last `reach` rows of a window instead of a chain over all dates."""
    rows = series.withColumn("slope", F.col("raw") - F.lag("raw").over(by_date())).where("slope is not null")
    past = F.collect_list("slope").over(last_n(reach))
    return rows.withColumn("past", past).select("date", "slope", F.aggregate("past", F.col("past")[0], lambda a, v: (a + v) / 2).alias("smooth"))


def momentum_score(series: DataFrame, sectors: DataFrame) -> DataFrame:
    """By date with a slope: ladder of the smoothed slope 50 %, of its acceleration 30 % (mean of the last ten less the ten
    before; of five with under twenty rows, 50 with under ten), share of sectors (date, sector, slope) with a rising slope
    20 % (50 without sectors; a null slope does not rise)."""
    s = F.round("smooth", 9)
    level = F.when(F.lit(False), 0.0)
    for start, points, more in SLOPES:
        level = level.when(s >= start, F.least(F.lit(100.0), points + (s - start) / 0.01 * more))
    level = level.otherwise(F.greatest(F.lit(0.0), 9 + (s + 0.02) / 0.01 * 9))
    rows = smoothed_slopes(series).withColumn("i", F.row_number().over(by_date()))

    def change(n: int) -> Column:
        return F.round(F.avg("smooth").over(last_n(n)) - F.avg("smooth").over(by_date().rowsBetween(1 - 2 * n, -n)), 9)

    rows = rows.withColumn("acceleration", F.when(F.col("i") >= 20, change(10)).when(F.col("i") >= 10, change(5)))
    faster = F.when(F.col("acceleration").isNull(), 50.0)
    for over, v in ACCELERATIONS:
        faster = faster.when(F.col("acceleration") > over, float(v))
    wide = sectors.groupBy("date").agg((F.avg(F.when(F.round("slope", 9) > 0, 1.0).otherwise(0.0)) * 100).alias("wide"))
    rows = rows.withColumn("level", level).withColumn("faster", faster.otherwise(10.0)).join(wide, "date", "left")
    blend = 0.5 * F.col("level") + 0.3 * F.col("faster") + 0.2 * F.coalesce("wide", F.lit(50.0))
    return rows.select("date", "smooth", "acceleration", "wide", clamp(F.bround(F.round(blend, 9)), 0.0, 100.0).cast("long").alias("score"))
