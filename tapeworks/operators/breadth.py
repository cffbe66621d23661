"""Scores of a breadth series by date, of sector panels, and weighted component scores.

A breadth series is small (one row a date), so its windows over dates need no partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp, step_score

def by_date() -> WindowSpec:
    return Window.orderBy("date")


def last_n(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def history_percentile(series: DataFrame, col: str, mid_rank: bool = False) -> DataFrame:
    """One row: share of all values below the latest one, in %; with mid_rank equal values count half."""
    latest = series.agg(F.max_by(col, "date").alias("latest"))
    rows = series.join(F.broadcast(latest), F.lit(True))
    x = F.when(F.col(col) < F.col("latest"), 1.0).when(F.lit(mid_rank) & (F.col(col) == F.col("latest")), 0.5).otherwise(0.0)
    return rows.where(F.col(col).isNotNull()).agg(F.max("latest").alias("latest"), (F.avg(x) * 100).alias("pct"))


def run_length(series: DataFrame, flag: Column, name: str) -> DataFrame:
    """Length of the run of true flags that ends at each date."""
    rows = series.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(by_date()))
    return rows.withColumn(name, F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(Window.partitionBy("_g").orderBy("date"))).drop("_f", "_g")


def breadth_series(days: DataFrame, raw: str = "b50") -> DataFrame:
    """8 and 200 row means of a raw breadth value and the direction of the long one (compared at nine decimals)."""
    rows = days.select("date", F.col(raw).alias("raw"), "market_ret").withColumn("ma8", F.avg("raw").over(last_n(8))).withColumn("ma200", F.avg("raw").over(last_n(200)))
    return rows.withColumn("trend", F.when(F.round("ma200", 9) >= F.lag(F.round("ma200", 9)).over(by_date()), 1).otherwise(-1))


def pink_zone(series: DataFrame) -> DataFrame:
    """Trailing run of dates with a falling long mean and the short mean below it."""
    return run_length(series, (F.col("trend") == -1) & (F.round("ma8", 9) < F.round("ma200", 9)), "streak").select("date", "streak")


#: Ladders of the short mean's level and of its gap over the long mean.
LEVELS = [(0.7, 95), (0.6, 80), (0.5, 65), (0.4, 50), (0.3, 35), (0.2, 20)]
GAPS = [(0.15, 95), (0.10, 80), (0.05, 65), (0.0, 50), (-0.05, 35), (-0.10, 20)]


def level_and_gap(series: DataFrame) -> DataFrame:
    """level: the short mean's ladder 70 %, the long mean's trend 30 % (80 up, 20 down), and what its move over five rows
    changes; gap: the ladder of both means' gap, 10 more for a recovery below, 10 less for a decline above (50 before
    the sixth row). Values are compared at nine decimals."""
    short, long = F.round("ma8", 9), F.round("ma200", 9)
    old = F.lag(short, 5).over(by_date())
    turn = F.when((short < old) & (short > 0.6), -10).when((short < old) & (short < 0.4), 5).when((short > old) & (short < 0.6), 5).otherwise(0)
    level = F.bround(0.7 * step_score(short, LEVELS, 5) + 0.3 * F.when(F.col("trend") == 1, 80).otherwise(20)) + turn
    gap = F.round(short - long, 9)
    mend = F.when((gap < 0) & (short > old), 10).when((gap > 0) & ~(short > old), -10).otherwise(0)
    gapped = F.when(old.isNull(), 50.0).otherwise(clamp(step_score(gap, GAPS, 5) + mend, 0.0, 100.0))
    return series.select("date", clamp(level, 0.0, 100.0).alias("level"), gapped.alias("gap"))


def divergence(series: DataFrame, long: int = 60, short: int = 20) -> DataFrame:
    """Breadth change less index change over 60 and 20 rows (both ends counted), blended 0.6 and 0.4."""
    rows = series.withColumn("idx", F.exp(F.sum(F.log(1 + F.coalesce("market_ret", F.lit(0.0)))).over(by_date())))

    def lead(n: int) -> Column:
        return (F.col("ma8") - F.lag("ma8", n - 1).over(by_date())) - (F.col("idx") / F.lag("idx", n - 1).over(by_date()) - 1) / 10

    return rows.select("date", (0.6 * lead(long) + 0.4 * lead(short)).alias("divergence"))


def cycle_markers(series: DataFrame, k: int = 10, n: int = 120) -> DataFrame:
    """The series with row number i, the latest peak or trough of the short mean within n rows (an extreme among k rows on
    both sides at nine decimals, a peak wins on one row), its level, rows since it, and the direction over five rows."""
    around = by_date().rowsBetween(-k, k)
    x = F.round("ma8", 9)
    rows = series.withColumn("i", F.row_number().over(by_date())).withColumn("_x", x)
    rows = rows.withColumn("top", F.col("_x") == F.max("_x").over(around)).withColumn("low", F.col("_x") == F.min("_x").over(around))
    mark = F.when(F.col("top") | F.col("low"), F.struct("i", F.when(F.col("top"), "peak").otherwise("trough").alias("kind"), F.col("_x").alias("level")))
    rows = rows.withColumn("m", F.max(mark).over(last_n(n)))
    return rows.select("date", "i", F.col("m.kind").alias("marker"), F.col("m.level").alias("level"), (F.col("i") - F.col("m.i")).alias("since"), (F.col("_x") > F.lag("_x", 5).over(by_date())).alias("rising"))


def cycle_position(series: DataFrame, k: int = 10, n: int = 120) -> DataFrame:
    """Latest peak or trough of the short mean within n rows (a peak wins on one row), rows since, direction."""
    return cycle_markers(series, k, n).select("date", "marker", "since", "rising")


def slope_momentum(series: DataFrame) -> DataFrame:
    """Mean of the last ten daily changes of the raw value less that of the ten before."""
    rows = series.withColumn("d", F.col("raw") - F.lag("raw").over(by_date()))
    return rows.select("date", (F.avg("d").over(last_n(10)) - F.avg("d").over(by_date().rowsBetween(-19, -10))).alias("momentum"))


def regression_slope(rows: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """Least-squares slope of each key's last n values."""
    w = Window.partitionBy(key)
    x = rows.withColumn("_k", F.row_number().over(w.orderBy(F.desc("date")))).where(F.col("_k") <= n)
    return x.groupBy(key).agg(F.regr_slope(value, -F.col("_k")).alias("slope"))


def winsorize(rows: DataFrame, col: str, cap: float, least: int = 5) -> DataFrame:
    """Hard cap, then three population deviations of all capped values; skipped for fewer than `least` rows."""
    s = rows.withColumn("_c", clamp(F.col(col), -cap, cap))
    stats = s.agg(F.avg("_c").alias("_m"), F.stddev_pop("_c").alias("_s"), F.count("_c").alias("_n"))
    s = s.join(F.broadcast(stats), F.lit(True))
    lim = F.greatest(F.col("_m") - 3 * F.col("_s"), F.least(F.col("_m") + 3 * F.col("_s"), F.col("_c")))
    return s.withColumn(f"{col}_raw", F.col(col)).withColumn(col, F.when(F.col("_n") >= least, lim).otherwise(F.col("_c"))).drop("_c", "_m", "_s", "_n")


def weighted_score(rows: DataFrame, weights: dict[str, float], renormalise: bool = True) -> DataFrame:
    """Weighted sum of component columns; missing ones give their weight to the others; strongest and weakest."""
    have = [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()]
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum(have, F.lit(0.0)) if renormalise else F.lit(1.0)
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.lit(c).alias("c"))) for c in weights]))
    score = F.when(weight > 0, total / weight)
    zone = F.when(score >= 80, "Strong").when(score >= 60, "Healthy").when(score >= 40, "Neutral").when(score >= 20, "Weak").otherwise("Critical")
    return rows.select("*", score.alias("composite"), F.array_max(pairs)["c"].alias("strongest"), F.array_min(pairs)["c"].alias("weakest"), zone.alias("zone"))


def sector_participation(rows: DataFrame, over: float = 0.37, under: float = 0.097) -> DataFrame:
    """By date from (date, sector, ratio, up): ladder of the number of sectors up 60 %, of the ratios' spread 40 % (50
    without ratios), and how many sectors are extreme."""
    up = F.count_if(F.col("up"))
    count = F.when(up >= 10, 100).when(up >= 8, 80).when(up >= 6, 60).when(up >= 4, 40).when(up >= 2, 20).otherwise(0)
    x = F.round(F.max("ratio") - F.min("ratio"), 9)
    spread = F.when(x.isNull(), 50.0).when(x < 0.15, 100.0).when(x < 0.25, 100 - (x - 0.15) / 0.10 * 20).when(x < 0.35, 80 - (x - 0.25) / 0.10 * 20).when(x < 0.45, 60 - (x - 0.35) / 0.10 * 30).otherwise(F.greatest(F.lit(0.0), 30 - (x - 0.45) / 0.10 * 30))
    score = F.bround(F.round(0.6 * count + 0.4 * spread, 9)).cast("long")
    return rows.groupBy("date").agg(score.alias("score"), up.alias("up"), F.count_if(F.col("ratio") > over).alias("overbought"), F.count_if(F.col("ratio") < under).alias("oversold"))


def sector_groups(rows: DataFrame, groups: dict[str, str]) -> DataFrame:
    """By date: mean ratio of the cyclical, defensive and commodity groups and the score of the first two's difference.

    5 points off where commodities lead both (10 by over 0.10), and 5 where a group of two or more sectors is divided:
    deviation over 0.08, spread over 0.20, or a sector against its group's majority (up on a tie). 50 without either
    group. rows: date, sector, ratio, up; groups: sector -> cyclical, defensive or commodity."""
    side = F.element_at(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]), F.col("sector"))
    per = rows.withColumn("g", side).where("g is not null and ratio is not null").groupBy("date", "g").agg(
        F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sd"), (F.max("ratio") - F.min("ratio")).alias("spread"), F.count("*").alias("n"), F.count_if(F.col("up")).alias("up"))
    split = (F.col("g") != "commodity") & (F.col("n") >= 2) & ((F.round("sd", 9) > 0.08) | (F.round("spread", 9) > 0.20) | ((F.col("up") > 0) & (F.col("up") < F.col("n"))))
    means = {g: F.max(F.when(F.col("g") == g, F.col("mean"))) for g in ("cyclical", "defensive", "commodity")}
    out = per.groupBy("date").agg(*[c.alias(g) for g, c in means.items()], F.max(split).alias("divided"))
    x = F.round(F.col("cyclical") - F.col("defensive"), 9)
    base = (
        F.when(x > 0.15, F.least(F.lit(100.0), 90 + (x - 0.15) / 0.10 * 10)).when(x > 0.05, 70 + (x - 0.05) / 0.10 * 19).when(x > -0.05, 45 + (x + 0.05) / 0.10 * 24)
        .when(x > -0.15, 20 + (x + 0.15) / 0.10 * 24).otherwise(F.greatest(F.lit(0.0), 19 + (x + 0.15) / 0.10 * 19))
    )
    lead = F.round(F.col("commodity") - F.greatest("cyclical", "defensive"), 9)
    late = F.when(lead > 0.10, -10).when(lead > 0, -5).otherwise(0)
    score = F.when(x.isNull(), 50).otherwise(F.bround(F.round(clamp(base + late + F.when(F.col("divided"), -5).otherwise(0), 0.0, 100.0), 9)))
    return out.select("date", "cyclical", "defensive", "commodity", x.alias("difference"), (F.coalesce(lead > 0, F.lit(False))).alias("late_cycle"), "divided", score.cast("long").alias("score"))


def signal_convergence(rows: DataFrame, modules: list[str]) -> DataFrame:
    """100 - 3.33 * population deviation of at least three module scores, +15 if all lean one way."""
    long = rows.unpivot(["date"], modules, "module", "score").where("score is not null")
    unanimous = F.bool_and(F.col("score") >= 50) | F.bool_and(F.col("score") < 50)
    x = clamp(100 - 3.33 * F.stddev_pop("score") + F.when(unanimous, 15).otherwise(0), 0.0, 100.0)
    return long.groupBy("date").agg(F.when(F.count("*") >= 3, x).alias("convergence"))


def nearest_pattern(vectors: DataFrame, library: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Each row's nearest library row by weighted squared distance; the library is a short fixed list."""
    lib = F.broadcast(library.select(F.col("name"), *[F.col(c).alias(f"l_{c}") for c in weights]))
    dist = sum(((F.col(c) - F.col(f"l_{c}")) ** 2 * w for c, w in weights.items()), F.lit(0.0))
    return vectors.join(lib, F.lit(True)).withColumn("distance", dist).groupBy("date").agg(F.min_by("name", F.struct("distance", "name")).alias("match"), F.min("distance").alias("distance"))


def exposure(rows: DataFrame, weights: dict[str, float], critical: list[str]) -> DataFrame:
    """Weighted mean of available inputs, 10 off per missing critical one, with ceiling and advice."""
    base = weighted_score(rows, weights)
    missing = sum((F.when(F.col(c).isNull(), 10).otherwise(0) for c in critical), F.lit(0))
    score = clamp(F.coalesce("composite", F.lit(0.0)) - missing, 0.0, 100.0)
    out = base.withColumn("exposure", score)
    ceiling = F.when(F.col("exposure") >= 80, 100).when(F.col("exposure") >= 65, 80).when(F.col("exposure") >= 50, 60).when(F.col("exposure") >= 35, 40).otherwise(20)
    return out.select("date", "exposure", ceiling.alias("ceiling"), F.when(F.col("exposure") >= 65, "NEW_ENTRY_ALLOWED").when(F.col("exposure") >= 35, "REDUCE_ONLY").otherwise("CASH_PRIORITY").alias("advice"))
