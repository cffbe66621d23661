"""Industries and themes: ranking, heat, life cycle and overlaps. Themes and industries are tables of hundreds of rows;
what grows (stocks, members, sector rows) is aggregated by theme first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp, industry_momentum, theme_momentum

# Weights of the horizons, of heat and of maturity, the upper ends of the fund ladder and the stages.
HORIZONS = {"perf_1w": 0.10, "perf_1m": 0.25, "perf_3m": 0.35, "perf_6m": 0.30}
HEAT = {"momentum": 0.35, "volume": 0.20, "uptrend": 0.25, "breadth": 0.20}
MATURITY = {"duration": 0.25, "extremity": 0.25, "price_extreme": 0.25, "valuation": 0.15, "funds": 0.10}
FUNDS = [(0, 0.0), (1, 20.0), (3, 40.0), (6, 60.0), (10, 80.0)]
STAGES = [(20, "Emerging"), (40, "Accelerating"), (60, "Trending"), (80, "Mature")]


def volume_intensity(short: Column, long: Column) -> Column:
    """Square root of the volume ratio's excess over 0.8, 100 from a ratio of 2; 50 where a mean is missing."""
    return F.when(short.isNull() | long.isNull() | (long == 0), F.lit(50.0)).otherwise(F.least(F.lit(100.0), F.sqrt(F.greatest(F.lit(0.0), short / long - 0.8)) / F.sqrt(F.lit(1.2)) * 100))


def breadth_signal(ratio: Column, industries: Column) -> Column:
    """Power curve of the share of members that agree, and 2 points for each industry up to 20; 50 without a share."""
    score = F.pow(F.greatest(F.lit(0.0), ratio), F.lit(2.5)) * 80 + F.least(F.lit(20.0), industries * 2.0)
    return F.when(ratio.isNull(), F.lit(50.0)).otherwise(clamp(score, 0.0, 100.0))


def weighted_return() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in HORIZONS.items()), F.lit(0.0))


def rank_industries(industries: DataFrame) -> DataFrame:
    """weighted_return, momentum_score, direction, rank and rank_direction (the upper half is bullish); ties by name."""
    rows = industries.withColumn("_w", weighted_return())
    rows = rows.withColumn("weighted_return", F.round("_w", 4)).withColumn("momentum_score", F.round(industry_momentum(F.col("_w")), 2)).withColumn("direction", F.when(F.col("_w") > 0, "bullish").otherwise("bearish"))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("momentum_score"), "name")))  # one row per industry
    half = F.floor(F.count("*").over(Window.partitionBy()) / 2)
    return rows.withColumn("rank_direction", F.when(F.col("rank") <= half, "bullish").otherwise("bearish")).drop("_w")


def uptrend_signal(sectors: DataFrame) -> DataFrame:
    """theme, up: weighted mean over sectors of the uptrend ratio (80 at most), 10 above its mean, 10 if it rises.

    sectors: theme, ratio, ma_10, slope, weight; a weight of null or 0 counts as 1, other nulls as 0."""
    zero = F.lit(0.0)
    ratio, mean, slope = (F.coalesce(F.col(c), zero) for c in ("ratio", "ma_10", "slope"))
    weight = F.when(F.coalesce(F.col("weight"), zero) == 0, F.lit(1.0)).otherwise(F.col("weight"))
    score = F.least(F.lit(80.0), ratio * 100) + F.when(ratio > mean, 10.0).otherwise(0.0) + F.when(slope > 0, 10.0).otherwise(0.0)
    return sectors.groupBy("theme").agg((F.sum(score * weight) / F.sum(weight)).alias("up"))


def _share(hit: Column, valid: Column) -> Column:
    """Twice the share of valid rows that hit, in %, 100 at most; 50 if none is valid."""
    return F.coalesce(F.least(F.lit(100.0), F.sum(F.when(valid & hit, 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(valid, 1.0).otherwise(0.0)), F.lit(0.0)) * 200), F.lit(50.0))


def theme_scores(themes: DataFrame, members: DataFrame, industries: DataFrame, stocks: DataFrame, sectors: DataFrame) -> DataFrame:
    """Heat with its four parts, maturity with its five, stage and divergence of each theme.

    themes: theme, direction, vol_20d, vol_60d, funds; members: theme, name; industries: name and the perf_ columns,
    perf_1y too; stocks: theme, rsi, dist_high, dist_low, pe; sectors: see uptrend_signal. A part without data is 50.
    """
    joined = members.join(industries, "name").join(themes.select("theme", "direction"), "theme").withColumn("_w", F.round(weighted_return(), 4))
    agrees = F.when(F.col("direction") == "bearish", F.col("_w") < 0).otherwise(F.col("_w") > 0)
    of = joined.groupBy("theme").agg(F.count("*").alias("n"), F.avg("_w").alias("mean"), F.avg(F.when(agrees, 1.0).otherwise(0.0)).alias("ratio"), *[F.avg(c).alias(c) for c in ("perf_1m", "perf_3m", "perf_6m", "perf_1y")])
    bear = F.first("direction") == "bearish"
    held = stocks.join(themes.select("theme", "direction"), "theme")
    near = F.when(F.col("direction") == "bearish", F.col("dist_low")).otherwise(F.col("dist_high"))
    far = F.when(F.col("direction") == "bearish", F.col("rsi") < 30).otherwise(F.col("rsi") > 70)
    paid = F.when(F.col("pe") > 0, F.col("pe"))
    held = held.groupBy("theme").agg(
        _share(far, F.col("rsi").isNotNull()).alias("extremity"), _share(near <= 0.05, near.isNotNull()).alias("price_extreme"),
        F.when(F.count(paid) >= 3, clamp((F.median(paid) / 22 - 0.5) * 32, 0.0, 100.0)).otherwise(50.0).alias("valuation"), bear.alias("_bear"))
    rows = themes.join(of, "theme", "left").join(held, "theme", "left").join(uptrend_signal(sectors), "theme", "left")
    is_bear = F.col("direction") == "bearish"
    active = sum((F.when(F.when(is_bear, F.col(c) < -2).otherwise(F.col(c) > 2), 25.0).otherwise(0.0) for c in ("perf_1m", "perf_3m", "perf_6m", "perf_1y")), F.lit(0.0))
    funds = F.lit(100.0)
    for top, score in FUNDS[::-1]:
        funds = F.when(F.col("funds") <= top, score).otherwise(funds)
    parts = {
        "momentum": F.coalesce(theme_momentum(F.col("mean")), F.lit(50.0)), "volume": volume_intensity(F.col("vol_20d"), F.col("vol_60d")),
        "uptrend": F.coalesce(F.when(is_bear, 100 - F.col("up")).otherwise(F.col("up")), F.lit(50.0)), "breadth": breadth_signal(F.col("ratio"), F.coalesce("n", F.lit(0))),
        "duration": active, "extremity": F.coalesce("extremity", F.lit(50.0)), "price_extreme": F.coalesce("price_extreme", F.lit(50.0)), "valuation": F.coalesce("valuation", F.lit(50.0)), "funds": funds,
    }
    rows = rows.select("theme", "direction", *[c.cast("double").alias(k) for k, c in parts.items()])
    heat, age = (sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) for weights in (HEAT, MATURITY))
    rows = rows.withColumn("heat", clamp(heat, 0.0, 100.0)).withColumn("maturity", clamp(age, 0.0, 100.0))
    stage = F.lit("Exhausting")
    for top, name in STAGES[::-1]:
        stage = F.when(F.col("maturity") < top, name).otherwise(stage)
    gap = F.col("momentum") - F.col("uptrend")
    return rows.withColumn("stage", stage).withColumn("divergence", F.when(F.abs(gap) >= 25, F.when(gap > 0, "narrow_rally").otherwise("internal_recovery")))


def overlap_dedup(themes: DataFrame, members: DataFrame, sector_funds: dict[str, str], limit: float = 0.5) -> DataFrame:
    """Themes that stay, with funds: vertical ones go if a seed of their direction holds `limit` of the smaller set;
    discovered ones also for any older theme, or by Jaccard. A vertical theme without funds takes those of the seed that
    overlaps most (of any direction, from `limit` on), else its main sector's.

    themes: theme, origin (seed, vertical, discovered), direction, funds; members: theme, name, sector.
    """
    size = members.groupBy("theme").agg(F.countDistinct("name").alias("size"))
    who = themes.select("theme", "origin", "direction", "funds").join(size, "theme")
    at = members.select("theme", "name").distinct()
    pairs = at.join(at.select(F.col("theme").alias("other"), "name"), "name").where("theme <> other").groupBy("theme", "other").agg(F.count("*").alias("both"))
    old = who.select(F.col("theme").alias("other"), F.col("origin").alias("o2"), F.col("direction").alias("d2"), F.col("funds").alias("f2"), F.col("size").alias("s2"))
    pairs = pairs.join(who, "theme").join(old, "other").where("(origin = 'vertical' and o2 = 'seed') or (origin = 'discovered' and o2 <> 'discovered')")
    small, jaccard = F.col("both") / F.least("size", "s2"), F.col("both") / (F.col("size") + F.col("s2") - F.col("both"))
    pairs = pairs.withColumn("overlap", small)
    gone = pairs.where((F.col("direction") == F.col("d2")) & ((small >= limit) | (F.col("origin") == "discovered") & (jaccard >= limit))).select("theme").distinct()
    best = pairs.where("origin = 'vertical'").groupBy("theme").agg(F.max_by(F.struct("overlap", "f2"), F.struct("overlap", F.col("other"))).alias("b"))
    counts = members.where("sector is not null").groupBy("theme", "sector").agg(F.count("*").alias("n"))
    main = counts.groupBy("theme").agg(F.max_by("sector", F.struct("n", "sector")).alias("main"))
    table = F.create_map(*[F.lit(x) for kv in sector_funds.items() for x in kv])
    rows = themes.join(gone, "theme", "left_anti").join(best, "theme", "left").join(main, "theme", "left")
    own = F.when(F.col("b.overlap") >= limit, F.col("b.f2")).otherwise(F.element_at(table, F.col("main")))
    return rows.select("theme", "origin", "direction", F.when((F.col("origin") == "vertical") & F.col("funds").isNull(), own).otherwise(F.col("funds")).alias("funds"))
