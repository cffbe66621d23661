"""Drift after reports: weekly candles cut at the report, the red week, the break above it and a composite of four scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import step_score
from tapeworks.operators.features import frame

#: Weights of the composite, its ratings, and the ladders of gap in %, reward by risk and dollar volume.
WEIGHTS = (("setup", 0.30), ("breakout", 0.25), ("liquidity", 0.25), ("risk_reward", 0.20))
RATINGS = ((85, "Strong Setup"), (70, "Good Setup"), (55, "Developing"))
GAP_LADDER = [(10, 50), (7, 40), (5, 30), (3, 20)]
REWARD_LADDER = [(3.0, 100), (2.5, 85), (2.0, 70), (1.5, 50)]

_KEY = ["symbol", "event", "as_of"]


def _monday(date: str) -> Column:
    return F.to_date(F.date_trunc("week", date))


def halves_up(x: Column | str, digits: int = 2) -> Column:
    """Rounded with halves up, by the same steps as in the SQL."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 10**digits + 0.5) / 10**digits


def review_weeks(bars: DataFrame, reviews: DataFrame, before: int = 13) -> DataFrame:
    """ISO weeks of each review (symbol, event, as_of), from `before` weeks before the event's up to as_of.

    The event's week has only bars from the event on, the last one only bars up to as_of. tail holds the last bar's close
    and the share and dollar volume of its 20 bars. Whole weeks are built once a symbol and met by (symbol, week); only
    the two cut weeks meet daily bars, so a review brings a row a week, not a row a bar.
    """
    shares = F.avg(F.coalesce("volume", F.lit(0.0))).over(frame(20))
    dollars = F.avg(F.when((F.col("volume") > 0) & (F.col("close") > 0), F.col("volume") * F.col("close"))).over(frame(20))
    days = bars.dropna(subset=["symbol", "date", "open", "high", "low", "close"]).select("symbol", "date", "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).cast("double").alias("volume"))
    days = days.withColumn("tail", F.struct("close", shares.alias("shares"), F.coalesce(dollars, shares * F.col("close")).alias("dollars"), F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("bars")))
    days = days.withColumn("week", _monday("date"))
    parts = [F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.max_by("tail", "date").alias("tail")]
    ahead = (F.datediff(_monday("as_of"), _monday("event")) / 7).cast("int")
    spans = reviews.select(*_KEY, F.explode(F.sequence(F.lit(-before), ahead)).alias("k")).withColumn("week", F.date_add(_monday("event"), F.col("k") * 7))
    spans = spans.withColumn("cut", (F.col("k") == 0) | (F.col("week") == _monday("as_of")))
    whole = days.groupBy("symbol", "week").agg(*parts).join(spans.where("not cut"), ["symbol", "week"])
    some = days.join(spans.where("cut"), ["symbol", "week"]).where("date <= as_of and (k <> 0 or date >= event)").groupBy(*_KEY, "week", "k").agg(*parts)
    return whole.select(some.columns).unionByName(some)


def drift_setups(bars: DataFrame, reviews: DataFrame, watch: int = 5, reward: float = 2.0, floors: tuple[float, float, float] = (25e6, 1e6, 10.0), tiers: tuple[float, float] = (100e6, 50e6), before: int = 13) -> DataFrame:
    """Stage, plan and composite of each review: symbol, event (the report's day), as_of, gap (in %, may be null).

    stage: EXPIRED after more than `watch` candles since the event's week; else MONITORING without a red week after it,
    BREAKOUT when the latest candle is green and closes above the latest red one's high, or SIGNAL_READY. Without a bar in
    the event's week from the event on, its age is that of the latest week in days by seven, and every candle but the
    oldest may be red. The stop is the red week's low, the target `reward` times the risk above the last close.
    confirmed: the latest week's volume exceeds the mean of the four weeks before, weeks without volume left out.
    Candles are held in cents, halves up. Liquidity passes by dollar volume, shares and price (`floors`), its best scores by `tiers`.

    Bars with a null price, symbol or date count as absent, a null volume as 0, a null gap as the lowest. Reviews with a
    null, or before their event, and those with fewer than five bars by then are left out; repeated ones give one row by
    the largest gap. Equal scores: the first in the order of WEIGHTS is the weakest. Empty tables give no rows; extra
    columns are ignored.
    """
    asked = reviews.where("symbol is not null and as_of >= event").groupBy(*_KEY).agg(F.max(F.col("gap").cast("double")).alias("gap"))
    w = Window.partitionBy(*_KEY).orderBy(F.desc("week"))
    near, prior, all_rows = w.rowsBetween(-2, 2), w.rowsBetween(1, 4), Window.partitionBy(*_KEY)
    rows = review_weeks(bars, asked, before).withColumn("green", F.col("close") >= F.col("open"))
    for c in ("open", "high", "low", "close"):
        rows = rows.withColumn(c, halves_up(c, 2))
    others = (F.sum("volume").over(near) - F.col("volume")) / F.nullif(F.count("*").over(near) - 1, F.lit(0))
    span = F.col("high") - F.col("low")
    rows = rows.select(
        *_KEY, "week", "k", "open", "high", "low", "close", "volume", "tail", "green", (F.row_number().over(w) - 1).alias("i"), (F.count("*").over(all_rows) - 1).alias("oldest"),
        F.when(others > 0, F.col("volume") / others).otherwise(1.0).alias("ratio"), F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(prior).alias("usual"),
        F.when(span > 0, (F.least("open", "close") - F.col("low")) / span * 100).otherwise(0.0).alias("wick"))
    rows = rows.withColumn("at", F.max(F.when(F.col("k") == 0, F.col("i"))).over(all_rows))
    red_at = F.when(~F.col("green") & (F.col("i") < F.coalesce("at", "oldest")), F.col("i"))
    out = rows.groupBy(*_KEY).agg(
        F.max("at").alias("at"), F.min_by(F.struct("week", "close", "volume", "green", "usual", "tail"), "i").alias("now"), F.min_by(F.struct("week", "high", "low", "wick", "ratio"), red_at).alias("red"))
    out = out.join(asked, _KEY).where("now.tail.bars >= 5")
    age = F.coalesce("at", F.greatest(F.lit(0), F.floor(F.datediff("now.week", "event") / 7)))
    out = out.withColumn("weeks", age.cast("long")).withColumn("red", F.when(F.col("weeks") <= watch, F.col("red"))).withColumn("price", F.col("now.tail.close"))
    broke = F.col("now.green") & (F.col("now.close") > F.col("red.high"))
    out = out.withColumn("stage", F.when(F.col("weeks") > watch, "EXPIRED").when(F.col("red").isNull(), "MONITORING").when(broke, "BREAKOUT").otherwise("SIGNAL_READY"))

    above = F.when(F.col("red.high") > 0, (F.col("price") - F.col("red.high")) / F.col("red.high") * 100)
    out = out.withColumn("above", F.coalesce(above, F.lit(0.0))).withColumn("confirmed", (F.col("above") > 0) & F.coalesce(F.col("now.volume") > F.col("now.usual"), F.lit(False)))
    breakout = F.when(F.col("above") <= 0, 0.0).when((F.col("above") >= 3) & F.col("confirmed"), 100.0).when((F.col("above") >= 2) & F.col("confirmed"), 85.0).when(F.col("above") >= 1, 70.0).otherwise(55.0)
    quality = F.when(F.col("stage") == "BREAKOUT", 50.0).when(F.col("stage") == "SIGNAL_READY", 40.0 + F.when(F.col("red.wick") > 30, 5.0).otherwise(0.0))
    quality = quality.when(F.col("stage") == "MONITORING", F.when(F.col("weeks") <= 2, 25.0).otherwise(15.0)).otherwise(0.0)
    tail = F.col("now.tail")
    passed = sum(((x >= floor).cast("int") for x, floor in zip((tail["dollars"], tail["shares"], F.col("price")), floors, strict=True)), F.lit(0))
    liquidity = F.when(passed == 3, F.when(tail["dollars"] > tiers[0], 100.0).when(tail["dollars"] > tiers[1], 85.0).otherwise(70.0)).when(passed == 2, 40.0).otherwise(15.0)
    stop = F.when((F.col("red.low") > 0) & (F.col("red.low") < F.col("price")), F.col("red.low"))
    out = out.withColumn("stop", stop).withColumn("setup", step_score(F.col("gap"), GAP_LADDER, 10, 10) + quality).withColumn("breakout", breakout).withColumn("liquidity", F.when(F.col("price") > 0, liquidity).otherwise(15.0))
    out = out.withColumn("risk_reward", F.when(F.col("stop").isNull(), 25.0).otherwise(step_score(F.lit(float(reward)), REWARD_LADDER, 25)))
    total = sum((F.col(c) * share for c, share in WEIGHTS), F.lit(0.0))
    out = out.withColumn("composite", F.bround(total, 1))
    rating = F.when(F.col("composite") >= RATINGS[0][0], RATINGS[0][1])
    for floor, name in RATINGS[1:]:
        rating = rating.when(F.col("composite") >= floor, name)
    least = F.least(*[c for c, _ in WEIGHTS])
    weakest = F.coalesce(*[F.when(F.col(c) == least, c) for c, _ in WEIGHTS])
    risk = F.col("price") - F.col("stop")
    return out.select(
        *_KEY, "stage", "weeks", F.col("red.week").alias("red_week"), halves_up("red.wick", 1).alias("wick_pct"), halves_up("red.ratio", 2).alias("red_volume"), halves_up("above", 2).alias("breakout_pct"), "confirmed",
        halves_up("price", 2).alias("entry"), halves_up("stop", 2).alias("stop"), halves_up(F.col("price") + risk * reward, 2).alias("target"), halves_up(risk / F.col("price") * 100, 2).alias("risk_pct"),
        *[c for c, _ in WEIGHTS], "composite", rating.otherwise("Weak").alias("rating"), weakest.alias("weakest"))
