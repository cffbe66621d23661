"""The contraction screen from bars to ranked candidates: trend, contractions, volume, pivot and strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp
from tapeworks.operators import contraction
from tapeworks.operators.events import relative_strength
from tapeworks.operators.features import by, frame, full, latest, trend_template
from tapeworks.operators.folds import fold
from tapeworks.operators.ordered import carried, numbered, stored, stretches, with_carried
from tapeworks.operators.screens import forward_outcome

# Weights, ratings from the highest on, and the highest rating that a state allows.
WEIGHTS = {"trend": 0.25, "contraction": 0.25, "volume": 0.20, "pivot_score": 0.15, "strength": 0.15}
RATINGS = [(90, "Textbook VCP"), (80, "Strong VCP"), (70, "Good VCP"), (60, "Developing VCP"), (50, "Weak VCP"), (None, "No VCP")]
STATE_CAPS = {"Invalid": "No VCP", "Damaged": "No VCP", "Overextended": "Weak VCP", "Extended": "Developing VCP", "Early-post-breakout": "Strong VCP"}


def pivot_score(distance: Column, breakout: Column) -> Column:
    """Score of the distance from the pivot in %, 10 more for a breakout on volume up to 5 % above; 0 without a pivot."""
    base = (
        F.when(distance > 20, 20).when(distance > 10, 35).when(distance > 5, 50).when(distance > 3, 65).when(distance >= -2, 90)
        .when(distance >= -5, 75).when(distance >= -8, 60).when(distance >= -10, 45).when(distance >= -15, 30).otherwise(10)
    )
    return F.when(distance.isNull(), 0).otherwise(base + F.when(breakout & (distance > 0) & (distance <= 5), 10).otherwise(0)).cast("double")


def execution_state(price: Column, sma50: Column, sma200: Column, last_low: Column, distance: Column, breakout: Column, far: float = 50.0) -> Column:
    """The first state whose condition holds, from broken trends to forming patterns."""
    return (
        F.when((price < sma50) & (sma50 < sma200), "Invalid").when((last_low > 0) & (price < last_low) | (price < sma50), "Damaged")
        .when((price - sma200) / sma200 * 100 > far, "Overextended").when(distance.isNull(), "Pre-breakout").when(distance > 10, "Overextended").when(distance > 5, "Extended")
        .when(distance > 3, "Early-post-breakout").when((distance >= 0) & breakout, "Breakout").when(distance >= 0, "Early-post-breakout").otherwise("Pre-breakout")
    )


def pattern_class(state: Column, valid: Column, contractions: Column, last_depth: Column, dry_up: Column, wide: Column) -> Column:
    textbook = valid & ~wide & (contractions >= 3) & (last_depth.isNull() | (last_depth <= 10)) & F.coalesce(dry_up <= 0.7, F.lit(False))
    return (
        F.when(state.isin("Invalid", "Damaged"), "Damaged").when(state.isin("Overextended", "Extended") & valid, "Extended Leader").when(state.isin("Early-post-breakout", "Breakout") & valid, "Post-breakout")
        .when((state == "Pre-breakout") & textbook, "Textbook VCP").otherwise("VCP-adjacent")
    )


def capped_rating(composite: Column, valid: Column, state: Column, wide: Column) -> Column:
    """Rating by score, at most Developing for an invalid or wide pattern, and at most what the state allows."""
    names = [n for _, n in RATINGS]
    place = F.lit(len(names) - 1)
    for i in range(len(RATINGS) - 2, -1, -1):
        place = F.when(composite >= RATINGS[i][0], i).otherwise(place)
    third = names.index("Developing VCP")
    place = F.when(~valid, F.greatest(place, F.lit(third))).otherwise(place)
    for name, most in STATE_CAPS.items():
        place = F.when(state == name, F.greatest(place, F.lit(names.index(most)))).otherwise(place)
    place = F.when(wide, F.greatest(place, F.lit(third))).otherwise(place)
    return F.element_at(F.array(*[F.lit(n) for n in names]), (place + 1).cast("int"))


def volume_rows(bars: DataFrame) -> DataFrame:
    """Each bar with the mean volume of 50 bars, that of bars 1 to 10 before it (v10), the ratio of its own volume, and
    net_days: rising less falling days on more than the mean volume among 20."""
    rows = bars.withColumn("n", F.count("*").over(by())).withColumn("v50", F.avg("volume").over(frame(50)))
    move = F.signum(F.col("close") - F.lag("close").over(by()))
    days = F.collect_list(F.struct("volume", "move")).over(frame(20))
    rows = rows.withColumn("move", F.coalesce(move, F.lit(0.0))).withColumn("days", days).withColumn("v10", F.avg("volume").over(frame(10, 1)))
    net = F.aggregate("days", F.lit(0.0), lambda a, x: a + F.when(x["volume"] > F.col("v50"), x["move"]).otherwise(0.0))
    return rows.select("symbol", "date", "n", "v50", "v10", "volume", net.alias("net_days")).where("n >= 20 and v50 > 0")


def volume_zones(rows: DataFrame) -> DataFrame:
    """Columns added to patterns with their bar's volume_rows: zone_a (mean volume of the last pullback over that of 50
    bars), zone_b (the ten bars before the last), zone_c (the last bar's ratio, if it closes over the pivot), dry_up, and
    volume, the score with 10 more for a breakout on volume and for volume that falls from pullback to pullback."""
    some = F.size("chain") > 0
    over = F.coalesce(F.col("close") > F.col("pivot"), F.lit(False))
    whole = F.floor("v10")  # zones count whole shares
    recent = F.when(some & (whole > 0), whole).otherwise(F.coalesce("v10", F.lit(0.0)))
    rows = rows.withColumn("zone_a", F.when(some, F.round(F.element_at("chain", -1)["volume"] / F.col("v50"), 3))).withColumn("zone_b", F.when(some, F.round(F.coalesce(whole, F.lit(0)) / F.col("v50"), 3)))
    rows = rows.withColumn("zone_c", F.when(some & over, F.round("bar_ratio", 3))).withColumn("dry_up", recent / F.col("v50"))
    dry = F.when(F.col("dry_up") < 0.3, 90).when(F.col("dry_up") < 0.5, 75).when(F.col("dry_up") < 0.7, 60).when(F.col("dry_up") <= 1, 40).otherwise(20)
    score = dry + F.when(F.col("breakout"), 10).otherwise(0) + F.when(F.col("net_days") > 3, 10).when(F.col("net_days") < -3, -10).otherwise(0) + F.when(F.col("volume_declining"), 10).otherwise(0)
    return rows.withColumn("volume", clamp(score, 0.0, 100.0))


def candidates(bars: DataFrame, found: DataFrame, strength: DataFrame, breakout_ratio: float = 1.5) -> DataFrame:
    """Patterns (found: symbol, date and the columns of folds.PATTERN) as candidates as of their dates: component scores,
    composite, execution state, pattern class and rating. strength: symbol, date, strength."""
    means = bars.select("symbol", "date", "close", full(F.avg("close"), "close", 50).alias("sma50"), full(F.avg("close"), "close", 200).alias("sma200"))
    key = ["symbol", "date"]
    volume = volume_rows(bars).withColumn("bar_ratio", F.col("volume") / F.col("v50")).drop("volume", "n")
    rows = means.join(trend_template(bars).select(*key, F.col("score").alias("trend")), key).join(volume, key).join(strength, key).join(found, key)
    distance = F.when(F.col("pivot") > 0, (F.col("close") - F.col("pivot")) / F.col("pivot") * 100)
    rows = rows.withColumn("distance", distance).withColumn("breakout", (F.coalesce(F.col("close") > F.col("pivot"), F.lit(False))) & (F.col("bar_ratio") >= breakout_ratio))
    rows = volume_zones(rows).withColumn("contraction", F.col("score").cast("double")).withColumn("pivot_score", pivot_score(F.col("distance"), F.col("breakout")))
    rows = rows.withColumn("composite", F.round(sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)), 1)).withColumn("state", execution_state(F.col("close"), F.col("sma50"), F.col("sma200"), F.col("last_low"), F.col("distance"), F.col("breakout")))
    pattern = pattern_class(F.col("state"), F.col("valid"), F.col("contractions"), F.col("last_depth"), F.col("dry_up"), F.col("wide"))
    return rows.withColumn("pattern", pattern).withColumn("rating", capped_rating(F.col("composite"), F.col("valid"), F.col("state"), F.col("wide")))


MEASURES = ["pivot", "last_low", "range_compression", "wide", "right_side", "zone_a", "zone_b", "zone_c"]


def vcp_screen(bars: DataFrame, bench: DataFrame, breakout_ratio: float = 1.5) -> DataFrame:
    """Each symbol's last bar as a candidate, by the screen's limits.

    Strength is re-ranked in the universe: the share of symbols at or below, in whole %, as its score; without a value 0.
    """
    strength = latest(relative_strength(bars, bench)).select("symbol", "date", "rs")
    known = strength.where("rs is not null")
    n = known.count()  # one number
    place = known.groupBy("rs").agg(F.count("*").alias("k"))
    strength = strength.join(_at_or_below(place), "rs", "left").select("symbol", "date", F.coalesce(F.bround(F.col("below") * 100 / F.lit(max(n, 1))), F.lit(0)).cast("double").alias("strength"))
    rows = candidates(bars, fold(bars, "vcp_screen"), strength, breakout_ratio)
    return rows.select("symbol", "date", *WEIGHTS, "composite", "state", "pattern", "rating", *MEASURES).orderBy(F.desc("composite"), "symbol")


def walk_forward(bars: DataFrame, bench: DataFrame, step: int = 5, ahead: int = 60, stretch: int = 500) -> DataFrame:
    """The screen at every step-th bar from the 120th on, from the bars up to it alone: valid patterns, each once (by its
    first high, last low and pivot, the earliest date wins), with what the next bars did.

    A symbol's line is cut into stretches of `stretch` bars, each with the 119 bars before it, so that a long line is
    spread over tasks and no task holds more than stretch + 119 bars of it. Symbols of fewer than 150 bars give nothing.
    """
    window = contraction.SCREEN.window
    lines = numbered(bars, ["symbol"], [F.col("date")], "bar").where(F.col("_size") >= window + 30).drop("_size")
    home = F.floor((F.col("bar") - 1) / stretch)
    rows = lines.withColumn("stretch", F.explode(F.sequence(home, F.floor((F.col("bar") + window - 2) / stretch))))
    cursor = (F.col("stretch") == home) & (F.col("bar") >= window) & ((F.col("bar") - window) % step == 0) & (F.col("close") > 0)
    found = stored(fold(rows.withColumn("cursor", cursor), "cursors"))
    strength = relative_strength(bars, bench).select("symbol", "date", F.col("score").cast("double").alias("strength"))
    rows = candidates(bars, found, strength)
    first = Window.partitionBy("symbol", "first_high_date", "last_low_date", "pivot").orderBy("bar")
    rows = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    after = forward_outcome(rows.select("symbol", "bar", "pivot", F.col("last_low").alias("stop")), bars, ahead)
    rows = rows.join(after, ["symbol", "bar"], "left")
    return rows.select("symbol", F.col("date").alias("as_of"), *WEIGHTS, "composite", "state", "pattern", "rating", "pivot", "last_low", "first_high_date", "last_low_date", F.coalesce("outcome", F.lit("insufficient_data")).alias("outcome"), "days", "max_gain", "max_loss")


def _at_or_below(place: DataFrame) -> DataFrame:
    """rs, below: how many symbols have that value or less, from counts by value."""
    parts = stretches(place, [], [F.col("rs")])
    w = Window.partitionBy("_part").orderBy("rs").rowsBetween(Window.unboundedPreceding, 0)
    sums = carried(parts.groupBy("_part").agg(F.sum("k").alias("s")), [], {"_s": F.sum("s")})
    return with_carried(parts.withColumn("below", F.sum("k").over(w)), [], sums).select("rs", (F.col("below") + F.coalesce("_s", F.lit(0))).alias("below"))
