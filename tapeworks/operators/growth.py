"""The growth screen's composite of seven component scores per symbol, and two of its components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.features import frame, latest

# Weights and least scores of the components, and ratings from the highest on.
WEIGHTS = {"C": 0.15, "A": 0.20, "N": 0.15, "S": 0.15, "L": 0.20, "I": 0.10, "M": 0.05}
LEAST = {"C": 60, "A": 50, "N": 40, "S": 40, "L": 50, "I": 40, "M": 40}
RATINGS = [(90, "Exceptional+"), (80, "Exceptional"), (70, "Strong"), (60, "Above Average"), (50, "Average"), (40, "Below Average")]


def newness(bars: DataFrame, high_n: int = 252, volume_n: int = 50) -> DataFrame:
    """symbol, N: by the last close's distance from the year's high, and whether it is there on 1.4 times the mean volume."""
    rows = bars.withColumn("top", F.max("high").over(frame(high_n))).withColumn("mean", F.avg("volume").over(frame(volume_n)))
    last = latest(rows).withColumn("far", F.round((F.col("close") / F.col("top") - 1) * 100, 9))
    out = (F.col("close") >= F.col("top") * 0.995) & (F.col("volume") > F.col("mean") * 1.4)
    score = F.when((F.col("far") >= -5) & out, 100).when((F.col("far") >= -10) & out, 80).when((F.col("far") >= -15) | out, 60).when(F.col("far") >= -25, 40).otherwise(20)
    return last.select("symbol", score.alias("N"))


def sponsorship(holders: Column, share: Column, named: Column) -> Column:
    """Score of the number of holders and the share that they own in %; a named holder adds 10 (15 of at most 70 where the
    share is unknown)."""
    known = F.coalesce(named, F.lit(False))

    def both(a: int, b: int, lo: int, hi: int, open_: bool = False) -> Column:
        return (holders >= a) & ((holders < b) if open_ else (holders <= b)) & (share >= lo) & (share <= hi)

    bare = F.when((holders >= 50) & (holders <= 100), 50).when((holders >= 30) & (holders < 50), 40).when((holders > 100) & (holders <= 150), 35).when(holders > 150, 20).otherwise(10)
    base = (
        F.when(both(50, 100, 30, 60), 100).when(known & (holders >= 30) & (holders <= 150), 90).when(both(30, 50, 20, 40, True) | both(101, 150, 40, 70), 80)
        .when(both(20, 30, 20, 50, True) | both(50, 150, 20, 70), 60).when((share < 10) | (share > 90), 20).when((share < 20) | (share > 80), 40).otherwise(50)
    )
    full = F.least(F.lit(100), base + F.when(known, 10).otherwise(0))
    return F.when(share.isNull(), F.least(F.lit(70), bare + F.when(known, 15).otherwise(0))).otherwise(full)


def growth_composite(rows: DataFrame) -> DataFrame:
    """symbol, composite, rating, weakest component (the first of equals), those under their least score, and advice: avoid
    in a falling market (M of 0), for laggards (L under 40) and for two or more failures, watchlist for one, else buy.

    rows: symbol and the seven components; a missing one counts as 0."""
    score = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in WEIGHTS}
    composite = sum((score[c] * w for c, w in WEIGHTS.items()), F.lit(0.0))
    rating = F.lit("Weak")
    for least, name in RATINGS[::-1]:
        rating = F.when(F.round(composite, 9) >= least, name).otherwise(rating)
    parts = F.array(*[F.struct(score[c].alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(WEIGHTS)])
    failed = F.array_compact(F.array(*[F.when(score[c] < x, F.lit(c)) for c, x in LEAST.items()]))
    out = rows.select("symbol", *[score[c].alias(c) for c in WEIGHTS], F.round(composite, 1).alias("composite"), rating.alias("rating"), F.array_min(parts)["c"].alias("weakest"), failed.alias("f"))
    n = F.size("f")
    advice = F.when((F.col("M") == 0) | (F.col("L") < 40) | (n > 1), "avoid").when(n == 1, "watchlist").otherwise("buy")
    return out.select("symbol", "composite", "rating", "weakest", F.array_join("f", ",").alias("failed"), advice.alias("advice"))
