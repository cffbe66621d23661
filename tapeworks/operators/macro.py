"""Monthly macro components and regime, leaders' health, cycle phase, uptrend level, and the days after a follow-through.

Series are short (a row a month, or a row a session of a basket), partitioned by name; rules are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp, interpolated
from tapeworks.operators.features import by, frame

# Directions of the components (up, down, none), their weights, and the cycle's leaders and laggards.
DIRECTIONS = {
    "concentration": ("broadening", "concentrating", "unknown"),
    "yield_curve": ("steepening", "flattening", "stable"),
    "credit_conditions": ("easing", "tightening", "stable"),
    "size_factor": ("small_cap_leading", "large_cap_leading", "neutral"),
    "equity_bond": ("risk_on", "risk_off", "neutral"),
    "sector_rotation": ("risk_on", "risk_off", "neutral"),
}
WEIGHTS = {"concentration": 0.25, "yield_curve": 0.20, "credit_conditions": 0.15, "size_factor": 0.15, "equity_bond": 0.15, "sector_rotation": 0.10}
PHASES = {
    "early": (["Technology", "Consumer Cyclical", "Industrials", "Financial"], ["Utilities", "Consumer Defensive", "Healthcare"]),
    "mid": (["Technology", "Industrials", "Consumer Cyclical", "Energy"], ["Utilities", "Consumer Defensive"]),
    "late": (["Energy", "Basic Materials", "Healthcare"], ["Technology", "Consumer Cyclical", "Industrials"]),
    "recession": (["Utilities", "Consumer Defensive", "Healthcare"], ["Technology", "Consumer Cyclical", "Industrials", "Financial"]),
}


def _whole(x: Column) -> Column:
    """Toward zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def transition_score(cross: Column, ago: Column, gap: Column, short: Column, long: Column, fast: Column, slow: Column) -> Column:
    """0 to 100 from the means' crossing (40), the turn of momentum (30) and their agreement (30)."""
    crossed = cross.isin("golden_cross", "death_cross")
    first = F.when(crossed, F.when(ago <= 2, 40).when(ago <= 5, 30).otherwise(20)).when(cross == "converging", _whole(F.greatest(F.lit(0.0), 1 - F.abs(gap)) * 25)).otherwise(0)
    turn = _whole(F.least(F.abs(short), F.lit(5.0)) / 5.0 * 30)
    second = F.coalesce(F.when((long < 0) & (short > 0) | (long > 0) & (short < 0), turn).when(F.abs(short) > 3, F.when(long.isNotNull(), 10).otherwise(0)), F.lit(0))
    agree = F.coalesce(F.when((cross == "golden_cross") & (short > 0) | (cross == "death_cross") & (short < 0), 10), F.lit(0))
    wide = F.coalesce(F.when((slow != 0) & (F.abs(fast - slow) / slow * 100 > 0.5), 10), F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), first + second + F.when(crossed, 10).otherwise(0) + agree + wide)).cast("long")


def components(series: DataFrame, least: int = 12) -> DataFrame:
    """Last month of each component with data for `least` months: score, direction, qualifier, means, rates, percentile.

    series: name, month, value. A crossing counts for twelve months, and only from 15 months of data on. From three
    months on a crossing that the three-month rate contradicts gives way to it ("reversing").
    """
    w = Window.partitionBy("name").orderBy("month")

    def mean(n: int) -> Column:
        f = w.rowsBetween(1 - n, 0)
        return F.when(F.count("value").over(f) == n, F.avg("value").over(f))

    def rate(n: int) -> Column:
        old = F.lag("value", n).over(w)
        return F.when(old != 0, (F.col("value") - old) / old * 100)

    rows = series.withColumn("n", F.row_number().over(w)).withColumn("fast", mean(6)).withColumn("slow", mean(12)).withColumn("roc_3m", rate(3)).withColumn("roc_12m", rate(12))
    side, before = F.col("fast") - F.col("slow"), F.lag(F.col("fast") - F.col("slow")).over(w)
    turn = F.when((before <= 0) & (side > 0), 1).when((before >= 0) & (side < 0), -1)
    rows = rows.withColumn("turn", turn).withColumn("at", F.max(F.when(F.col("turn").isNotNull(), F.struct(F.col("n").alias("n"), "turn"))).over(w))
    last = rows.groupBy("name").agg(F.max(F.struct("n", "month", "value", "fast", "slow", "roc_3m", "roc_12m", "at")).alias("x")).select("name", "x.*").where(F.col("n") >= least)
    rank = series.join(last.select("name", F.col("value").alias("_now")), "name").groupBy("name").agg((F.sum(F.when(F.col("value") < F.col("_now"), 1.0).otherwise(0.0)) / F.count("*") * 100).alias("percentile"))
    gap = F.when(F.col("n") < 15, F.lit(None)).otherwise(F.when(F.col("slow") != 0, (F.col("fast") - F.col("slow")) / F.col("slow") * 100).otherwise(0.0))
    recent = (F.col("n") >= 15) & (F.col("n") - F.col("at.n") <= 11)
    last = last.withColumn("gap_pct", F.round(gap, 3)).withColumn("bars_ago", F.when(recent, F.col("n") - F.col("at.n")))
    cross = F.when(F.col("bars_ago").isNotNull(), F.when(F.col("at.turn") > 0, "golden_cross").otherwise("death_cross")).when(F.abs(gap) < 1, "converging").otherwise("none")
    last = last.withColumn("crossover", cross)
    last = last.withColumn("score", transition_score(F.col("crossover"), F.col("bars_ago"), F.coalesce("gap_pct", F.lit(0.0)), F.col("roc_3m"), F.col("roc_12m"), F.col("fast"), F.col("slow")))
    up, down, none = (F.create_map(*[F.lit(x) for k, v in DIRECTIONS.items() for x in (k, v[i])])[F.col("name")] for i in range(3))
    moving = F.when(F.col("roc_3m") > 0, up).when(F.col("roc_3m") < 0, down)
    crossed = F.when(F.col("crossover") == "golden_cross", up).when(F.col("crossover") == "death_cross", down)
    against = moving.isNotNull() & (moving != crossed)
    level = F.when(F.col("name") == "concentration", F.when(F.col("fast") > F.col("slow"), up).when(F.col("slow").isNotNull(), down))
    direction = F.when(F.col("name") == "yield_curve", F.coalesce(moving, none)).when(crossed.isNotNull(), F.when((F.col("bars_ago") >= 3) & against, moving).otherwise(crossed)).otherwise(F.coalesce(level, moving, none))
    qualifier = F.when((F.col("name") == "yield_curve") | crossed.isNull() | moving.isNull(), "N/A").when((F.col("bars_ago") >= 3) & against, "reversing").when(against, "fading").otherwise("confirmed")
    return last.join(rank, "name").select("name", "month", "score", direction.alias("direction"), qualifier.alias("qualifier"), "crossover", "bars_ago", "gap_pct", F.round("roc_3m", 2).alias("roc_3m"), F.round("roc_12m", 2).alias("roc_12m"), F.round("percentile", 1).alias("percentile"))


def correlation_regime(monthly: DataFrame) -> DataFrame:
    """One row: correlations of two series' monthly changes over 6 and 12 months, their regime and the score's bonus.

    monthly: month, a, b."""
    w = Window.orderBy("month")  # one row a month

    def change(c: str) -> Column:
        return F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0)) - 1

    rows = monthly.select("month", change("a").alias("x"), change("b").alias("y")).where("x is not null and y is not null").withColumn("k", F.row_number().over(Window.orderBy(F.desc("month"))))

    def corr(n: int) -> Column:
        near = F.col("k") <= n
        return F.when(F.count(F.when(near, 1)) == n, F.coalesce(F.corr(F.when(near, F.col("x")), F.when(near, F.col("y"))), F.lit(0.0)))

    out = rows.agg(corr(6).alias("corr_6m"), corr(12).alias("corr_12m"))
    a, b = F.col("corr_6m"), F.col("corr_12m")
    kind = F.when(a.isNull(), "unknown").when(a < -0.3, "negative_strong").when(a < 0, "negative_mild").when(a < 0.3, "near_zero").otherwise("positive")
    bonus = F.coalesce(F.when((a > 0) != (b > 0), 20).when(F.abs(a - b) > 0.3, 10), F.lit(0))
    return out.select(kind.alias("correlation_regime"), bonus.cast("long").alias("bonus"), F.round("corr_6m", 3).alias("correlation_6m"), F.round("corr_12m", 3).alias("correlation_12m"))


def regime(found: DataFrame, correlation: DataFrame) -> DataFrame:
    """One row: regime, confidence, points of each hypothesis, signalling components and transition level.

    found: rows of components; correlation: the row of correlation_regime, whose bonus adds to equity_bond's score."""
    names = list(WEIGHTS)
    wide = found.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.struct("score", "direction"))).alias(n) for n in names])
    both = wide.crossJoin(correlation)  # one row each
    d = {n: F.coalesce(F.col(f"{n}.direction"), F.lit("unknown")) for n in names}
    kind = F.when(F.col("equity_bond").isNull(), "unknown").otherwise(F.col("correlation_regime"))
    scores = {n: F.coalesce(F.col(f"{n}.score"), F.lit(0)) for n in names}
    scores["equity_bond"] = F.when(F.col("equity_bond").isNull(), 0).otherwise(F.least(F.lit(100), F.col("equity_bond.score") + F.col("bonus")))

    def points(*rules: tuple[Column, int]) -> Column:
        return F.greatest(F.lit(0), sum((F.when(hit, n).otherwise(0) for hit, n in rules), F.lit(0)))

    credit = d["credit_conditions"].isin("stable", "easing")
    rows = both.select(
        F.greatest(F.lit(0), points((d["concentration"] == "concentrating", 2), (d["size_factor"] == "large_cap_leading", 2), (credit, 1))).alias("concentration"),
        points((d["concentration"] == "broadening", 2), (d["size_factor"] == "small_cap_leading", 2), (credit, 1), (d["sector_rotation"] == "risk_on", 1), (d["yield_curve"] == "steepening", 1)).alias("broadening"),
        points((d["credit_conditions"] == "tightening", 2), (d["sector_rotation"] == "risk_off", 2), (d["equity_bond"] == "risk_off", 1), (d["yield_curve"] == "flattening", 1), (d["size_factor"] == "small_cap_leading", -1)).alias("contraction"),
        points((kind == "positive", 3), (kind == "near_zero", 1), (d["equity_bond"] == "risk_off", 1)).alias("inflationary"),
        sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names), F.lit(0)).alias("available"),
        sum((F.when(s >= 40, 1).otherwise(0) for s in scores.values()), F.lit(0)).alias("signaling"),
        (sum(scores.values(), F.lit(0)) / len(names)).alias("mean_score"), sum((scores[n] * w for n, w in WEIGHTS.items()), F.lit(0.0)).alias("composite"),
    )
    order = ["concentration", "broadening", "contraction", "inflationary"]
    ranked = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(order)]))
    rows = rows.withColumn("r", ranked).withColumn("top", -F.col("r")[0]["s"]).withColumn("tied", (F.col("top") > 0) & (F.col("top") + F.col("r")[1]["s"] <= 1))
    loose = (~(F.col("tied") & (F.col("composite") < 50))) & (F.col("signaling") >= 3) & (F.col("top") < 3)
    rows = rows.withColumn("regime", F.when(F.col("tied") & (F.col("composite") < 50) | loose, "transitional").otherwise(F.col("r")[0]["n"])).withColumn("best", F.when(loose, F.col("signaling")).otherwise(F.col("top")))
    sure = F.when(F.col("best") >= 4, F.when(F.col("tied"), "moderate").otherwise("high")).when(F.col("best") >= 3, "moderate").when(F.col("best") >= 2, "low").otherwise("very_low")
    sure = F.when(F.col("available") <= 3, "very_low").when((F.col("available") <= 4) & sure.isin("high", "moderate"), "low").otherwise(sure)
    level = F.when((F.col("signaling") >= 4) & (F.col("mean_score") >= 50), "high").when((F.col("signaling") >= 3) & (F.col("mean_score") >= 40), "moderate").when((F.col("signaling") >= 2) & (F.col("mean_score") >= 30), "low").otherwise("minimal")
    return rows.select("regime", sure.alias("confidence"), *[F.col(n).cast("long").alias(f"{n}_points") for n in order], F.col("signaling").cast("long").alias("signaling"), level.alias("transition"), F.round("mean_score", 1).alias("mean_score"), F.col("tied").alias("ambiguous"))


def cycle_phase(sectors: DataFrame, phases: dict[str, tuple[list[str], list[str]]] = PHASES) -> DataFrame:
    """date, phase, confidence and score: leaders in the top half 0.4, laggards in the bottom half 0.3, trends 0.3.

    sectors: date, sector, ratio, trend; one row per date and sector. A sector in the middle is in both halves."""
    spark = sectors.sparkSession
    table = spark.createDataFrame([(p, i, role, s, len(side)) for i, (p, sides) in enumerate(phases.items()) for role, side in zip(("up", "down"), sides, strict=True) for s in side], "phase string, place int, role string, sector string, size int")
    per = Window.partitionBy("date")
    ranked = sectors.withColumn("k", F.row_number().over(per.orderBy(F.desc("ratio"), "sector"))).withColumn("half", F.floor(F.count("*").over(per) / 2))
    hit = F.when(F.col("role") == "up", F.col("k") <= F.col("half") + 1).otherwise(F.col("k") > F.col("half"))
    rows = ranked.join(F.broadcast(table), "sector")  # two dozen rows
    rows = rows.groupBy("date", "phase", "place").agg(
        F.sum(F.when(hit, F.when(F.col("role") == "up", 0.4).otherwise(0.3) / F.col("size")).otherwise(0.0)).alias("held"), F.avg(F.when(F.lower("trend") == F.col("role"), 1.0).otherwise(0.0)).alias("trend"))
    rows = rows.withColumn("score", F.round((F.col("held") + 0.3 * F.col("trend")) * 100, 1))
    best = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "place", "phase"))).alias("r"))  # four rows a date
    gap = F.col("r")[1]["s"] - F.col("r")[0]["s"]
    return best.select("date", F.col("r")[0]["phase"].alias("phase"), F.when(gap > 20, "high").when(gap > 10, "moderate").otherwise("low").alias("confidence"), (-F.col("r")[0]["s"]).alias("score"))


def uptrend_level(rows: DataFrame) -> DataFrame:
    """score of each row of ratio, trend and slope: the interpolated ladder, 5 more or less where trend and slope agree."""
    r = F.col("ratio")
    base = (
        F.when(r >= 0.5, interpolated(r, [(0.5, 90), (0.6, 100)])).when(r >= 0.37, 70 + (r - 0.37) / 0.13 * 19).when(r >= 0.25, 40 + (r - 0.25) / 0.12 * 29)
        .when(r >= 0.097, 10 + (r - 0.097) / 0.153 * 29).otherwise(F.greatest(F.lit(0.0), r / 0.097 * 9))
    )
    step = F.when((F.lower("trend") == "up") & (F.col("slope") > 0), 5).when((F.lower("trend") == "down") & (F.col("slope") < 0), -5).otherwise(0)
    return rows.withColumn("score", F.when(r.isNull(), 50).otherwise(F.bround(clamp(base + F.coalesce(step, F.lit(0)), 0.0, 100.0))).cast("long"))


def leader_deterioration(bars: DataFrame, basket: int = 10, pool: int = 5, session: Column | None = None) -> DataFrame:
    """One row for the `basket` symbols nearest to their 52-week high (all, if under `pool` have one): mean points of
    deterioration, 1.3 times as much if 60 % of them have 50 or more; each symbol's last bar counts."""
    w = by()
    top = F.max("high").over(frame(252))
    swing = (F.col("high") > F.lag("high").over(w)) & (F.col("high") > F.lead("high").over(w))
    rows = bars.withColumn("swing", F.coalesce(swing, F.lit(False))).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("i", F.row_number().over(w))

    def mean(n: int) -> Column:
        return F.when(F.count("close").over(frame(n)) == n, F.avg("close").over(frame(n)))

    rows = rows.withColumn("top", top).withColumn("m20", mean(20)).withColumn("m50", mean(50)).withColumn("m200", mean(200))
    inner = F.col("swing") & (F.col("i") > F.col("n") - 19)  # swings with both neighbours among the last 20 bars
    last = rows.groupBy("symbol").agg(F.max("n").alias("n"), F.max_by(F.struct("close", "top", "m20", "m50", "m200"), "i").alias("x"), F.array_sort(F.collect_list(F.when(inner, F.struct("i", "high")))).alias("s"))
    price, s = F.col("x.close"), F.col("s")
    far = (price - F.col("x.top")) / F.col("x.top") * 100
    points = F.when(F.col("x.top") > 0, F.when(far <= -25, 40).when(far <= -15, 30).when(far <= -10, 20).when(far <= -5, 10)).otherwise(0)
    below = F.when(F.col("n") >= 50, F.when(price < F.col("x.m50"), 20).otherwise(0) + F.when(F.col("n") >= 200, F.when(price < F.col("x.m200"), 20).otherwise(0)).when(price < F.col("x.m50") * 0.95, 10).otherwise(0)).when((F.col("n") >= 20) & (price < F.col("x.m20")), 15).otherwise(0)
    lower = F.when((F.col("n") >= 20) & (F.size(s) >= 2), F.when(F.element_at(s, -1)["high"] < F.element_at(s, -2)["high"], 20)).otherwise(0)
    total = F.least(F.lit(100), F.coalesce(points, F.lit(0)) + below + F.coalesce(lower, F.lit(0)))
    scored = last.select("symbol", total.alias("points"), F.when((price > 0) & (F.col("x.top") > 0), price / F.col("x.top")).alias("near"))
    chosen = scored.where("near is not null").orderBy(F.desc("near"), "symbol").limit(basket)
    out = chosen.agg(F.count("*").alias("evaluated"), F.sum(F.when(F.col("points") >= 50, 1).otherwise(0)).alias("deteriorating"), F.avg("points").alias("mean"))
    amplified = F.col("deteriorating") >= 0.6 * F.col("evaluated")
    score = F.when(amplified, F.least(F.lit(100.0), F.col("mean") * 1.3)).otherwise(F.col("mean"))
    return out.where(F.col("evaluated") >= pool).select("evaluated", "deteriorating", F.round("mean", 1).alias("mean"), amplified.alias("amplified"), F.bround(score).cast("long").alias("score"))


def post_ftd(bars: DataFrame, ftd: DataFrame, n: int = 5) -> DataFrame:
    """Aftermath of each follow-through day (symbol, date): distribution days among the next n, the first one's number,
    sessions seen, and the first close below that day's low with its distance."""
    w = by()
    rows = bars.withColumn("i", F.row_number().over(w))
    prior, pv = F.lag("close").over(w), F.lag("volume").over(w)
    hit = (prior > 0) & (pv > 0) & ((F.col("close") - prior) / prior * 100 <= -0.2) & (F.col("volume") > pv)
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    start = rows.join(ftd.select("symbol", "date"), ["symbol", "date"]).select("symbol", F.col("date").alias("ftd"), F.col("i").alias("i0"), F.col("low").alias("floor"))
    after = start.join(rows.select("symbol", "i", "hit", F.col("close").alias("c")), "symbol").where(F.col("i") > F.col("i0"))  # Spark joins by symbol
    day = F.col("i") - F.col("i0")
    seen = after.groupBy("symbol", "ftd").agg(F.sum(F.when((day <= n) & F.col("hit"), 1).otherwise(0)).alias("distribution_count"), F.min(F.when((day <= n) & F.col("hit"), day)).alias("first_day"), F.sum(F.when(day <= n, 1).otherwise(0)).alias("days"), F.min(F.when(F.col("c") < F.col("floor"), day)).alias("invalid_after"))
    out = start.join(seen, ["symbol", "ftd"], "left")
    return out.select("symbol", F.col("ftd").alias("date"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("distribution_count", "days")], "first_day", "invalid_after", F.col("invalid_after").isNotNull().alias("invalidated"))
