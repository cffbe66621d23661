"""The exhaustion screen from bars to graded rows, and plans of a session without bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp, linear_score, log10_liquidity, trading_days_between
from tapeworks.operators.features import acceleration, by, frame, liquidity_metrics, ma_extension, range_expansion

# Weights of the components and the grades' thresholds.
WEIGHTS = {"ma_extension": 0.30, "acceleration": 0.25, "volume_climax": 0.20, "range_expansion": 0.15, "liquidity": 0.10}
GRADES = [(85, "A"), (70, "B"), (50, "C")]


def parabolic_screen(bars: DataFrame, earnings: DataFrame, blackout: int = 2, catalyst: int = 5, strong_close: float = 0.8, volume: float = 2.0) -> DataFrame:
    """Every bar's component scores, score, grade, weakest and strongest component, state cap, warnings and blackout.

    still_in_markup: a close in the top of its range within two bars of the 52-week high; too_early_to_short: such a close
    on much volume otherwise; recent_earnings_catalyst: a report within `catalyst` trading days before; blackout: the next
    report within `blackout` calendar days. Missing values score 0. earnings: symbol, date."""
    high = F.max("high").over(frame(252))
    rows = bars.withColumn("_top", F.coalesce(F.col("high") >= high, F.lit(False))).withColumn("at_high", F.max("_top").over(frame(2)))
    rows = liquidity_metrics(range_expansion(ma_extension(acceleration(rows))))
    days = earnings.select("symbol", F.col("date").alias("e")).distinct()
    line = rows.select("symbol", "date", F.lit(None).cast("date").alias("e")).unionByName(days.select("symbol", F.col("e").alias("date"), "e"))
    w = by()
    near = line.groupBy("symbol", "date").agg(F.max("e").alias("e")).select("symbol", "date", F.last("e", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_event"), F.first("e", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_event"), F.col("e").isNotNull().alias("_on"))
    rows = rows.join(near, ["symbol", "date"], "left")
    scores = {
        "ma_extension": 0.5 * linear_score(F.col("ext_20"), 20.0, 120.0) + 0.5 * linear_score(F.col("ext_atr"), 3.0, 10.0),
        "acceleration": 0.4 * linear_score(F.col("ret_5") * 100, 20.0, 100.0) + 0.2 * linear_score(F.col("green"), 2.0, 5.0) + 0.2 * linear_score(F.col("accel"), 1.0, 2.0) + 0.2 * linear_score(F.col("ret_3") * 100, 10.0, 50.0),
        "volume_climax": linear_score(F.col("volume_ratio"), 1.5, 5.0), "range_expansion": linear_score(F.col("expansion"), 1.2, 3.0), "liquidity": clamp(F.coalesce(log10_liquidity(F.col("adv20")), F.lit(0.0)) * 10, 0.0, 100.0),
    }
    out = rows.select("symbol", "date", "close", "high", "low", "at_high", "volume_ratio", "last_event", "next_event", *[F.round(c, 9).alias(k) for k, c in scores.items()])
    out = out.withColumn("score", F.round(sum((F.col(k) * w_ for k, w_ in WEIGHTS.items()), F.lit(0.0)), 1))
    grade = F.lit("D")
    for least, name in GRADES[::-1]:
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    parts = F.array(*[F.struct(F.col(k).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(WEIGHTS)])
    best = F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(WEIGHTS)])
    strong = F.coalesce((F.col("high") > F.col("low")) & ((F.col("close") - F.col("low")) / (F.col("high") - F.col("low")) >= strong_close), F.lit(False))
    markup = strong & F.col("at_high")
    early = strong & ~F.col("at_high") & F.coalesce(F.col("volume_ratio") >= volume, F.lit(False))
    recent = F.col("last_event").isNotNull() & (trading_days_between(F.col("last_event"), F.col("date")) <= catalyst)
    warnings = F.array_join(F.array_compact(F.array(F.when(early, "too_early_to_short"), F.when(recent, "recent_earnings_catalyst"))), ",")
    return out.select("symbol", "date", *[F.round(k, 4).alias(k) for k in WEIGHTS], "score", grade.alias("grade"), F.array_min(parts)["k"].alias("weakest"), F.array_min(best)["k"].alias("strongest"), F.when(markup, "still_in_markup").alias("state_cap"), warnings.alias("warnings"), F.coalesce(F.datediff("next_event", "date") <= blackout, F.lit(False)).alias("blackout"))


def carry_forward(plans: DataFrame, states: DataFrame, bars: DataFrame) -> DataFrame:
    """State of each plan (plan_id, ticker, session): computed where its session has bars, else the last one before it,
    never advanced, marked no_bars; armed without any. states: plan_id, session, state of earlier sessions and this one.

    Times and prices of a state belong to its own session, so a carried state has none."""
    seen = bars.select("ticker", "session").distinct().withColumn("_has", F.lit(True))
    rows = plans.join(seen, ["ticker", "session"], "left")
    earlier = rows.select("plan_id", "session").join(states.select("plan_id", F.col("session").alias("s"), F.col("state").alias("old")), "plan_id").where("s <= session")
    last = earlier.groupBy("plan_id", "session").agg(F.max_by("old", F.when(F.col("s") < F.col("session"), F.col("s"))).alias("prior"), F.max(F.when(F.col("s") == F.col("session"), F.col("old"))).alias("now"))
    rows = rows.join(last, ["plan_id", "session"], "left")
    has = F.col("_has").isNotNull()
    return rows.select("plan_id", "ticker", "session", F.when(has, F.coalesce("now", F.lit("armed"))).otherwise(F.coalesce("prior", F.lit("armed"))).alias("state"), F.when(has, "ok").otherwise("no_bars").alias("status"))
