"""Queries of drift after reports, with SQL, and of the state of two indices, whose fold SQL cannot express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.pattern_queries import smooth
from tapeworks.jobs.tables import BARS, bars, dates_as_text, earnings, rounded
from tapeworks.operators import drift, rallies
from tapeworks.operators import events as e

#: The tables' volumes are small, so are the floors and tiers of liquidity here.
FLOORS, TIERS = (30_000.0, 25.0, 1_000.0), (80_000.0, 45_000.0)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with its gap in %, reviewed four and nine weeks later."""
    gaps = e.earnings_gap(bars(spark, sf_dir), earnings(spark, sf_dir)).select("symbol", F.col("date").alias("event"), F.round(F.col("gap") * 100, 6).alias("gap"))
    return gaps.withColumn("as_of", F.explode(F.array(F.date_add("event", 28), F.date_add("event", 63))))


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_setups(bars(spark, sf_dir), reviews(spark, sf_dir), floors=FLOORS, tiers=TIERS)


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand with the brand of the next number as its second index."""
    names = bars(spark, sf_dir).select("symbol").distinct()
    number = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    return names.select(F.col("symbol").alias("market"), F.col("symbol").alias("first"), F.concat(F.lit("Brand#"), (number % 25 + 1).cast("string")).alias("second"))


def market_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rallies.market_states(rallies.weekly_rallies(smooth(spark, sf_dir)), markets(spark, sf_dir))


_SQL = f"""WITH {BARS},
    g AS (SELECT symbol, date, open, close, lag(close) OVER w AS pc, lead(open) OVER w AS no FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    v AS (SELECT earn.symbol, earn.date AS event, CAST(earn.date + d AS DATE) AS as_of, round((CASE WHEN timing = 'bmo' THEN open / pc - 1 ELSE no / close - 1 END) * 100, 6) AS gap FROM earn LEFT JOIN g ON g.symbol = earn.symbol AND g.date = earn.date, (SELECT unnest([28, 63]) AS d)),
    t AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week, avg(volume) OVER w AS shares, avg(volume * close) OVER w AS dollars, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    c AS (SELECT v.symbol, event, as_of, week, arg_min(open, date) AS o0, max(high) AS h0, min(low) AS l0, arg_max(close, date) AS c0, sum(volume)::DOUBLE AS vol, arg_max(shares, date) AS shares, arg_max(dollars, date) AS dollars, arg_max(n, date) AS n
        FROM v JOIN t ON t.symbol = v.symbol AND date <= as_of AND week >= date_trunc('week', event) - INTERVAL 91 DAY AND (week <> date_trunc('week', event) OR date >= event) GROUP BY ALL),
    i AS (SELECT *, c0 >= o0 AS green, floor((o0) * 100 + 0.5) / 100 AS o, floor((h0) * 100 + 0.5) / 100 AS h, floor((l0) * 100 + 0.5) / 100 AS l, floor((c0) * 100 + 0.5) / 100 AS cl, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, event, as_of) - 1 AS oldest, avg(CASE WHEN vol > 0 THEN vol END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS usual,
        (sum(vol) OVER k - vol) / nullif(count(*) OVER k - 1, 0) AS others FROM c WINDOW w AS (PARTITION BY symbol, event, as_of ORDER BY week DESC), k AS (PARTITION BY symbol, event, as_of ORDER BY week DESC ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    a AS (SELECT *, max(CASE WHEN week = date_trunc('week', event) THEN i END) OVER (PARTITION BY symbol, event, as_of) AS hit FROM i),
    r AS (SELECT symbol, event, as_of, max(hit) AS hit, min(CASE WHEN NOT green AND i < coalesce(hit, oldest) THEN i END) AS ri FROM a GROUP BY ALL),
    j AS (SELECT r.symbol, r.event, r.as_of, coalesce(r.hit, greatest(0, CAST(floor((z.week - r.event) / 7) AS BIGINT))) AS weeks, z.green, z.cl, z.c0 AS price, z.vol, z.usual, z.shares, z.dollars, z.n, q.week AS rw, q.h AS rh, q.l AS rl,
        CASE WHEN q.h > q.l THEN (least(q.o, q.cl) - q.l) / (q.h - q.l) * 100 ELSE 0 END AS wick, CASE WHEN q.others > 0 THEN q.vol / q.others ELSE 1 END AS ratio
        FROM r JOIN a z ON z.symbol = r.symbol AND z.event = r.event AND z.as_of = r.as_of AND z.i = 0 LEFT JOIN a q ON q.symbol = r.symbol AND q.event = r.event AND q.as_of = r.as_of AND q.i = r.ri),
    b AS (SELECT symbol, event, as_of, weeks, green, cl, price, vol, usual, shares, dollars, CASE WHEN weeks <= 5 THEN rw END AS rw, CASE WHEN weeks <= 5 THEN rh END AS rh, CASE WHEN weeks <= 5 THEN rl END AS rl, wick, ratio FROM j WHERE n >= 5),
    s AS (SELECT b.*, gap, CASE WHEN weeks > 5 THEN 'EXPIRED' WHEN rw IS NULL THEN 'MONITORING' WHEN green AND cl > rh THEN 'BREAKOUT' ELSE 'SIGNAL_READY' END AS stage, coalesce((price - rh) / rh * 100, 0) AS above, CASE WHEN rl < price THEN rl END AS stop FROM b JOIN v USING (symbol, event, as_of)),
    p AS (SELECT *, above > 0 AND coalesce(vol > usual, false) AS confirmed, (dollars >= {FLOORS[0]})::INT + (shares >= {FLOORS[1]})::INT + (price >= {FLOORS[2]})::INT AS passed FROM s),
    x AS (SELECT *, (CASE WHEN gap >= 10 THEN 50 WHEN gap >= 7 THEN 40 WHEN gap >= 5 THEN 30 WHEN gap >= 3 THEN 20 ELSE 10 END + CASE stage WHEN 'BREAKOUT' THEN 50 WHEN 'SIGNAL_READY' THEN if(wick > 30, 45, 40) WHEN 'MONITORING' THEN if(weeks <= 2, 25, 15) ELSE 0 END)::DOUBLE AS setup,
        (CASE WHEN above <= 0 THEN 0 WHEN above >= 3 AND confirmed THEN 100 WHEN above >= 2 AND confirmed THEN 85 WHEN above >= 1 THEN 70 ELSE 55 END)::DOUBLE AS breakout,
        (CASE passed WHEN 3 THEN CASE WHEN dollars > {TIERS[0]} THEN 100 WHEN dollars > {TIERS[1]} THEN 85 ELSE 70 END WHEN 2 THEN 40 ELSE 15 END)::DOUBLE AS liquidity, if(stop IS NULL, 25, 70)::DOUBLE AS risk_reward FROM p),
    f AS (SELECT *, round_even(setup * 0.3::DOUBLE + breakout * 0.25::DOUBLE + liquidity * 0.25::DOUBLE + risk_reward * 0.2::DOUBLE, 1) AS composite, least(setup, breakout, liquidity, risk_reward) AS low FROM x)
    SELECT symbol, event, as_of, stage, weeks::BIGINT AS weeks, rw AS red_week, CASE WHEN rw IS NOT NULL THEN floor((wick) * 10 + 0.5) / 10 END AS wick_pct, CASE WHEN rw IS NOT NULL THEN floor((ratio) * 100 + 0.5) / 100 END AS red_volume, floor((above) * 100 + 0.5) / 100 AS breakout_pct, confirmed, floor((price) * 100 + 0.5) / 100 AS entry, floor((stop) * 100 + 0.5) / 100 AS stop,
        floor((price + (price - stop) * 2) * 100 + 0.5) / 100 AS target, floor(((price - stop) / price * 100) * 100 + 0.5) / 100 AS risk_pct, setup, breakout, liquidity, risk_reward, composite,
        CASE WHEN composite >= 85 THEN 'Strong Setup' WHEN composite >= 70 THEN 'Good Setup' WHEN composite >= 55 THEN 'Developing' ELSE 'Weak' END AS rating,
        CASE low WHEN setup THEN 'setup' WHEN breakout THEN 'breakout' WHEN liquidity THEN 'liquidity' ELSE 'risk_reward' END AS weakest FROM f"""

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {"h16_drift_setups": lambda s, d: rounded(setups(s, d)), "h07_market_states": lambda s, d: rounded(market_states(s, d))}
SQL: dict[str, str] = {"h16_drift_setups": dates_as_text(_SQL, ("event", "as_of", "red_week"))}
