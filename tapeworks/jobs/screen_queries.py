"""Queries of the screens over derived tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.tables import BARS, bars, dates_as_text, earnings, rounded, table
from tapeworks.operators import features as f
from tapeworks.operators import patterns as p
from tapeworks.operators import screens as c

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, dates: tuple[str, ...] = ()) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    SQL[name] = dates_as_text(sql, dates)


_add("p01_prefilter_quote", lambda s, d: c.prefilter_quote(f.range_52w(bars(s, d)), volume=20.0), f"""WITH {BARS}, x AS (SELECT *, max(high) OVER y AS yh, min(low) OVER y AS yl, avg(volume) OVER v AS av FROM bars
    WINDOW y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), v AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING))
    SELECT symbol, date, close > 10 AND av >= 20 AND close / yl - 1 >= 0.2::DOUBLE AND 1 - close / yh <= 0.3::DOUBLE AS passed, round(least(close / yl - 1, 1) * 50 + (1 - (1 - close / yh)) * 50, 6) AS likelihood FROM x""", ("date",))
_add("p03_tradable_common_stock", lambda s, d: c.tradable_common_stock(table(s, d, "part").select(F.col("p_brand").alias("symbol"), "p_partkey", (F.col("p_size") > 45).alias("is_etf"), (F.col("p_size") < 3).alias("is_fund"), F.when(F.col("p_size") != 10, True).otherwise(False).alias("is_active"))).select("p_partkey"),
     "SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 45 AND p_size <> 10")
_add("p04_stale_price", lambda s, d: c.stale_price(bars(s, d), limit=60.0), f"WITH {BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) SELECT symbol, count(*) = 10 AND avg((high - low) / close * 100) < 60 AS is_stale FROM x WHERE k <= 10 GROUP BY symbol")
_add("p08_entry_ready", lambda s, d: c.entry_ready(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "Extended").otherwise("Pre-breakout").alias("state"), (F.col("p_size") - 20).alias("distance_pct"), (F.col("p_size") / 25).alias("dry_up"), (F.col("p_size") - 2).alias("risk_pct"), (F.col("p_partkey") % 2 == 0).alias("valid"))).select("p_partkey", "entry_ready"),
     "SELECT p_partkey, p_size % 5 <> 0 AND p_size - 20 BETWEEN -8 AND 3 AND p_size / 25 <= 1 AND p_size - 2 > 0 AND p_size - 2 <= 15 AND p_partkey % 2 = 0 AS entry_ready FROM part")
_add("p09_earnings_entry_filter", lambda s, d: c.earnings_entry_filter(table(s, d, "part").select("p_partkey", (F.col("p_size") * 2).alias("price"), (F.col("p_partkey") % 30 / 100).alias("gap"), (F.col("p_partkey") % 101).alias("score"))).select("p_partkey"),
     "SELECT p_partkey FROM part WHERE p_size * 2 >= 30 AND NOT (p_partkey % 30 / 100 >= 0.1::DOUBLE AND p_partkey % 101 >= 85)")
_add("p10_hard_invalidation", lambda s, d: c.hard_invalidation(table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("earnings_in"), (F.col("c_acctbal") * 1e6).alias("market_cap"), (F.col("c_acctbal") * 1e4).alias("adv"), (F.col("c_custkey") % 9).alias("price"), (F.col("c_custkey") % 100).alias("days_listed"))).select("c_custkey", F.array_join("reasons", ",").alias("reasons")),
     "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 <= 2 THEN 'earnings' END, CASE WHEN c_acctbal * 1e6 < 2e9 THEN 'market_cap' END, CASE WHEN c_acctbal * 1e4 < 2e7 THEN 'liquidity' END, CASE WHEN c_custkey % 9 < 5 THEN 'price' END, CASE WHEN c_custkey % 100 < 60 THEN 'listed' END], lambda z: z IS NOT NULL), ',') AS reasons FROM customer")
_add("p11_filter_earnings_calendar", lambda s, d: c.filter_earnings_calendar(earnings(s, d), table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg((F.max("p_retailprice") * 1e6).alias("market_cap")).withColumn("exchange", F.when(F.col("symbol").endswith("1"), "LSE").otherwise("NYSE")), 9.98e8).select("symbol", "date", "timing"),
     f"WITH {BARS}, pf AS (SELECT p_brand AS symbol FROM part WHERE p_brand NOT LIKE '%1' GROUP BY p_brand HAVING max(p_retailprice) * 1e6 >= 9.98e8) SELECT symbol, date, timing FROM earn JOIN pf USING (symbol)", ("date",))
_add("p12_grade_gate", lambda s, d: c.grade_gate(table(s, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("grade")), "B"), "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A' ELSE 'B' END AS grade FROM customer WHERE c_custkey % 4 <= 1")
_add("p13_review_due", lambda s, d: c.review_due(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("ACTIVE").alias("status"), F.to_date("o_orderdate").cast("string").alias("next_review")), "1997-01-01").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) <= DATE '1997-01-01'")
_add("f19_k07_share_classes", lambda s, d: c.dedupe_share_classes(table(s, d, "supplier").select(F.concat(F.lit("S"), F.translate((F.col("s_suppkey") % 17).cast("string"), "0123456789", "ABCDEFGHIJ"), F.when(F.col("s_suppkey") % 2 == 0, ".A").otherwise("-B")).alias("symbol"), F.col("s_acctbal").alias("market_cap"))).select("symbol", "market_cap"),
     "WITH x AS (SELECT 'S' || translate(CAST(s_suppkey % 17 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS g, CASE WHEN s_suppkey % 2 = 0 THEN '.A' ELSE '-B' END AS e, s_acctbal AS m FROM supplier), y AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m DESC, g || e) AS k FROM x) SELECT g || e AS symbol, m AS market_cap FROM y WHERE k = 1")
_add("k09_cap_synthetic", lambda s, d: c.cap_synthetic(table(s, d, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 3 != 0).alias("synthetic"), F.col("o_totalprice").alias("priority"), F.col("o_orderkey").alias("id"))).select("grp", "id"),
     "WITH x AS (SELECT o_orderpriority AS grp, o_orderkey % 3 <> 0 AS syn, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 3 <> 0 ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) FILTER (o_orderkey % 3 = 0) OVER (PARTITION BY o_orderpriority) AS r FROM orders) SELECT grp, id FROM x WHERE NOT syn OR k <= greatest(ceil(r * 0.5::DOUBLE), 3)")
_add("w44_rank_composite", lambda s, d: c.rank_composite(table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_nationkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("cap"), (F.col("s_suppkey") % 13).alias("change")), {"cap": 0.6, "change": 0.4}, "s_nationkey").select("symbol", "composite"),
     "WITH x AS (SELECT s_suppkey AS symbol, s_nationkey AS g, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS cap, s_suppkey % 13 AS ch FROM supplier), y AS (SELECT *, (count(cap) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY cap DESC NULLS LAST, symbol) + 1) / count(cap) OVER (PARTITION BY g) AS a, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY ch DESC, symbol) + 1) / count(*) OVER (PARTITION BY g) AS b FROM x) SELECT symbol, round(CASE WHEN cap IS NULL THEN b ELSE a * 0.6::DOUBLE + b * 0.4::DOUBLE END, 6) AS composite FROM y")
_add("w47_sector_strength", lambda s, d: c.sector_strength(table(s, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("sector"), "c_acctbal"), "c_acctbal"), "WITH x AS (SELECT c_custkey AS symbol, c_mktsegment AS sector, (count(*) OVER (PARTITION BY c_mktsegment) - rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)) / count(*) OVER (PARTITION BY c_mktsegment) * 100 AS x FROM customer) SELECT symbol, sector, round(x, 6) AS strength, x >= 80 AS leader FROM x")
_add("w46_score_trend", lambda s, d: c.score_trend(bars(s, d).select("symbol", "date", (F.col("close") / 1000).alias("score"))), f"WITH {BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars), y AS (SELECT symbol, arg_max(close / 1000, date) - arg_min(close / 1000, date) AS q FROM x WHERE k <= 5 GROUP BY symbol) SELECT symbol, round(q, 6) AS delta, CASE WHEN q > 2 THEN 'improving' WHEN q < -2 THEN 'deteriorating' ELSE 'stable' END AS trend FROM y")
_add("h18_plateau", lambda s, d: c.plateau(table(s, d, "orders").select(F.col("o_custkey").alias("strategy"), F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 5000).alias("score"))), """WITH x AS (SELECT o_custkey AS strategy, o_orderkey AS i, o_totalprice / 5000 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders),
    y AS (SELECT strategy, count(*) = 3 AND max(score) - min(score) <= 3 AS p, arg_max(score, i) AS a, arg_min(score, i) AS b FROM x WHERE k <= 3 GROUP BY strategy) SELECT strategy, p AS plateau, CASE WHEN a < 30 AND a <= b THEN 'abandon' WHEN p THEN 'pivot' ELSE 'continue' END AS advice FROM y""")
_THEMES = {"size": ["small", "medium"], "offer": ["promo", "economy"]}
_add("j19_theme_match", lambda s, d: c.theme_match(table(s, d, "part").select("p_type").distinct(), _THEMES, "p_type"), "WITH x AS (SELECT DISTINCT lower(p_type) AS t FROM part) SELECT 'size' AS theme, count(*) AS members FROM x WHERE regexp_matches(t, 'small|medium') HAVING count(*) >= 2 UNION ALL SELECT 'offer', count(*) FROM x WHERE regexp_matches(t, 'promo|economy') HAVING count(*) >= 2")
_add("j20_unmatched", lambda s, d: c.unmatched(table(s, d, "part").select("p_type").distinct(), _THEMES, "p_type"), "SELECT DISTINCT p_type FROM part WHERE NOT regexp_matches(lower(p_type), 'small|medium|promo|economy')")
_add("j08_news_reaction", lambda s, d: c.news_reaction(table(s, d, "customer").select(F.col("c_custkey").alias("symbol"), (F.col("c_acctbal") / 100000).alias("reaction")), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("segment")), 50), "SELECT c_custkey AS symbol, round(c_acctbal / 100000, 6) AS reaction, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, round(70 * least(1, abs(c_acctbal / 100000) / 0.12::DOUBLE) + 20, 2) AS score FROM customer ORDER BY abs(c_acctbal / 100000) DESC, symbol LIMIT 50")
_add("h09_trend_trades", lambda s, d: c.trend_trades(bars(s, d)), f"""WITH {BARS}, x AS (SELECT *, coalesce(close > CASE WHEN count(*) OVER a = 20 THEN avg(close) OVER a END, false) AS "on", lead(close) OVER w AS nx, lead(date) OVER w AS nd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    y AS (SELECT *, sum((NOT "on")::INT) OVER w AS g FROM x {_W}) SELECT symbol, min(date) AS entry, arg_max(coalesce(nd, date), date) AS "exit", round(arg_max(coalesce(nx, close), date) / arg_min(close, date) - 1, 6) AS ret FROM y WHERE "on" GROUP BY symbol, g""", ("entry", "exit"))
_add("w27_power_trend", lambda s, d: c.power_trend(bars(s, d)), f"""WITH {BARS}, i AS (SELECT symbol, date, close, row_number() OVER w AS i, avg(close) OVER a AS seed, CASE WHEN count(*) OVER b = 50 THEN avg(close) OVER b END AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)),
    e AS (SELECT *, pow(10 / 11::DOUBLE, i - 21) * (max(seed) FILTER (i = 21) OVER (PARTITION BY symbol) + coalesce(sum(close / 11 / pow(10 / 11::DOUBLE, i - 21)) FILTER (i > 21) OVER (PARTITION BY symbol ORDER BY date), 0)) AS s FROM i)
    SELECT symbol, date, coalesce(i >= 21 AND s > m AND m > lag(m, 5) OVER w AND close > s, false) AS power FROM e {_W}""", ("date",))
_add("w26_gap_downs", lambda s, d: c.gap_downs(bars(s, d)), f"WITH {BARS}, x AS (SELECT symbol, date, coalesce(open / lag(close) OVER w - 1 <= -0.005 AND volume > 1.1::DOUBLE * lag(volume) OVER w, false)::INT AS h FROM bars {_W}) SELECT symbol, date, CAST(sum(h) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS BIGINT) AS gap_downs FROM x", ("date",))
_DET = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS bar FROM bars),
    q AS (SELECT symbol, date, count(*) OVER b = 3 AND count(*) OVER a = 3 AND high > max(high) OVER b AND high > max(high) OVER a AS hi FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
    det AS (SELECT n.symbol, n.bar, n.high AS pv, n.low * 0.5 AS st, n.close AS c0 FROM n JOIN q USING (symbol, date) WHERE hi)"""


def _detections(s: SparkSession, d: str) -> DataFrame:
    numbered = bars(s, d).select("symbol", "date", F.row_number().over(f.by()).alias("bar"))
    tops = p.fixed_window_swings(bars(s, d), 3).where("swing_high")
    return tops.join(numbered, ["symbol", "date"]).select("symbol", "bar", F.col("high").alias("pivot"), (F.col("low") * 0.5).alias("stop"))


_add("h05_forward_outcome", lambda s, d: c.forward_outcome(_detections(s, d), bars(s, d)), f"""WITH {BARS}, {_DET}, x AS (SELECT det.symbol, det.bar, c0, min(CASE WHEN n.close > pv THEN n.bar END) AS up, min(CASE WHEN n.close < st THEN n.bar END) AS dn, max(n.close) AS hi, min(n.close) AS lo
    FROM det JOIN n ON n.symbol = det.symbol AND n.bar BETWEEN det.bar + 1 AND det.bar + 60 GROUP BY ALL)
    SELECT symbol, bar, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up <= dn) THEN 'breakout' WHEN dn IS NOT NULL THEN 'stop_hit' ELSE 'timeout' END AS outcome, least(up, dn) - bar AS days, round(hi / c0 - 1, 6) AS max_gain, round(lo / c0 - 1, 6) AS max_loss FROM x""")
_add("u02_distinct_hints", lambda s, d: c.distinct_hints(table(s, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "p_partkey"), "SELECT min(p_partkey) AS p_partkey, p_brand, p_type FROM part GROUP BY p_brand, p_type")
_add("u03_common_dates", lambda s, d: c.common_dates(bars(s, d), "Brand#1", "Brand#2"), f"WITH {BARS} SELECT date FROM bars WHERE symbol IN ('Brand#1', 'Brand#2') AND close > 0 GROUP BY date HAVING count(DISTINCT symbol) = 2", ("date",))
_add("u04_index_difference", lambda s, d: c.index_difference(table(s, d, "customer").where("c_custkey % 3 <> 0"), table(s, d, "customer").where("c_custkey % 5 <> 0"), "c_custkey"), "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'left' ELSE 'right' END AS side FROM customer WHERE (c_custkey % 3 <> 0) <> (c_custkey % 5 <> 0)")
