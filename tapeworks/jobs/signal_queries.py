"""Queries for scalars, signals, outcomes, breadth, income, texts, folds and intraday state, with SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions import scalars as x
from tapeworks.jobs.event_queries import _PANEL, _panel
from tapeworks.jobs.pattern_queries import smooth
from tapeworks.jobs.tables import BARS, INTRADAY, OUTCOMES, bars, dates_as_text, intraday, outcomes, rounded, table, ticks
from tapeworks.operators import breadth as b
from tapeworks.operators import folds, income
from tapeworks.operators import regime as r
from tapeworks.operators import signals as g
from tapeworks.operators import textchecks as t
from tapeworks.operators.features import frame, sma
from tapeworks.operators.ordered import written
from tapeworks.sources import bars as src
from tapeworks.streaming import intraday as live

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, dates: tuple[str, ...] = ()) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        SQL[name] = dates_as_text(sql, dates)


def _scalar(name: str, source: str, key: str, cols: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of column expressions over a table, and the same in SQL."""
    _add(name, lambda s, d: table(s, d, source).select(key, *[c().alias(n) for n, (c, _) in cols.items()]), f"SELECT {key}, {', '.join(f'{q} AS {n}' for n, (_, q) in cols.items())} FROM {source}")


_scalar("f01_linear_score", "orders", "o_orderkey", {"score": (lambda: x.linear_score(F.col("o_totalprice"), 1000.0, 300000.0), "round(least(100, greatest(0, (o_totalprice - 1000.0) / 299000.0 * 100)), 6)")})
_scalar("f02_step_score", "orders", "o_orderkey", {"score": (lambda: x.step_score(F.col("o_totalprice"), ((200000, 100), (100000, 60), (50000, 20)), 5), "CASE WHEN o_totalprice >= 200000 THEN 100.0::DOUBLE WHEN o_totalprice >= 100000 THEN 60 WHEN o_totalprice >= 50000 THEN 20 ELSE 5 END")})
_scalar("f03_momentum_scores", "orders", "o_orderkey", {
    "industry": (lambda: x.industry_momentum(F.col("o_totalprice") / 10000), "round(100 / (1 + exp(-0.15 * (abs(o_totalprice / 10000) - 5))), 6)"), "theme": (lambda: x.theme_momentum(F.col("o_totalprice") / 10000), "round(100 / (1 + exp(-2.0 * (ln(1 + abs(o_totalprice / 10000)) - ln(16.0)))), 6)")})
_scalar("f05_log10_liquidity", "orders", "o_orderkey", {"score": (lambda: x.log10_liquidity(F.col("o_totalprice") * 1000), "round(least(10, greatest(0, (log10(o_totalprice * 1000) - 7) / 1.5 * 10)), 6)")})
_scalar("f06_cagr", "part", "p_partkey", {"growth": (lambda: x.cagr(F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size") * 100, 3), "round((pow((p_retailprice + p_size * 100) / p_retailprice, 1.0::DOUBLE / 3) - 1) * 100, 2)")})
_scalar("f07_normalize_timing", "customer", "c_custkey", {"timing": (lambda: x.normalize_timing(F.when(F.col("c_custkey") % 3 == 0, " BMO ").when(F.col("c_custkey") % 3 == 1, "After Market Close").otherwise("noon")), "CASE c_custkey % 3 WHEN 0 THEN 'bmo' WHEN 1 THEN 'amc' ELSE 'unknown' END")})
_scalar("f08_normalize_direction", "customer", "c_custkey", {"direction": (lambda: x.normalize_direction(F.when(F.col("c_custkey") % 3 == 0, " Bullish ").when(F.col("c_custkey") % 3 == 1, "SELL").otherwise(F.col("c_mktsegment"))), "CASE c_custkey % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'NEUTRAL' END")})
_scalar("f09_normalize_score", "customer", "c_custkey", {"score": (lambda: x.normalize_score(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise(F.substring("c_mktsegment", 1, 1))),
    "round(CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal <= 1 THEN c_acctbal WHEN c_acctbal <= 100 THEN c_acctbal / 100 ELSE 1 END ELSE CASE substr(c_mktsegment, 1, 1) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'F' THEN 0.2 ELSE 0 END END, 6)::DOUBLE")})
_scalar("f10_horizon_bucket", "part", "p_partkey", {"bucket": (lambda: x.horizon_bucket(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "D").when(F.col("p_partkey") % 4 == 1, " w").when(F.col("p_partkey") % 4 == 2, "M").otherwise(" years"))),
    "CASE p_partkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN CASE WHEN p_size <= 12 THEN 'short' ELSE 'medium' END WHEN 2 THEN CASE WHEN p_size <= 3 THEN 'short' WHEN p_size <= 6 THEN 'medium' ELSE 'long' END ELSE 'long' END")})
_scalar("f11_ticker_array", "part", "p_partkey", {"tickers": (lambda: F.array_join(x.ticker_array(F.concat_ws(" , ", F.lower("p_brand"), "p_brand", F.lit(""), F.lit("spy"))), ","), "array_to_string(list_sort(['SPY', upper(p_brand)]), ',')")})
_scalar("f12_jaccard", "part", "p_partkey", {
    "jaccard": (lambda: x.jaccard(F.split("p_type", " "), F.split("p_name", " ")), "round(len(list_intersect(string_split(p_type, ' '), string_split(p_name, ' '))) / len(list_distinct(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')))), 6)"),
    "containment": (lambda: x.containment(F.split("p_type", " "), F.split("p_name", " ")), "round(len(list_intersect(string_split(p_type, ' '), string_split(p_name, ' '))) / least(len(list_distinct(string_split(p_type, ' '))), len(list_distinct(string_split(p_name, ' ')))), 6)")})
_scalar("f13_first_family", "part", "p_partkey", {"family": (lambda: x.first_family(F.col("p_brand"), (("one", ("#1", "#3")), ("two", ("#2",)))), "CASE WHEN p_brand LIKE '%#1%' OR p_brand LIKE '%#3%' THEN 'one' WHEN p_brand LIKE '%#2%' THEN 'two' END")})
_scalar("f14_sanitize_identifier", "part", "p_partkey", {"id": (lambda: x.sanitize_identifier(F.concat(F.lit("--"), "p_brand", F.lit(" & "), "p_type", F.lit("!"))), "regexp_replace(regexp_replace(lower('--' || p_brand || ' & ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')")})
_scalar("f15_recency_factor", "orders", "o_orderkey", {"factor": (lambda: x.recency_factor(F.to_date("o_orderdate"), F.lit("1998-06-05").cast("date")), "CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-06-05') < 1 THEN 1.0::DOUBLE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-06-05') <= 3 THEN 0.95 WHEN date_diff('day', o_orderdate::DATE, DATE '1998-06-05') <= 7 THEN 0.9 ELSE 0.85 END")})
_DAYS = "(SELECT count(*) FROM range(0, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1996-01-17'))) q(i) WHERE isodow(o_orderdate::DATE + CAST(i + 1 AS INT)) <= 5)"
_scalar("f16_trading_days", "orders", "o_orderkey", {"days": (lambda: x.trading_days_between(F.to_date("o_orderdate"), F.lit("1996-01-17").cast("date")), _DAYS)})
_scalar("f17_quarter_end", "orders", "o_orderkey", {"quarter": (lambda: F.quarter("o_orderdate").cast("long"), "quarter(o_orderdate)"), "ends": (lambda: x.quarter_end(F.to_date("o_orderdate")).cast("string"), "CAST(last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS VARCHAR)")})
_scalar("f18_fingerprint", "part", "p_partkey", {"print": (lambda: x.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_partkey").cast("string")), "substr(sha256(p_brand || '|' || p_type || '|' || p_partkey), 1, 16)")})
_scalar("f20_daily_limit", "part", "p_partkey", {
    "low": (lambda: x.daily_limit(F.col("p_retailprice"), 0.15, 0.1)[0], "round(p_retailprice * (1 - 0.1::DOUBLE), 6)"),
    "sessions": (lambda: x.sessions_to_reach(F.col("p_retailprice"), F.col("p_retailprice") * 2.1, 0.15), "CAST(greatest(1, ceil(ln(p_retailprice * 2.1::DOUBLE / p_retailprice) / ln(1.15::DOUBLE))) AS BIGINT)")})
_scalar("f21_market_cap_tier", "orders", "o_orderkey", {"tier": (lambda: x.market_cap_tier(F.col("o_totalprice") * 1e6), "CASE WHEN o_totalprice * 1e6 >= 200e9 THEN 'Mega' WHEN o_totalprice * 1e6 >= 10e9 THEN 'Large' WHEN o_totalprice * 1e6 >= 2e9 THEN 'Mid' WHEN o_totalprice > 0 THEN 'Small' ELSE 'Unknown' END")})
def _size() -> tuple[Column, Column]:
    return x.position_size(100000.0, 1.0, F.col("p_retailprice"), F.col("p_retailprice") * 0.93, 10.0)
_scalar("f22_position_size", "part", "p_partkey", {"shares": (lambda: _size()[0], "CAST(least(floor(1000.0::DOUBLE / (p_retailprice - p_retailprice * 0.93::DOUBLE)), floor(10000.0::DOUBLE / p_retailprice)) AS BIGINT)"),
    "binds": (lambda: _size()[1], "CASE WHEN floor(1000.0::DOUBLE / (p_retailprice - p_retailprice * 0.93::DOUBLE)) <= floor(10000.0::DOUBLE / p_retailprice) THEN 'risk' ELSE 'position' END")})
_scalar("f23_trade_prices", "part", "p_partkey", {"risk_pct": (lambda: x.trade_prices(F.col("p_retailprice"), F.col("p_retailprice") * 0.9 - F.col("p_size"))["risk_pct"], "round((p_retailprice * 1.02::DOUBLE - (p_retailprice * 0.9::DOUBLE - p_size)) / (p_retailprice * 1.02::DOUBLE) * 100, 4)")})

# Outcomes of signals.
_CAT = """cat AS (SELECT *, CASE WHEN abs(ret5) < 0.005 THEN 'NEUTRAL' WHEN sg > 0 THEN 'TRUE_POSITIVE' WHEN changed AND sg < -0.02 THEN 'REGIME_MISMATCH' WHEN sg < -0.02 THEN 'FALSE_POSITIVE_SEVERE' ELSE 'FALSE_POSITIVE' END AS category
    FROM (SELECT *, CASE WHEN direction = 'SHORT' THEN -ret5 ELSE ret5 END AS sg, regime <> regime_now AS changed FROM outcomes))"""
_MET = """met AS (SELECT skill, count(*) AS n, count(*) FILTER (category = 'TRUE_POSITIVE') AS tp, count(*) FILTER (category LIKE 'FALSE_POSITIVE%') AS fp, count(*) FILTER (category = 'FALSE_POSITIVE_SEVERE') AS severe,
    count(*) FILTER (category = 'REGIME_MISMATCH') AS mismatch, count(*) FILTER (category = 'NEUTRAL') AS neutral, avg(ret5) AS mr FROM cat GROUP BY skill)"""


def _classified(s: SparkSession, d: str) -> DataFrame:
    return outcomes(s, d).withColumn("category", g.classify_outcome(F.col("direction"), F.col("ret5"), F.col("regime") != F.col("regime_now")))


_add("a19_classify_outcome", lambda s, d: _classified(s, d).select("signal_id", "category"), f"WITH {OUTCOMES}, {_CAT} SELECT signal_id, category FROM cat")
_add("a14_skill_metrics", lambda s, d: g.skill_metrics(_classified(s, d)), f"WITH {OUTCOMES}, {_CAT}, {_MET} SELECT skill, n, tp, fp, severe, mismatch, neutral, round(tp / (tp + fp), 6) AS accuracy, round(fp / n, 6) AS fp_rate, round(mr, 6)::DOUBLE AS mean_ret FROM met")
_add("a15_weight_feedback", lambda s, d: g.weight_feedback(g.skill_metrics(_classified(s, d)), target=0.35), f"WITH {OUTCOMES}, {_CAT}, {_MET} SELECT skill, n, round(1 + (tp / (tp + fp) - 0.35) * 0.5, 6)::DOUBLE AS weight, CASE WHEN tp / (tp + fp) >= 0.35 THEN 'raise' ELSE 'lower' END AS action FROM met WHERE n >= 20 AND abs((tp / (tp + fp) - 0.35) * 0.5) >= 0.05")
_add("a16_improvement_backlog", lambda s, d: g.improvement_backlog(g.skill_metrics(_classified(s, d))), f"""WITH {OUTCOMES}, {_CAT}, {_MET}, u AS (SELECT skill, unnest([{{'rule': 'fp_rate', 'rate': fp / n, 'lim': 0.15}}, {{'rule': 'mismatch', 'rate': mismatch / n, 'lim': 0.25}}, {{'rule': 'severe', 'rate': severe / n, 'lim': 0.10}}]) AS q FROM met)
    SELECT skill, q.rule AS rule, round(q.rate, 6) AS rate FROM u WHERE q.rate > q.lim""")
_add("a17_worst_regime", lambda s, d: g.worst_regime(_classified(s, d)), f"""WITH {OUTCOMES}, {_CAT}, q AS (SELECT skill, regime, count(*) AS n, count(*) FILTER (category LIKE 'FALSE_POSITIVE%') / count(*) AS rate FROM cat GROUP BY ALL)
    SELECT skill, coalesce(arg_max(regime, (rate, regime)) FILTER (n >= 5 AND rate > 0.2), 'NONE') AS regime FROM q GROUP BY skill""")
_add("a18_outcome_summary", lambda s, d: g.outcome_summary(_classified(s, d)), f"""WITH {OUTCOMES}, {_CAT}, m AS (SELECT *, strftime(date, '%Y-%m') AS month FROM cat)
    SELECT skill, month, category, count(*) AS n, round(avg(ret5), 6)::DOUBLE AS mean_ret, grouping(skill, month, category) AS level FROM m GROUP BY GROUPING SETS ((skill), (month), (category))""")


def _signals(s: SparkSession, d: str, tickers: str = "l_partkey") -> DataFrame:
    """Signals of all orders: tickers are the lines' parts (or brands, of which there are 25), titles name customer and order."""
    rows = outcomes(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("signal_id"), "o_custkey"), "signal_id")
    lines = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("signal_id")).agg(F.array_sort(F.collect_set(F.col(tickers).cast("string"))).alias("tickers"))
    rows = rows.join(lines, "signal_id", "left")
    return rows.select(
        F.lpad(F.col("signal_id").cast("string"), 9, "0").alias("signal_ref"), "skill", F.concat(F.lit("customer c"), F.col("o_custkey").cast("string"), F.lit(" order "), F.col("signal_id").cast("string")).alias("title"), (F.col("raw") / 600000).alias("raw_score"),
        F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"), "direction", F.when(F.col("signal_id") % 3 == 0, "20D").when(F.col("signal_id") % 3 == 1, "5M").otherwise("soon").alias("horizon"), F.col("date").alias("ts"))


_SIGS = f"""{OUTCOMES}, tk AS (SELECT l_orderkey AS signal_id, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS tickers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
sigs AS (SELECT lpad(CAST(signal_id AS VARCHAR), 9, '0') AS signal_ref, skill, direction, raw / 600000 AS raw_score, coalesce(tickers, []) AS tickers, o_custkey, CASE signal_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'unknown' END AS h
    FROM outcomes JOIN orders ON o_orderkey = signal_id LEFT JOIN tk USING (signal_id)),
tick AS (SELECT signal_ref, skill, direction, h, len(tickers) AS n, unnest(tickers) AS ticker FROM sigs)"""
def _union(rows: DataFrame) -> DataFrame:
    names = {c: c for c in g.SIGNAL_COLUMNS if c != "skill"}
    return g.union_signals({"a": (rows.where("direction = 'LONG'"), names), "b": (rows.where("direction = 'SHORT'"), names)}).select("signal_ref", "skill", F.array_join("tickers", ",").alias("tickers"), "direction")


_add("u01_union_signals", lambda s, d: _union(_signals(s, d)), f"WITH {_SIGS} SELECT signal_ref, CASE direction WHEN 'LONG' THEN 'a' ELSE 'b' END AS skill, array_to_string(tickers, ',') AS tickers, direction FROM sigs")
# Titles hold four words, two of them in every title: six tenths of two titles' words agree if the customer does.
_add("h11_similar_pairs", lambda s, d: g.similar_pairs(_signals(s, d)), f"""WITH {_SIGS}, p AS (SELECT a.signal_ref AS a, b.signal_ref AS b FROM tick a JOIN tick b ON a.direction = b.direction AND a.ticker = b.ticker AND a.signal_ref < b.signal_ref GROUP BY 1, 2 HAVING count(*) >= 0.3 * (any_value(a.n) + any_value(b.n) - count(*)))
    SELECT a, b FROM p UNION SELECT a.signal_ref, b.signal_ref FROM sigs a JOIN sigs b ON a.o_custkey = b.o_custkey AND a.direction = b.direction AND a.signal_ref < b.signal_ref""")
_add("h11_dedupe_signals", lambda s, d: g.dedupe_signals(_signals(s, d)))
_add("h12_contradictions", lambda s, d: g.contradictions(_signals(s, d)), f"""WITH {_SIGS}
    SELECT a.signal_ref AS long_ref, b.signal_ref AS short_ref, min(a.ticker) AS ticker, CASE WHEN a.skill = b.skill THEN 'HIGH' WHEN a.h <> b.h AND a.h <> 'unknown' AND b.h <> 'unknown' THEN 'LOW' ELSE 'MEDIUM' END AS severity
    FROM tick a JOIN tick b ON a.ticker = b.ticker AND a.direction = 'LONG' AND b.direction = 'SHORT' GROUP BY a.signal_ref, b.signal_ref, a.skill, b.skill, a.h, b.h""")
_add("h12_contradiction_counts", lambda s, d: g.contradiction_counts(_signals(s, d)), f"""WITH {_SIGS}, p AS (SELECT a.signal_ref AS la, b.signal_ref AS sb, CASE WHEN a.skill = b.skill THEN 'high' WHEN a.h <> b.h AND a.h <> 'unknown' AND b.h <> 'unknown' THEN 'low' ELSE 'medium' END AS v
        FROM tick a JOIN tick b ON a.ticker = b.ticker AND a.direction = 'LONG' AND b.direction = 'SHORT' GROUP BY a.signal_ref, b.signal_ref, a.skill, b.skill, a.h, b.h)
    SELECT signal_ref, count(*) FILTER (v = 'high') AS high, count(*) FILTER (v = 'medium') AS medium, count(*) FILTER (v = 'low') AS low FROM (SELECT la AS signal_ref, v FROM p UNION ALL SELECT sb, v FROM p) GROUP BY signal_ref""")


def _conviction(s: SparkSession, d: str) -> DataFrame:
    rows = written(_signals(s, d))  # read by three steps
    scores = written(g.conviction(rows, written(g.dedupe_signals(rows)), {"1-URGENT": 0.3, "2-HIGH": 0.25}, "1998-02-01"))
    return g.adjust_for_contradictions(scores, g.contradiction_counts(rows))


_add("a20_conviction", _conviction)
_add("a21_concept_clusters", lambda s, d: g.concept_clusters(outcomes(s, d).select(F.col("skill").alias("hypothesis"), "regime", F.substring(F.col("signal_id").cast("string"), 1, 2).alias("symbol"), F.col("raw").alias("priority"))), f"""WITH {OUTCOMES}, k AS (SELECT skill AS hypothesis, regime, substr(CAST(signal_id AS VARCHAR), 1, 2) AS symbol, raw FROM outcomes),
    c0 AS (SELECT hypothesis, regime, symbol, count(*) AS c FROM k GROUP BY hypothesis, regime, symbol), c AS (SELECT *, row_number() OVER (PARTITION BY hypothesis, regime ORDER BY c DESC, symbol) AS n FROM c0), l AS (SELECT hypothesis, regime, string_agg(symbol, ',' ORDER BY n) AS symbols FROM c WHERE n <= 10 GROUP BY hypothesis, regime)
    SELECT k.hypothesis, k.regime, count(*) AS n, round(avg(raw), 4) AS mean_priority, any_value(symbols) AS symbols FROM k JOIN l ON k.hypothesis = l.hypothesis AND k.regime = l.regime GROUP BY k.hypothesis, k.regime""")
Q["a21_concept_clusters"] = (lambda run: lambda s, d: run(s, d).withColumn("mean_priority", F.round("mean_priority", 4)))(Q["a21_concept_clusters"])


def _concepts(rows: DataFrame) -> DataFrame:
    """Concepts by producer and first ticker; those without tickers have none."""
    rows = rows.where(F.size("tickers") > 0).withColumn("concept_id", F.element_at("tickers", 1)).withColumnRenamed("skill", "hypothesis")
    key = ["hypothesis", "concept_id"]
    sets = rows.select(*key, F.explode("tickers").alias("ticker")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("ticker")).alias("conditions"))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg("raw_score").alias("priority")).join(sets, key)


_add("h13_merge_concepts", lambda s, d: g.merge_concepts(_concepts(_signals(s, d, "p_brand"))))


def _fills(s: SparkSession, d: str) -> DataFrame:
    """Each order is a position: its first line's day buys all shares at the mean price, every line sells its own later."""
    lines = table(s, d, "lineitem").where("l_quantity > 0").select(F.col("l_orderkey").alias("position"), F.col("l_returnflag").alias("f"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    buy = lines.groupBy("position").agg(F.min("f").alias("kind"), F.min("date").alias("date"), F.sum("q").alias("shares"), F.avg("price").alias("price"))
    sell = lines.join(buy.select("position", "kind"), "position").select("position", "kind", "date", (-F.col("q")).alias("shares"), "price")
    return buy.unionByName(sell)


_POS = """lines AS (SELECT l_orderkey AS position, l_returnflag AS f, CAST(l_shipdate AS DATE) AS date, l_quantity AS q, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_quantity > 0),
pos AS (SELECT position, min(f) AS kind, sum(q * price) - sum(q) * avg(price) AS pnl, (sum(q * price) - sum(q) * avg(price)) / (sum(q) * avg(price)) * 100 AS pnl_pct, date_diff('day', min(date), max(date)) AS days FROM lines GROUP BY position)"""
_add("a39_position_outcomes", lambda s, d: g.position_outcomes(_fills(s, d)).select("position", "kind", F.round("pnl_pct", 4).alias("pnl_pct"), "days"), f"WITH {_POS} SELECT position, kind, round(pnl_pct, 4) + 0.0 AS pnl_pct, days FROM pos")
_add("a39_outcome_stats", lambda s, d: g.outcome_stats(g.position_outcomes(_fills(s, d)).withColumn("pnl", F.round("pnl", 4))), f"WITH {_POS} SELECT kind, count(*) AS n, round(avg(CASE WHEN round(pnl, 4) > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(pnl_pct), 6) AS mean_pct, round(avg(days), 6) AS mean_days, CAST(grouping(kind) AS BIGINT) AS level FROM pos GROUP BY ROLLUP (kind)")
_add("a40_backtest_quality", lambda s, d: g.backtest_quality(outcomes(s, d).select(F.col("skill").alias("strategy"), F.col("signal_id").alias("at"), "date", (F.col("ret5") * 100).alias("pnl")), 5, True), f"""WITH {OUTCOMES}, e AS (SELECT skill AS strategy, date, ret5 * 100 AS pnl, sum(ret5 * 100) OVER w AS eq, signal_id FROM outcomes WINDOW w AS (PARTITION BY skill ORDER BY signal_id ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY strategy ORDER BY signal_id ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e),
    m AS (SELECT strategy, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (pnl > 0) / count(*) AS wr, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS aw, coalesce(-avg(pnl) FILTER (pnl <= 0), 0) AS al, max(dd) AS dd, date_diff('day', min(date), max(date)) // 365 AS yr FROM q GROUP BY strategy),
    x AS (SELECT *, round(wr / 100 * aw - (1 - wr / 100) * al, 9) AS ex, CASE WHEN (1 - wr / 100) * al <> 0 THEN round(wr / 100 * aw / ((1 - wr / 100) * al), 9) END AS pf, round(dd, 9) AS d9 FROM m),
    s AS (SELECT *, CASE WHEN n < 30 THEN 0 WHEN n < 100 THEN 8 + floor((n - 30) / 70 * 7) WHEN n < 200 THEN 15 + floor((n - 100) / 100 * 5) ELSE 20 END AS s1, CASE WHEN ex <= 0 THEN 0 WHEN ex < 0.5 THEN 5 + floor(ex / 0.5 * 5) WHEN ex < 1.5 THEN 10 + floor((ex - 0.5) * 8) ELSE 20 END AS s2,
        CASE WHEN d9 >= 50 THEN 0 ELSE least(20, CASE WHEN d9 < 20 THEN 12 ELSE floor(12 * (50 - d9) / 30) END + CASE WHEN pf IS NULL OR pf >= 3 THEN 8 WHEN pf < 1 THEN 0 ELSE floor((pf - 1) / 2 * 8) END) END AS s3, least(20, CASE WHEN yr < 5 THEN 0 WHEN yr >= 10 THEN 15 ELSE 5 + floor((yr - 5) / 5 * 10) END + 3) AS s4, 20 AS s5 FROM x)
    SELECT strategy, n, round(wr, 6) AS win_rate, round(ex, 6) AS expectancy, round(pf, 6) AS profit_factor, round(dd, 6) AS max_drawdown, yr AS years, s1::BIGINT AS sample, s2::BIGINT AS expectancy_score, s3::BIGINT AS risk, s4::BIGINT AS robustness, s5::BIGINT AS realism, (s1 + s2 + s3 + s4 + s5)::BIGINT AS total,
        CASE WHEN s1 + s2 + s3 + s4 + s5 >= 70 THEN 'Deploy' WHEN s1 + s2 + s3 + s4 + s5 >= 40 THEN 'Refine' ELSE 'Abandon' END AS verdict, array_to_string(list_filter([CASE WHEN n < 30 THEN 'small_sample' END, CASE WHEN dd > 50 THEN 'excessive_drawdown' END, CASE WHEN yr < 5 THEN 'short_test_period' END, CASE WHEN ex < 0 THEN 'negative_expectancy' END, CASE WHEN wr > 90 AND dd < 5 THEN 'too_good' END], lambda z: z IS NOT NULL), ',') AS red_flags FROM s""")
_add("k02_top_bottom", lambda s, d: g.top_bottom(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10), """WITH a AS (SELECT c_custkey, c_acctbal, 'top' AS "end" FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10), b AS (SELECT c_custkey, c_acctbal, 'bottom' AS "end" FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 10)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)""")
_add("k06_merge_and_rank", lambda s, d: g.merge_and_rank(table(s, d, "orders").withColumn("sym", F.col("o_custkey") % 97), "sym", "o_totalprice", "o_orderstatus", 20), "SELECT o_custkey % 97 AS sym, max(o_totalprice) AS o_totalprice, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS sources FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_add("k08_best_per_key", lambda s, d: g.best_per_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey"), "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
_add("j22_differences", lambda s, d: g.differences(table(s, d, "supplier").where("s_suppkey % 7 <> 0"), table(s, d, "supplier").where("s_suppkey % 5 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(F.col("s_acctbal"))), "s_suppkey", ["s_name", "s_acctbal"]),
    "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'only_right' WHEN s_suppkey % 5 = 0 THEN 'only_left' ELSE 's_acctbal' END AS difference FROM supplier WHERE NOT (s_suppkey % 7 = 0 AND s_suppkey % 5 = 0) AND (s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 OR (s_suppkey % 3 = 0 AND s_acctbal <> 0))")

# Breadth series.
_BS = f"""{BARS}, {_PANEL}, sx AS (SELECT date, b50 AS raw, mr, avg(b50) OVER a AS ma8, avg(b50) OVER l AS ma200 FROM breadth WINDOW a AS (ORDER BY date ROWS 7 PRECEDING), l AS (ORDER BY date ROWS 199 PRECEDING)),
    sy AS (SELECT *, CASE WHEN round(ma200, 9) >= lag(round(ma200, 9)) OVER (ORDER BY date) THEN 1 ELSE -1 END AS trend FROM sx)"""


def _series(s: SparkSession, d: str) -> DataFrame:
    return b.breadth_series(r.market_breadth(_panel(s, d)))


_add("w34_history_percentile", lambda s, d: b.history_percentile(_series(s, d).where("raw is not null"), "raw", True), f"WITH {_BS}, l AS (SELECT arg_max(raw, date) AS x FROM sx WHERE raw IS NOT NULL) SELECT round(max(x), 6) AS latest, round(avg(CASE WHEN raw < x THEN 1.0 WHEN raw = x THEN 0.5 ELSE 0.0 END) * 100, 6)::DOUBLE AS pct FROM sx, l WHERE raw IS NOT NULL")
_add("w35_pink_zone", lambda s, d: b.pink_zone(_series(s, d)), f"WITH {_BS}, f AS (SELECT date, coalesce(trend = -1 AND round(ma8, 9) < round(ma200, 9), false) AS f FROM sy), q AS (SELECT *, sum((NOT f)::INT) OVER (ORDER BY date) AS g FROM f) SELECT date, CAST(sum(f::INT) OVER (PARTITION BY g ORDER BY date) AS BIGINT) AS streak FROM q", ("date",))
_add("w37_level_and_gap", lambda s, d: b.level_and_gap(_series(s, d)), f"""WITH {_BS}, r AS (SELECT date, trend, round(ma8, 9) AS m, round(ma200, 9) AS l, lag(round(ma8, 9), 5) OVER (ORDER BY date) AS o FROM sy), g AS (SELECT *, round(m - l, 9) AS gp FROM r)
    SELECT date, greatest(0, least(100, round_even(0.7 * CASE WHEN m >= 0.7 THEN 95 WHEN m >= 0.6 THEN 80 WHEN m >= 0.5 THEN 65 WHEN m >= 0.4 THEN 50 WHEN m >= 0.3 THEN 35 WHEN m >= 0.2 THEN 20 ELSE 5 END + 0.3 * CASE trend WHEN 1 THEN 80 ELSE 20 END, 0)
        + CASE WHEN m < o AND m > 0.6 THEN -10 WHEN m < o AND m < 0.4 THEN 5 WHEN m > o AND m < 0.6 THEN 5 ELSE 0 END))::DOUBLE + CASE WHEN m IS NULL THEN NULL ELSE 0 END AS level,
        (CASE WHEN o IS NULL THEN 50 WHEN gp IS NOT NULL THEN greatest(0, least(100, CASE WHEN gp >= 0.15 THEN 95 WHEN gp >= 0.1 THEN 80 WHEN gp >= 0.05 THEN 65 WHEN gp >= 0 THEN 50 WHEN gp >= -0.05 THEN 35 WHEN gp >= -0.1 THEN 20 ELSE 5 END + CASE WHEN gp < 0 AND m > o THEN 10 WHEN gp > 0 AND m <= o THEN -10 ELSE 0 END)) END)::DOUBLE AS gap FROM g""", ("date",))
_add("w36_cycle_position", lambda s, d: b.cycle_position(_series(s, d)))
_add("w38_divergence", lambda s, d: b.divergence(_series(s, d)).withColumn("divergence", F.round("divergence", 4)), f"""WITH {_BS}, i AS (SELECT *, exp(sum(ln(1 + coalesce(mr, 0))) OVER (ORDER BY date)) AS idx FROM sy)
    SELECT date, round(0.6::DOUBLE * ((ma8 - lag(ma8, 59) OVER w) - (idx / lag(idx, 59) OVER w - 1) / 10) + 0.4::DOUBLE * ((ma8 - lag(ma8, 19) OVER w) - (idx / lag(idx, 19) OVER w - 1) / 10), 4) AS divergence FROM i WINDOW w AS (ORDER BY date)""", ("date",))
_add("w39_slope_momentum", lambda s, d: b.slope_momentum(_series(s, d)), f"WITH {_BS}, q AS (SELECT date, raw - lag(raw) OVER (ORDER BY date) AS x FROM sy) SELECT date, round(avg(x) OVER (ORDER BY date ROWS 9 PRECEDING) - avg(x) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING), 6) AS momentum FROM q", ("date",))
_add("w40_regression_slope", lambda s, d: b.regression_slope(bars(s, d), "symbol", "close"), f"WITH {BARS}, q AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) SELECT symbol, round(regr_slope(close, -k), 1) AS slope FROM q WHERE k <= 5 GROUP BY symbol")
Q["w40_regression_slope"] = (lambda run: lambda s, d: run(s, d).withColumn("slope", F.round("slope", 1)))(Q["w40_regression_slope"])
_add("w43_winsorize", lambda s, d: b.winsorize(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 9000.0), """WITH c AS (SELECT c_custkey, c_acctbal AS raw, least(9000.0, greatest(-9000.0, c_acctbal)) AS x FROM customer), m AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM c)
    SELECT c_custkey, round(greatest(a - 3 * s, least(a + 3 * s, x)), 6)::DOUBLE AS c_acctbal, raw AS c_acctbal_raw FROM c, m""")


def _components(s: SparkSession, d: str) -> DataFrame:
    days = r.realized_vol_trend(r.market_breadth(_panel(s, d)))
    return days.select("date", (F.col("b50") * 100).alias("level"), (F.col("b200") * 100).alias("trend"), (100 - F.least(F.lit(100.0), F.when(F.col("vol_trend").isNotNull(), F.col("vol_trend") * 50))).alias("calm"))


_COMP = f"""{BARS}, {_PANEL}, cp AS (SELECT date, b50 * 100 AS level, b200 * 100 AS trend, 100 - CASE WHEN rv60 > 0 THEN least(100.0, rv20 / rv60 * 50) ELSE 100 END AS calm FROM vols)"""
_add("a22_weighted_component_score", lambda s, d: b.weighted_score(_components(s, d), {"level": 0.5, "trend": 0.3, "calm": 0.2}).select("date", "composite", "zone"), f"""WITH {_COMP}, q AS (SELECT date, (coalesce(level * 0.5, 0) + coalesce(trend * 0.3, 0) + calm * 0.2) / (CASE WHEN level IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN trend IS NOT NULL THEN 0.3 ELSE 0 END + 0.2) AS c FROM cp)
    SELECT date, round(c, 6)::DOUBLE AS composite, CASE WHEN c >= 80 THEN 'Strong' WHEN c >= 60 THEN 'Healthy' WHEN c >= 40 THEN 'Neutral' WHEN c >= 20 THEN 'Weak' ELSE 'Critical' END AS zone FROM q""", ("date",))
_add("a43_signal_convergence", lambda s, d: b.signal_convergence(_components(s, d), ["level", "trend", "calm"]))
_add("a42_exposure", lambda s, d: b.exposure(_components(s, d), {"level": 0.5, "trend": 0.3, "calm": 0.2}, ["trend"]))
_SECT = f"{BARS}, sr AS (SELECT date, symbol AS sector, avg(CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS ratio, close > open AS up FROM bars)"
_SIDES = {**dict.fromkeys(("Brand#1", "Brand#2", "Brand#3", "Brand#11", "Brand#12"), "cyclical"), **dict.fromkeys(("Brand#4", "Brand#5", "Brand#13", "Brand#14"), "defensive"), **dict.fromkeys(("Brand#6", "Brand#15"), "commodity")}


def _sectors(s: SparkSession, d: str) -> DataFrame:
    """A brand is a sector: its share of rising bars among the last ten."""
    up = F.col("close") > F.col("open")
    return bars(s, d).select("date", F.col("symbol").alias("sector"), F.avg(F.when(up, 1.0).otherwise(0.0)).over(frame(10)).alias("ratio"), up.alias("up"))


_add("a24_sector_participation", lambda s, d: b.sector_participation(_sectors(s, d)), f"""WITH {_SECT}, q AS (SELECT date, count(*) FILTER (up) AS up, round(max(ratio) - min(ratio), 9) AS x, count(*) FILTER (ratio > 0.37) AS overbought, count(*) FILTER (ratio < 0.097) AS oversold FROM sr GROUP BY date)
    SELECT date, round_even(round(0.6::DOUBLE * CASE WHEN up >= 10 THEN 100 WHEN up >= 8 THEN 80 WHEN up >= 6 THEN 60 WHEN up >= 4 THEN 40 WHEN up >= 2 THEN 20 ELSE 0 END + 0.4::DOUBLE * CASE WHEN x < 0.15 THEN 100 WHEN x < 0.25 THEN 100 - (x - 0.15) / 0.1 * 20 WHEN x < 0.35 THEN 80 - (x - 0.25) / 0.1 * 20 WHEN x < 0.45 THEN 60 - (x - 0.35) / 0.1 * 30 ELSE greatest(0, 30 - (x - 0.45) / 0.1 * 30) END, 9), 0)::BIGINT AS score, up, overbought, oversold FROM q""", ("date",))
_add("a23_sector_groups", lambda s, d: b.sector_groups(_sectors(s, d), _SIDES), f"""WITH {_SECT}, m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _SIDES.items())}) v(sector, g)),
    p AS (SELECT date, g, avg(ratio) AS mean, n >= 2 AND g <> 'commodity' AND (round(stddev_pop(ratio), 9) > 0.08 OR round(max(ratio) - min(ratio), 9) > 0.2 OR (bool_or(up) AND NOT bool_and(up))) AS dv FROM (SELECT sr.*, g, count(*) OVER (PARTITION BY date, g) AS n FROM sr JOIN m USING (sector)) GROUP BY date, g, n),
    q AS (SELECT date, max(mean) FILTER (g = 'cyclical') AS c, max(mean) FILTER (g = 'defensive') AS f, max(mean) FILTER (g = 'commodity') AS o, bool_or(dv) AS divided FROM p GROUP BY date), r AS (SELECT *, round(c - f, 9) AS x, round(o - greatest(c, f), 9) AS ld FROM q)
    SELECT date, round(c, 6) AS cyclical, round(f, 6) AS defensive, round(o, 6) AS commodity, round(x, 6) AS difference, coalesce(ld > 0, false) AS late_cycle, divided, (CASE WHEN x IS NULL THEN 50 ELSE round_even(round(least(100, greatest(0, CASE WHEN x > 0.15 THEN least(100, 90 + (x - 0.15) / 0.1 * 10) WHEN x > 0.05 THEN 70 + (x - 0.05) / 0.1 * 19 WHEN x > -0.05 THEN 45 + (x + 0.05) / 0.1 * 24 WHEN x > -0.15 THEN 20 + (x + 0.15) / 0.1 * 24 ELSE greatest(0, 19 + (x + 0.15) / 0.1 * 19) END
        + CASE WHEN ld > 0.1 THEN -10 WHEN ld > 0 THEN -5 ELSE 0 END + CASE WHEN divided THEN -5 ELSE 0 END)), 9), 0) END)::BIGINT AS score FROM r""", ("date",))
_LIB = (("euphoria", 90.0, 90.0), ("mixed", 50.0, 60.0), ("panic", 10.0, 20.0))
_add("a44_nearest_pattern", lambda s, d: b.nearest_pattern(_components(s, d).where("level is not null and trend is not null"), s.createDataFrame(_LIB, "name string, level double, trend double"), {"level": 1.0, "trend": 0.5}), f"""WITH {_COMP}, lib AS (SELECT * FROM (VALUES ('euphoria', 90.0, 90.0), ('mixed', 50.0, 60.0), ('panic', 10.0, 20.0)) v(name, l, t)),
    q AS (SELECT date, name, pow(level - l, 2) + pow(trend - t, 2) * 0.5 AS dist FROM cp, lib WHERE level IS NOT NULL AND trend IS NOT NULL) SELECT date, arg_min(name, (dist, name)) AS match, round(min(dist), 6)::DOUBLE AS distance FROM q GROUP BY date""", ("date",))

# Statements, dividends, holders: quarters of orders by nation, months of lines by supplier.
_ST = "st AS (SELECT CAST(c_nationkey AS VARCHAR) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS revenue, sum(o_totalprice) / count(*) AS eps FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_DV = "dv AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_tax * l_quantity) AS dividend FROM lineitem GROUP BY 1, 2)"


def _statements(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").cast("string").alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg(F.sum("o_totalprice").alias("revenue"), (F.sum("o_totalprice") / F.count("*")).alias("eps"))


def _dividends(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.sum(F.col("l_tax") * F.col("l_quantity")).alias("dividend"))


_add("a35_fundamental_growth", lambda s, d: income.fundamental_growth(_statements(s, d)), f"WITH {_ST} SELECT symbol, period, round(CASE WHEN lag(revenue, 4) OVER w <> 0 THEN (revenue - lag(revenue, 4) OVER w) / abs(lag(revenue, 4) OVER w) * 100 END, 6) AS revenue_yoy, round((eps - lag(eps, 4) OVER w) / abs(lag(eps, 4) OVER w) * 100, 6) AS eps_yoy FROM st WINDOW w AS (PARTITION BY symbol ORDER BY period)", ("period",))
_add("a35_annual_growth", lambda s, d: income.annual_growth(_statements(s, d)), f"""WITH {_ST}, y AS (SELECT symbol, year(period) AS year, sum(revenue) AS rev FROM st GROUP BY 1, 2 HAVING count(*) = 4), z AS (SELECT *, lag(rev, 3) OVER w AS old, coalesce(rev < lag(rev) OVER w, false)::INT AS dn FROM y WINDOW w AS (PARTITION BY symbol ORDER BY year)),
    q AS (SELECT *, sum(dn) OVER (PARTITION BY symbol ORDER BY year ROWS 2 PRECEDING) AS dns, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS k FROM z) SELECT symbol, round((pow(rev / old, 1.0::DOUBLE / 3) - 1) * 100, 2) AS cagr, dns = 0 AS no_down_year FROM q WHERE k = 1""")
_add("a31_dividend_growth_calendar", lambda s, d: income.dividend_growth_calendar(_dividends(s, d), 2001), f"""WITH {_DV}, y AS (SELECT symbol, year(date) AS year, sum(dividend) AS paid FROM dv WHERE year(date) < 2001 GROUP BY 1, 2), z AS (SELECT *, lag(paid, 3) OVER w AS old, coalesce(paid > lag(paid) OVER w, false) AS up, coalesce(paid < lag(paid) OVER w * 0.95::DOUBLE, false)::INT AS cut FROM y WINDOW w AS (PARTITION BY symbol ORDER BY year)),
    q AS (SELECT *, sum((NOT up)::INT) OVER w AS g, sum(cut) OVER (PARTITION BY symbol ORDER BY year ROWS 2 PRECEDING) AS cuts, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS k FROM z WINDOW w AS (PARTITION BY symbol ORDER BY year)), v AS (SELECT *, sum(up::INT) OVER (PARTITION BY symbol, g ORDER BY year) AS run FROM q)
    SELECT symbol, round((pow(paid / old, 1.0::DOUBLE / 3) - 1) * 100, 2) AS cagr, CAST(run AS BIGINT) AS growth_years, cuts = 0 AS no_cut FROM v WHERE k = 1""")
_add("a32_dividend_growth_ttm", lambda s, d: income.dividend_growth_ttm(_dividends(s, d), "2001-01-01"), f"""WITH {_DV}, a AS (SELECT symbol, dividend, date_diff('day', date, DATE '2001-01-01') AS age FROM dv), q AS (SELECT symbol, coalesce(sum(dividend) FILTER (age >= 0 AND age < 365), 0) AS y0, coalesce(sum(dividend) FILTER (age >= 365 AND age < 730), 0) AS y1,
    coalesce(sum(dividend) FILTER (age >= 730 AND age < 1095), 0) AS y2, coalesce(sum(dividend) FILTER (age >= 1095 AND age < 1460), 0) AS y3 FROM a GROUP BY symbol)
    SELECT symbol, round(y0, 6) AS y0, round(y1, 6) AS y1, round(y2, 6) AS y2, round(y3, 6) AS y3, round((pow(y0 / y3, 1.0::DOUBLE / 3) - 1) * 100, 2) AS cagr, y0 >= 0.95::DOUBLE * y1 AND y1 >= 0.95::DOUBLE * y2 AND y2 >= 0.95::DOUBLE * y3 AS consistent FROM q""")
_add("a33_dividend_stability", lambda s, d: income.dividend_stability(_dividends(s, d)), f"WITH {_DV}, y AS (SELECT symbol, year(date) AS year, sum(dividend) AS paid FROM dv GROUP BY 1, 2) SELECT symbol, count(*) AS years, round((max(paid) - min(paid)) / avg(paid), 6) AS spread FROM y GROUP BY symbol")
_HO = "ho AS (SELECT p_brand AS symbol, CAST(l_suppkey AS VARCHAR) AS holder, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, sum(l_quantity) AS shares FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"


def _holders(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("symbol"), F.col("l_suppkey").cast("string").alias("holder"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("quarter")).agg(F.sum("l_quantity").alias("shares"))


_add("a37_holder_changes", lambda s, d: income.holder_changes(_holders(s, d)), f"WITH {_HO}, q AS (SELECT *, lag(shares) OVER (PARTITION BY symbol, holder ORDER BY quarter) AS prev FROM ho) SELECT symbol, holder, quarter, CASE WHEN prev IS NULL THEN 'new' WHEN shares > prev THEN 'increased' WHEN shares < prev THEN 'decreased' ELSE 'unchanged' END AS move, round((shares - prev) / prev * 100, 6) AS change_pct FROM q", ("quarter",))
_add("a36_ownership_change", lambda s, d: income.ownership_change(_holders(s, d).groupBy("symbol", "quarter").agg(F.sum("shares").alias("shares"), F.count("*").alias("holders"), F.lit(0.8).alias("coverage"))), f"""WITH {_HO}, q AS (SELECT symbol, quarter, sum(shares) AS sh, count(*) AS hs FROM ho GROUP BY 1, 2), z AS (SELECT *, lag(sh) OVER w AS ps, lag(hs) OVER w AS ph, row_number() OVER (PARTITION BY symbol ORDER BY quarter DESC) AS k FROM q WINDOW w AS (PARTITION BY symbol ORDER BY quarter))
    SELECT symbol, quarter, round((sh - ps) / ps * 100, 6) AS share_change_pct, hs - ph AS holder_change, 'B' AS grade FROM z WHERE k = 1""", ("quarter",))
_add("a34_payout_and_health", lambda s, d: income.payout_and_health(table(s, d, "customer").select(F.col("c_custkey").alias("symbol"), (F.col("c_custkey") % 5 == 0).alias("is_reit"), (F.col("c_acctbal") * 2).alias("ffo"), F.col("c_acctbal").alias("net_income"), (F.col("c_acctbal") + 500).alias("fcf"), F.lit(1500.0).alias("paid"), F.lit(2000.0).alias("debt"), (F.col("c_acctbal") - 1000).alias("equity"), F.lit(900.0).alias("current_assets"), F.lit(800.0).alias("current_liabilities"))),
    """SELECT c_custkey AS symbol, round(CASE WHEN CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END > 0 THEN 1500.0 / CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END END, 6) AS payout, round(CASE WHEN c_acctbal + 500 > 0 THEN 1500.0 / (c_acctbal + 500) END, 6) AS fcf_payout,
    round(CASE WHEN c_acctbal - 1000 > 0 THEN 2000.0 / (c_acctbal - 1000) END, 6) AS debt_equity, 1.125::DOUBLE AS current_ratio, coalesce(1500.0 / CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END < 0.8 AND c_acctbal > 0 AND 1500.0 / (c_acctbal + 500) < 1, false) AS sustainable, coalesce(c_acctbal > 1000 AND 2000.0 / (c_acctbal - 1000) < 2, false) AS healthy FROM customer""")
_add("a38_calendar_summary", lambda s, d: income.calendar_summary(ticks(s, d).where("l_linenumber = 7").select(F.date_format("date", "yyyy-MM").alias("date"), F.col("l_returnflag").alias("timing"))), f"WITH {BARS} SELECT strftime(date, '%Y-%m') AS date, l_returnflag AS timing, count(*) AS n, CAST(grouping(strftime(date, '%Y-%m'), l_returnflag) AS BIGINT) AS level FROM ticks WHERE l_linenumber = 7 GROUP BY CUBE (strftime(date, '%Y-%m'), l_returnflag)")
_add("a49_tax_class", lambda s, d: table(s, d, "part").select("p_partkey", income.tax_class(F.when(F.col("p_partkey") % 4 == 0, "REIT").when(F.col("p_partkey") % 4 == 1, "PREFERRED").otherwise("COMMON"), F.col("p_size") * 3).alias("tax")), "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'ORDINARY' WHEN p_partkey % 4 = 1 THEN CASE WHEN p_size * 3 >= 91 THEN 'QUALIFIED' ELSE 'ORDINARY' END WHEN p_size * 3 >= 61 THEN 'QUALIFIED' ELSE 'ORDINARY' END AS tax FROM part")
_add("a48_yield_entry", lambda s, d: income.yield_entry(table(s, d, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") / 10.0).alias("mean_yield"), F.col("p_size").cast("double").alias("annual_dividend"), F.col("p_retailprice").alias("price"))), "SELECT p_partkey AS symbol, round(p_size / 10.0::DOUBLE + 0.5, 6) AS target_yield, round(p_size / (p_size / 10.0::DOUBLE + 0.5) * 100, 6) AS buy_price, CASE WHEN p_retailprice <= p_size / (p_size / 10.0::DOUBLE + 0.5) * 100 THEN 'TRIGGERED' ELSE 'WAIT' END AS signal FROM part")
_add("a52_portfolio_summary", lambda s, d: income.portfolio_summary(table(s, d, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("sector"), F.col("o_totalprice").alias("value"))), "WITH q AS (SELECT o_custkey AS account, o_orderpriority AS sector, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT account, sector, round(v, 4) AS value, round(v / sum(v) OVER (PARTITION BY account) * 100, 6) AS weight_pct FROM q")
Q["a52_portfolio_summary"] = (lambda run: lambda s, d: run(s, d).withColumn("value", F.round("value", 4)))(Q["a52_portfolio_summary"])

# Texts and logs.
_add("x06_usage_counts", lambda s, d: t.usage_counts(table(s, d, "conversations"), r"\b(th[a-z]{4})\b"), r"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b(th[a-z]{4})\b', 1)) AS name FROM conversations) GROUP BY name")
_add("x08_repeated_sequences", lambda s, d: t.repeated_sequences(table(s, d, "conversations"), "role"), "WITH q AS (SELECT role || '>' || lead(role, 1) OVER w || '>' || lead(role, 2) OVER w AS sequence FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT sequence, count(*) AS n FROM q WHERE sequence IS NOT NULL GROUP BY sequence HAVING count(*) >= 3")
_add("x09_automation_requests", lambda s, d: t.automation_requests(table(s, d, "conversations").withColumn("text", F.concat(F.lit("create "), "text"))), "SELECT DISTINCT conv_id, substr('create ' || text, 1, 100) AS request FROM conversations WHERE role = 'user'")
_add("x10_log_totals", lambda s, d: t.log_totals(table(s, d, "conversations")), "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")

# Folds and intraday state.
_add("h_indicators", lambda s, d: folds.fold(bars(s, d), "indicators"))
for _name in ("rally", "mean_reversion"):
    _add(f"h_{_name}", lambda s, d, n=_name: folds.fold(smooth(s, d), n))
_add("h06_dividend_basis", lambda s, d: folds.fold(_dividends(s, d), "dividends"))
Q["t01_session_vwap"] = lambda s, d: live.session_vwap(intraday(s, d)).select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.round("vwap", 8).alias("vwap"))
SQL["t01_session_vwap"] = f"WITH {INTRADAY} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS at, round(sum(c * v) OVER w / sum(v) OVER w, 8) AS vwap FROM intraday WINDOW w AS (PARTITION BY ticker, session ORDER BY ts)"
_add("t06_regular_session", lambda s, d: live.regular_session(table(s, d, "events")).groupBy("session").agg(F.count("*").alias("n")), "SELECT CAST((ts - INTERVAL 5 HOUR)::DATE AS VARCHAR) AS session, count(*) AS n FROM events WHERE hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) BETWEEN 570 AND 959 AND isodow(ts - INTERVAL 5 HOUR) <= 5 GROUP BY 1")

# Readers' checks.
_add("s10_audit_bars", lambda s, d: src.audit_bars(bars(s, d)), f"WITH {BARS}, q AS (SELECT symbol, date, date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date), date) AS gap FROM bars) SELECT symbol, date, 'gap' AS problem FROM q WHERE gap > 3", ("date",))
_add("s09_dedupe_bars", lambda s, d: src.dedupe_bars(ticks(s, d).select("symbol", "date", "price", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "size").alias("k")), "k").drop("k"), f"WITH {BARS} SELECT symbol, date, round(arg_min(price, k), 6) AS price FROM ticks GROUP BY symbol, date", ("date",))
_add("s11_upsert_history", lambda s, d: src.upsert_history(bars(s, d).where("date < date '2001-06-01'").select("symbol", "date", "close"), bars(s, d).where("date >= date '2001-05-01'").select("symbol", "date", "close"), "symbol", "date"), f"WITH {BARS}, q AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) SELECT symbol, date, round(close, 6) AS close FROM q WHERE k <= 20", ("date",))
_add("s12_freshness", lambda s, d: src.freshness(bars(s, d), "symbol", "2001-11-06"), f"WITH {BARS} SELECT symbol, max(date) AS latest, date_diff('day', max(date), DATE '2001-11-06') AS age, date_diff('day', max(date), DATE '2001-11-06') > 5 AS is_stale FROM bars GROUP BY symbol", ("latest",))
