"""Queries of ladder scores, weeks around reports, income over years, calendars, accounts and session logs, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.jobs.pattern_queries import smooth
from tapeworks.jobs.signal_queries import _BS, _DV, _HO, _SECT, _ST, _dividends, _holders, _sectors, _series, _statements
from tapeworks.jobs.signal_queries import SQL as _SIGNAL_SQL
from tapeworks.jobs.tables import BARS, bars, dates_as_text, earnings, outcomes, rounded, table, ticks, wide_bars
from tapeworks.operators import events as e
from tapeworks.operators import features as f
from tapeworks.operators import folds, income, ladders, pairs
from tapeworks.operators import patterns as p
from tapeworks.operators import screens as c
from tapeworks.operators import signals as g
from tapeworks.operators import textchecks as t
from tapeworks.sources import bars as src

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, dates: tuple[str, ...] = ()) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        SQL[name] = dates_as_text(sql, dates)


_add("w33_rs_score", lambda s, d: ladders.percentile_score(f.universe_percentile(f.period_return(bars(s, d), 20), "ret_20", "pct"), "ret_20", "pct").select("symbol", "date", "pct", "score"), f"""WITH {BARS},
    x AS (SELECT symbol, date, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars), y AS (SELECT *, count(r) OVER (PARTITION BY date ORDER BY r) AS k, count(r) OVER (PARTITION BY date) AS n FROM x),
    z AS (SELECT *, CASE WHEN r IS NULL THEN 0 ELSE least(round_even(100 * k / n, 0), CASE WHEN n < 5 THEN 74 WHEN n < 10 THEN 84 WHEN n < 20 THEN 94 ELSE 100 END) END AS p FROM y)
    SELECT symbol, date, p::BIGINT AS pct, (CASE WHEN r IS NULL THEN 0 WHEN p >= 95 THEN 100 WHEN p >= 85 THEN 90 WHEN p >= 75 THEN 80 WHEN p >= 60 THEN 70 WHEN p >= 45 THEN 60 WHEN p >= 30 THEN 50 WHEN p >= 15 THEN 40 ELSE 20 END)::DOUBLE AS score FROM z""", ("date",))


def _signal() -> Column:
    """A bearish signal: the short mean lost over a tenth in ten rows."""
    return F.round(F.col("ma8") - F.lag("ma8", 10).over(Window.orderBy("date")), 9) < -0.1


def _bearish(s: SparkSession, d: str) -> DataFrame:
    rows = _series(s, d).where("ma8 is not null").withColumn("signal", _signal())
    return ladders.bearish_score(rows, F.col("signal"))


_add("w35_bearish_score", _bearish, f"""WITH {_BS}, f AS (SELECT date, trend, round(ma8, 9) AS m, coalesce(trend = -1 AND round(ma8, 9) < round(ma200, 9), false) AS f, coalesce(round(ma8 - lag(ma8, 10) OVER (ORDER BY date), 9) < -0.1, false) AS active FROM sy WHERE ma8 IS NOT NULL),
    q AS (SELECT *, sum((NOT f)::INT) OVER (ORDER BY date) AS g FROM f), r AS (SELECT *, CAST(sum(f::INT) OVER (PARTITION BY g ORDER BY date) AS BIGINT) AS streak FROM q)
    SELECT date, active, streak, greatest(0, least(100, CASE WHEN active AND trend = 1 THEN 30 WHEN active THEN 10 WHEN trend = 1 THEN 85 ELSE 50 END + CASE WHEN active AND m > 0.5 THEN 15 WHEN active AND m < 0.25 THEN -5 WHEN NOT active AND f THEN -10 ELSE 0 END))::DOUBLE AS score FROM r""", ("date",))
_add("w36_cycle_score", lambda s, d: ladders.cycle_score(_series(s, d).where("ma8 is not null")), f"""WITH {_BS}, a AS (SELECT date, round(ma8, 9) AS x, row_number() OVER (ORDER BY date) AS i FROM sy WHERE ma8 IS NOT NULL),
    b AS (SELECT *, x = max(x) OVER k AS top, x = min(x) OVER k AS low, x > lag(x, 5) OVER (ORDER BY date) AS rising FROM a WINDOW k AS (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
    m AS (SELECT *, max(CASE WHEN top OR low THEN i END) OVER (ORDER BY date ROWS 119 PRECEDING) AS at FROM b), j AS (SELECT m.date, m.i, m.rising, m.i - m.at AS since, CASE WHEN t.top THEN 'peak' WHEN t.low THEN 'trough' END AS marker, t.x AS level FROM m LEFT JOIN b t ON t.i = m.at),
    s AS (SELECT *, coalesce(rising, false) AS up, coalesce(marker = 'trough' AND level < 0.4, false) AS extreme FROM j)
    SELECT date, marker, since, rising, extreme, least(100, CASE WHEN i < 10 OR marker IS NULL THEN 50 WHEN marker = 'trough' THEN CASE WHEN since <= 20 THEN if(up, 85, 30) WHEN since <= 60 THEN if(up, 75, 35) ELSE if(up, 65, 40) END + if(extreme, 10, 0)
        ELSE CASE WHEN since <= 20 THEN if(up, 60, 20) WHEN since <= 60 THEN if(up, 45, 15) ELSE if(up, 50, 10) END END)::DOUBLE AS score FROM s""", ("date",))


def _gap_sql(n: int) -> str:
    x, y = f"p{n}", f"b{n}"
    return f"CASE WHEN {x} > 3 AND {y} < -0.05 THEN 10 WHEN {x} > 1 AND {y} < -0.03 THEN 25 WHEN {x} < -3 AND {y} > 0.05 THEN 80 WHEN {x} < -1 AND {y} > 0.03 THEN 65 WHEN abs({x}) < 0.5 AND abs({y}) < 0.01 THEN 50 WHEN {x} > 0 AND {y} > 0 THEN 70 WHEN {x} <= 0 AND {y} <= 0 THEN 30 ELSE 50 END"


_add("w38_divergence_score", lambda s, d: ladders.divergence_score(_series(s, d)), f"""WITH {_BS}, a AS (SELECT date, ma8, exp(sum(ln(1 + coalesce(mr, 0))) OVER (ORDER BY date)) AS idx FROM sy),
    b AS (SELECT date, row_number() OVER (ORDER BY date) AS i, round((idx / first(idx) OVER l - 1) * 100, 9) AS p60, round(ma8 - first(ma8) OVER l, 9) AS b60, round((idx / first(idx) OVER k - 1) * 100, 9) AS p20, round(ma8 - first(ma8) OVER k, 9) AS b20 FROM a WHERE ma8 IS NOT NULL
        WINDOW l AS (ORDER BY date ROWS 59 PRECEDING), k AS (ORDER BY date ROWS 19 PRECEDING)), q AS (SELECT date, i, ({_gap_sql(60)})::DOUBLE AS "long", ({_gap_sql(20)})::DOUBLE AS "short" FROM b)
    SELECT date, "long", "short", CASE WHEN i < 20 THEN 50 ELSE round(0.6::DOUBLE * "long" + 0.4::DOUBLE * "short", 1) END AS score, i >= 20 AND "short" <= 25 AND "long" >= 50 AS early_warning FROM q""", ("date",))


def _sector_slopes(s: SparkSession, d: str) -> DataFrame:
    return _sectors(s, d).withColumn("slope", F.col("ratio") - F.lag("ratio").over(Window.partitionBy("sector").orderBy("date")))


_add("w39_momentum_score", lambda s, d: ladders.momentum_score(_series(s, d), _sector_slopes(s, d)), f"""WITH {_BS}, {_SECT.removeprefix(BARS + ', ')}, a AS (SELECT date, raw - lag(raw) OVER (ORDER BY date) AS slope FROM sy), b AS (SELECT date, list(slope) OVER (ORDER BY date ROWS 63 PRECEDING) AS l, row_number() OVER (ORDER BY date) AS i FROM a WHERE slope IS NOT NULL),
    m AS (SELECT date, i, list_reduce(l, lambda x, y: (x + y) / 2) AS sm FROM b), n AS (SELECT *, round(CASE WHEN i >= 20 THEN avg(sm) OVER (ORDER BY date ROWS 9 PRECEDING) - avg(sm) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING)
        WHEN i >= 10 THEN avg(sm) OVER (ORDER BY date ROWS 4 PRECEDING) - avg(sm) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END, 9) AS ac, round(sm, 9) AS s FROM m),
    v AS (SELECT date, avg(CASE WHEN round(sl, 9) > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS wide FROM (SELECT date, ratio - lag(ratio) OVER (PARTITION BY sector ORDER BY date) AS sl FROM sr) GROUP BY date),
    z AS (SELECT n.*, wide, CASE WHEN s >= 0.02 THEN least(100, 95 + (s - 0.02) / 0.01 * 5) WHEN s >= 0.01 THEN 75 + (s - 0.01) / 0.01 * 19 WHEN s >= 0 THEN 55 + s / 0.01 * 19 WHEN s >= -0.01 THEN 35 + (s + 0.01) / 0.01 * 19 WHEN s >= -0.02 THEN 10 + (s + 0.02) / 0.01 * 24 ELSE greatest(0, 9 + (s + 0.02) / 0.01 * 9) END AS lv,
        CASE WHEN ac IS NULL THEN 50 WHEN ac > 0.005 THEN 90 WHEN ac > 0.001 THEN 75 WHEN ac > -0.001 THEN 50 WHEN ac > -0.005 THEN 25 ELSE 10 END AS fs FROM n LEFT JOIN v USING (date))
    SELECT date, round(sm, 6) AS smooth, round(ac, 6) AS acceleration, round(wide, 6) AS wide, greatest(0, least(100, round_even(round(0.5::DOUBLE * lv + 0.3::DOUBLE * fs + 0.2::DOUBLE * coalesce(wide, 50), 9), 0)))::BIGINT AS score FROM z""", ("date",))

_add("a08_event_weeks", lambda s, d: e.event_weeks(bars(s, d), earnings(s, d).select("symbol", F.col("date").alias("event"))), f"""WITH {BARS}, sp AS (SELECT symbol, date AS event, k, CAST(date_trunc('week', date) AS DATE) + 7 * k::INT AS week FROM earn, range(-4, 7) r(k)), wb AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM bars),
    q AS (SELECT symbol, event, week, k, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, count(*) AS sessions FROM wb JOIN sp USING (symbol, week) WHERE k <> 0 OR date >= event GROUP BY ALL),
    l AS (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol) SELECT symbol, event, week, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, sessions,
    (CAST(date_trunc('week', last) AS DATE) = week AND isodow(last) < 5) OR (k = 0 AND sessions < 5) AS partial, close >= open AS green FROM q JOIN l USING (symbol)""", ("event", "week"))
_add("a33_stability_score", lambda s, d: income.stability_score(_dividends(s, d), 2001), f"""WITH {_DV}, n AS (SELECT symbol FROM dv GROUP BY symbol HAVING count(*) >= 4), y AS (SELECT symbol, year(date) AS year, sum(dividend) AS paid FROM dv WHERE year(date) < 2001 GROUP BY 1, 2),
    z AS (SELECT *, coalesce(paid >= lag(paid) OVER w * 0.95::DOUBLE, false) AS held FROM y WINDOW w AS (PARTITION BY symbol ORDER BY year)), g AS (SELECT *, sum((NOT held)::INT) OVER (PARTITION BY symbol ORDER BY year) AS g FROM z), r AS (SELECT *, sum(held::INT) OVER (PARTITION BY symbol, g ORDER BY year) AS run FROM g),
    a AS (SELECT symbol, count(*) AS years, CASE WHEN avg(paid) > 0 THEN round((max(paid) - min(paid)) / avg(paid) * 100, 9) END AS sp, arg_max(run, year)::BIGINT AS run, arg_min(paid, year) AS f, arg_max(paid, year) AS l FROM r GROUP BY symbol HAVING count(*) >= 3),
    b AS (SELECT *, coalesce(sp < 50, false) AS stable, run >= 2 AND l > f AS growing FROM a JOIN n USING (symbol))
    SELECT symbol, years, round(sp, 6) AS spread, run AS growth_years, stable, growing, round(CASE WHEN stable THEN 40 WHEN round(sp, 1) < 100 THEN greatest(0, 40 - round(sp, 1) * 0.4::DOUBLE) ELSE 0 END + if(growing, 30, 0) + least(run * 10, 30), 1)::DOUBLE AS score FROM b""")
_add("a35_positive_trend", lambda s, d: income.positive_trend(_statements(s, d), "revenue"), f"""WITH {_ST}, y AS (SELECT symbol, year(period) AS year, sum(revenue) AS v FROM st GROUP BY 1, 2 HAVING count(*) = 4), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS k FROM y),
    q AS (SELECT *, coalesce(v < lag(v) OVER (PARTITION BY symbol ORDER BY year), false) AS fell FROM k WHERE k <= 4) SELECT symbol, count(*) AS years, count(*) FILTER (fell) AS falls, count(*) >= 3 AND arg_min(v, year) < arg_max(v, year) AND count(*) FILTER (fell) <= 1 AS positive FROM q GROUP BY symbol""")
_add("a36_ownership_trend", lambda s, d: income.ownership_trend(_holders(s, d).groupBy("symbol", "quarter").agg(F.sum("shares").alias("shares"), F.count("*").alias("holders"))), f"""WITH {_HO}, q AS (SELECT symbol, quarter, sum(shares) AS sh, count(*) AS hs, row_number() OVER (PARTITION BY symbol ORDER BY quarter DESC) AS k FROM ho GROUP BY 1, 2)
    SELECT symbol, count(*) AS quarters, round((arg_max(sh, quarter) - arg_min(sh, quarter)) / arg_min(sh, quarter) * 100, 6) AS shares_trend_pct, arg_max(hs, quarter) - arg_min(hs, quarter) AS holders_trend FROM q WHERE k <= 8 GROUP BY symbol""")


def _reports(s: SparkSession, d: str) -> DataFrame:
    """Seventh lines are reports; ten million shares at the line's price are the market cap."""
    timing = F.when(F.col("l_returnflag") == "A", "bmo").when(F.col("l_returnflag") == "N", "amc").otherwise("tas")
    return ticks(s, d).where("l_linenumber = 7").select("symbol", "date", timing.alias("timing"), "sector", (F.col("price") * 1e7).alias("market_cap"))


_REP = f"{BARS}, rep AS (SELECT symbol, date, CASE l_returnflag WHEN 'A' THEN 'bmo' WHEN 'N' THEN 'amc' ELSE 'tas' END AS timing, sector, price * 1e7 AS market_cap FROM ticks WHERE l_linenumber = 7)"
_add("a38_calendar_stats", lambda s, d: income.calendar_stats(_reports(s, d)), f"""WITH {_REP} SELECT 'total' AS kind, 'total' AS name, count(*) AS n FROM rep UNION ALL SELECT 'total', 'large_cap', count(*) FILTER (market_cap >= 1e10) FROM rep UNION ALL SELECT 'total', 'mid_cap', count(*) FILTER (market_cap < 1e10) FROM rep
    UNION ALL SELECT 'sector', sector, count(*) FROM rep GROUP BY sector UNION ALL (SELECT 'peak', CAST(date AS VARCHAR), count(*) AS n FROM rep GROUP BY date ORDER BY n DESC, date LIMIT 1)""")
_add("a38_calendar_order", lambda s, d: income.calendar_order(_reports(s, d)).select("date", "symbol", "timing", "place"), f"WITH {_REP} SELECT date, symbol, timing, row_number() OVER (PARTITION BY date ORDER BY CASE timing WHEN 'bmo' THEN 1 WHEN 'amc' THEN 2 ELSE 3 END, market_cap DESC, symbol) AS place FROM rep", ("date",))


def _accounts(s: SparkSession, d: str) -> DataFrame:
    """Customers hold the brands of their orders' lines and have their balance as cash; one row for each of the largest."""
    lines = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    held = lines.select(F.col("o_custkey").alias("account"), F.col("p_brand").alias("symbol"), F.col("l_extendedprice").alias("value"))
    out = income.account_summary(held, table(s, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash")))
    out = out.select("account", F.round("equity", 2).alias("equity"), F.round("cash_pct", 4).alias("cash_pct"), "positions", F.posexplode_outer("largest").alias("place", "x"))
    return out.select("account", "equity", "cash_pct", "positions", "place", "x.symbol", "x.of_long", "x.of_equity")


_add("a52_account_summary", _accounts, """WITH h AS (SELECT o_custkey AS account, p_brand AS symbol, sum(l_extendedprice) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY v DESC, symbol) - 1 AS place, count(*) OVER (PARTITION BY account) AS positions, sum(v) OVER (PARTITION BY account) AS gross FROM h WHERE v > 0), a AS (SELECT c_custkey AS account, c_acctbal AS cash FROM customer)
    SELECT a.account, round(cash + coalesce(gross, 0), 2)::DOUBLE AS equity, CASE WHEN cash + coalesce(gross, 0) > 0 THEN round(cash / (cash + coalesce(gross, 0)) * 100, 4)::DOUBLE END AS cash_pct, coalesce(positions, 0) AS positions, place, symbol, round(v / gross * 100, 4)::DOUBLE AS of_long,
    CASE WHEN cash + gross > 0 THEN round(v / (cash + gross) * 100, 4)::DOUBLE END AS of_equity FROM a LEFT JOIN k ON k.account = a.account AND place < 10""")
_add("h09_trend_summary", lambda s, d: c.trade_summary(c.trend_trades(bars(s, d)), bars(s, d), 20), f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS i, coalesce(close > CASE WHEN count(*) OVER a = 20 THEN avg(close) OVER a END, false) AS "on", lead(close) OVER w AS nx, lead(date) OVER w AS nd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    y AS (SELECT *, sum((NOT "on")::INT) OVER (PARTITION BY symbol ORDER BY date) AS g FROM x), t AS (SELECT symbol, min(i) AS i0, max(CASE WHEN nd IS NULL THEN i ELSE i + 1 END) AS i1, round(arg_max(coalesce(nx, close), date) / arg_min(close, date) - 1, 4) AS r FROM y WHERE "on" GROUP BY symbol, g),
    v AS (SELECT symbol, count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS wr, avg(r) AS mr, exp(sum(ln(1 + r))) - 1 AS tr, avg(i1 - i0) AS mb FROM t GROUP BY symbol), h AS (SELECT symbol, arg_max(close, i) / coalesce(max(close) FILTER (i = 20), arg_max(close, i)) - 1 AS hr FROM x GROUP BY symbol)
    SELECT symbol, coalesce(n, 0) AS trades, round(wr, 3) AS win_rate, round(coalesce(mr, 0), 4) AS mean_return, round(coalesce(tr, 0), 4) AS total_return, round(hr, 4) AS hold_return, round(coalesce(mb, 0), 1) AS mean_bars FROM h LEFT JOIN v USING (symbol)""")
_add("h08_mean_reversion_summary", lambda s, d: c.trade_summary(folds.fold(smooth(s, d), "mean_reversion"), smooth(s, d), 15))
_add("s12_weekday_freshness", lambda s, d: src.weekday_freshness(bars(s, d), "symbol", "2001-11-06"), f"WITH {BARS}, q AS (SELECT symbol, max(date) AS latest FROM bars GROUP BY symbol), n AS (SELECT symbol, latest, (SELECT count(*) FROM range(latest + 1, DATE '2001-11-07', INTERVAL 1 DAY) r(x) WHERE isodow(x) <= 5) AS age FROM q) SELECT symbol, latest, age, age > 2 AS is_stale FROM n", ("latest",))
_add("x08_session_sequences", lambda s, d: t.session_sequences(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type"), """WITH q AS (SELECT user_id, event_type || '>' || lead(event_type, 1) OVER w || '>' || lead(event_type, 2) OVER w AS sequence, count(*) OVER (PARTITION BY user_id) AS size FROM events WHERE event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, sequence, count(*) AS n FROM q WHERE size >= 9 AND sequence IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""")


def _thin(s: SparkSession, d: str) -> DataFrame:
    """Bars whose sessions of under ten shares have no volume."""
    return bars(s, d).withColumn("volume", F.when(F.col("volume") >= 10, F.col("volume")))


_add("w21_skipped_pairs", lambda s, d: p.skipped_pairs(_thin(s, d)), f"""WITH {BARS}, q AS (SELECT symbol, date, close > 0 AND volume >= 10 AS ok FROM bars), r AS (SELECT *, lag(ok) OVER (PARTITION BY symbol ORDER BY date) AS before FROM q)
    SELECT symbol, date, 'missing_or_invalid_close_volume' AS reason FROM r WHERE before IS NOT NULL AND NOT (ok AND before)""", ("date",))
_add("w26_weakness", lambda s, d: c.weakness(bars(s, d)), f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS i, coalesce(open / lag(close) OVER w - 1 <= -0.005 AND volume > 1.1::DOUBLE * lag(volume) OVER w, false)::INT AS h, CASE WHEN high > lag(high) OVER w AND high > lead(high) OVER w THEN high END AS top FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    y AS (SELECT symbol, date, close, i, sum(h) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS gaps, list(top) FILTER (top IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING) AS tops, max((close, i)) OVER (PARTITION BY symbol ORDER BY date ROWS 14 PRECEDING) AS peak FROM x)
    SELECT symbol, date, coalesce(i >= 20 AND len(tops) >= 2 AND tops[-1] < tops[-2], false) AS lower_highs, coalesce(i >= 15 AND i - peak[2] BETWEEN 3 AND 10 AND round((close / peak[1] - 1) * 100, 9) < -2, false) AS failed_rally, i >= 6 AND gaps > 0 AS gap_down FROM y""", ("date",))


def _evaluations(s: SparkSession, d: str) -> DataFrame:
    """Producers within regimes are strategies, their years iterations: the evaluation of each year's trades."""
    name = F.concat_ws("/", "skill", "regime", F.year("date"))
    trades = outcomes(s, d).select(name.alias("strategy"), F.col("signal_id").alias("at"), "date", (F.col("ret5") * 100).alias("pnl"))
    rows = g.backtest_quality(trades, 5, True).withColumn("i", F.substring_index("strategy", "/", -1).cast("int")).withColumn("strategy", F.regexp_replace("strategy", "/[0-9]+$", ""))
    return rows.withColumn("slippage_tested", F.lit(True))


_YEARS = _SIGNAL_SQL["a40_backtest_quality"].replace("SELECT skill AS strategy,", "SELECT skill || '/' || regime || '/' || year(date) AS strategy,").replace("PARTITION BY skill ORDER BY signal_id", "PARTITION BY skill, regime, year(date) ORDER BY signal_id")
_add("h18_stagnation", lambda s, d: c.stagnation(_evaluations(s, d)), f"""WITH ev AS ({_YEARS}), k AS (SELECT *, regexp_replace(strategy, '/[0-9]+$', '') AS name, row_number() OVER (PARTITION BY regexp_replace(strategy, '/[0-9]+$', '') ORDER BY strategy DESC) AS k FROM ev),
    e AS (SELECT name, count(*) = 3 AND max(total) - min(total) < 3 AS plateau, arg_min(expectancy_score >= 15 AND risk >= 15 AND robustness < 10 AND regexp_matches(red_flags, '(^|,)(over_optimized|short_test_period)(,|$)'), k) AS overfitting,
        arg_min(coalesce(expectancy < 0.3 AND profit_factor < 1.3, false), k) AS cost_defeat, arg_min(max_drawdown > 35 OR risk <= 5, k) AS tail_risk, count(*) = 3 AND arg_min(total, k) < 30 AND max(total) FILTER (k = 1) <= max(total) FILTER (k = 2) AND max(total) FILTER (k = 2) <= max(total) FILTER (k = 3) AS quit FROM k WHERE k <= 3 GROUP BY name)
    SELECT name AS strategy, plateau, overfitting, cost_defeat, tail_risk, CASE WHEN quit THEN 'abandon' WHEN plateau OR overfitting OR cost_defeat OR tail_risk THEN 'pivot' ELSE 'continue' END AS advice FROM e""")
_add("h10_scan_pairs", lambda s, d: pairs.scan_pairs(wide_bars(s, d), 0.17))


def _yearly(s: SparkSession, d: str) -> DataFrame:
    """symbol, year, paid, price: a supplier's dividends and mean line price of each year."""
    lines = table(s, d, "lineitem").where("l_quantity > 0")
    return lines.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.year("l_shipdate").alias("year")).agg(F.sum(F.col("l_tax") * F.col("l_quantity")).alias("paid"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def _holdings(rows: DataFrame) -> DataFrame:
    """The latest year's price; its pays, a tenth more for even suppliers, whose declaration is known, none for each fifth."""
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("paid", "price"), "year").alias("x"))
    number = F.col("symbol").cast("long")
    return last.select("symbol", F.col("x.price").alias("price"), F.when(number % 2 == 0, F.col("x.paid") * 1.1).alias("declared"), F.when(number % 5 != 0, F.col("x.paid")).alias("profile"))


_add("a48_yield_signal", lambda s, d: income.yield_signal(_holdings(_yearly(s, d)), _yearly(s, d).select("symbol", "year", (F.col("paid") / F.col("price") * 100).alias("yield_pct"))), """WITH y AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, year(l_shipdate) AS year, sum(l_tax * l_quantity) AS paid, avg(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS k FROM y), m AS (SELECT symbol, round(round(avg(paid / price * 100), 9), 2) AS my, count(*) AS n FROM k WHERE k <= 5 GROUP BY symbol),
    h AS (SELECT symbol, price, coalesce(CASE WHEN symbol::BIGINT % 2 = 0 THEN paid * 1.1::DOUBLE END, CASE WHEN symbol::BIGINT % 5 <> 0 THEN paid END) AS an FROM k WHERE k = 1), q AS (SELECT *, round(round(my + 0.5, 9), 2) AS tg FROM h JOIN m USING (symbol)), b AS (SELECT *, round(round(an / (tg / 100), 9), 2) AS bp FROM q)
    SELECT symbol, round(round(an / price * 100, 9), 2) AS current_yield, my AS mean_yield, n AS observations, tg AS target_yield, bp AS buy_price, CASE WHEN bp IS NOT NULL THEN round(round(greatest(0, (price - bp) / price * 100), 9), 2) END AS drop_needed,
    CASE WHEN bp IS NULL THEN 'ASSUMPTION-REQUIRED' WHEN price <= bp THEN 'TRIGGERED' ELSE 'WAIT' END AS signal FROM b""")


def _basis(s: SparkSession, d: str) -> DataFrame:
    """Yields of suppliers on the day of the latest line; pays of months with returns only are labelled special."""
    lines = table(s, d, "lineitem")
    named = lines.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.sum(F.col("l_tax") * F.col("l_quantity")).alias("dividend"), F.when(F.min("l_returnflag") == "R", "special").alias("label"))
    day = lines.agg(F.to_date(F.max("l_shipdate")).alias("day")).first()["day"]  # one value
    return income.dividend_yields(folds.fold(named.withColumn("as_of", F.lit(day).cast("date")), "dividends"), _holdings(_yearly(s, d)))


_add("h06_dividend_yields", _basis)
