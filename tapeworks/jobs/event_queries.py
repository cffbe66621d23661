"""Queries for event joins, regimes, scanners and pairs, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.tables import BARS, WIDE, bars, benchmark, dates_as_text, earnings, rounded, wide_bars
from tapeworks.operators import events as e
from tapeworks.operators import features as f
from tapeworks.operators import pairs as p
from tapeworks.operators import regime as r

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, dates: tuple[str, ...] = ("date",), base: str = BARS) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        text = sql.lstrip()
        SQL[name] = dates_as_text(f"WITH {base} {text}" if text.startswith(("SELECT", ",")) else f"WITH {base}, {text}", dates)


def _ladder_sql(x: str, ladder: list[tuple[float, float]], below: float, null: float = 0) -> str:
    return f"CASE WHEN {x} IS NULL THEN {null} " + " ".join(f"WHEN {x} >= {t} THEN {v}" for t, v in ladder) + f" ELSE {below} END"


def _rs_sql(periods: tuple[tuple[int, float], ...]) -> str:
    def gain(c: str, then: str) -> str:
        return f"({c} - {then}) / {then} * 100"

    ex = [(f"CASE WHEN i > {n} THEN {gain('close', f'lag(close, {n}) OVER w')} - {gain('bench', f'lag(bench, {n}) OVER w')} ELSE {gain('close', 'c0')} - {gain('bench', 'b0')} END", f"CASE WHEN i > {n} THEN {w}::DOUBLE WHEN i > {n // 2} THEN {w / 2}::DOUBLE ELSE 0 END") for n, w in periods]
    return f"""j AS (SELECT symbol, date, close, bench, row_number() OVER w AS i, first_value(close) OVER w AS c0, first_value(bench) OVER w AS b0 FROM bars JOIN bench USING (date) {_W}),
    x AS (SELECT symbol, date, {" + ".join(f"({a}) * ({b})" for a, b in ex)} AS t, {" + ".join(b for _, b in ex)} AS wt FROM j {_W}), y AS (SELECT symbol, date, CASE WHEN wt > 0 THEN t / wt END AS rs FROM x)
    SELECT symbol, date, round(rs, 6)::DOUBLE AS rs, ({_ladder_sql("rs", [(x, y) for x, y, _ in e.RS_LADDER], 0)})::DOUBLE AS score, ({_ladder_sql("rs", [(x, z) for x, _, z in e.RS_LADDER], 10)})::DOUBLE AS rank FROM y"""


def _multi_sql(periods: tuple[tuple[int, float], ...]) -> str:
    own = [(f"(close / lag(close, {n}) OVER w - 1) * 100", w) for n, w in periods]
    ex = [(f"((close / lag(close, {n}) OVER w - 1) * 100 - (bench / lag(bench, {n}) OVER w - 1) * 100)", w) for n, w in periods]

    def mean(parts: list[tuple[str, float]]) -> str:
        return "(" + " + ".join(f"coalesce({x} * {w}::DOUBLE, 0)" for x, w in parts) + ") / nullif(" + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for x, w in parts) + ", 0)"

    return f"x AS (SELECT symbol, date, {mean(own)} AS p, {mean(ex)} AS r FROM bars LEFT JOIN bench USING (date) {_W}) SELECT symbol, date, round(p, 6) AS performance, round(r, 6) AS relative, round(coalesce(r, p), 6) AS rs FROM x"


_add("j01_relative_strength", lambda s, d: e.relative_strength(bars(s, d), benchmark(bars(s, d))), _rs_sql(e.RS_PERIODS))
_add("j02_multi_period_rs", lambda s, d: e.multi_period_rs(bars(s, d), benchmark(bars(s, d))), _multi_sql(e.MULTI_PERIODS))
_GAP = f"""g AS (SELECT symbol, date, open, close, lag(close) OVER w AS pc, lead(open) OVER w AS no FROM bars {_W}),
    gaps AS (SELECT earn.symbol, earn.date, timing, CASE WHEN timing = 'bmo' THEN open / pc - 1 ELSE no / close - 1 END AS gap, close FROM earn LEFT JOIN g ON earn.symbol = g.symbol AND earn.date = g.date)"""
_add("j03_earnings_gap", lambda s, d: e.earnings_gap(bars(s, d), earnings(s, d)), f"{_GAP} SELECT symbol, date, timing, round(gap, 6) AS gap, CASE WHEN close IS NULL THEN 'no bar' WHEN gap IS NULL THEN 'no neighbour' END AS warning FROM gaps")
_PRE = """t AS (SELECT symbol, date, close / lag(close, 20) OVER w - 1 AS pt, CASE WHEN count(*) OVER f60 >= 20 AND avg(volume) OVER f60 > 0 THEN CASE WHEN count(*) OVER f20 >= 5 THEN avg(volume) OVER f20 END / avg(volume) OVER f60 END AS vt,
        close / CASE WHEN count(*) OVER f200 = 200 THEN avg(close) OVER f200 END - 1 AS d200, close / CASE WHEN count(*) OVER f50 = 50 THEN avg(close) OVER f50 END - 1 AS d50 FROM bars
        WINDOW w AS (PARTITION BY symbol ORDER BY date), f20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), f50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING),
        f60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), f200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING))"""
_add("j04_earnings_trend", lambda s, d: e.earnings_trend(bars(s, d), earnings(s, d)), f"{_PRE} SELECT symbol, date, round(pt, 6) AS pre_trend, round(vt, 6) AS volume_trend FROM earn JOIN t USING (symbol, date)")
_add(
    "a51_earnings_reaction",
    lambda s, d: e.earnings_reaction(bars(s, d), earnings(s, d)),
    f"""{_GAP}, {_PRE}, v AS (SELECT gaps.symbol, gaps.date, {", ".join(f"({_ladder_sql(x, *e.REACTION_LADDERS[c])})::DOUBLE AS {c}" for c, x in (("gap", "round(abs(gap) * 100, 9)"), ("trend", "round(pt * 100, 9)"), ("volume", "round(vt, 9)"), ("ma200", "round(d200 * 100, 9)"), ("ma50", "round(d50 * 100, 9)")))}
        FROM gaps LEFT JOIN t ON gaps.symbol = t.symbol AND gaps.date = t.date),
    s AS (SELECT *, round({" + ".join(f"{c} * {w}::DOUBLE" for c, w in e.REACTION.items())}, 1) AS score, [{", ".join(e.REACTION)}] AS l FROM v)
    SELECT symbol, date, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade, {[*e.REACTION]}[list_position(l, list_min(l))] AS weakest, {[*e.REACTION]}[list_position(l, list_max(l))] AS strongest FROM s""",
)
_add(
    "j05_nearest_earnings",
    lambda s, d: e.nearest_earnings(bars(s, d).select("symbol", "date"), earnings(s, d)),
    """x AS (SELECT b.symbol, b.date, max(CASE WHEN e.date <= b.date THEN e.date END) AS le, min(CASE WHEN e.date > b.date THEN e.date END) AS ne FROM bars b LEFT JOIN earn e ON e.symbol = b.symbol GROUP BY b.symbol, b.date)
    SELECT symbol, date, CAST(le AS VARCHAR) AS last_event, CAST(ne AS VARCHAR) AS next_event, CASE WHEN le IS NOT NULL THEN CAST(5 * floor((date - DATE '1969-12-29') / 7) + least(((date - DATE '1969-12-29') % 7) + 1, 5)
        - 5 * floor((le - DATE '1969-12-29') / 7) - least(((le - DATE '1969-12-29') % 7) + 1, 5) AS BIGINT) ELSE 0 END AS days_since, date_diff('day', date, ne) AS days_to FROM x""",
)


def _signals(s: SparkSession, d: str) -> DataFrame:
    return earnings(s, d).select(F.concat_ws("/", "symbol", F.col("date").cast("string")).alias("id"), "symbol", "date")


_SIG = "sig AS (SELECT symbol || '/' || CAST(date AS VARCHAR) AS id, symbol, date FROM earn)"
_add(
    "j06_holding_returns",
    lambda s, d: e.holding_returns(_signals(s, d), bars(s, d)),
    f"""{_SIG}, t AS (SELECT *, unnest([5, 20]) AS h FROM sig), x AS (SELECT t.id, t.h, t.symbol, t.date, arg_min(b.close, b.date) AS ex FROM t JOIN bars b ON b.symbol = t.symbol AND b.date BETWEEN t.date + CAST(h AS INT) AND t.date + CAST(h AS INT) + 4 GROUP BY ALL)
    SELECT id, h, round(ex / close - 1, 6) AS ret FROM x JOIN bars USING (symbol, date)""",
    (),
)
_add(
    "j07_mae_mfe",
    lambda s, d: e.mae_mfe(_signals(s, d).select("id", "symbol", F.col("date").alias("entry_date"), F.date_add("date", 15).alias("exit_date")), bars(s, d)),
    f"""{_SIG}, x AS (SELECT id, min(close) AS lo, max(close) AS hi, arg_min(close, b.date) AS c FROM sig JOIN bars b ON b.symbol = sig.symbol AND b.date BETWEEN sig.date AND sig.date + 15 GROUP BY id)
    SELECT id, round(lo / c - 1, 6) AS mae, round(hi / c - 1, 6) AS mfe FROM x""",
    (),
)
_WEEK = "weeks AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, count(*) AS sessions FROM bars GROUP BY ALL)"
_add("a08_weekly_bars", lambda s, d: e.weekly_bars(bars(s, d)), f"{_WEEK} SELECT symbol, week, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, sessions FROM weeks", ("week",))
_MONTH = "months AS (SELECT symbol, strftime(date, '%Y-%m') AS month, arg_max(close, date) AS close FROM bars WHERE close > 0 GROUP BY ALL)"
_add("a09_monthly_close", lambda s, d: e.monthly_close(bars(s, d)), f"{_MONTH} SELECT symbol, month, round(close, 6) AS close FROM months", ())
_add("j18_ratio_series", lambda s, d: e.ratio_series(e.monthly_close(bars(s, d)), "Brand#1", "Brand#2"), f"{_MONTH} SELECT a.month, round(a.close / b.close, 6) AS ratio FROM months a JOIN months b ON a.month = b.month AND a.symbol = 'Brand#1' AND b.symbol = 'Brand#2'", ())
_add(
    "w41_sma_crossover",
    lambda s, d: e.sma_crossover(e.monthly_close(bars(s, d))),
    f"""{_MONTH}, m AS (SELECT *, CASE WHEN count(*) OVER a = 6 THEN avg(close) OVER a END AS f, CASE WHEN count(*) OVER b = 12 THEN avg(close) OVER b END AS s FROM months
        WINDOW a AS (PARTITION BY symbol ORDER BY month ROWS 5 PRECEDING), b AS (PARTITION BY symbol ORDER BY month ROWS 11 PRECEDING)),
    n AS (SELECT *, CASE WHEN f > s THEN 1 ELSE -1 END AS side, row_number() OVER (PARTITION BY symbol ORDER BY month) AS k FROM m WHERE s IS NOT NULL),
    o AS (SELECT *, side <> lag(side) OVER (PARTITION BY symbol ORDER BY month) AS turn FROM n),
    q AS (SELECT symbol, max(k) AS bars, max(CASE WHEN turn THEN k END) AS spot, arg_max(side, CASE WHEN turn THEN k END) AS side, arg_max((f / s - 1) * 100, k) AS gap FROM o GROUP BY symbol)
    SELECT symbol, CASE WHEN spot IS NULL THEN 'none' WHEN side > 0 THEN 'golden' ELSE 'death' END AS "cross", bars - spot AS bars_ago, round(gap, 6) AS gap_pct, abs(gap) < 1 AS converging FROM q""",
    (),
)
_add(
    "w42_roc",
    lambda s, d: f.period_return(bars(s, d), 12).select("symbol", "date", (F.col("ret_12") * 100).alias("roc")),
    f"SELECT symbol, date, round((close / lag(close, 12) OVER w - 1) * 100, 6) AS roc FROM bars {_W}",
)
_add(
    "a07_calendar_seasonality",
    lambda s, d: e.calendar_seasonality(bars(s, d), 3, 0.4),
    f"""{_MONTH}, x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS ret, substr(month, 6, 2) AS m FROM months)
    SELECT symbol, m, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM x GROUP BY symbol, m
    HAVING count(*) >= 3 AND avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) >= 0.4 AND avg(ret) >= 0.025""",
    (),
)
_add(
    "h16_pead_stage",
    lambda s, d: e.pead_stage(bars(s, d), earnings(s, d), "1999-03-01", 40),
    f"""l AS (SELECT symbol, max(date) AS event FROM earn WHERE date <= DATE '1999-03-01' GROUP BY symbol),
    k AS (SELECT b.symbol, CAST(date_trunc('week', b.date) AS DATE) AS week, arg_min(open, b.date) AS o, max(high) AS h, arg_max(close, b.date) AS c FROM bars b WHERE b.date <= DATE '1999-03-01' GROUP BY ALL),
    q AS (SELECT k.*, event FROM k JOIN l USING (symbol) WHERE week >= date_trunc('week', event)),
    x AS (SELECT symbol, max(CASE WHEN c < o THEN week END) AS rw, arg_max(h, CASE WHEN c < o THEN week END) AS rh, max(week) AS nw, arg_max(o, week) AS no, arg_max(c, week) AS nc FROM q GROUP BY symbol)
    SELECT l.symbol, event, CAST(floor((DATE '1999-03-01' - event) / 7) AS BIGINT) AS age, CASE WHEN floor((DATE '1999-03-01' - event) / 7) > 40 THEN 'EXPIRED' WHEN rw IS NULL THEN 'MONITORING'
        WHEN nc > no AND nc > rh AND nw > rw THEN 'BREAKOUT' ELSE 'SIGNAL_READY' END AS stage FROM l LEFT JOIN x USING (symbol)""",
    ("event",),
)
_DEF, _OFF = ["Brand#1", "Brand#2", "Brand#3"], ["Brand#4", "Brand#5", "Brand#6"]
_add(
    "a26_defensive_rotation",
    lambda s, d: e.defensive_rotation(bars(s, d), _DEF, _OFF),
    f"""x AS (SELECT symbol, date, close / lag(close, 10) OVER w - 1 AS a, close / lag(close, 20) OVER w - 1 AS b, close / lag(close, 40) OVER w - 1 AS c FROM bars {_W})
    SELECT date, round((avg(a) FILTER (symbol IN ('Brand#1', 'Brand#2', 'Brand#3')) - avg(a) FILTER (symbol IN ('Brand#4', 'Brand#5', 'Brand#6'))) * 0.2
        + (avg(b) FILTER (symbol IN ('Brand#1', 'Brand#2', 'Brand#3')) - avg(b) FILTER (symbol IN ('Brand#4', 'Brand#5', 'Brand#6'))) * 0.5
        + (avg(c) FILTER (symbol IN ('Brand#1', 'Brand#2', 'Brand#3')) - avg(c) FILTER (symbol IN ('Brand#4', 'Brand#5', 'Brand#6'))) * 0.3, 6)::DOUBLE AS rotation
    FROM x WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6') GROUP BY date""",
)


def _panel(s: SparkSession, d: str) -> DataFrame:
    return f.daily_features(bars(s, d))


_PANEL = """pn AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1d, CASE WHEN count(*) OVER f50 = 50 THEN avg(close) OVER f50 END AS ma50, CASE WHEN count(*) OVER f200 = 200 THEN avg(close) OVER f200 END AS ma200,
        CASE WHEN count(*) OVER f20 = 20 THEN avg(volume) OVER f20 END AS va, lag(close) OVER w AS pc, open / lag(close) OVER w - 1 AS gap, close / lag(close, 120) OVER w - 1 AS rs,
        CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
        CASE WHEN count(*) OVER g = 20 THEN max(high) OVER g END AS h20, CASE WHEN high > low THEN (close - low) / (high - low) END AS cp FROM bars
        WINDOW w AS (PARTITION BY symbol ORDER BY date), f20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), f50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING),
        f200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    panel AS (SELECT *, volume / va AS rv, CASE WHEN count(*) OVER f14 = 14 THEN avg(tr) OVER f14 END / close AS atrp FROM pn WINDOW f14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)),
    breadth AS (SELECT date, avg(CASE WHEN ma50 IS NOT NULL THEN CASE WHEN close > ma50 THEN 1.0 ELSE 0.0 END END) AS b50, avg(CASE WHEN ma200 IS NOT NULL THEN CASE WHEN close > ma200 THEN 1.0 ELSE 0.0 END END) AS b200,
        avg(ret_1d) AS mr, count(*) AS symbols FROM panel GROUP BY date),
    vols AS (SELECT *, CASE WHEN count(mr) OVER f20 >= 10 THEN stddev_pop(mr) OVER f20 * sqrt(252.0) END AS rv20, CASE WHEN count(mr) OVER f60 >= 20 THEN stddev_pop(mr) OVER f60 * sqrt(252.0) END AS rv60 FROM breadth
        WINDOW f20 AS (ORDER BY date ROWS 19 PRECEDING), f60 AS (ORDER BY date ROWS 59 PRECEDING))"""
_add("a01_market_breadth", lambda s, d: r.market_breadth(_panel(s, d)), f"{_PANEL} SELECT date, round(b50, 6) AS b50, round(b200, 6) AS b200, round(mr, 6) AS market_ret, symbols FROM breadth")
_add("a02_avg_pair_correlation", lambda s, d: r.avg_pair_correlation(_panel(s, d)), f"""{_PANEL}, ld AS (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 20), q AS (SELECT symbol, date, ret_1d AS x FROM panel JOIN ld USING (date) WHERE ret_1d IS NOT NULL),
    c AS (SELECT corr(a.x, b.x) AS c, count(*) AS n FROM q a JOIN q b ON a.date = b.date AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol) SELECT round(avg(c), 6) AS avg_corr FROM c WHERE n >= 5 AND NOT isnan(c)""", ())
_add("a03_realized_vol_trend", lambda s, d: r.realized_vol_trend(r.market_breadth(_panel(s, d))).select("date", "rv20", "rv60", "vol_trend"), f"{_PANEL} SELECT date, round(rv20, 6) AS rv20, round(rv60, 6) AS rv60, round(CASE WHEN rv60 > 0 THEN rv20 / rv60 END, 6) AS vol_trend FROM vols")


def _regimes(s: SparkSession, d: str) -> DataFrame:
    days = r.realized_vol_trend(r.market_breadth(_panel(s, d))).where("b50 is not null")
    return r.market_regime(days.withColumn("corr", F.lit(None).cast("double")).withColumn("trend_up", F.col("b200") > 0.5))


_CLIP = "least(1, greatest(0, coalesce({}, 0)))"
_REG = f"""{_PANEL}, rg AS (SELECT date, b50, coalesce(b200 > 0.5, false) AS up, coalesce(CASE WHEN rv60 > 0 THEN rv20 / rv60 END, 1.0) AS v FROM vols WHERE b50 IS NOT NULL),
    sc AS (SELECT date, CASE WHEN up THEN 25 ELSE 5 END + 35 * {_CLIP.format('(b50 - 0.35) / 0.45')} + 20 * ((0.8 - 0.5) / 0.6) + 20 * {_CLIP.format('(1.4 - v) / 0.8')} AS ron,
        CASE WHEN up THEN 5 ELSE 20 END + 30 * ((0.5 - 0.35) / 0.45) + 30 * {_CLIP.format('(v - 0.95) / 0.8')} + 20 * {_CLIP.format('(0.55 - b50) / 0.45')} AS roff FROM rg),
    reg AS (SELECT *, CASE WHEN roff >= 65 AND roff - ron >= 5 THEN 'RiskOff' WHEN ron >= 65 AND ron >= roff THEN 'RiskOn' ELSE 'Neutral' END AS regime FROM sc)"""
_add("a04_market_regime", lambda s, d: _regimes(s, d).select("date", "risk_on", "risk_off", "regime"), f"{_REG} SELECT date, round(ron, 6)::DOUBLE AS risk_on, round(roff, 6)::DOUBLE AS risk_off, regime FROM reg")
_add("a05_regime_shift", lambda s, d: r.regime_shift(r.market_breadth(_panel(s, d))), f"{_PANEL} SELECT date, round(b50 - lag(b50, 7) OVER (ORDER BY date), 6) AS breadth_delta, round(sum(mr) OVER (ORDER BY date ROWS 4 PRECEDING), 6) AS ret5 FROM breadth")


def _scan_rows(s: SparkSession, d: str) -> DataFrame:
    rows = r.tradable(_panel(s, d), 5.0, 1.0)
    rows = f.cross_rank(rows, "rs_120", "rs_rank_pct").join(_regimes(s, d).select("date", "regime"), "date", "left")
    return rows.withColumn("regime", F.coalesce("regime", F.lit("Neutral"))).withColumn("boost", F.lit(0.0))


_SCAN = f"""{_REG}, td AS (SELECT p.*, coalesce(regime, 'Neutral') AS regime FROM panel p LEFT JOIN reg ON p.date = reg.date WHERE close >= 5 AND va >= 1 AND ma50 IS NOT NULL AND ma200 IS NOT NULL),
    rk AS (SELECT *, CASE WHEN rs IS NOT NULL THEN (rank() OVER (PARTITION BY date, rs IS NULL ORDER BY rs) + (count(rs) OVER (PARTITION BY date, rs) - 1) / 2) / count(rs) OVER (PARTITION BY date) END AS rp FROM td)"""
_add("p02_tradable_universe", lambda s, d: r.tradable(_panel(s, d), 5.0, 25.0).select("symbol", "date"), f"{_PANEL} SELECT symbol, date FROM panel WHERE close >= 5 AND va >= 25 AND ma50 IS NOT NULL AND ma200 IS NOT NULL")
_add("p05_scan_breakout", lambda s, d: r.scan_breakout(_scan_rows(s, d)).select("symbol", "date", "score"), f"""{_SCAN} SELECT symbol, date, round(least(100, greatest(0, 40 * coalesce(rp, 0) + 20 * {_CLIP.format('rv / 3')} + 20 * {_CLIP.format('(close / h20 - 1) / 0.08')} + 10 * coalesce(cp, 0)
    + CASE regime WHEN 'RiskOn' THEN 10 WHEN 'RiskOff' THEN -5 ELSE 5 END - 15 * {_CLIP.format('(atrp - 0.08) / 0.07')})), 2) AS score FROM rk WHERE close > ma50 AND ma50 > ma200 AND close > h20 AND rv >= 1.5 AND cp >= 0.55 AND rp >= 0.7""")
_add("p06_scan_gap_up", lambda s, d: r.scan_gap_up(_scan_rows(s, d)).select("symbol", "date", "score"), f"""{_SCAN} SELECT symbol, date, round(least(100, greatest(0, 35 * {_CLIP.format('gap / 0.12')} + 25 * {_CLIP.format('rv / 4')} + 20 * coalesce(cp, 0) + 10 * (close > ma50)::INT + 10 * (close > ma200)::INT
    + CASE regime WHEN 'RiskOn' THEN 8 WHEN 'RiskOff' THEN -8 ELSE 4 END - 10 * {_CLIP.format('(atrp - 0.10) / 0.08')})), 2) AS score FROM rk WHERE gap >= 0.04 AND rv >= 2 AND cp >= 0.5 AND close > ma50""")
_add("p07_scan_panic_reversal", lambda s, d: r.scan_panic_reversal(_scan_rows(s, d)).select("symbol", "date", "score"), f"""{_SCAN} SELECT symbol, date, round(least(100, greatest(0, 45 * {_CLIP.format('-ret_1d / 0.18')} + 20 * {_CLIP.format('rv / 4')} + CASE WHEN close > ma200 THEN 15 ELSE 5 END
    + CASE regime WHEN 'RiskOn' THEN 2 WHEN 'RiskOff' THEN 12 ELSE 7 END - 12 * {_CLIP.format('(atrp - 0.14) / 0.10')})), 2) AS score FROM rk WHERE ret_1d <= -0.07 AND rv >= 1.8 AND close > 0.85 * ma200""")


def breakout_candidates(s: SparkSession, d: str, k: int = 25) -> DataFrame:
    """The workload from bars to ranked candidates: features, breadth, regime, ranks, scan, top k."""
    return rounded(r.scan_breakout(_scan_rows(s, d), rs=0.5).select("symbol", "date", "regime", "score").orderBy(F.desc("score"), "symbol", "date").limit(k))


def flagship(s: SparkSession, sf_dir: str) -> DataFrame:
    """The same with short windows, for tables with few dates."""
    rows = f.daily_features(bars(s, sf_dir), ma=(5, 10, 20), rs=10).withColumnsRenamed({"ma10": "ma50"}).withColumn("ma200", F.col("ma20"))
    rows = f.cross_rank(rows.where("ma200 is not null"), "rs_10", "rs_rank_pct").withColumn("regime", F.lit("Neutral")).withColumn("boost", F.lit(0.0))
    return rounded(r.scan_breakout(rows, 1.0, 0.5, 0.5).select("symbol", "date", "score").orderBy(F.desc("score"), "symbol", "date").limit(25))


Q["k01_breakout_candidates"] = breakout_candidates
SQL["k01_breakout_candidates"] = dates_as_text(f"""WITH {BARS}, {_SCAN} SELECT symbol, date, regime, round(least(100, greatest(0, 40 * coalesce(rp, 0) + 20 * {_CLIP.format('rv / 3')} + 20 * {_CLIP.format('(close / h20 - 1) / 0.08')} + 10 * coalesce(cp, 0)
    + CASE regime WHEN 'RiskOn' THEN 10 WHEN 'RiskOff' THEN -5 ELSE 5 END - 15 * {_CLIP.format('(atrp - 0.08) / 0.07')})), 2) AS score FROM rk WHERE close > ma50 AND ma50 > ma200 AND close > h20 AND rv >= 1.5 AND cp >= 0.55 AND rp >= 0.5
    ORDER BY score DESC, symbol, date LIMIT 25""", ("date",))
_add(
    "a06_anomalies",
    lambda s, d: r.anomalies(f.latest(f.rolling_zscore(f.rolling_zscore(bars(s, d), "close"), "volume")), ["close_z", "volume_z"], 0.5),
    """x AS (SELECT *, (close - avg(close) OVER f) / stddev_pop(close) OVER f AS close_z, (volume - avg(volume) OVER f) / stddev_pop(volume) OVER f AS volume_z, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n
        FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)), y AS (SELECT symbol, unnest([{'m': 'close_z', 'z': close_z}, {'m': 'volume_z', 'z': volume_z}]) AS q FROM x WHERE n = 1)
    SELECT symbol, q.m AS metric, round(q.z, 6) AS z FROM y WHERE abs(q.z) >= 0.5 ORDER BY abs(q.z) DESC, symbol, metric LIMIT 10""",
    (),
)
_add("j16_leader_follower", lambda s, d: r.leader_follower(_panel(s, d), "2001-06-15", least=0.05, quiet_below=0.5, per_leader=12, k=12), f"""{_PANEL}, dt AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM panel WHERE date <= DATE '2001-06-15')),
    sp AS (SELECT p.*, k FROM panel p JOIN dt USING (date) WHERE k <= 90), lq AS (SELECT symbol, avg(close * volume) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS q FROM sp) WHERE q <= 20 GROUP BY symbol ORDER BY v DESC, symbol LIMIT 120),
    td AS (SELECT * FROM panel WHERE date = DATE '2001-06-15'), ld AS (SELECT symbol AS leader, ret_1d AS lr FROM (SELECT * FROM td WHERE abs(ret_1d) >= 0.045 ORDER BY abs(ret_1d) DESC, symbol LIMIT 6) WHERE symbol IN (SELECT symbol FROM lq)),
    pr AS (SELECT leader, lr, b.symbol, corr(a.ret_1d, b.ret_1d) AS corr, count(*) AS n FROM ld JOIN sp a ON a.symbol = leader JOIN sp b ON b.k = a.k - 1 AND b.symbol <> leader AND b.symbol IN (SELECT symbol FROM lq) WHERE a.ret_1d IS NOT NULL AND b.ret_1d IS NOT NULL GROUP BY ALL),
    tp AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY round(corr, 9) DESC, symbol) AS q FROM pr WHERE round(corr, 9) >= 0.05),
    sc AS (SELECT leader, tp.symbol, corr, n, round(40 * {_CLIP.format('abs(lr) / 0.12')} + 35 * {_CLIP.format('corr / 0.6')} + 15 * {_CLIP.format('rv / 3')} + CASE WHEN close > ma50 THEN 10 ELSE 4 END, 2) AS score FROM tp JOIN td ON td.symbol = tp.symbol WHERE q <= 12 AND abs(ret_1d) < 0.5),
    bb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, leader) AS z FROM sc) SELECT leader, symbol, round(corr, 6) AS corr, n, score FROM bb WHERE z = 1 ORDER BY score DESC, symbol LIMIT 12""", ())
_add(
    "a10_market_factor",
    lambda s, d: f.period_return(bars(s, d), 1).groupBy("date").agg(F.avg("ret_1").alias("factor")),
    f"x AS (SELECT date, close / lag(close) OVER w - 1 AS r FROM bars {_W}) SELECT date, round(avg(r), 6) AS factor FROM x GROUP BY date",
)

_STAT = "pr AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, corr(a.{v}, b.{v}) AS c, regr_slope(a.{v}, b.{v}) AS beta, regr_intercept(a.{v}, b.{v}) AS alpha FROM {t} a JOIN {t} b ON a.date = b.date AND a.symbol < b.symbol GROUP BY ALL)"
_add(
    "j11_pair_correlation_screen",
    lambda s, d: p.pair_correlations(wide_bars(s, d), least_corr=0.15),
    f"many AS (SELECT symbol FROM wide GROUP BY symbol HAVING count(*) >= 250), wb AS (SELECT * FROM wide JOIN many USING (symbol)), {_STAT.format(v='close', t='wb')} SELECT a, b, n, round(c, 6) AS corr FROM pr WHERE n >= 100 AND c >= 0.15",
    (),
    WIDE,
)
_CHOSEN = f"many AS (SELECT symbol FROM wide GROUP BY symbol HAVING count(*) >= 250), wb AS (SELECT * FROM wide JOIN many USING (symbol)), {_STAT.format(v='close', t='wb')}, ch AS (SELECT * FROM pr WHERE n >= 100 AND c >= 0.17)"


_SPREAD = f"""{_CHOSEN}, sp AS (SELECT a, b, x.date, x.close - beta * y.close AS spread FROM ch JOIN wide x ON x.symbol = a JOIN wide y ON y.symbol = b AND y.date = x.date),
    zs AS (SELECT *, CASE WHEN count(*) OVER f = 90 THEN (spread - avg(spread) OVER f) / stddev_samp(spread) OVER f END AS z FROM sp WINDOW f AS (PARTITION BY a, b ORDER BY date ROWS 89 PRECEDING))"""
_add("j12_pair_hedge_spread", lambda s, d: p.pair_signals(wide_bars(s, d), 0.17), f"{_SPREAD}, l AS (SELECT a, b, arg_max(z, date) AS z FROM zs GROUP BY a, b) SELECT a, b, round(z, 6) AS z, CASE WHEN z <= -2 THEN 'LONG' WHEN z >= 2 THEN 'SHORT' ELSE 'NONE' END AS signal FROM l", (), WIDE)
_add("j13_pair_half_life", lambda s, d: p.pair_half_lives(wide_bars(s, d), 0.17), f"""{_SPREAD}, k AS (SELECT a, b, spread, lag(spread) OVER (PARTITION BY a, b ORDER BY date) AS back FROM sp), q AS (SELECT a, b, regr_slope(spread, back) AS phi FROM k WHERE back IS NOT NULL GROUP BY a, b)
    SELECT a, b, round(phi, 6) AS phi, round(CASE WHEN phi > 0 AND phi < 1 THEN -ln(2.0) / ln(phi) END, 6) AS half_life FROM q""", (), WIDE)
Q["j14_pair_adf"] = lambda s, d: rounded(p.pair_unit_roots(wide_bars(s, d), 0.17))
Q["h10_backtest_pairs"] = lambda s, d: rounded(p.backtest_pairs(wide_bars(s, d), 0.17))


def _returns(panel: DataFrame) -> DataFrame:
    return f.period_return(panel, 1).select("symbol", "date", F.col("ret_1").alias("ret"))


_RET = f"rt AS (SELECT symbol, date, close / lag(close) OVER w - 1 AS ret FROM wide {_W}), rn AS (SELECT * FROM rt WHERE ret IS NOT NULL)"
_add("j15_top_return_pairs", lambda s, d: p.top_return_pairs(_returns(wide_bars(s, d))), f"{_RET}, ok AS (SELECT symbol FROM rn GROUP BY symbol HAVING count(*) >= 120), ro AS (SELECT * FROM rn JOIN ok USING (symbol)), {_STAT.format(v='ret', t='ro')} SELECT a, b, n, round(c, 6) AS corr FROM pr WHERE n >= 120 ORDER BY c DESC, a, b LIMIT 12", (), WIDE)
_add("j17_lead_lag_market", lambda s, d: p.lead_lag_market(_returns(wide_bars(s, d))), f"""{_RET}, mk AS (SELECT date, avg(ret) AS m FROM rt GROUP BY date), mb AS (SELECT *, lag(m) OVER (ORDER BY date) AS m1 FROM mk), q AS (SELECT symbol, ret, m, m1, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS r1 FROM rt JOIN mb USING (date))
    SELECT symbol, round(corr(ret, m), 6) AS market_corr, round(corr(ret, m1), 6) AS lead_corr, round(corr(ret, r1), 6) AS auto_corr, count(*) AS n FROM q GROUP BY symbol""", (), WIDE)
