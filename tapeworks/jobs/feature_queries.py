"""Queries over derived bars for the feature and pattern operators, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.tables import BARS, bars, dates_as_text, rounded
from tapeworks.operators import features as f
from tapeworks.operators import patterns as p

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}



def _frames(*sizes: int) -> str:
    """A WINDOW clause with w (the symbol) and f<n> (the last n rows) for each size."""
    return "WINDOW w AS (PARTITION BY symbol ORDER BY date), " + ", ".join(f"f{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)


def _mean(col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER f{n} = {n} THEN avg({col}) OVER f{n} END"


def _add(name: str, run: Callable[[DataFrame], DataFrame], sql: str, dates: tuple[str, ...] = ("date",)) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(bars(spark, sf_dir)))
    text = sql.lstrip()
    text = f"WITH {BARS} {text}" if text.startswith(("SELECT", ",")) else f"WITH {BARS}, {text}"
    SQL[name] = dates_as_text(text, dates)


_add("bars_daily", lambda b: b, "SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
_add("w01_sma", lambda b: f.sma(b, 20).select("symbol", "date", "sma_20"), f"SELECT symbol, date, round({_mean('close', 20)}, 6) AS sma_20 FROM bars {_frames(20)}")
_add(
    "w02_daily_features",
    lambda b: f.daily_features(b).select("symbol", "date", "prev_close", "ret_1d", "ma20", "ma50", "ma200", "vol_avg20", "rel_volume", "high20_prev", "low20_prev", "close_pos", "gap", "rs_120", "atr14", "atr_pct"),
    f"""x AS (SELECT *, lag(close) OVER w AS prev_close, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
        lag(close, 120) OVER w AS c120 FROM bars {_frames(2)}),
    y AS (SELECT *, {_mean('close', 20)} AS ma20, {_mean('close', 50)} AS ma50, {_mean('close', 200)} AS ma200, {_mean('volume', 20)} AS va, {_mean('tr', 14)} AS atr,
        CASE WHEN count(*) OVER g = 20 THEN max(high) OVER g END AS h20, CASE WHEN count(*) OVER g = 20 THEN min(low) OVER g END AS l20
        FROM x {_frames(14, 20, 50, 200)}, g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, date, round(prev_close, 6) AS prev_close, round(close / prev_close - 1, 6) AS ret_1d, round(ma20, 6) AS ma20, round(ma50, 6) AS ma50, round(ma200, 6) AS ma200, round(va, 6) AS vol_avg20,
        round(volume / va, 6) AS rel_volume, round(h20, 6) AS high20_prev, round(l20, 6) AS low20_prev, round(CASE WHEN high > low THEN (close - low) / (high - low) END, 6) AS close_pos,
        round(open / prev_close - 1, 6) AS gap, round(close / c120 - 1, 6) AS rs_120, round(atr, 6) AS atr14, round(atr / close, 6) AS atr_pct FROM y""",
)
_add(
    "w03_rolling_zscore",
    lambda b: f.rolling_zscore(b, "close").select("symbol", "date", "close_z"),
    f"SELECT symbol, date, round(CASE WHEN count(close) OVER f60 >= 30 AND stddev_pop(close) OVER f60 > 0 THEN (close - avg(close) OVER f60) / stddev_pop(close) OVER f60 END, 6) AS close_z FROM bars {_frames(60)}",
)
_add("w04_as_of_session", lambda b: f.as_of_session(b, "1998-07-04"), "SELECT max(date) AS session FROM bars WHERE date <= DATE '1998-07-04'", ("session",))
_TR = "CASE WHEN lag(close) OVER w IS NULL THEN NULL ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"
_add("w05_atr", lambda b: f.atr(b, 14).select("symbol", "date", "atr_14"), f"x AS (SELECT *, {_TR} AS tr FROM bars {_frames(2)}) SELECT symbol, date, round(coalesce({_mean('tr', 14)}, 0), 6) AS atr_14 FROM x {_frames(14)}")
_add(
    "w09_historical_volatility",
    lambda b: f.historical_volatility(b).select("symbol", "date", "hv"),
    f"x AS (SELECT *, ln(close / lag(close) OVER w) AS r FROM bars {_frames(2)}) SELECT symbol, date, round(CASE WHEN count(r) OVER f30 = 30 THEN stddev_pop(r) OVER f30 END * sqrt(252.0), 6) AS hv FROM x {_frames(30)}",
)
_add(
    "w10_range_52w",
    lambda b: f.range_52w(b).select("symbol", "date", "year_high", "year_low", "avg_volume", "from_high", "from_low"),
    f"""x AS (SELECT *, max(high) OVER f252 AS yh, min(CASE WHEN low > 0 THEN low END) OVER f252 AS yl, avg(volume) OVER f50 AS av FROM bars {_frames(50, 252)})
    SELECT symbol, date, round(yh, 6) AS year_high, round(yl, 6) AS year_low, round(av, 6) AS avg_volume, round((yh - close) / yh, 6) AS from_high, round((close - yl) / close, 6) AS from_low FROM x""",
)
_add(
    "w12_trend_template",
    lambda b: f.trend_template(b).drop("close", "criteria"),
    f"""x AS (SELECT *, {_mean('close', 50)} AS a, {_mean('close', 150)} AS b, {_mean('close', 200)} AS c, max(high) OVER f252 AS hi, min(low) OVER f252 AS lo FROM bars {_frames(50, 150, 200, 252)}),
    y AS (SELECT *, lag(c, 22) OVER w AS c22 FROM x {_frames(2)})
    , z AS (SELECT symbol, date, round((close - a) / a * 100, 9) AS near, round((close - c) / c * 100, 9) AS far, round(least(14.3 * (coalesce(close > b AND close > c, false)::INT + coalesce(b > c, false)::INT + coalesce(c > c22, false)::INT + coalesce(a > b AND a > c, false)::INT
        + coalesce(close > a, false)::INT + (close >= lo * 1.25)::INT + (close >= hi * 0.75)::INT), 100), 1)::DOUBLE AS raw_score FROM y),
    q AS (SELECT *, CASE WHEN near >= 25 THEN -20 WHEN near >= 18 THEN -15 WHEN near >= 12 THEN -10 WHEN near >= 8 THEN -5 ELSE 0 END AS ep, CASE WHEN far >= 70 THEN -20 WHEN far >= 60 THEN -15 WHEN far > 50 THEN -10 ELSE 0 END AS lp FROM z)
    SELECT symbol, date, raw_score, ep::BIGINT AS extended_penalty, lp::BIGINT AS sma200_penalty, round(greatest(0, raw_score + ep), 1)::DOUBLE AS score FROM q""",
)
_add(
    "w13_multi_period_return",
    lambda b: f.period_return(f.period_return(b, 63), 21, both_ends=True).select("symbol", "date", "ret_63", "ret_21"),
    f"SELECT symbol, date, round(close / lag(close, 63) OVER w - 1, 6) AS ret_63, round(close / lag(close, 20) OVER w - 1, 6) AS ret_21 FROM bars {_frames(2)}",
)
_add(
    "w14_volume_pattern",
    f.volume_pattern,
    f"""x AS (SELECT *, avg(volume) OVER f50 AS avg50, sign(close - lag(close) OVER w) AS up FROM bars {_frames(50)}),
    y AS (SELECT *, CASE WHEN volume > avg50 THEN up ELSE 0 END AS net FROM x)
    SELECT symbol, date, round(avg50, 6) AS avg50, round(avg(volume) OVER g / avg50, 6) AS dry_up, round(volume / avg50, 6) AS last_ratio, CAST(sum(net) OVER f20 AS DOUBLE) AS net_days
    FROM y {_frames(20)}, g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
_add(
    "w15_supply_demand",
    f.supply_demand,
    f"""x AS (SELECT *, close - lag(close) OVER w AS d FROM bars {_frames(2)}),
    y AS (SELECT symbol, date, count(*) FILTER (d > 0) OVER f60 AS nu, count(*) FILTER (d < 0) OVER f60 AS nd, avg(volume) FILTER (d > 0) OVER f60 AS u, avg(volume) FILTER (d < 0) OVER f60 AS dn FROM x {_frames(60)})
    SELECT symbol, date, round(CASE WHEN nu >= 10 AND nd >= 10 THEN CASE WHEN dn > 0 THEN u / dn ELSE 5.0 END END, 6) AS ratio FROM y""",
)
_add(
    "w16_acceleration",
    lambda b: f.acceleration(b).select("symbol", "date", "ret_3", "ret_5", "ret_10", "ret_15", "accel", "green"),
    f"""x AS (SELECT *, close / lag(close) OVER w - 1 AS r, coalesce(close > lag(close) OVER w, false) AS g FROM bars {_frames(2)}),
    y AS (SELECT *, sum((NOT g)::INT) OVER w AS run, {_mean('r', 10)} AS slow, {_mean('r', 3)} AS fast FROM x {_frames(3, 10)})
    SELECT symbol, date, round(close / lag(close, 3) OVER w - 1, 6) AS ret_3, round(close / lag(close, 5) OVER w - 1, 6) AS ret_5, round(close / lag(close, 10) OVER w - 1, 6) AS ret_10, round(close / lag(close, 15) OVER w - 1, 6) AS ret_15,
        round(CASE WHEN slow <> 0 THEN fast / slow END, 6) AS accel, CAST(sum(g::INT) OVER (PARTITION BY symbol, run ORDER BY date) AS BIGINT) AS green FROM y {_frames(2)}""",
)
_add(
    "w17_ma_extension",
    lambda b: f.ma_extension(b).select("symbol", "date", "ext_10", "ext_20", "ext_50", "ext_atr"),
    f"""x AS (SELECT *, {_TR} AS tr FROM bars {_frames(2)}), y AS (SELECT *, {_mean('tr', 14)} AS a, {_mean('close', 10)} AS m10, {_mean('close', 20)} AS m20, {_mean('close', 50)} AS m50 FROM x {_frames(10, 14, 20, 50)})
    SELECT symbol, date, round((close / m10 - 1) * 100, 6) AS ext_10, round((close / m20 - 1) * 100, 6) AS ext_20, round((close / m50 - 1) * 100, 6) AS ext_50, round(CASE WHEN a > 0 THEN (close - m20) / a END, 6) AS ext_atr FROM y""",
)
_add(
    "w18_range_expansion",
    lambda b: f.range_expansion(b).select("symbol", "date", "expansion"),
    f"""x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {_frames(2)}),
    y AS (SELECT symbol, date, avg(tr) OVER f5 AS a, CASE WHEN count(tr) OVER g = 20 THEN avg(tr) OVER g END AS b FROM x {_frames(5)}, g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING))
    SELECT symbol, date, round(CASE WHEN b > 0 THEN a / b END, 6) AS expansion FROM y""",
)
_add(
    "w19_liquidity_metrics",
    lambda b: f.liquidity_metrics(b).select("symbol", "date", "adv20", "volume_ratio", "ratio_20_60"),
    f"""x AS (SELECT *, avg(close * volume) OVER f20 AS adv, CASE WHEN count(*) OVER g = 20 THEN avg(volume) OVER g END AS pv, avg(volume) OVER f20 AS v20, avg(volume) OVER f60 AS v60
        FROM bars {_frames(20, 60)}, g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, date, round(adv, 1) AS adv20, round(CASE WHEN pv > 0 THEN volume / pv END, 6) AS volume_ratio, round(CASE WHEN v60 > 0 THEN v20 / v60 END, 6) AS ratio_20_60 FROM x""",
)
Q["w19_liquidity_metrics"] = lambda spark, sf_dir: rounded(f.liquidity_metrics(bars(spark, sf_dir)).select("symbol", "date", F.round("adv20", 1).alias("adv20"), "volume_ratio", "ratio_20_60"))
_DD = f"x AS (SELECT *, close / lag(close) OVER w - 1 AS change, lag(volume) OVER w AS pv, row_number() OVER w AS bar FROM bars {_frames(2)})"
_add("w21_distribution_days", lambda b: p.distribution_days(b).select("symbol", "date", "bar", "change"), f"{_DD} SELECT symbol, date, bar, round(change, 6) AS change FROM x WHERE change <= -0.002 + 1e-12 AND volume > pv")
_add(
    "w22_stalling_and_clustering",
    p.stalling_and_clustering,
    f"""{_DD}, y AS (SELECT symbol, date, coalesce(change <= -0.002 AND volume > pv, false)::INT AS d, coalesce(change >= 0 AND change < 0.001 AND volume > pv, false)::INT AS s FROM x),
    z AS (SELECT symbol, date, CAST(sum(d) OVER f25 AS BIGINT) AS distribution, CAST(sum(s) OVER f25 AS BIGINT) AS stalling, sum(d) OVER f5 AS d5 FROM y {_frames(5, 25)})
    SELECT symbol, date, distribution, stalling, round(CASE WHEN distribution > 0 THEN d5 / distribution ELSE 0 END, 6) AS cluster FROM z""",
)
_BOTH = "b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
_add(
    "w23_fixed_window_swings",
    lambda b: p.fixed_window_swings(b, 3),
    f"""x AS (SELECT symbol, date, high, low, count(*) OVER b = 3 AND count(*) OVER a = 3 AS ok, high > max(high) OVER b AND high > max(high) OVER a AS hi, low < min(low) OVER b AND low < min(low) OVER a AS lo FROM bars WINDOW {_BOTH.format(k=3)})
    SELECT symbol, date, round(high, 6) AS high, round(low, 6) AS low, ok AND hi AS swing_high, ok AND lo AS swing_low FROM x WHERE ok AND (hi OR lo)""",
)
_PT = """x AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS bar, count(*) OVER f = 41 AND close = max(close) OVER f AS peak, count(*) OVER f = 41 AND close = min(close) OVER f AS trough
        FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)), m AS (SELECT * FROM x WHERE peak OR trough)"""
_add("w24_peaks_troughs", p.peaks_troughs, f"{_PT} SELECT symbol, date, bar, round(close, 6) AS close, peak, trough FROM m")
_TREND = f"""{_PT}, n AS (SELECT *, max(CASE WHEN peak THEN bar END) OVER (PARTITION BY symbol ORDER BY bar) AS pb FROM m),
    t AS (SELECT symbol, pb, arg_min(bar, (close, bar)) AS tb, arg_min(date, (close, bar)) AS td, arg_min(close, (close, bar)) AS tc FROM n WHERE trough AND bar > pb GROUP BY symbol, pb),
    trend AS (SELECT m.symbol, m.date AS peak_date, m.close AS peak_close, td AS trough_date, tc AS trough_close, tb - m.bar AS bars, (1 - tc / m.close) * 100 AS depth_pct
        FROM m JOIN t ON m.symbol = t.symbol AND m.bar = t.pb WHERE m.peak AND (1 - tc / m.close) * 100 >= 5 AND tb - m.bar >= 3)"""
_add("w25_downtrends", p.downtrends, f"{_TREND} SELECT symbol, peak_date, round(peak_close, 6) AS peak_close, trough_date, round(trough_close, 6) AS trough_close, bars, round(depth_pct, 6) AS depth_pct FROM trend", ("peak_date", "trough_date"))


def _with_groups(b: DataFrame) -> DataFrame:
    return p.downtrends(b).withColumn("sector", F.substring("symbol", 1, 7)).withColumn("tier", F.when(F.col("depth_pct") >= 50, "deep").otherwise("shallow"))


_add(
    "a11_downtrend_stats",
    lambda b: p.downtrend_stats(_with_groups(b)),
    f"""{_TREND}, g AS (SELECT *, substr(symbol, 1, 7) AS sector, CASE WHEN depth_pct >= 50 THEN 'deep' ELSE 'shallow' END AS tier FROM trend)
    SELECT sector, tier, count(*) AS n, round(quantile_cont(bars, 0.5), 6) AS median, round(avg(bars), 6) AS mean, CAST(floor(quantile_cont(bars, 0.25)) AS BIGINT) AS p25, CAST(floor(quantile_cont(bars, 0.75)) AS BIGINT) AS p75,
        CAST(floor(quantile_cont(bars, 0.9)) AS BIGINT) AS p90, CAST(grouping(sector, tier) AS INT) AS level FROM g GROUP BY GROUPING SETS ((), (sector), (tier))""",
    (),
)
_add(
    "a45_dd_status",
    p.dd_status,
    f"""{_DD}, d AS (SELECT * FROM x WHERE change <= -0.002 + 1e-12 AND volume > pv), l AS (SELECT symbol, max(bar) AS last FROM x GROUP BY symbol),
    r AS (SELECT d.symbol, d.date, d.bar, max(y.high) AS hs, min(CASE WHEN y.bar > d.bar AND y.high >= d.close * 1.05 THEN y.bar END) AS hit FROM d JOIN x y ON y.symbol = d.symbol AND y.bar BETWEEN d.bar AND d.bar + 25 GROUP BY ALL)
    SELECT r.symbol, r.date, last - bar AS age, round(hs, 6) AS high_since, CASE WHEN hit IS NOT NULL THEN 'invalidated' WHEN last - bar > 25 THEN 'expired' ELSE 'active' END AS status FROM r JOIN l USING (symbol)""",
)
_add(
    "a45_dd_risk",
    lambda b: p.dd_risk(p.dd_status(b, gain=0.9)),
    f"""{_DD}, d AS (SELECT * FROM x WHERE change <= -0.002 + 1e-12 AND volume > pv), l AS (SELECT symbol, max(bar) AS last FROM x GROUP BY symbol),
    r AS (SELECT d.symbol, d.bar, min(CASE WHEN y.bar > d.bar AND y.high >= d.close * (1 + 0.9) THEN y.bar END) AS hit FROM d JOIN x y ON y.symbol = d.symbol AND y.bar BETWEEN d.bar AND d.bar + 25 GROUP BY ALL),
    q AS (SELECT r.symbol, last - bar AS age, hit IS NULL AND last - bar <= 25 AS active FROM r JOIN l USING (symbol)),
    c AS (SELECT symbol, count(*) FILTER (active AND age < 5) AS d5, count(*) FILTER (active AND age < 15) AS d15, count(*) FILTER (active AND age < 25) AS d25 FROM q GROUP BY symbol)
    SELECT *, CASE WHEN d25 >= 6 OR d15 >= 4 THEN 'SEVERE' WHEN d25 >= 5 OR d15 >= 3 OR d5 >= 2 THEN 'HIGH' WHEN d25 >= 3 THEN 'CAUTION' ELSE 'NORMAL' END AS risk FROM c""",
    (),
)


def _trend_sql(k: int) -> str:
    f_ = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {5 + k} PRECEDING AND {1 + k} PRECEDING)"
    move = f"(last_value(close) OVER {f_} - first_value(close) OVER {f_}) / abs(first_value(close) OVER {f_})"
    return f"CASE WHEN count(close) OVER {f_} < 2 THEN 0 WHEN {move} > 0.01 THEN 1 WHEN {move} < -0.01 THEN -1 ELSE 0 END AS t{k}"


_HITS = f"""k AS (SELECT *, row_number() OVER w AS bar, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc, lag(open, 2) OVER w AS ao, lag(close, 2) OVER w AS ac,
        {_trend_sql(0)}, {_trend_sql(1)}, {_trend_sql(2)} FROM bars {_frames(2)}),
    e AS (SELECT *, high - low AS span, abs(close - open) AS body, high - greatest(open, close) AS us, least(open, close) - low AS ls, ph - pl AS pspan, abs(pc - po) AS pbody, abs(ac - ao) AS abody, 0.001 * greatest(close, 1.0) AS tol FROM k),
    h AS (SELECT symbol, date, bar, close, volume, unnest([
        CASE WHEN span > 0 AND body / span <= 0.1 THEN {{'pattern': 'doji', 'direction': 0, 'reliability': 0.3::DOUBLE}} END,
        CASE WHEN span > 0 AND body > 0 AND body / span < 0.4 AND ls >= 2 * body AND us <= 0.15 * span AND t0 = -1 THEN {{'pattern': 'hammer', 'direction': 1, 'reliability': 0.6::DOUBLE}} END,
        CASE WHEN span > 0 AND body > 0 AND body / span < 0.4 AND ls >= 2 * body AND us <= 0.15 * span AND t0 = 1 THEN {{'pattern': 'hanging_man', 'direction': -1, 'reliability': 0.5::DOUBLE}} END,
        CASE WHEN span > 0 AND body > 0 AND body / span < 0.4 AND us >= 2 * body AND ls <= 0.15 * span AND t0 = -1 THEN {{'pattern': 'inverted_hammer', 'direction': 1, 'reliability': 0.5::DOUBLE}} END,
        CASE WHEN span > 0 AND body > 0 AND body / span < 0.4 AND us >= 2 * body AND ls <= 0.15 * span AND t0 = 1 THEN {{'pattern': 'shooting_star', 'direction': -1, 'reliability': 0.6::DOUBLE}} END,
        CASE WHEN span > 0 AND body / span >= 0.9 AND close > open THEN {{'pattern': 'bullish_marubozu', 'direction': 1, 'reliability': 0.55::DOUBLE}} END,
        CASE WHEN span > 0 AND body / span >= 0.9 AND close < open THEN {{'pattern': 'bearish_marubozu', 'direction': -1, 'reliability': 0.55::DOUBLE}} END,
        CASE WHEN pc < po AND close > open AND close >= po AND open <= pc AND body > pbody THEN {{'pattern': 'bullish_engulfing', 'direction': 1, 'reliability': 0.7::DOUBLE}} END,
        CASE WHEN pc > po AND close < open AND open >= pc AND close <= po AND body > pbody THEN {{'pattern': 'bearish_engulfing', 'direction': -1, 'reliability': 0.7::DOUBLE}} END,
        CASE WHEN t1 = -1 AND pc < po AND close > open AND open < pl AND close > (po + pc) / 2 AND close < po THEN {{'pattern': 'piercing_line', 'direction': 1, 'reliability': 0.6::DOUBLE}} END,
        CASE WHEN t1 = 1 AND pc > po AND close < open AND open > ph AND close < (po + pc) / 2 AND close > po THEN {{'pattern': 'dark_cloud_cover', 'direction': -1, 'reliability': 0.6::DOUBLE}} END,
        CASE WHEN pc < po AND close > open AND open > pc AND close < po AND body < pbody THEN {{'pattern': 'bullish_harami', 'direction': 1, 'reliability': 0.45::DOUBLE}} END,
        CASE WHEN pc > po AND close < open AND open < pc AND close > po AND body < pbody THEN {{'pattern': 'bearish_harami', 'direction': -1, 'reliability': 0.45::DOUBLE}} END,
        CASE WHEN pspan > 0 AND span > 0 AND t1 = -1 AND abs(pl - low) <= tol AND pc < po AND close > open THEN {{'pattern': 'tweezer_bottom', 'direction': 1, 'reliability': 0.4::DOUBLE}} END,
        CASE WHEN pspan > 0 AND span > 0 AND t1 = 1 AND abs(ph - high) <= tol AND pc > po AND close < open THEN {{'pattern': 'tweezer_top', 'direction': -1, 'reliability': 0.4::DOUBLE}} END,
        CASE WHEN t2 = -1 AND ac < ao AND pbody < abody * 0.5 AND close > open AND close > (ao + ac) / 2 THEN {{'pattern': 'morning_star', 'direction': 1, 'reliability': 0.75::DOUBLE}} END,
        CASE WHEN t2 = 1 AND ac > ao AND pbody < abody * 0.5 AND close < open AND close < (ao + ac) / 2 THEN {{'pattern': 'evening_star', 'direction': -1, 'reliability': 0.75::DOUBLE}} END,
        CASE WHEN ac > ao AND pc > po AND close > open AND pc > ac AND close > pc AND po > ao AND open > po THEN {{'pattern': 'three_white_soldiers', 'direction': 1, 'reliability': 0.7::DOUBLE}} END,
        CASE WHEN ac < ao AND pc < po AND close < open AND pc < ac AND close < pc AND po < ao AND open < po THEN {{'pattern': 'three_black_crows', 'direction': -1, 'reliability': 0.7::DOUBLE}} END]) AS hit FROM e),
    hits AS (SELECT symbol, date, bar, close, volume, hit.pattern AS pattern, hit.direction AS direction, hit.reliability AS reliability FROM h WHERE hit IS NOT NULL)"""
_add("w28_candlestick_patterns", lambda b: p.candlestick_patterns(b).drop("close", "volume"), f", {_HITS} SELECT symbol, date, bar, pattern, direction, reliability FROM hits")
_add(
    "w29_pattern_signal",
    p.pattern_signal,
    f""", {_HITS}, l AS (SELECT symbol, count(*) AS last FROM bars GROUP BY symbol),
    q AS (SELECT l.symbol, last, last - bar AS age, direction * reliability AS x FROM l LEFT JOIN (SELECT * FROM hits WHERE direction <> 0) h ON h.symbol = l.symbol AND last - bar < 3),
    s AS (SELECT symbol, last, round(coalesce(CASE WHEN count(*) FILTER (age = 0) > 0 THEN sum(x) FILTER (age = 0) ELSE sum(x * pow(0.5, age)) END, 0), 9) AS score FROM q GROUP BY symbol, last)
    SELECT symbol, round(score, 6) AS score, CASE WHEN last < 20 THEN 'NODATA' WHEN score >= 0.5 THEN 'BUY' WHEN score <= -0.5 THEN 'SELL' ELSE 'NEUTRAL' END AS signal FROM s""",
    (),
)
_FWD = f"""o AS (SELECT symbol, date, lead(close, 5) OVER w / close - 1 AS f5, lead(close, 10) OVER w / close - 1 AS f10, count(*) OVER (PARTITION BY symbol) AS n,
        CASE WHEN count(*) OVER g = 20 AND avg(volume) OVER g > 0 THEN CASE WHEN volume >= 1.5 * avg(volume) OVER g THEN 'high' ELSE 'normal' END END AS bucket
        FROM bars {_frames(2)}, g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
_OUT = f""", {_HITS}, {_FWD}, q AS (SELECT pattern, direction, bucket, unnest([{{'horizon': 5, 'ret': f5}}, {{'horizon': 10, 'ret': f10}}]) AS x FROM hits JOIN o USING (symbol, date) WHERE direction <> 0 AND n >= 12),
    r AS (SELECT pattern, direction, bucket, x.horizon AS horizon, x.ret AS ret FROM q WHERE x.ret IS NOT NULL)"""
_STATS = "count(*) AS n, round(avg(CASE WHEN direction * ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(ret), 6) AS mean_ret, round(avg(ret * direction), 6) AS signed_ret"
_add("a12_pattern_backtest", p.pattern_backtest, f"{_OUT} SELECT pattern, horizon, {_STATS} FROM r GROUP BY pattern, horizon", ())
_add(
    "a13_pattern_backtest_by_volume",
    lambda b: p.pattern_backtest(b, by_volume=True),
    f"{_OUT} SELECT pattern, horizon, bucket, {_STATS} FROM r WHERE bucket IS NOT NULL GROUP BY pattern, horizon, bucket UNION ALL SELECT pattern, horizon, 'all', {_STATS} FROM r GROUP BY pattern, horizon",
    (),
)
_add(
    "w30_volume_bucket",
    lambda b: p.volume_bucket(p.forward_return(b, 5)).select("symbol", "date", "fwd_5", "bucket"),
    f", {_FWD} SELECT symbol, date, round(f5, 6) AS fwd_5, bucket FROM o",
)
_add(
    "w32_rs_rank_percentile",
    lambda b: f.cross_rank(f.period_return(b, 20), "ret_20", "pct").select("symbol", "date", "pct"),
    f"""x AS (SELECT symbol, date, close / lag(close, 20) OVER w - 1 AS r FROM bars {_frames(2)}),
    y AS (SELECT *, rank() OVER (PARTITION BY date, r IS NULL ORDER BY r) AS k, count(r) OVER (PARTITION BY date, r) AS t, count(r) OVER (PARTITION BY date) AS n FROM x)
    SELECT symbol, date, round(CASE WHEN r IS NOT NULL THEN (k + (t - 1) / 2) / n END, 6) AS pct FROM y""",
)
_add(
    "w33_rs_universe_percentile",
    lambda b: f.universe_percentile(f.period_return(b, 20), "ret_20", "pct").select("symbol", "date", "pct"),
    f"""x AS (SELECT symbol, date, close / lag(close, 20) OVER w - 1 AS r FROM bars {_frames(2)}),
    y AS (SELECT *, count(r) OVER (PARTITION BY date ORDER BY r) AS k, count(r) OVER (PARTITION BY date) AS n FROM x)
    SELECT symbol, date, CAST(CASE WHEN r IS NULL THEN 0 ELSE least(round_even(100 * k / n, 0), CASE WHEN n < 5 THEN 74 WHEN n < 10 THEN 84 WHEN n < 20 THEN 94 ELSE 100 END) END AS BIGINT) AS pct FROM y""",
)
