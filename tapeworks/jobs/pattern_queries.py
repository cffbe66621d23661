"""Queries of contraction patterns: swings, patterns, the screen and its walk forward; SQL of swings and patterns by a
recursion over bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.tables import BARS, bars, benchmark, dates_as_text, rounded
from tapeworks.operators import folds, vcp
from tapeworks.operators.features import frame
from tapeworks.operators.ordered import stored

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, dates: tuple[str, ...] = ()) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        SQL[name] = dates_as_text(sql, dates)


def smooth(s: SparkSession, d: str) -> DataFrame:
    """Bars of 20 day means: the ticks of unrelated parts jump too much for many valid patterns of days."""
    rows = bars(s, d).withColumn("_n", F.count("*").over(frame(20)))
    means = rows.select("symbol", "date", "volume", "_n", *[F.avg(c).over(frame(20)).alias(c) for c in ("open", "high", "low", "close")]).where("_n = 20")
    return means.select("symbol", "date", "open", "high", "low", "close", "volume")


_PLAIN = "base AS (SELECT symbol, date, high, low, close, volume FROM bars)"
_SMOOTH = """base AS (SELECT symbol, date, m AS high, l AS low, c AS close, volume FROM (SELECT symbol, date, volume, count(*) OVER w AS n, avg(high) OVER w AS m, avg(low) OVER w AS l, avg(close) OVER w AS c
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) WHERE n = 20)"""

#: The last 120 bars (b), their ranges (a), and a walk over them (z): the running extreme, its bar, the side looked for,
#: and the turn that a bar confirms.
_SWINGS = """k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM base),
b AS (SELECT symbol, date, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM k WHERE back <= 120),
r AS (SELECT symbol, i, n, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
a AS (SELECT symbol, n, CASE WHEN n >= 15 THEN avg(tr) FILTER (i > n - 14) END * 1.5::DOUBLE AS step, CASE WHEN n >= 11 THEN avg(tr) FILTER (i > n - 10) END AS short, CASE WHEN n >= 51 THEN avg(tr) FILTER (i > n - 50) END AS long FROM r GROUP BY symbol, n),
s0 AS (SELECT symbol, arg_max(i, (high, -i)) AS i, max(high) AS ev FROM b WHERE i <= 14 GROUP BY symbol),
z(symbol, i, side, ei, ev, ti, tv, ts) AS (SELECT symbol, i, 1, i, ev, NULL::BIGINT, NULL::DOUBLE, NULL::INTEGER FROM s0 JOIN a USING (symbol) WHERE step > 0
    UNION ALL SELECT symbol, i, CASE WHEN turn THEN -side ELSE side END, CASE WHEN turn OR new THEN i ELSE ei END, CASE WHEN turn THEN CASE side WHEN 1 THEN low ELSE high END WHEN new THEN CASE side WHEN 1 THEN high ELSE low END ELSE ev END,
        CASE WHEN turn THEN ei END, CASE WHEN turn THEN ev END, CASE WHEN turn THEN side END
    FROM (SELECT *, NOT new AND CASE side WHEN 1 THEN ev - low >= step ELSE high - ev >= step END AS turn
        FROM (SELECT z.symbol, b.i, side, ei, ev, high, low, step, CASE side WHEN 1 THEN high > ev ELSE low < ev END AS new FROM z JOIN b ON b.symbol = z.symbol AND b.i = z.i + 1 JOIN a ON a.symbol = z.symbol)))"""


def _pattern_sql(base: str, depth: float, ratio: float) -> str:
    """The best chain of up to four pullbacks (ch) from the three highest swing highs, its verdict and measures."""
    return f"""WITH RECURSIVE {BARS}, {base}, {_SWINGS},
turns AS (SELECT symbol, ti AS i, ts AS side FROM z WHERE ti IS NOT NULL),
fixed AS (SELECT symbol, i, CASE WHEN up THEN 1 ELSE -1 END AS side FROM (SELECT symbol, i, n, high > max(high) OVER p AND high > max(high) OVER f AS up, low < min(low) OVER p AND low < min(low) OVER f AS down FROM b
    WINDOW p AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE (up OR down) AND i > 5 AND i <= n - 5),
enough AS (SELECT symbol FROM turns GROUP BY symbol HAVING count(*) FILTER (side = 1) > 0 AND count(*) FILTER (side = -1) > 0),
sw AS (SELECT * FROM turns WHERE symbol IN (SELECT symbol FROM enough) UNION ALL SELECT * FROM fixed WHERE symbol NOT IN (SELECT symbol FROM enough)),
l AS (SELECT symbol, list(i ORDER BY i) FILTER (side = 1) AS tops, list(i ORDER BY i) FILTER (side = -1) AS bots FROM sw JOIN a USING (symbol) WHERE n >= 30 GROUP BY symbol HAVING count(*) FILTER (side = 1) > 0 AND count(*) FILTER (side = -1) > 0),
st AS (SELECT symbol, i AS s, high AS hs, row_number() OVER (PARTITION BY symbol ORDER BY high DESC, i) AS c FROM sw JOIN b USING (symbol, i) JOIN l USING (symbol) WHERE side = 1),
ch(symbol, c, k, s, hs, hb, lo) AS (SELECT symbol, c, 1, s, hs, s, CASE WHEN len(list_filter(bots, lambda x: x > s AND x < s + 5)) > 0 AND list_filter(bots, lambda x: x >= s + 5)[1] > list_filter(tops, lambda x: x > s)[1] THEN NULL ELSE list_filter(bots, lambda x: x >= s + 5)[1] END FROM st JOIN l USING (symbol) WHERE c <= 3
    UNION ALL SELECT q.symbol, c, k + 1, s, hs, hb2, CASE WHEN len(list_filter(bots, lambda x: x > hb2 AND x < hb2 + 5)) > 0 AND list_filter(bots, lambda x: x >= hb2 + 5)[1] > list_filter(tops, lambda x: x > hb2)[1] THEN NULL ELSE list_filter(bots, lambda x: x >= hb2 + 5)[1] END
    FROM (SELECT ch.*, tops, bots, list_filter(tops, lambda x: x > lo)[1] AS hb2 FROM ch JOIN l ON l.symbol = ch.symbol WHERE lo IS NOT NULL AND k < 4) q JOIN b t ON t.symbol = q.symbol AND t.i = hb2 WHERE abs(t.high - hs) <= hs * 5 / 100::DOUBLE),
pb AS (SELECT ch.symbol, c, k, hb, lo, t.high AS hi, u.low AS lw, round_even((t.high - u.low) / t.high * 100, 2) AS d, t.date AS hd, u.date AS ld, (SELECT CAST(floor(avg(volume)) AS BIGINT) FROM b v WHERE v.symbol = ch.symbol AND v.i BETWEEN hb AND lo) AS v
    FROM ch JOIN b t ON t.symbol = ch.symbol AND t.i = hb JOIN b u ON u.symbol = ch.symbol AND u.i = lo),
g AS (SELECT symbol, c, count(*) AS m, list(d ORDER BY k) AS ds, list(v ORDER BY k) AS vs, max(lo) - min(hb) AS span, arg_max(round_even(hi, 2), k) AS pv, arg_max(round_even(lw, 2), k) AS last_low, arg_max(d, k) AS last_depth, arg_max(lo - hb, k) AS last_bars, arg_min(hd, k) AS first_high_date, arg_max(ld, k) AS last_low_date FROM pb GROUP BY symbol, c),
e AS (SELECT *, list_transform(range(1, m), lambda j: ds[j + 1] / ds[j]) AS rs FROM g),
f AS (SELECT *, m >= 2 AND ds[1] >= {depth}::DOUBLE AND span >= 15 AND len(list_filter(rs, lambda x: x > {ratio}::DOUBLE)) = 0 AS valid FROM e),
o AS (SELECT *, CASE WHEN m < 2 THEN 0 WHEN valid THEN least(100, CASE m WHEN 2 THEN 60 WHEN 3 THEN 80 ELSE 90 END + CASE WHEN last_depth < 5 THEN 10 ELSE 0 END + CASE WHEN list_avg(list_transform(rs, lambda x: round(x, 3))) < 0.4::DOUBLE THEN 10 ELSE 0 END - CASE WHEN ds[1] > 30 THEN 10 ELSE 0 END) ELSE least(40, 15 * m) END AS score FROM f),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY valid DESC, score DESC, m DESC, c) AS nth FROM o) WHERE nth = 1),
w AS (SELECT symbol, max(high) - min(low) AS width FROM b WHERE i > n - 15 GROUP BY symbol)
SELECT a.symbol, (SELECT max(date) FROM b x WHERE x.symbol = a.symbol) AS date, coalesce(valid, false) AS valid, CAST(coalesce(score, 0) AS BIGINT) AS score, coalesce(m, 0) AS contractions, coalesce(pv, (SELECT high FROM b x WHERE x.symbol = a.symbol AND x.i = tops[-1])) AS pivot, last_low, last_depth,
    CASE WHEN tops IS NOT NULL THEN round(short / long, 3) END AS range_compression, coalesce(m >= 2 AND last_depth > 15 AND last_bars < 10, false) AS wide, CASE WHEN m >= 2 THEN round(width / long, 3) END AS right_side,
    coalesce(m > 1 AND len(list_filter(range(1, m), lambda j: vs[j] <= vs[j + 1])) = 0, false) AS volume_declining, first_high_date, last_low_date
FROM a LEFT JOIN l USING (symbol) LEFT JOIN best USING (symbol) LEFT JOIN w USING (symbol)"""


_DATES = ("date", "first_high_date", "last_low_date")
_add("h01_zigzag_swings", lambda s, d: folds.fold(bars(s, d), "swings"), f"WITH RECURSIVE {BARS}, {_PLAIN}, {_SWINGS} SELECT z.symbol, b.date, CASE ts WHEN 1 THEN 'high' ELSE 'low' END AS kind, round(tv, 6) AS price FROM z JOIN b ON b.symbol = z.symbol AND b.i = ti", ("date",))
_add("h02_contraction_patterns", lambda s, d: folds.fold(bars(s, d), "vcp").drop("chain"), _pattern_sql(_PLAIN, 8.0, 0.75), _DATES)
_add("h_vcp", lambda s, d: folds.fold(smooth(s, d), "vcp").drop("chain"), _pattern_sql(_SMOOTH, 8.0, 0.75), _DATES)


def _screened(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        panel = stored(smooth(s, d))  # read by every component
        return run(panel, benchmark(panel))

    return query


_add("h03_vcp_screen", _screened(vcp.vcp_screen))
_add("h_walk_forward", _screened(vcp.walk_forward))
