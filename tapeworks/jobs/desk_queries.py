"""Queries of desk selections, reviews and macro components over derived tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.jobs.event_queries import _REG, _regimes
from tapeworks.jobs.feature_queries import _HITS
from tapeworks.jobs.tables import BARS, INTRADAY, bars, dates_as_text, earnings, intraday, rounded, table
from tapeworks.operators import desk, growth, macro, parabolic, reviews
from tapeworks.operators.events import monthly_close
from tapeworks.operators.features import by, full, rolling_zscore
from tapeworks.streaming import intraday as live

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, dates: tuple[str, ...] = ()) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    SQL[name] = dates_as_text(sql, dates)


_add("p14_recent_volume_reversals", lambda s, d: desk.recent_volume_reversals(bars(s, d), ("hanging_man", "shooting_star", "bearish_engulfing", "bearish_harami"), high=1.1, within=60), f"""WITH {BARS}, {_HITS},
    v AS (SELECT symbol, date, volume / avg(volume) OVER g AS ratio, count(*) OVER g = 20 AS ok FROM bars WINDOW g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    l AS (SELECT symbol, count(*) AS last FROM bars GROUP BY symbol HAVING count(*) >= 23)
    SELECT symbol, pattern, date, last - bar AS bars_ago, round(ratio, 2) AS vol_ratio FROM hits JOIN l USING (symbol) JOIN v USING (symbol, date)
    WHERE pattern IN ('hanging_man', 'shooting_star', 'bearish_engulfing', 'bearish_harami') AND last - bar < 60 AND ok AND ratio >= 1.1::DOUBLE""", ("date",))

_add("k04_rank_pairs", lambda s, d: desk.rank_pairs(table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.round(F.avg("l_discount"), 4).alias("p_value"), F.when(F.count("*") > 1, F.round((F.avg("l_quantity") - 25) / 10, 4)).alias("z"))),
     "SELECT l_partkey AS a, l_suppkey AS b, round(avg(l_discount), 4)::DOUBLE AS p_value, CASE WHEN count(*) > 1 THEN round((avg(l_quantity) - 25) / 10, 4) END AS z FROM lineitem GROUP BY 1, 2 ORDER BY p_value, abs(coalesce(z, 0)) DESC, a, b")


def _proposals(s: SparkSession, d: str) -> DataFrame:
    """An order is a proposal of its customer: archetype = priority, modules = flags and numbers of its lines, the source's
    modules those of the customer's first order."""
    orders, lines = table(s, d, "orders"), table(s, d, "lineitem")
    modes = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))).alias("target_modules"))
    rows = orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("archetype"), (F.col("o_totalprice") / 600000).alias("quality")).join(modes, "id")
    first = rows.groupBy("source").agg(F.min_by("target_modules", "id").alias("source_modules"))
    return rows.join(first, "source")


_add("k05_diversity_top_k", lambda s, d: desk.diverse_top(_proposals(s, d)), """WITH m AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag || l_linestatus || l_linenumber)) AS t FROM lineitem GROUP BY 1),
    p AS (SELECT o_custkey AS source, id, o_orderpriority AS archetype, o_totalprice / 600000 AS quality, t FROM orders JOIN m ON o_orderkey = id), f AS (SELECT source, arg_min(t, id) AS s FROM p GROUP BY source),
    n AS (SELECT p.source, id, archetype, quality, 1 - len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))) AS nov FROM p JOIN f USING (source)), c AS (SELECT *, round(0.6::DOUBLE * quality + 0.4::DOUBLE * nov, 4) AS combined FROM n),
    b AS (SELECT *, row_number() OVER (PARTITION BY source, archetype ORDER BY combined DESC, nov DESC, id) AS k1 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY combined DESC, nov DESC, id) AS place FROM b WHERE k1 = 1)
    SELECT source, archetype, id, combined, round(nov, 4) AS novelty, place FROM r WHERE place <= 3""")


def _related(s: SparkSession, d: str) -> DataFrame:
    """Brands with large parts of one type are related to the type's first brand."""
    parts = table(s, d, "part").where("p_size > 40").select("p_type", "p_brand").distinct()
    first = parts.groupBy("p_type").agg(F.min("p_brand").alias("future"))
    return parts.join(first, "p_type").where("p_brand <> future").select("future", F.lower("p_brand").alias("symbol")).distinct()


_add("j09_futures_trigger", lambda s, d: desk.futures_trigger(bars(s, d), _related(s, d)), f"""WITH {BARS}, r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars),
    z AS (SELECT symbol, date, CASE WHEN count(ret) OVER f >= 30 THEN (ret - avg(ret) OVER f) / stddev_pop(ret) OVER f END AS z FROM r WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)),
    m AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size > 40), g AS (SELECT p_type, min(p_brand) AS future FROM m GROUP BY 1), rel AS (SELECT DISTINCT future, p_brand AS symbol FROM m JOIN g USING (p_type) WHERE p_brand <> future)
    SELECT date, upper(rel.symbol) AS symbol, future, round(z, 3) AS z, round(least(abs(z) / 4, 1) * 60 + 20, 2) AS score FROM z JOIN rel ON future = z.symbol WHERE abs(z) >= 2""", ("date",))

_NAMED = ["supplier#000000001", "Supplier#000000002", "Supplier#000000007"]
_add("j23_named_holders", lambda s, d: desk.named_holders(table(s, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.format_string("Supplier#%09d", F.col("l_suppkey").cast("long")).alias("holder")), _NAMED),
     "WITH h AS (SELECT DISTINCT l_partkey AS symbol, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS holder FROM lineitem) SELECT symbol, count(*) FILTER (holder IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000007')) > 0 AS flag, coalesce(string_agg(holder, ',' ORDER BY holder) FILTER (holder IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000007')), '') AS names FROM h GROUP BY symbol")


def _odd(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    gap = b.withColumn("gap", F.col("open") / F.lag("close").over(by()) - 1).withColumn("rv", F.col("volume") / full(F.avg("volume"), "volume", 20, 1))
    rows = rolling_zscore(rolling_zscore(gap, "gap"), "rv")
    return rows.select("date", "symbol", F.explode(F.array(F.struct(F.lit("gap").alias("metric"), F.col("gap_z").alias("z")), F.struct(F.lit("rel_volume").alias("metric"), F.col("rv_z").alias("z")))).alias("x")).select("date", "symbol", "x.*").where("z is not null")


def _moves(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d).select("date", "symbol", (F.col("close") / F.col("open") - 1).alias("reaction"))


_add("u05_rule_hints", lambda s, d: desk.rule_hints(_regimes(s, d).select("date", "regime"), _odd(s, d), _moves(s, d), most=2, news_limit=0.5), f"""WITH {BARS}, {_REG.split("WITH", 1)[-1]},
    g AS (SELECT symbol, date, open / lag(close) OVER w - 1 AS gap, CASE WHEN count(*) OVER v = 20 THEN volume / avg(volume) OVER v END AS rv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    zz AS (SELECT symbol, date, CASE WHEN count(gap) OVER f >= 30 THEN (gap - avg(gap) OVER f) / stddev_pop(gap) OVER f END AS a, CASE WHEN count(rv) OVER f >= 30 THEN (rv - avg(rv) OVER f) / stddev_pop(rv) OVER f END AS b FROM g WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)),
    an AS (SELECT date, symbol, 'gap' AS metric, a AS z FROM zz WHERE a IS NOT NULL UNION ALL SELECT date, symbol, 'rel_volume', b FROM zz WHERE b IS NOT NULL),
    tp AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(z) DESC, symbol, metric) AS k FROM an), days AS (SELECT date, regime FROM reg)
    SELECT date, CASE regime WHEN 'RiskOn' THEN 'Breadth-supported breakout regime' ELSE 'Risk-off selectivity' END AS title, CASE regime WHEN 'RiskOn' THEN 'breakout' ELSE 'regime_shift' END AS hypothesis, CASE regime WHEN 'RiskOn' THEN 'pivot_breakout' END AS family, NULL AS symbol, regime, CASE regime WHEN 'RiskOn' THEN 'behavior' ELSE 'risk_premium' END AS mechanism
        FROM days WHERE regime IN ('RiskOn', 'RiskOff')
    UNION ALL SELECT tp.date, CASE WHEN metric = 'rel_volume' THEN 'Participation spike in ' WHEN z > 0 THEN 'Positive gap shock in ' ELSE 'Downside overreaction watch in ' END || upper(symbol), CASE WHEN metric = 'gap' AND z < 0 THEN 'panic_reversal' ELSE 'breakout' END,
        CASE WHEN metric = 'rel_volume' THEN 'pivot_breakout' WHEN z > 0 THEN 'gap_up_continuation' ELSE 'panic_reversal' END, upper(symbol), regime, CASE metric WHEN 'gap' THEN 'behavior' ELSE 'flow' END FROM tp LEFT JOIN days ON days.date = tp.date WHERE k <= 2 AND abs(z) >= 2.5
    UNION ALL SELECT b.date, CASE WHEN close >= open THEN 'News drift continuation in ' ELSE 'News shock reversal in ' END || upper(symbol), 'news_reaction', 'news_reaction', upper(symbol), regime, 'behavior' FROM bars b LEFT JOIN days ON days.date = b.date WHERE abs(close / open - 1) >= 0.5""", ("date",))

# Macro: ratios of brands' monthly closes.
_PAIRS = {"concentration": ("Brand#11", "Brand#12"), "yield_curve": ("Brand#13", "Brand#14"), "credit_conditions": ("Brand#15", "Brand#21"), "size_factor": ("Brand#22", "Brand#23"), "equity_bond": ("Brand#24", "Brand#25"), "sector_rotation": ("Brand#31", "Brand#32")}


def _brands(s: SparkSession, d: str) -> DataFrame:
    """The table's brands in order: some scales write Brand#1, others Brand#11."""
    return table(s, d, "part").select(F.col("p_brand").alias("symbol")).distinct()


def _series(s: SparkSession, d: str) -> DataFrame:
    months = monthly_close(bars(s, d))
    spans = s.createDataFrame([(n, 2 * i + 1, 2 * i + 2) for i, n in enumerate(_PAIRS)], "name string, up int, down int")
    place = _brands(s, d).selectExpr("symbol", "row_number() over (order by symbol) as k")  # two dozen brands
    at = months.join(place, "symbol")
    up, down = at.select(F.col("k").alias("up"), "month", F.col("close").alias("a")), at.select(F.col("k").alias("down"), "month", F.col("close").alias("b"))
    return spans.join(up, "up").join(down, ["down", "month"]).where("b <> 0").select("name", "month", (F.col("a") / F.col("b")).alias("value"), "a", "b")


_MAC = f"""{BARS}, mc AS (SELECT symbol, strftime(date, '%Y-%m') AS month, arg_max(close, date) AS close FROM bars WHERE close > 0 GROUP BY ALL), pl AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT p_brand AS symbol FROM part)),
at0 AS (SELECT k, month, close FROM mc JOIN pl USING (symbol)), sp AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {2 * i + 1}, {2 * i + 2})" for i, n in enumerate(_PAIRS))}) v(name, u, d)),
ser AS (SELECT name, a.month, a.close / b.close AS value, a.close AS a, b.close AS b FROM sp JOIN at0 a ON a.k = u JOIN at0 b ON b.k = d AND b.month = a.month),
sm AS (SELECT *, row_number() OVER w AS n, CASE WHEN count(*) OVER f = 6 THEN avg(value) OVER f END AS fast, CASE WHEN count(*) OVER g = 12 THEN avg(value) OVER g END AS slow, (value - lag(value, 3) OVER w) / lag(value, 3) OVER w * 100 AS r3, (value - lag(value, 12) OVER w) / lag(value, 12) OVER w * 100 AS r12
    FROM ser WINDOW w AS (PARTITION BY name ORDER BY month), f AS (PARTITION BY name ORDER BY month ROWS 5 PRECEDING), g AS (PARTITION BY name ORDER BY month ROWS 11 PRECEDING)),
tn AS (SELECT *, fast - slow AS side, lag(fast - slow) OVER (PARTITION BY name ORDER BY month) AS bs FROM sm),
cr AS (SELECT name, max(n) AS cn, arg_max(CASE WHEN side > 0 THEN 1 ELSE -1 END, n) AS ct FROM tn WHERE (bs <= 0 AND side > 0) OR (bs >= 0 AND side < 0) GROUP BY name),
ls AS (SELECT tn.*, cn, ct, CASE WHEN n >= 15 THEN side / slow * 100 END AS gp, CASE WHEN n >= 15 AND n - cn <= 11 THEN n - cn END AS ago FROM tn LEFT JOIN cr USING (name) WHERE n >= 12 QUALIFY row_number() OVER (PARTITION BY name ORDER BY month DESC) = 1),
x1 AS (SELECT *, CASE WHEN ago IS NOT NULL THEN CASE WHEN ct > 0 THEN 'golden_cross' ELSE 'death_cross' END WHEN abs(gp) < 1 THEN 'converging' ELSE 'none' END AS xo, coalesce(round(gp, 3), 0) AS g3 FROM ls),
pc AS (SELECT ls.name, 100.0::DOUBLE * count(*) FILTER (ser.value < ls.value) / count(*) AS pct FROM ls JOIN ser ON ser.name = ls.name GROUP BY ls.name),
dirs AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{a}', '{b}', '{c}')" for n, (a, b, c) in macro.DIRECTIONS.items())}) v(name, u, dn, no)),
x2 AS (SELECT x1.*, pct, CASE WHEN r3 > 0 THEN u WHEN r3 < 0 THEN dn END AS mv, CASE xo WHEN 'golden_cross' THEN u WHEN 'death_cross' THEN dn END AS xd, u, dn, no FROM x1 JOIN dirs USING (name) JOIN pc USING (name)),
comp AS (SELECT name, month, least(100, CASE WHEN xd IS NOT NULL THEN CASE WHEN ago <= 2 THEN 40 WHEN ago <= 5 THEN 30 ELSE 20 END WHEN xo = 'converging' THEN trunc(greatest(0, 1 - abs(g3)) * 25) ELSE 0 END
        + coalesce(CASE WHEN r12 * r3 < 0 THEN trunc(least(abs(r3), 5) / 5 * 30) WHEN r12 IS NOT NULL AND abs(r3) > 3 THEN 10 END, 0)
        + CASE WHEN xd IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN (xo = 'golden_cross' AND r3 > 0) OR (xo = 'death_cross' AND r3 < 0) THEN 10 ELSE 0 END + CASE WHEN abs(fast - slow) / slow * 100 > 0.5 THEN 10 ELSE 0 END)::BIGINT AS score,
    CASE WHEN name = 'yield_curve' THEN coalesce(mv, no) WHEN xd IS NOT NULL THEN CASE WHEN ago >= 3 AND mv <> xd THEN mv ELSE xd END WHEN name = 'concentration' AND slow IS NOT NULL THEN CASE WHEN fast > slow THEN u ELSE dn END ELSE coalesce(mv, no) END AS direction,
    CASE WHEN name = 'yield_curve' OR xd IS NULL OR mv IS NULL THEN 'N/A' WHEN mv = xd THEN 'confirmed' WHEN ago >= 3 THEN 'reversing' ELSE 'fading' END AS qualifier, xo AS crossover, ago AS bars_ago, round(gp, 3) AS gap_pct, round(r3, 2) AS roc_3m, round(r12, 2) AS roc_12m, round(pct, 1) AS percentile FROM x2)"""
_add("a28_macro_components", lambda s, d: macro.components(_series(s, d).select("name", "month", "value")), f"WITH {_MAC} SELECT * FROM comp")


def _correlation(s: SparkSession, d: str) -> DataFrame:
    return macro.correlation_regime(_series(s, d).where("name = 'equity_bond'").select("month", "a", "b"))


_COR = """ret AS (SELECT month, a / lag(a) OVER (ORDER BY month) - 1 AS x, b / lag(b) OVER (ORDER BY month) - 1 AS y FROM ser WHERE name = 'equity_bond'), rk0 AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS k FROM ret WHERE x IS NOT NULL),
co AS (SELECT CASE WHEN count(*) FILTER (k <= 6) = 6 THEN corr(x, y) FILTER (k <= 6) END AS c6, CASE WHEN count(*) FILTER (k <= 12) = 12 THEN corr(x, y) FILTER (k <= 12) END AS c12 FROM rk0),
cg AS (SELECT *, CASE WHEN c6 IS NULL THEN 'unknown' WHEN c6 < -0.3 THEN 'negative_strong' WHEN c6 < 0 THEN 'negative_mild' WHEN c6 < 0.3 THEN 'near_zero' ELSE 'positive' END AS kind, coalesce(CASE WHEN (c6 > 0) <> (c12 > 0) THEN 20 WHEN abs(c6 - c12) > 0.3 THEN 10 END, 0)::BIGINT AS bonus FROM co)"""
_add("a28_equity_bond_correlation", _correlation, f"WITH {_MAC}, {_COR} SELECT kind AS correlation_regime, bonus, round(c6, 3) AS correlation_6m, round(c12, 3) AS correlation_12m FROM cg")
_add("a29_macro_regime", lambda s, d: macro.regime(macro.components(_series(s, d).select("name", "month", "value")), _correlation(s, d)), f"""WITH {_MAC}, {_COR},
    dd AS (SELECT list(direction ORDER BY name) AS l, max(direction) FILTER (name = 'concentration') AS co, max(direction) FILTER (name = 'yield_curve') AS yc, max(direction) FILTER (name = 'credit_conditions') AS cr, max(direction) FILTER (name = 'size_factor') AS sz, max(direction) FILTER (name = 'equity_bond') AS eb, max(direction) FILTER (name = 'sector_rotation') AS sr, count(*) AS av FROM comp),
    sc0 AS (SELECT name, CASE name WHEN 'equity_bond' THEN least(100, score + bonus) ELSE score END AS score FROM comp, cg),
    ag AS (SELECT count(*) FILTER (score >= 40) AS sg, sum(score) / 6 AS ms, sum(score * CASE name {" ".join(f"WHEN '{n}' THEN {w}" for n, w in macro.WEIGHTS.items())} END) AS cp FROM sc0),
    pt AS (SELECT sg, ms, cp, av, 2 * coalesce((co = 'concentrating')::INT, 0) + 2 * coalesce((sz = 'large_cap_leading')::INT, 0) + coalesce((cr IN ('stable', 'easing'))::INT, 0) AS p1,
        2 * coalesce((co = 'broadening')::INT, 0) + 2 * coalesce((sz = 'small_cap_leading')::INT, 0) + coalesce((cr IN ('stable', 'easing'))::INT, 0) + coalesce((sr = 'risk_on')::INT, 0) + coalesce((yc = 'steepening')::INT, 0) AS p2,
        greatest(0, 2 * coalesce((cr = 'tightening')::INT, 0) + 2 * coalesce((sr = 'risk_off')::INT, 0) + coalesce((eb = 'risk_off')::INT, 0) + coalesce((yc = 'flattening')::INT, 0) - coalesce((sz = 'small_cap_leading')::INT, 0)) AS p3,
        CASE WHEN eb IS NULL THEN 0 WHEN kind = 'positive' THEN 3 WHEN kind = 'near_zero' THEN 1 ELSE 0 END + coalesce((eb = 'risk_off')::INT, 0) AS p4 FROM dd, ag, cg),
    so AS (SELECT *, list_reverse_sort([p1, p2, p3, p4]) AS o FROM pt), t AS (SELECT *, o[1] > 0 AND o[1] - o[2] <= 1 AS tied FROM so),
    u AS (SELECT *, NOT (tied AND cp < 50) AND sg >= 3 AND o[1] < 3 AS loose FROM t),
    v AS (SELECT *, CASE WHEN (tied AND cp < 50) OR loose THEN 'transitional' WHEN p1 = o[1] THEN 'concentration' WHEN p2 = o[1] THEN 'broadening' WHEN p3 = o[1] THEN 'contraction' ELSE 'inflationary' END AS regime, CASE WHEN loose THEN sg ELSE o[1] END AS best FROM u),
    w AS (SELECT *, CASE WHEN best >= 4 AND NOT tied THEN 'high' WHEN best >= 3 THEN 'moderate' WHEN best >= 2 THEN 'low' ELSE 'very_low' END AS c FROM v)
    SELECT regime, CASE WHEN av <= 3 THEN 'very_low' WHEN av <= 4 AND c IN ('high', 'moderate') THEN 'low' ELSE c END AS confidence, p1::BIGINT AS concentration_points, p2::BIGINT AS broadening_points, p3::BIGINT AS contraction_points, p4::BIGINT AS inflationary_points, sg AS signaling,
        CASE WHEN sg >= 4 AND ms >= 50 THEN 'high' WHEN sg >= 3 AND ms >= 40 THEN 'moderate' WHEN sg >= 2 AND ms >= 30 THEN 'low' ELSE 'minimal' END AS transition, round(ms, 1)::DOUBLE AS mean_score, tied AS ambiguous FROM w""")

_NAMES = sorted({x for up, down in macro.PHASES.values() for x in (*up, *down)})


def _sector_days(s: SparkSession, d: str) -> DataFrame:
    """Sectors are the nations' numbers of customers by month of orders: ratio = share of large orders, trend its sign."""
    names = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("c_nationkey") % len(_NAMES) + 1).cast("int"))
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("date"), names.alias("sector")).agg(F.avg(F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)).alias("ratio"), (F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)) > 0).alias("f"), (F.count("*") % 2 == 0).alias("even"))
    return rows.select("date", "sector", F.round("ratio", 6).alias("ratio"), F.when(F.col("even"), "Up").otherwise("Down").alias("trend"))


_SEC = f"""sd AS (SELECT strftime(o_orderdate, '%Y-%m') AS date, [{", ".join(f"'{n}'" for n in _NAMES)}][c_nationkey % {len(_NAMES)} + 1] AS sector, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio, CASE WHEN count(*) % 2 = 0 THEN 'up' ELSE 'down' END AS trend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
_add("a25_cycle_phase", lambda s, d: macro.cycle_phase(_sector_days(s, d)), f"""WITH {_SEC}, ph AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {i}, '{role}', '{x}', {len(side)})" for i, (p, sides) in enumerate(macro.PHASES.items()) for role, side in zip(("up", "down"), sides, strict=True) for x in side)}) v(phase, place, role, sector, size)),
    k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ratio DESC, sector) AS k, count(*) OVER (PARTITION BY date) // 2 AS h FROM sd),
    s AS (SELECT date, phase, place, round(100 * (sum(CASE WHEN role = 'up' AND k <= h + 1 THEN 0.4::DOUBLE / size WHEN role = 'down' AND k > h THEN 0.3::DOUBLE / size ELSE 0 END) + 0.3::DOUBLE * avg(CASE WHEN trend = role THEN 1.0::DOUBLE ELSE 0 END)), 1) AS score FROM k JOIN ph USING (sector) GROUP BY ALL),
    o AS (SELECT *, lead(score) OVER w AS nx, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY date ORDER BY score DESC, place))
    SELECT date, phase, CASE WHEN score - nx > 20 THEN 'high' WHEN score - nx > 10 THEN 'moderate' ELSE 'low' END AS confidence, score FROM o WHERE r = 1""")
_add("w48_uptrend_level", lambda s, d: macro.uptrend_level(_sector_days(s, d).withColumn("slope", F.col("ratio") - 0.4)).select("date", "sector", "score"), f"""WITH {_SEC} SELECT date, sector, round_even(least(100, greatest(0, CASE WHEN ratio >= 0.5 THEN least(100, 90 + (ratio - 0.5) * 100) WHEN ratio >= 0.37 THEN 70 + (ratio - 0.37) / 0.13::DOUBLE * 19 WHEN ratio >= 0.25 THEN 40 + (ratio - 0.25) / 0.12::DOUBLE * 29
    WHEN ratio >= 0.097 THEN 10 + (ratio - 0.097) / 0.153::DOUBLE * 29 ELSE ratio / 0.097::DOUBLE * 9 END + CASE WHEN trend = 'up' AND ratio > 0.4 THEN 5 WHEN trend = 'down' AND ratio < 0.4 THEN -5 ELSE 0 END)), 0)::BIGINT AS score FROM sd""")
_add("a27_leader_deterioration", lambda s, d: macro.leader_deterioration(bars(s, d)), f"""WITH {BARS}, m AS (SELECT symbol, date, close, high, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, max(high) OVER y AS top, CASE WHEN count(*) OVER a = 20 THEN avg(close) OVER a END AS m20, CASE WHEN count(*) OVER b = 50 THEN avg(close) OVER b END AS m50, CASE WHEN count(*) OVER c = 200 THEN avg(close) OVER c END AS m200,
        high > lag(high) OVER w AND high > lead(high) OVER w AS sw FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), c AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)),
    h AS (SELECT symbol, list(high ORDER BY i DESC) AS hs FROM m WHERE sw AND i > n - 19 GROUP BY symbol), l AS (SELECT m.*, hs FROM m LEFT JOIN h USING (symbol) WHERE i = n),
    p AS (SELECT symbol, close / top AS near, least(100, CASE WHEN close / top - 1 <= -0.25 THEN 40 WHEN close / top - 1 <= -0.15 THEN 30 WHEN close / top - 1 <= -0.1 THEN 20 WHEN close / top - 1 <= -0.05 THEN 10 ELSE 0 END
        + CASE WHEN n >= 50 THEN CASE WHEN close < m50 THEN 20 ELSE 0 END + CASE WHEN n >= 200 THEN CASE WHEN close < m200 THEN 20 ELSE 0 END WHEN close < m50 * 0.95 THEN 10 ELSE 0 END WHEN n >= 20 AND close < m20 THEN 15 ELSE 0 END + CASE WHEN n >= 20 AND len(hs) >= 2 AND hs[1] < hs[2] THEN 20 ELSE 0 END) AS pts FROM l),
    b AS (SELECT * FROM p ORDER BY near DESC, symbol LIMIT 10), z AS (SELECT count(*) AS evaluated, count(*) FILTER (pts >= 50) AS deteriorating, avg(pts) AS mean FROM b)
    SELECT evaluated, deteriorating, round(mean, 1) AS mean, deteriorating >= 0.6::DOUBLE * evaluated AS amplified, round_even(CASE WHEN deteriorating >= 0.6::DOUBLE * evaluated THEN least(100, mean * 1.3) ELSE mean END, 0)::BIGINT AS score FROM z WHERE evaluated >= 5""")


def _ftd(s: SparkSession, d: str) -> DataFrame:
    """Strong days on rising volume."""
    b = bars(s, d)
    hit = (F.col("close") / F.lag("close").over(by()) > 1.3) & (F.col("volume") > F.lag("volume").over(by()))
    return b.withColumn("hit", hit).where("hit").select("symbol", "date")


_add("w45_post_ftd", lambda s, d: macro.post_ftd(bars(s, d), _ftd(s, d)), f"""WITH {BARS}, n AS (SELECT *, row_number() OVER w AS i, close / lag(close) OVER w > 1.3 AND volume > lag(volume) OVER w AS ftd, (close / lag(close) OVER w - 1) * 100 <= -0.2 AND volume > lag(volume) OVER w AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    x AS (SELECT a.symbol, a.date, count(*) FILTER (b.dd AND b.i <= a.i + 5) AS distribution_count, count(b.i) FILTER (b.i <= a.i + 5) AS days, min(b.i - a.i) FILTER (b.dd AND b.i <= a.i + 5) AS first_day, min(b.i - a.i) FILTER (b.close < a.low) AS invalid_after FROM n a LEFT JOIN n b ON b.symbol = a.symbol AND b.i > a.i WHERE a.ftd GROUP BY ALL)
    SELECT symbol, date, distribution_count, days, first_day, invalid_after, invalid_after IS NOT NULL AS invalidated FROM x""", ("date",))


def _pick(words: list[str | None], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def _holdings(s: SparkSession, d: str) -> DataFrame:
    """A customer is a holding: pays and flows from its orders in order of keys, texts from their comments' statuses."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    last = F.transform(F.slice("x", F.greatest(F.size("x") - 3, F.lit(1)), F.lit(4)), lambda e: e["o_totalprice"])
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_name", "c_mktsegment").join(o.select("k", last.alias("p")), "k")
    k, p = F.col("k"), F.col("p")
    end = F.element_at(p, -1)
    return rows.select(
        F.lower("c_name").alias("ticker"), _pick(["stock", "reit", "bdc", "etf"], k).alias("kind"), F.when(k % 11 != 0, end / 100000).alias("latest"), F.when(F.size(p) > 1, F.element_at(p, F.lit(-2)) / 100000).alias("prior"), (k % 97 == 0).alias("missing"),
        F.col("c_acctbal").alias("fcf"), (F.col("c_acctbal") + 100).alias("ffo"), F.when(k % 5 != 0, F.col("c_acctbal") - 200).alias("nii"), (end / 60).alias("dividends_paid"), F.transform(p, lambda v: v / 200000).alias("coverage"),
        p.alias("net_debt"), F.transform(p, lambda v: v / 60000).alias("interest_coverage"), F.lit(50.0).alias("buybacks"), F.array(F.col("c_mktsegment"), F.when(k % 13 == 0, "Notice of NON-RELIANCE on statements")).alias("filings"),
        (F.col("c_acctbal") - 1000).alias("revenue_cagr"), _pick(["up", "down", None], k).alias("margin"), _pick(["Down", "flat"], k).alias("guidance"), (k % 3 == 0).alias("stalled"),
        (k % 31 == 0).alias("cut"), (k % 37 == 0).alias("variable"), (k % 17 == 0).alias("freeze"), (k % 19 == 0).alias("special"))


_add("a46_dividend_triggers", lambda s, d: reviews.dividend_triggers(_holdings(s, d)), """WITH o AS (SELECT o_custkey AS k, (list(o_totalprice ORDER BY o_orderkey))[-4:] AS p FROM orders GROUP BY 1), h AS (SELECT c_custkey AS k, c_name, c_acctbal AS b, p, p[-1] AS e, p[-2] AS e2, p[-3] AS e3 FROM customer JOIN o ON k = c_custkey),
    c AS (SELECT *, CASE k % 4 WHEN 1 THEN b + 100 WHEN 2 THEN CASE WHEN k % 5 <> 0 THEN b - 200 END ELSE b END AS base, e / 60 AS paid FROM h), n AS (SELECT *, CASE WHEN base > 0 THEN paid / base END AS now FROM c),
    t AS (SELECT k, c_name, CASE WHEN k % 97 = 0 OR (k % 11 <> 0 AND len(p) > 1 AND e / 100000 < e2 / 100000 * 0.99::DOUBLE) THEN 'REVIEW' END AS t1,
        CASE WHEN base <= 0 AND paid > 0 THEN 'REVIEW' WHEN e / 200000 > 1 AND e2 / 200000 > 1 THEN 'REVIEW' WHEN now > 1 AND e / 200000 > 1 THEN 'REVIEW' WHEN now > 1 THEN 'WARN' WHEN e / 200000 > 0.8::DOUBLE AND e / 200000 > e2 / 200000 THEN 'WARN' END AS t2,
        coalesce(e3 < e2 AND e2 < e, false) AS up, coalesce(e / 60000 < e2 / 60000, false) AS fall, e / 60000 < 2.5 AS weak, b > 0 AND 50 + paid > b * 1.1::DOUBLE AS stretch, k % 13 = 0 AS t4,
        (b - 1000 < 0)::INT + (k % 3 = 1)::INT + (k % 2 = 0)::INT + (k % 3 = 0)::INT AS dn, CASE WHEN k % 31 = 0 OR k % 37 = 0 THEN 'REVIEW' WHEN k % 17 = 0 OR k % 19 = 0 THEN 'WARN' END AS t6 FROM n),
    u AS (SELECT c_name, list_filter(['T1:' || t1, 'T2:' || t2, 'T3:' || CASE WHEN up AND (fall OR weak OR stretch) THEN 'REVIEW' WHEN up OR (fall AND weak) THEN 'WARN' END, 'T4:' || CASE WHEN t4 THEN 'REVIEW' END, 'T5:' || CASE WHEN dn >= 3 THEN 'REVIEW' WHEN dn = 2 THEN 'WARN' END, 'T6:' || t6], lambda z: z IS NOT NULL) AS f FROM t),
    w AS (SELECT upper(c_name) AS ticker, CASE WHEN len(list_filter(f, lambda z: z LIKE '%REVIEW')) > 0 THEN 'REVIEW' WHEN len(f) > 0 THEN 'WARN' ELSE 'OK' END AS status, array_to_string(f, ',') AS findings FROM u)
    SELECT *, CASE status WHEN 'REVIEW' THEN 'pause_buy_adds,create_review_ticket,human_read_full_disclosure' WHEN 'WARN' THEN 'pause_buy_adds_optional,append_next_earnings_checklist' ELSE '' END AS actions FROM w""")


def _payers(s: SparkSession, d: str) -> DataFrame:
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return table(s, d, "supplier").select(
        F.col("s_suppkey").alias("ticker"), _pick(["Technology", "Banks", " utilities", "Insurance", None], k).alias("sector"), (F.abs(b) / 2000).alias("dividend"), F.when(k % 7 != 0, b / 1500).alias("gaap_eps"), F.when(k % 6 != 0, b / 1500 + k % 5).alias("adjusted_eps"),
        F.when(k % 8 != 0, b / 1200).alias("fcf_per_share"), (k % 23 == 0).alias("merged"), F.when(k % 4 != 0, F.lit(11.0)).alias("cet1"), F.when(k % 9 != 0, F.lit(0.2)).alias("cre"), _pick(["stable", "Deteriorating", None], k).alias("npl"), _pick(["stable", None], k).alias("nco"), (k % 10 / 10).alias("deposit_beta"),
        F.when(k % 12 != 0, k % 25 / 100).alias("ffo_debt"), _pick(["fine", "adverse", "fine", "fine"], k).alias("rate_case"), _pick(["low", "HIGH", "low"], k).alias("issuance"), _pick(["flat", "falling", "flat", "flat", "flat"], k).alias("roe_trend"),
        F.when(k % 5 != 4, 0.9 + k % 20 / 100).alias("combined_ratio"), _pick(["fine", "fine", "adverse", None], k).alias("reserves"), _pick(["strong", "weak", "strong"], k).alias("statutory"))


_PAY = """x AS (SELECT s_suppkey AS k, s_acctbal AS b, CASE s_suppkey % 5 WHEN 1 THEN 'bank' WHEN 2 THEN 'utility' WHEN 3 THEN 'insurer' ELSE 'consumer' END AS kind, abs(s_acctbal) / 2000 AS dv, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 1500 END AS ge, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal / 1500 + s_suppkey % 5 END AS ae, CASE WHEN s_suppkey % 8 <> 0 THEN s_acctbal / 1200 END AS fe FROM supplier),
    r AS (SELECT *, dv / nullif(ge, 0) AS g, dv / nullif(ae, 0) AS a, dv / nullif(fe, 0) AS f, k % 23 = 0 AND ae IS NULL AS mg, coalesce(abs(ge - ae) / abs(nullif(ae, 0)) > 0.25, false) AS ov FROM x),
    v AS (SELECT *, CASE WHEN mg THEN 'HOLD-REVIEW'
        WHEN kind = 'bank' THEN CASE WHEN g > 0.85 THEN 'FAIL' WHEN k % 4 = 0 OR k % 9 = 0 OR k % 3 = 1 OR k % 10 / 10 > 0.5 THEN 'CAUTION' ELSE 'PASS' END
        WHEN kind = 'utility' THEN CASE WHEN g > 1 THEN 'FAIL' WHEN k % 4 = 1 THEN 'HOLD-REVIEW' WHEN k % 12 = 0 OR k % 25 / 100 < 0.13::DOUBLE OR k % 5 = 1 OR k % 3 = 1 THEN 'CAUTION' ELSE 'PASS' END
        WHEN kind = 'insurer' THEN CASE WHEN coalesce(a, g) > 0.85 THEN 'FAIL' WHEN k % 4 = 2 OR k % 3 = 1 THEN 'HOLD-REVIEW' WHEN 0.9::DOUBLE + k % 20 / 100 > 1 THEN 'CAUTION' ELSE 'PASS' END
        ELSE CASE WHEN f > 1 OR a > 0.85 THEN 'FAIL' WHEN ae IS NULL THEN 'HOLD-REVIEW' WHEN a > 0.7 OR f > 0.8 THEN 'CAUTION' ELSE 'PASS' END END AS safety,
        array_to_string(list_sort(list_filter([CASE WHEN ov THEN 'gaap_adjusted_divergence_gt_25pct' END, CASE WHEN mg OR (kind = 'consumer' AND ae IS NULL) THEN 'adjusted_eps_unavailable' END, CASE WHEN NOT mg AND kind = 'bank' AND k % 4 = 0 THEN 'bank_capital_unavailable' END, CASE WHEN NOT mg AND kind = 'bank' AND k % 9 = 0 THEN 'bank_cre_concentration_unavailable' END,
            CASE WHEN NOT mg AND kind = 'bank' AND k % 3 = 1 THEN 'bank_npl_nco_deteriorating' END, CASE WHEN NOT mg AND kind = 'utility' AND k % 12 = 0 THEN 'utility_ffo_debt_unavailable' END, CASE WHEN NOT mg AND kind = 'utility' AND k % 12 <> 0 AND k % 25 / 100 < 0.13::DOUBLE THEN 'utility_ffo_debt_weak' END, CASE WHEN NOT mg AND kind = 'utility' AND k % 4 = 1 THEN 'utility_rate_case_adverse' END,
            CASE WHEN NOT mg AND kind = 'insurer' AND k % 4 = 2 THEN 'insurer_reserve_development_adverse' END], lambda z: z IS NOT NULL)), ',') AS blockers FROM r)"""
_add("a47_payout_safety", lambda s, d: reviews.payout_safety(_payers(s, d)), f"WITH {_PAY} SELECT k AS ticker, kind, safety, blockers, round(g, 4) AS gaap_payout, round(a, 4) AS adj_payout, round(f, 4) AS fcf_payout FROM v")


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    """Safety of suppliers, events from their lines as deals, verdict."""
    p = F.col("l_extendedprice")
    deals = table(s, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), p.alias("tx_value"), F.lit(1e6).alias("market_cap"), (F.col("l_discount") * 100).alias("issuance_pct"), F.lit(0.0).alias("leverage_delta"), F.lit(False).alias("control"), F.lit(None).cast("string").alias("structure"), F.lit(None).cast("string").alias("policy"), (p * 1.45).alias("rolling"))
    deals = deals.withColumn("issuance_pct", F.when(F.col("issuance_pct") > 11, F.lit(None)).otherwise(F.col("issuance_pct") / 2))
    rows = reviews.payout_safety(_payers(s, d)).join(reviews.structural_event(deals), "ticker", "left")
    cap, blocked = reviews.event_cap(F.col("result"), F.col("ticker") % 2 == 0)
    step = _pick(["STEP1-PASS", "HOLD-REVIEW", "STEP1-PASS", "STEP1-RECHECK", "STEP1-PASS", "FAIL"], F.col("ticker"))
    return rows.select("ticker", F.coalesce("result", F.lit("NONE")).alias("result"), reviews.final_verdict(step, F.col("safety"), cap, F.col("blockers") != "").alias("verdict"), blocked.alias("blocked"))


_add("a47_final_verdict", _verdicts, f"""WITH {_PAY}, e AS (SELECT l_suppkey AS k, max((l_extendedprice / 1e6 > 0.1 OR l_extendedprice * 1.45 / 1e6 > 0.15)::INT) AS m FROM lineitem GROUP BY 1),
    q AS (SELECT v.k, safety, blockers, CASE m WHEN 1 THEN 'MAJOR_EVENT' WHEN 0 THEN 'CLEAN_CONFIRMED' ELSE 'NONE' END AS result, ['STEP1-PASS', 'HOLD-REVIEW', 'STEP1-PASS', 'STEP1-RECHECK', 'STEP1-PASS', 'FAIL'][v.k % 6 + 1] AS st FROM v LEFT JOIN e ON e.k = v.k)
    SELECT k AS ticker, result, CASE WHEN st = 'FAIL' OR safety = 'FAIL' THEN 'FAIL' WHEN st = 'STEP1-RECHECK' THEN 'STEP1-RECHECK' WHEN result = 'MAJOR_EVENT' OR (result = 'NONE' AND k % 2 = 0) OR safety = 'HOLD-REVIEW' THEN 'HOLD-REVIEW'
        WHEN st = 'HOLD-REVIEW' THEN CASE WHEN safety = 'PASS' AND blockers = '' THEN 'CONDITIONAL-PASS' ELSE 'HOLD-REVIEW' END WHEN safety = 'CAUTION' OR blockers <> '' THEN 'PASS-CAUTION' ELSE 'CLEAN-PASS' END AS verdict, result <> 'CLEAN_CONFIRMED' AS blocked FROM q""")


def _trades(s: SparkSession, d: str) -> DataFrame:
    """An order is a trade, its lines the evidence; its least supplier chooses the journal."""
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("trade_id")).agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("disc"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("losses"), F.element_at(F.array(*map(F.lit, ("AIR", "MAIL", "RAIL", "SHIP"))), (F.min("l_suppkey") % 4 + 1).cast("int")).alias("mode"), F.max("l_linenumber").alias("n"))
    k = F.col("trade_id")
    return li.select(
        "trade_id", F.when(k % 9 != 0, k % 4 != 0).alias("thesis_recorded"), F.when(k % 2 == 0, k % 10 != 0).alias("setup_confirmed"), (k % 13 == 0).alias("early_entry"), F.when(F.col("mode") == "AIR", "Cash_Priority").otherwise("open").alias("regime"), (k % 29 == 0).alias("against_regime"),
        (k % 6 == 0).alias("stop_moved"), (k % 12 == 0).alias("stop_planned"), (k % 14 == 0).alias("premature_exit"), F.lit(None).cast("boolean").alias("hesitated"), F.when(k % 15 != 0, F.col("q") / 100).alias("actual_r"), F.lit(1.0).alias("planned_r"), F.when(k % 3 == 0, F.lit(1.2)).alias("max_r"),
        F.col("n").cast("double").alias("heat"), F.lit(6.0).alias("max_heat"), F.col("losses").cast("double").alias("losses"), F.when(F.col("mode") == "MAIL", "Had to make it back after that").when(F.col("mode") == "RAIL", "I froze").when(F.col("disc") > 0.09, "Easy money").alias("journal"))


_add("a50_trade_review", lambda s, d: reviews.trade_review(_trades(s, d)), """WITH l AS (SELECT l_orderkey AS k, sum(l_quantity) / 100 AS r, max(l_discount) AS dc, count(*) FILTER (l_returnflag = 'R') AS ls, ['AIR', 'MAIL', 'RAIL', 'SHIP'][min(l_suppkey) % 4 + 1] AS md, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT *, k % 13 = 0 AS early, k % 6 = 0 AS mv, k % 12 = 0 AS pl, CASE WHEN k % 3 = 0 THEN 1.2::DOUBLE ELSE 1 END AS lim, k % 15 <> 0 AS known, CASE md WHEN 'MAIL' THEN 'm' WHEN 'RAIL' THEN 'r' ELSE CASE WHEN dc > 0.09 THEN 'e' END END AS j FROM l),
    p AS (SELECT *, (early OR k % 10 = 0)::INT + (k % 29 = 0 OR md = 'AIR')::INT + (mv AND NOT pl)::INT AS pc, (k % 9 = 0 OR k % 4 = 0)::INT AS pw, (known AND r > lim * 1.25)::INT + (n > 6)::INT + (ls >= 4)::INT AS nc, (NOT known OR (r > lim AND r <= lim * 1.25))::INT + (n <= 6 AND n > 5.4)::INT + (ls = 3)::INT AS nw, early::INT + (mv AND NOT pl)::INT AS ec, (mv AND pl)::INT + (k % 14 = 0)::INT AS ew FROM f),
    t AS (SELECT *, list_filter([CASE WHEN early THEN 'fomo_entry' END, CASE WHEN j = 'm' THEN 'revenge_trade' END, CASE WHEN k % 14 = 0 THEN 'premature_exit' END, CASE WHEN j = 'e' THEN 'overconfidence_after_winner' END, CASE WHEN mv AND NOT pl THEN 'stop_moved' END, CASE WHEN known AND r > lim THEN 'size_creep' END, CASE WHEN NOT known THEN 'unknown_size_discipline' END,
        CASE WHEN j = 'r' THEN 'hesitation' END, CASE WHEN pc + pw >= 3 THEN 'rule_drift' END], lambda z: z IS NOT NULL) AS g FROM p)
    SELECT k AS trade_id, (pc + nc + ec)::BIGINT AS criticals, (pw + nw + ew)::BIGINT AS warnings, greatest(0, 100 - 30 * pc - 15 * pw)::BIGINT AS score, CASE WHEN len(g) = 0 THEN 'no_pattern_detected' ELSE array_to_string(g, ',') END AS tags,
        CASE WHEN pc + nc + ec >= 2 OR (j = 'm' AND ls >= 2) OR ls >= 4 THEN 'COOL_DOWN' WHEN pc + nc + ec >= 1 THEN 'RULE_VIOLATION' WHEN pw + nw + ew > 0 THEN 'REVIEW_REQUIRED' ELSE 'OK' END AS verdict FROM t""")


_LIN = "greatest(0, least(100, coalesce(({x} - {lo}) / {n} * 100, 0)))"


def _lin(x: str, lo: float, hi: float) -> str:
    return _LIN.format(x=x, lo=lo, n=hi - lo)


_PARTS = list(parabolic.WEIGHTS)
_add("h17_parabolic_screen", lambda s, d: parabolic.parabolic_screen(bars(s, d), earnings(s, d)), f"""WITH {BARS}, a AS (SELECT *, row_number() OVER w AS i, close / lag(close) OVER w - 1 AS r, coalesce(close > lag(close) OVER w, false) AS g, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, high >= max(high) OVER y AS tp FROM bars
        WINDOW w AS (PARTITION BY symbol ORDER BY date), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
    b AS (SELECT *, sum((NOT g)::INT) OVER w AS run, CASE WHEN count(r) OVER f3 = 3 THEN avg(r) OVER f3 END AS q3, CASE WHEN count(r) OVER f10 = 10 THEN avg(r) OVER f10 END AS q10, close / lag(close, 3) OVER w - 1 AS r3, close / lag(close, 5) OVER w - 1 AS r5, CASE WHEN count(*) OVER f20 = 20 THEN avg(close) OVER f20 END AS m20, CASE WHEN count(tr) OVER f14 = 14 THEN avg(tr) OVER f14 END AS atr,
        avg(tr) OVER f5 AS t5, CASE WHEN count(tr) OVER g20 = 20 THEN avg(tr) OVER g20 END AS tb, avg(close * volume) OVER f20 AS adv, CASE WHEN count(*) OVER p20 = 20 THEN avg(volume) OVER p20 END AS pv, bool_or(tp) OVER f2 AS ah FROM a
        WINDOW w AS (PARTITION BY symbol ORDER BY date), f2 AS (PARTITION BY symbol ORDER BY date ROWS 1 PRECEDING), f3 AS (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING), f5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), f10 AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING), f14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING),
        f20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), p20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), g20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING)),
    c AS (SELECT *, sum(g::INT) OVER (PARTITION BY symbol, run ORDER BY date) AS green FROM b),
    ev AS (SELECT c.symbol, c.date, max(e.date) FILTER (e.date <= c.date) AS le, min(e.date) FILTER (e.date > c.date) AS ne FROM c LEFT JOIN earn e ON e.symbol = c.symbol GROUP BY 1, 2),
    s AS (SELECT c.*, le, ne, round(0.5 * {_lin("(close / m20 - 1) * 100", 20, 120)} + 0.5 * {_lin("CASE WHEN atr > 0 THEN (close - m20) / atr END", 3, 10)}, 9) AS ma_extension,
        round(0.4::DOUBLE * {_lin("r5 * 100", 20, 100)} + 0.2::DOUBLE * {_lin("green", 2, 5)} + 0.2::DOUBLE * {_lin("CASE WHEN q10 <> 0 THEN q3 / q10 END", 1, 2)} + 0.2::DOUBLE * {_lin("r3 * 100", 10, 50)}, 9) AS acceleration,
        round({_lin("CASE WHEN pv > 0 THEN volume / pv END", 1.5, 5)}, 9) AS volume_climax, round({_lin("CASE WHEN tb > 0 THEN t5 / tb END", 1.2, 3)}, 9) AS range_expansion, round(CASE WHEN adv > 0 THEN greatest(0, least(10, (log10(adv) - 7) / 1.5 * 10)) * 10 ELSE 0 END, 9) AS liquidity FROM c JOIN ev ON ev.symbol = c.symbol AND ev.date = c.date),
    t AS (SELECT *, round({" + ".join(f"{k} * {w}::DOUBLE" for k, w in parabolic.WEIGHTS.items())}, 1) AS score, [{", ".join(_PARTS)}] AS l, coalesce(high > low AND (close - low) / (high - low) >= 0.8::DOUBLE, false) AS st,
        coalesce(5 * floor((date - DATE '1969-12-29') / 7) + least(((date - DATE '1969-12-29') % 7) + 1, 5) - 5 * floor((le - DATE '1969-12-29') / 7) - least(((le - DATE '1969-12-29') % 7) + 1, 5) <= 5, false) AS rc FROM s)
    SELECT symbol, date, {", ".join(f"round({k}, 4)::DOUBLE AS {k}" for k in _PARTS)}, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade, {_PARTS}[list_position(l, list_min(l))] AS weakest, {_PARTS}[list_position(l, list_max(l))] AS strongest,
        CASE WHEN st AND ah THEN 'still_in_markup' END AS state_cap, concat_ws(',', CASE WHEN st AND NOT ah AND pv > 0 AND volume / pv >= 2 THEN 'too_early_to_short' END, CASE WHEN rc THEN 'recent_earnings_catalyst' END) AS warnings, coalesce(ne - date <= 2, false) AS blackout FROM t""", ("date",))


def _plans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A user watches a kind of event on every day from the first one on; a day's state is known where there were events."""
    ev = table(s, d, "events").select(F.to_date("ts").alias("session"), F.col("event_type").alias("ticker"), (F.col("user_id") % 50).alias("u"), "value")
    end = ev.agg(F.max("session")).first()[0]  # one date
    first = ev.groupBy(F.concat_ws("/", "u", "ticker").alias("plan_id"), "ticker").agg(F.min("session").alias("first"))
    plans = first.select("plan_id", "ticker", F.explode(F.sequence("first", F.lit(end))).alias("session"))
    states = ev.groupBy(F.concat_ws("/", "u", "ticker").alias("plan_id"), "session").agg(F.when(F.max("value") > 190, "triggered").otherwise("armed").alias("state"))
    return plans, states, ev.where("value > 100").groupBy("ticker", "session").agg(F.count("*").alias("n"), F.max("value").alias("top")).where("top > 150").select("ticker", "session")


_add("t07_no_bars", lambda s, d: parabolic.carry_forward(*_plans(s, d)), """WITH ev AS (SELECT CAST(ts AS DATE) AS session, event_type AS ticker, user_id % 50 AS u, value FROM events), p AS (SELECT u || '/' || ticker AS plan_id, ticker, CAST(unnest(generate_series(min(session), (SELECT max(session) FROM ev), INTERVAL 1 DAY)) AS DATE) AS session FROM ev GROUP BY u, ticker),
    st AS (SELECT u || '/' || ticker AS plan_id, session, CASE WHEN max(value) > 190 THEN 'triggered' ELSE 'armed' END AS state FROM ev GROUP BY 1, 2), b AS (SELECT ticker, session FROM ev WHERE value > 100 GROUP BY 1, 2 HAVING max(value) > 150),
    l AS (SELECT p.plan_id, p.session, arg_max(state, s.session) FILTER (s.session < p.session) AS prior, max(state) FILTER (s.session = p.session) AS cur FROM p LEFT JOIN st s ON s.plan_id = p.plan_id AND s.session <= p.session GROUP BY 1, 2)
    SELECT p.plan_id, p.ticker, p.session, CASE WHEN b.session IS NOT NULL THEN coalesce(cur, 'armed') ELSE coalesce(prior, 'armed') END AS state, CASE WHEN b.session IS NOT NULL THEN 'ok' ELSE 'no_bars' END AS status FROM p JOIN l ON l.plan_id = p.plan_id AND l.session = p.session LEFT JOIN b ON b.ticker = p.ticker AND b.session = p.session""", ("session",))


def _day_ranges(s: SparkSession, d: str) -> DataFrame:
    """Mean of the true ranges of up to 14 earlier sessions; null in the first two."""
    w = Window.partitionBy("ticker").orderBy("session")
    days = intraday(s, d).groupBy("ticker", "session").agg((F.max("h") - F.min("l")).alias("r"))
    before = w.rowsBetween(-14, -1)
    return days.select("ticker", "session", F.when(F.count("r").over(before) >= 2, F.avg("r").over(before)).alias("atr_14"))


_add("t02_opening_status", lambda s, d: live.opening_status(intraday(s, d), _day_ranges(s, d), "UTC+9:30"), f"""WITH {INTRADAY}, f AS (SELECT ticker, session, min(ts) AS first, row_number() OVER (PARTITION BY ticker ORDER BY session) AS k FROM intraday GROUP BY ticker, session)
    SELECT ticker, session, CASE WHEN k <= 2 THEN 'atr_14_unavailable' WHEN strftime(first + INTERVAL 570 MINUTE, '%H:%M') <> '09:30' THEN 'opening_range_bar_unavailable' END AS skip_reason FROM f""", ("session",))
Q["t02_orl_monitor"] = lambda s, d: rounded(live.orl_monitor(intraday(s, d), _day_ranges(s, d), "UTC+9:30"))


def _growth(s: SparkSession, d: str) -> DataFrame:
    """Components of each brand: newness of its bars, sponsorship of its lines' suppliers, others from its lines."""
    b = bars(s, d)
    lines = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("symbol"))
    own = lines.agg(F.countDistinct("l_suppkey").alias("h"), (F.avg(F.when(F.col("l_returnflag") == "N", 100.0).otherwise(0.0))).alias("share"), F.max(F.col("l_suppkey") == 7).alias("named"), F.avg("l_quantity").alias("q"), F.sum("l_linenumber").alias("lines"), F.avg(F.when(F.col("l_linestatus") == "O", 100.0).otherwise(0.0)).alias("o"))
    rows = own.join(growth.newness(b), "symbol")
    return rows.select("symbol", F.round(F.col("q") * 3, 6).alias("C"), F.round(F.col("o") + 20, 6).alias("A"), "N", (F.col("lines") % 101).alias("S"), (F.col("lines") % 97).alias("L"), growth.sponsorship(F.col("h"), F.round("share", 6), F.col("named")).alias("I"), F.when(F.col("lines") % 5 != 0, 80).otherwise(0).alias("M"))


_add("a41_growth_composite", lambda s, d: growth.growth_composite(_growth(s, d)), f"""WITH {BARS}, t AS (SELECT symbol, date, close, volume, max(high) OVER y AS top, avg(volume) OVER v AS mean FROM bars WINDOW y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), v AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
    u AS (SELECT symbol, round((close / top - 1) * 100, 9) AS f, close >= top * 0.995::DOUBLE AND volume > mean * 1.4::DOUBLE AS b FROM t), nn AS (SELECT symbol, CASE WHEN f >= -5 AND b THEN 100 WHEN f >= -10 AND b THEN 80 WHEN f >= -15 OR b THEN 60 WHEN f >= -25 THEN 40 ELSE 20 END AS "N" FROM u),
    w AS (SELECT p_brand AS symbol, count(DISTINCT l_suppkey) AS h, round(avg(CASE WHEN l_returnflag = 'N' THEN 100.0::DOUBLE ELSE 0 END), 6) AS sh, bool_or(l_suppkey = 7) AS nm, avg(l_quantity) AS q, sum(l_linenumber) AS ln, avg(CASE WHEN l_linestatus = 'O' THEN 100.0::DOUBLE ELSE 0 END) AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    i AS (SELECT *, CASE WHEN h BETWEEN 50 AND 100 AND sh BETWEEN 30 AND 60 THEN 100 WHEN nm AND h BETWEEN 30 AND 150 THEN 90 WHEN (h >= 30 AND h < 50 AND sh BETWEEN 20 AND 40) OR (h > 100 AND h <= 150 AND sh BETWEEN 40 AND 70) THEN 80 WHEN (h >= 20 AND h < 30 AND sh BETWEEN 20 AND 50) OR (h BETWEEN 50 AND 150 AND sh BETWEEN 20 AND 70) THEN 60
        WHEN sh < 10 OR sh > 90 THEN 20 WHEN sh < 20 OR sh > 80 THEN 40 ELSE 50 END AS b FROM w),
    c AS (SELECT symbol, round(q * 3, 6) AS "C", round(o + 20, 6) AS "A", "N", ln % 101 AS "S", ln % 97 AS "L", least(100, b + CASE WHEN nm THEN 10 ELSE 0 END) AS "I", CASE WHEN ln % 5 <> 0 THEN 80 ELSE 0 END AS "M" FROM i JOIN nn USING (symbol)),
    s AS (SELECT *, {" + ".join(f'"{c}" * {w}::DOUBLE' for c, w in growth.WEIGHTS.items())} AS x, ["C", "A", "N", "S", "L", "I", "M"] AS lst, list_filter([{", ".join(f"""CASE WHEN "{c}" < {v} THEN '{c}' END""" for c, v in growth.LEAST.items())}], lambda z: z IS NOT NULL) AS f FROM c)
    SELECT symbol, round(x, 1) AS composite, CASE WHEN round(x, 9) >= 90 THEN 'Exceptional+' WHEN round(x, 9) >= 80 THEN 'Exceptional' WHEN round(x, 9) >= 70 THEN 'Strong' WHEN round(x, 9) >= 60 THEN 'Above Average' WHEN round(x, 9) >= 50 THEN 'Average' WHEN round(x, 9) >= 40 THEN 'Below Average' ELSE 'Weak' END AS rating,
        ['C', 'A', 'N', 'S', 'L', 'I', 'M'][list_position(lst, list_min(lst))] AS weakest, array_to_string(f, ',') AS failed, CASE WHEN "M" = 0 OR "L" < 40 OR len(f) > 1 THEN 'avoid' WHEN len(f) = 1 THEN 'watchlist' ELSE 'buy' END AS advice FROM s""")
