"""Queries of industries and themes, with SQL. Industries are part names, themes the words of a name, sectors part types,
stocks brands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.jobs.tables import BARS, bars, rounded, table
from tapeworks.operators import screens
from tapeworks.operators import themes as t
from tapeworks.operators.features import by, frame, full

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    SQL[name] = sql


_PERF = {"perf_1w": 5, "perf_1m": 21, "perf_3m": 63, "perf_6m": 126, "perf_1y": 252}


def _named(s: SparkSession, d: str) -> DataFrame:
    """Ticks with their part's name."""
    lines = table(s, d, "lineitem").where("l_quantity > 0").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("p_name").alias("name"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"))


def industries(s: SparkSession, d: str) -> DataFrame:
    """name and percent changes of each part name's mean price up to its last day."""
    days = _named(s, d).groupBy("name", "date").agg(F.avg("price").alias("close"))
    w = Window.partitionBy("name").orderBy("date")
    days = days.select("name", *[((F.col("close") / F.lag("close", n).over(w) - 1) * 100).alias(c) for c, n in _PERF.items()], F.row_number().over(Window.partitionBy("name").orderBy(F.desc("date"))).alias("k"))
    return days.where("k = 1").drop("k")


_IND = f"""{BARS}, nt AS (SELECT p_name AS name, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
days AS (SELECT name, date, avg(price) AS close FROM nt GROUP BY 1, 2),
ind AS (SELECT name, {", ".join(f"(close / lag(close, {n}) OVER w - 1) * 100 AS {c}" for c, n in _PERF.items())} FROM days WINDOW w AS (PARTITION BY name ORDER BY date)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY date DESC) = 1),
wr AS (SELECT *, 0.1::DOUBLE * coalesce(perf_1w, 0) + 0.25::DOUBLE * coalesce(perf_1m, 0) + 0.35::DOUBLE * coalesce(perf_3m, 0) + 0.3::DOUBLE * coalesce(perf_6m, 0) AS w FROM ind),
rk AS (SELECT name, w, round(100 / (1 + exp(-0.15::DOUBLE * (abs(w) - 5))), 2) AS score FROM wr),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS rank, count(*) OVER () AS n FROM rk)"""
_add("k03_rank_industries", lambda s, d: t.rank_industries(industries(s, d)).select("name", "weighted_return", "momentum_score", "direction", "rank", "rank_direction"),
     f"""WITH {_IND} SELECT name, round(w, 4) AS weighted_return, score AS momentum_score, CASE WHEN w > 0 THEN 'bullish' ELSE 'bearish' END AS direction, rank, CASE WHEN rank <= n // 2 THEN 'bullish' ELSE 'bearish' END AS rank_direction FROM ranked""")


def _signals(s: SparkSession, d: str) -> DataFrame:
    up = F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0)
    rows = bars(s, d).withColumn("up", up)
    ratio = F.when(F.count("up").over(frame(10)) == 10, F.avg("up").over(frame(10)))
    return rows.select("symbol", "date", t.volume_intensity(full(F.avg("volume"), "volume", 20), full(F.avg("volume"), "volume", 60)).alias("volume_intensity"), t.breadth_signal(ratio, F.floor(F.col("volume") / 10)).alias("breadth_signal"))


_add("f04_theme_signals", _signals, f"""WITH {BARS}, x AS (SELECT *, CASE WHEN count(*) OVER a = 20 THEN avg(volume) OVER a END AS v20, CASE WHEN count(*) OVER b = 60 THEN avg(volume) OVER b END AS v60,
    CASE WHEN count(*) OVER c = 10 THEN avg(CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0 END) OVER c END AS r FROM bars
    WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), c AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING))
    SELECT symbol, CAST(date AS VARCHAR) AS date, round(CASE WHEN v20 IS NULL OR v60 IS NULL THEN 50 ELSE least(100, sqrt(greatest(0, v20 / v60 - 0.8::DOUBLE)) / sqrt(1.2) * 100) END, 6)::DOUBLE AS volume_intensity,
    round(CASE WHEN r IS NULL THEN 50 ELSE least(100, pow(r, 2.5) * 80 + least(20, floor(volume / 10) * 2)) END, 6)::DOUBLE AS breadth_signal FROM x""")


def _stocks(s: SparkSession, d: str) -> DataFrame:
    """Last row of each brand: symbol, rsi (simple 14-bar), distances from the year's extremes, pe, and trend figures."""
    b = bars(s, d).withColumn("chg", F.col("close") - F.lag("close").over(by()))
    up, down = (F.sum(F.greatest(F.lit(0.0), sign * F.col("chg"))).over(frame(14)) for sign in (1, -1))
    rows = b.select("symbol", "date", "close", (100 * up / F.nullif(up + down, F.lit(0.0))).alias("rsi"), (1 - F.col("close") / F.max("high").over(frame(252))).alias("dist_high"), (F.col("close") / F.min("low").over(frame(252)) - 1).alias("dist_low"),
                    F.avg("close").over(frame(20)).alias("m20"), F.avg("close").over(frame(50)).alias("m50"), (F.col("close") / F.lag("close", 5).over(by()) - 1).alias("slope"))
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("k = 1")
    paid = table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg((F.avg("p_retailprice") / 60).alias("pe"))
    return last.join(paid, "symbol").drop("k", "date")


def _theme_inputs(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    parts = table(s, d, "part")
    ind = industries(s, d)
    members = ind.select("name", F.explode(F.split("name", " ")).alias("theme"))
    side = members.join(t.rank_industries(ind).select("name", "rank_direction"), "name").groupBy("theme").agg(F.when(F.sum(F.when(F.col("rank_direction") == "bullish", 1).otherwise(-1)) > 0, "bullish").otherwise("bearish").alias("direction"))
    volume = _named(s, d).select(F.explode(F.split("name", " ")).alias("theme"), "date", "size").groupBy("theme", "date").agg(F.sum("size").alias("v"))
    w = Window.partitionBy("theme").orderBy("date")
    volume = volume.select("theme", F.avg("v").over(w.rowsBetween(-19, 0)).alias("vol_20d"), F.avg("v").over(w.rowsBetween(-59, 0)).alias("vol_60d"), F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("date"))).alias("k")).where("k = 1").drop("k")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("theme"), F.col("p_brand").alias("symbol"), "p_type")
    funds = words.groupBy("theme").agg((F.count("*") % 13).alias("funds"))
    stocks = _stocks(s, d)
    held = words.select("theme", "symbol").distinct().join(stocks, "symbol").select("theme", "rsi", "dist_high", "dist_low", "pe")
    maker = parts.select("p_type", F.col("p_brand").alias("symbol")).distinct().join(stocks, "symbol").groupBy("p_type").agg(
        F.avg(F.when(F.col("close") > F.col("m20"), 1.0).otherwise(0.0)).alias("ratio"), F.avg(F.when(F.col("close") > F.col("m50"), 1.0).otherwise(0.0)).alias("ma_10"), F.avg("slope").alias("slope"))
    sectors = words.groupBy("theme", "p_type").agg(F.count("*").cast("double").alias("weight")).join(maker, "p_type").drop("p_type")
    return side.join(volume, "theme").join(funds, "theme"), members, ind, held, sectors


_LAST = """st0 AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS chg FROM bars),
st AS (SELECT symbol, close, 100 * sum(greatest(0, chg)) OVER f / nullif(sum(greatest(0, chg)) OVER f + sum(greatest(0, -chg)) OVER f, 0) AS rsi, 1 - close / max(high) OVER y AS dist_high, close / min(low) OVER y - 1 AS dist_low,
    avg(close) OVER a AS m20, avg(close) OVER b AS m50, close / lag(close, 5) OVER w - 1 AS slope FROM st0
    WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), w AS (PARTITION BY symbol ORDER BY date)
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
words AS (SELECT unnest(string_split(p_name, ' ')) AS theme, p_brand AS symbol, p_type, p_retailprice FROM part),
pe AS (SELECT p_brand AS symbol, avg(p_retailprice) / 60 AS pe FROM part GROUP BY 1)"""
_add("a30_theme_heat", lambda s, d: t.theme_scores(*_theme_inputs(s, d)), f"""WITH {_IND}, {_LAST},
mem AS (SELECT name, unnest(string_split(name, ' ')) AS theme FROM ind),
side AS (SELECT theme, CASE WHEN sum(CASE WHEN rank <= n // 2 THEN 1 ELSE -1 END) > 0 THEN 'bullish' ELSE 'bearish' END AS direction FROM mem JOIN ranked USING (name) GROUP BY theme),
v1 AS (SELECT theme, date, sum(size) AS v FROM (SELECT unnest(string_split(name, ' ')) AS theme, date, size FROM nt) GROUP BY ALL),
v2 AS (SELECT theme, avg(v) OVER (PARTITION BY theme ORDER BY date ROWS 19 PRECEDING) / avg(v) OVER (PARTITION BY theme ORDER BY date ROWS 59 PRECEDING) AS ratio FROM v1 QUALIFY row_number() OVER (PARTITION BY theme ORDER BY date DESC) = 1),
fu AS (SELECT theme, count(*) % 13 AS funds FROM words GROUP BY theme),
m1 AS (SELECT theme, count(*) AS n, avg(round(w, 4)) AS mean, avg(CASE WHEN (direction = 'bearish' AND round(w, 4) < 0) OR (direction = 'bullish' AND round(w, 4) > 0) THEN 1.0::DOUBLE ELSE 0 END) AS ratio, avg(perf_1m) AS a, avg(perf_3m) AS b, avg(perf_6m) AS c, avg(perf_1y) AS e FROM mem JOIN wr USING (name) JOIN side USING (theme) GROUP BY theme),
h1 AS (SELECT theme, direction, rsi, CASE direction WHEN 'bearish' THEN dist_low ELSE dist_high END AS near, pe FROM (SELECT DISTINCT theme, symbol FROM words) JOIN st USING (symbol) JOIN pe USING (symbol) JOIN side USING (theme)),
h2 AS (SELECT theme, coalesce(least(100, 200.0::DOUBLE * count(*) FILTER ((direction = 'bearish' AND rsi < 30) OR (direction = 'bullish' AND rsi > 70)) / nullif(count(rsi), 0)), 50) AS ex, coalesce(least(100, 200.0::DOUBLE * count(*) FILTER (near <= 0.05) / nullif(count(near), 0)), 50) AS px,
    CASE WHEN count(*) FILTER (pe > 0) >= 3 THEN least(100, greatest(0, (median(pe) FILTER (pe > 0) / 22 - 0.5) * 32)) ELSE 50 END AS va FROM h1 GROUP BY theme),
mk AS (SELECT p_type, avg(CASE WHEN close > m20 THEN 1.0::DOUBLE ELSE 0 END) AS r, avg(CASE WHEN close > m50 THEN 1.0::DOUBLE ELSE 0 END) AS m, avg(slope) AS s FROM (SELECT DISTINCT p_type, p_brand AS symbol FROM part) JOIN st USING (symbol) GROUP BY p_type),
u1 AS (SELECT theme, sum(k * (least(80, r * 100) + CASE WHEN r > m THEN 10 ELSE 0 END + CASE WHEN s > 0 THEN 10 ELSE 0 END)) / sum(k) AS up FROM (SELECT theme, p_type, count(*) AS k FROM words GROUP BY ALL) JOIN mk USING (p_type) GROUP BY theme),
p AS (SELECT theme, direction, 100 / (1 + exp(-2 * (ln(1 + abs(mean)) - ln(16)))) AS momentum, least(100, sqrt(greatest(0, v2.ratio - 0.8::DOUBLE)) / sqrt(1.2) * 100) AS volume, CASE direction WHEN 'bearish' THEN 100 - up ELSE up END AS uptrend,
    least(100, pow(m1.ratio, 2.5) * 80 + least(20, n * 2)) AS breadth, 25.0::DOUBLE * list_sum([CASE WHEN (direction = 'bearish' AND z < -2) OR (direction = 'bullish' AND z > 2) THEN 1 ELSE 0 END FOR z IN [a, b, c, e]]) AS duration, ex AS extremity, px AS price_extreme, va AS valuation,
    CASE WHEN funds = 0 THEN 0 WHEN funds = 1 THEN 20 WHEN funds <= 3 THEN 40 WHEN funds <= 6 THEN 60 WHEN funds <= 10 THEN 80 ELSE 100 END AS funds FROM side JOIN m1 USING (theme) JOIN h2 USING (theme) JOIN v2 USING (theme) JOIN fu USING (theme) JOIN u1 USING (theme)),
q AS (SELECT *, momentum * 0.35 + volume * 0.2 + uptrend * 0.25 + breadth * 0.2 AS heat, duration * 0.25 + extremity * 0.25 + price_extreme * 0.25 + valuation * 0.15 + funds * 0.1 AS maturity FROM p)
SELECT theme, direction, {", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in ("momentum", "volume", "uptrend", "breadth", "duration", "extremity", "price_extreme", "valuation", "funds", "heat", "maturity"))},
    CASE WHEN maturity < 20 THEN 'Emerging' WHEN maturity < 40 THEN 'Accelerating' WHEN maturity < 60 THEN 'Trending' WHEN maturity < 80 THEN 'Mature' ELSE 'Exhausting' END AS stage,
    CASE WHEN abs(momentum - uptrend) >= 25 THEN CASE WHEN momentum > uptrend THEN 'narrow_rally' ELSE 'internal_recovery' END END AS divergence FROM q""")

_FUNDS = {"PROMO": "XLP", "ECONOMY": "XLE", "SMALL": "XLK", "MEDIUM": "XLI", "LARGE": "XLF", "STANDARD": "XLU"}


def _theme_sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Themes by the last word of a name (seed), by brand (vertical) and by size (discovered), over part names."""
    p = table(s, d, "part").select("p_brand", "p_size", F.col("p_name").alias("name"), F.col("p_type").alias("sector"), F.element_at(F.split("p_name", " "), -1).alias("word"))
    seed = p.where("p_size > 10").withColumn("theme", F.concat(F.lit("seed "), "word")).withColumn("origin", F.lit("seed"))
    vert = p.where("p_size > 40").withColumn("theme", F.concat(F.lit("vert "), "p_brand")).withColumn("origin", F.lit("vertical"))
    found = p.where("p_size < 10").withColumn("theme", F.concat(F.lit("disc "), F.col("p_size").cast("string"))).withColumn("origin", F.lit("discovered"))
    rows = seed.unionByName(vert).unionByName(found)
    themes = rows.groupBy("theme", "origin").agg(F.when(F.sum("p_size") % 2 == 0, "bullish").otherwise("bearish").alias("direction"), F.when(F.col("origin") == "seed", F.concat(F.lit("F"), F.substring("theme", 6, 3))).alias("funds"))
    return themes, rows.select("theme", "name", "sector").distinct()


_add("j21_theme_overlap", lambda s, d: t.overlap_dedup(*_theme_sets(s, d), _FUNDS), f"""WITH a AS (
    SELECT 'seed ' || string_split(p_name, ' ')[-1] AS theme, 'seed' AS origin, p_name AS name, p_type AS sector, p_size FROM part WHERE p_size > 10
    UNION ALL SELECT 'vert ' || p_brand, 'vertical', p_name, p_type, p_size FROM part WHERE p_size > 40
    UNION ALL SELECT 'disc ' || p_size, 'discovered', p_name, p_type, p_size FROM part WHERE p_size < 10),
t AS (SELECT theme, origin, CASE WHEN sum(p_size) % 2 = 0 THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN origin = 'seed' THEN 'F' || substr(theme, 6, 3) END AS funds, count(DISTINCT name) AS size FROM a GROUP BY theme, origin),
m AS (SELECT DISTINCT theme, name, sector FROM a),
pr AS (SELECT x.theme, y.theme AS other, count(*) AS c FROM (SELECT DISTINCT theme, name FROM m) x JOIN (SELECT DISTINCT theme, name FROM m) y ON x.name = y.name AND x.theme <> y.theme GROUP BY ALL),
j AS (SELECT pr.theme, other, c, t.origin, t.direction AS d1, o.direction AS d2, o.funds AS f2, c / least(t.size, o.size) AS ov, c / (t.size + o.size - c) AS ja FROM pr JOIN t ON t.theme = pr.theme JOIN t o ON o.theme = other
    WHERE (t.origin = 'vertical' AND o.origin = 'seed') OR (t.origin = 'discovered' AND o.origin <> 'discovered')),
g AS (SELECT DISTINCT theme FROM j WHERE d1 = d2 AND (ov >= 0.5 OR (origin = 'discovered' AND ja >= 0.5))),
b AS (SELECT theme, max(ov) AS ov, arg_max(f2, (ov, other)) AS f2 FROM j WHERE origin = 'vertical' GROUP BY theme),
mn AS (SELECT theme, arg_max(sector, (n, sector)) AS main FROM (SELECT theme, sector, count(*) AS n FROM m GROUP BY ALL) GROUP BY theme)
SELECT t.theme, origin, direction, CASE WHEN origin = 'vertical' THEN CASE WHEN ov >= 0.5 THEN f2 ELSE CASE main {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FUNDS.items())} END END ELSE funds END AS funds
FROM t LEFT JOIN b ON b.theme = t.theme LEFT JOIN mn ON mn.theme = t.theme WHERE t.theme NOT IN (SELECT theme FROM g)""")


# Clusters of customers by balance in each nation, with the size of their orders as vector, and of part names by return.
def _balances(s: SparkSession, d: str) -> DataFrame:
    sums = table(s, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_order"), F.count("*").cast("double").alias("orders"))
    rows = table(s, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_nationkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"), "c_acctbal", "mean_order", "orders")


_CLUSTERS = """r AS (SELECT *, {gap} AS g, {dist} AS dist FROM (SELECT *, {lags} FROM base {spans} WINDOW w AS ({part} ORDER BY {value} DESC, name))),
y AS (SELECT *, sum(CASE WHEN g <= {most} AND sqrt(dist) <= 0.5::DOUBLE THEN 0 ELSE 1 END) OVER ({part} ORDER BY {value} DESC, name ROWS UNBOUNDED PRECEDING) AS cluster FROM r),
ws AS (SELECT *, row_number() OVER () AS nth FROM (SELECT {key}cluster, {value} AS v, name, unnest(string_split(name, ' ')) AS word, unnest(range(1, len(string_split(name, ' ')) + 1)) AS i FROM y)),
wc AS (SELECT {key}cluster, trim(word, '(),') AS word, count(*) AS c, min(struct_pack(v := -v, name := name, i := i)) AS f FROM ws WHERE trim(word, '(),') NOT IN ('', {stop}) GROUP BY ALL),
wn AS (SELECT {key}cluster, string_agg(word, ' & ' ORDER BY k) AS label FROM (SELECT *, row_number() OVER (PARTITION BY {key}cluster ORDER BY c DESC, f) AS k FROM wc) WHERE k <= 2 GROUP BY {key}cluster)
SELECT {out}CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(avg({value}), 6) AS mean, coalesce(any_value(label) || ' Related', 'Unknown Cluster') AS label FROM y LEFT JOIN wn USING ({key}cluster) GROUP BY {key}cluster HAVING count(*) >= 2"""


def _clusters_sql(value: str, vector: list[str], group: str, most: float) -> str:
    part = f"PARTITION BY {group}" if group else ""
    return _CLUSTERS.format(
        value=value, part=part, most=f"{most}::DOUBLE", key=f"{group}, " if group else "", out=f"{group}, " if group else "", stop=", ".join(f"'{x}'" for x in screens.STOP_WORDS), gap=f"abs({value} - p_{value})",
        lags=", ".join([*(f"lag({c}) OVER w AS p_{c}" for c in dict.fromkeys([value, *vector])), *(f"max({c}) OVER ({part}) - min({c}) OVER ({part}) AS r_{c}" for c in vector)]), spans="",
        dist=" + ".join(f"CASE WHEN r_{c} > 0 THEN pow(({c} - p_{c}) / r_{c}, 2) ELSE 0 END" for c in vector),
    )


Q["h14_discover_clusters"] = lambda s, d: rounded(screens.discover_clusters(_balances(s, d), ["c_nationkey"], "c_acctbal", "name", ["mean_order", "orders"], 150.0))
SQL["h14_discover_clusters"] = f"""WITH base AS (SELECT c_nationkey, c_mktsegment || ' ' || c_name AS name, c_acctbal, coalesce(avg(o_totalprice), 0) AS mean_order, count(o_orderkey)::DOUBLE AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL), {_clusters_sql("c_acctbal", ["mean_order", "orders"], "c_nationkey", 150.0)}"""
Q["h14_industry_clusters"] = lambda s, d: rounded(screens.discover_clusters(t.rank_industries(industries(s, d)), [], "weighted_return", "name", ["perf_1w", "perf_1m", "perf_3m"], 25.0))
SQL["h14_industry_clusters"] = f"""WITH {_IND}, base AS (SELECT name, round(w, 4) AS weighted_return, coalesce(perf_1w, 0) AS perf_1w, coalesce(perf_1m, 0) AS perf_1m, coalesce(perf_3m, 0) AS perf_3m FROM wr), {_clusters_sql("weighted_return", ["perf_1w", "perf_1m", "perf_3m"], "", 25.0)}"""
