"""Market tables derived from the trade tables, and the same derivations as SQL for comparison.

symbol = brand, date = ship date, a tick's price = extended price / quantity. Ticks are ordered by their keys; open and
close are the first and last tick of a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candles(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Open, high, low, close and volume by keys, from ticks of price and size."""
    at = F.struct(*order)
    return ticks.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date"), price.alias("price"), F.col("l_quantity").alias("size"), F.col("p_type").alias("sector"), "l_returnflag", *_ORDER
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume."""
    return candles(ticks(spark, sf_dir), ["symbol", "date"], _ORDER)


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by supplier (symbol), dated by the week's Monday."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    rows = lines.select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), *_ORDER)
    return candles(rows, ["symbol", "date"], _ORDER)


def benchmark(panel: DataFrame) -> DataFrame:
    """date, bench: the equal-weight mean close."""
    return panel.groupBy("date").agg(F.avg("close").alias("bench"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, timing: days with a seventh line; the least flag of a day gives its timing."""
    rows = ticks(spark, sf_dir).where("l_linenumber = 7").groupBy("symbol", "date").agg(F.min("l_returnflag").alias("flag"))
    return rows.select("symbol", "date", F.when(F.col("flag") == "A", "bmo").when(F.col("flag") == "N", "amc").otherwise("unknown").alias("timing"))


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of events: ticker, session, ts, o, h, l, c, v."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.window("ts", "5 minutes")["start"].alias("ts"), F.col("value").alias("price"), F.lit(1).alias("size"), "event_id", F.col("ts").alias("at"))
    out = candles(rows, ["ticker", "ts"], ["at", "event_id"])
    return out.select("ticker", F.to_date("ts").alias("session"), "ts", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("long").alias("v"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with outcomes from orders: producer = priority, regime = status, return from the price's last digits."""
    o = table(spark, sf_dir, "orders")
    ret = (F.pmod(F.floor(F.col("o_totalprice") * 100), F.lit(1001)) - 500) / 10000.0
    return o.select(
        F.col("o_orderkey").alias("signal_id"), F.col("o_orderpriority").alias("skill"), F.col("o_orderstatus").alias("regime"), F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), ret.alias("ret5"),
        F.when(F.col("o_custkey") % 7 == 0, "P").otherwise(F.col("o_orderstatus")).alias("regime_now"), F.col("o_totalprice").alias("raw"),
    )


BARS = """ticks AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS size, p_type AS sector,
        l_returnflag, l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
bars AS (SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume FROM ticks GROUP BY symbol, date),
bench AS (SELECT date, avg(close) AS bench FROM bars GROUP BY date),
earn AS (SELECT symbol, date, CASE min(l_returnflag) WHEN 'A' THEN 'bmo' WHEN 'N' THEN 'amc' ELSE 'unknown' END AS timing FROM ticks WHERE l_linenumber = 7 GROUP BY symbol, date)"""
WIDE = """wide AS (SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS size,
        (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem WHERE l_quantity > 0) GROUP BY symbol, date)"""
OUTCOMES = """outcomes AS (SELECT o_orderkey AS signal_id, o_orderpriority AS skill, o_orderstatus AS regime, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, (CAST(floor(o_totalprice * 100) AS BIGINT) % 1001 - 500) / 10000.0 AS ret5,
    CASE WHEN o_custkey % 7 = 0 THEN 'P' ELSE o_orderstatus END AS regime_now, o_totalprice AS raw FROM orders)"""
INTRADAY = """intraday AS (SELECT event_type AS ticker, CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS DATE) AS session, time_bucket(INTERVAL 5 MINUTE, ts) AS ts,
    arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, count(*) AS v FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """For comparison between engines: doubles rounded, whole numbers long, dates as text."""

    def plain(c: str, t: str) -> Column:
        if t == "double":
            return F.round(c, digits).alias(c)
        return F.col(c).cast({"int": "long", "date": "string"}[t]).alias(c) if t in ("int", "date") else F.col(c)

    return df.select(*[plain(c, t) for c, t in df.dtypes])


def dates_as_text(sql: str, names: tuple[str, ...]) -> str:
    """The same of a query's date columns."""
    if not names:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'CAST({n} AS VARCHAR) AS {n}' for n in names)}) FROM ({sql})"
