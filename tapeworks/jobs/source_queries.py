"""Readers and writers over derived tables: each query writes a table in a source's format into shared storage, reads it
back and returns what the reader made of it; and the hint boost and error mentions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.tables import BARS, bars, dates_as_text, rounded, table
from tapeworks.operators import regime, textchecks
from tapeworks.sources import bars as src

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, dates: tuple[str, ...] = ("date",)) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    SQL[name] = dates_as_text(sql, dates)


def _place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared storage that the cluster names, below the warehouse where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_BARS = f"WITH {BARS} SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"
_PICK = ["symbol", "date", "open", "high", "low", "close", "volume"]


def _parquet(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "bars-parquet")
    bars(s, d).select(F.concat(F.lit(" "), F.lower("symbol")).alias("Symbol"), F.date_format("date", "yyyy-MM-dd").alias("Timestamp"), "open", "high", "low", "close", F.col("volume").cast("double").alias("Volume")).write.parquet(path)
    return src.load_bars_parquet(s, path).select(*_PICK)


_add("s01_load_bars_parquet", _parquet, _BARS.replace("SELECT symbol,", "SELECT upper(symbol) AS symbol,"))


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "bars-csv")
    rows = bars(s, d).select("*", F.when(F.dayofmonth("date") % 2 == 0, F.date_format("date", "dd-MMM-yyyy")).otherwise(F.date_format("date", "yyyy/MM/dd")).alias("day"))
    rows.select(F.col("day").alias("Trade Date"), F.col("symbol").alias("Code"), F.col("open").alias("Open Price"), F.col("high").alias("HighPrice"), F.col("low").alias("L"), (F.col("close") + 1).alias("Last_Price"), F.col("close").alias("Current_Close"), F.when(F.col("volume") > 10, F.col("volume")).alias("Qty")).write.option("header", True).csv(path)
    return src.load_bars_csv(s, path).select(*_PICK)


_add("s02_load_bars_csv", _csv, _BARS.replace("SELECT symbol,", "SELECT upper(symbol) AS symbol,").replace(" volume FROM bars", " CASE WHEN volume > 10 THEN volume ELSE 0 END AS volume FROM bars"))


def _nested(s: SparkSession, d: str) -> DataFrame:
    """A symbol's history as one record: the format's own shape, one year a record."""
    path = _place(s, "price-json")
    one = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "high", "low", (F.col("close") + 1).alias("close"), F.col("close").alias("adjClose"), "volume")
    bars(s, d).groupBy("symbol", F.year("date").alias("y")).agg(F.collect_list(one).alias("historical")).drop("y").write.json(path)
    return src.flatten_price_json(s.read.schema("symbol string, historical array<struct<date: string, open: double, high: double, low: double, close: double, adjClose: double, volume: double>>").json(path)).select(*_PICK)


_add("s03_flatten_price_json", _nested, _BARS.replace("SELECT symbol,", "SELECT upper(symbol) AS symbol,"))


def _days(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "day-json")
    text = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low")]
    one = F.struct("symbol", *text, F.when(F.col("volume") > 1, F.col("close").cast("string")).otherwise("n/a").alias("close"), F.col("volume").cast("string").alias("volume"))
    sector = bars(s, d).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), F.substring("symbol", -1, 1).alias("sector")).agg(F.collect_list(one).alias("securities"))
    sector.groupBy("date").agg(F.collect_list(F.struct("sector", "securities")).alias("sectors")).write.json(path)
    return src.flatten_day_json(s.read.schema("date string, sectors array<struct<sector: string, securities: array<struct<symbol: string, open: string, high: string, low: string, close: string, volume: string>>>>").json(path)).select(*_PICK)


_add("s04_flatten_day_json", _days, _BARS + " WHERE volume > 1")


def _breadth(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d).groupBy("date").agg(F.avg(F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0)).alias("index"), F.count("*").alias("n"), F.max("close").alias("top"))


def _flagged(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "breadth-csv")
    b = _breadth(s, d)
    b.select(F.date_format("date", "yyyy-MM-dd").alias("Date"), F.when(F.col("n") > 1, F.col("index").cast("string")).otherwise(" ").alias("Breadth"), F.when(F.col("n") % 2 == 0, "Yes").otherwise("no").alias("Is_Peak"), F.concat(F.col("n").cast("string"), F.lit(".0")).alias("Trend")).unionByName(
        s.sql("select '' as Date, '0.5' as Breadth, 'yes' as Is_Peak, '1' as Trend")).write.option("header", True).csv(path)
    return src.load_flagged_csv(s, path, {"Date": "date", "Breadth": "double", "Is_Peak": "boolean", "Trend": "int"}).withColumnsRenamed({"Date": "date", "Breadth": "breadth", "Is_Peak": "is_peak", "Trend": "trend"})


_ALL = f"WITH {BARS}, b AS (SELECT date, avg(CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0 END) AS i, count(*) AS n, max(close) AS top FROM bars GROUP BY date)"
_add("s05_load_breadth_csv", _flagged, f"{_ALL} SELECT date, round(CASE WHEN n > 1 THEN i END, 6) AS breadth, n % 2 = 0 AS is_peak, n AS trend FROM b")


def _uptrend(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "uptrend-csv")
    _breadth(s, d).select(F.lit("all").alias("worksheet"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("n").alias("count"), F.col("index").alias("ratio"), F.when(F.col("top") > 20000, "").otherwise(F.col("top").cast("string")).alias("slope")).write.option("header", True).csv(path)
    return src.load_flagged_csv(s, path, {"worksheet": "string", "date": "date", "count": "int", "ratio": "double", "slope": "double"})


_add("s06_load_uptrend_csv", _uptrend, f"{_ALL} SELECT 'all' AS worksheet, date, n AS count, round(i, 6) AS ratio, round(CASE WHEN top <= 20000 THEN top END, 6) AS slope FROM b")


def _logs(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "session-logs")
    c = table(s, d, "conversations")
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("x").alias("text"))))
    message = F.struct("role", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("said "), "text")).otherwise(block).alias("content"))
    lines = c.select(F.to_json(F.struct(F.col("role").alias("type"), F.concat_ws("/", "conv_id", "turn").alias("timestamp"), (F.col("turn") % 5 == 4).alias("isSidechain"), message.alias("message"))).alias("value"))
    lines.unionByName(s.sql("select '{broken' as value")).write.text(path)
    return src.load_session_logs(s, path)


_add("s07_load_session_logs", _logs, "SELECT role AS type, conv_id || '/' || turn AS timestamp, role, CASE WHEN turn % 2 = 0 THEN 'said ' || text ELSE text END AS text FROM conversations WHERE turn % 5 <> 4", ())


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Assistants' turns call a tool, system turns are failed results, some users' turns are results of their text."""
    path = _place(s, "session-calls")
    c = table(s, d, "conversations").where("role <> 'user' or turn % 4 = 2")
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.lit("x").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("tool"), F.col("turn") % 3).alias("name"))))
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("tool_result")
    message = F.struct("role", F.when(F.col("role") == "assistant", block).otherwise(F.col("text")).alias("content"))
    line = F.struct(kind.alias("type"), F.concat_ws("/", "conv_id", "turn").alias("timestamp"), (F.col("turn") % 5 == 4).alias("isSidechain"), F.when(F.col("role") == "system", True).alias("is_error"), message.alias("message"))
    c.select(F.to_json(line).alias("value")).unionByName(s.sql("select '{broken' as value")).write.text(path)
    return src.load_session_calls(s, path)


_add("s07_session_calls", _calls, f"""SELECT conv_id || '/' || turn AS timestamp, 'tool_use' AS kind, 'tool' || turn % 3 AS name, NULL::VARCHAR AS output FROM conversations WHERE role = 'assistant' AND turn % 5 <> 4
    UNION ALL SELECT conv_id || '/' || turn, 'tool_error', '__tool_result_error__', substr(text, 1, {src.ERROR_OUTPUT}) FROM conversations WHERE turn % 5 <> 4 AND (role = 'system' OR (role = 'user' AND turn % 4 = 2 AND regexp_matches(lower(text), 'error|exception|traceback|failed')))""", ())


def _partitioned(s: SparkSession, d: str, form: str = "parquet") -> DataFrame:
    path = _place(s, "bars-by-symbol")
    src.write_partitioned(bars(s, d), path, form=form)
    reader = s.read.schema(bars(s, d).schema)
    return (reader.option("header", True) if form == "csv" else reader).format(form).load(path).select(*_PICK)


_add("s08_write_partitioned", _partitioned, _BARS)
for _form in ("csv", "json"):
    _add(f"s08_write_{_form}", lambda s, d, form=_form: _partitioned(s, d, form), _BARS)


def _boost(s: SparkSession, d: str) -> DataFrame:
    """Hints of a type name the brands of its small parts; a type without any is a hint for all."""
    hints = table(s, d, "part").groupBy("p_type").agg(F.collect_set(F.when(F.col("p_size") < 3, F.col("p_brand"))).alias("symbols"))
    hints = hints.select(F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), "pivot_breakout").otherwise("gap_up_continuation").alias("family"), "symbols")
    return regime.hint_boost(bars(s, d).select("symbol").distinct(), hints, "pivot_breakout").select("symbol", "boost")


_add("j10_hint_boost", _boost, f"""WITH {BARS}, h AS (SELECT p_type, list(DISTINCT p_brand) FILTER (p_size < 3) AS l FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE') GROUP BY 1), g AS (SELECT count(*) AS n FROM h WHERE l IS NULL),
    k AS (SELECT symbol, count(*) AS c FROM (SELECT unnest(l) AS symbol FROM h) GROUP BY 1) SELECT b.symbol, least(20, coalesce(12 * c, 0) + 6 * n)::DOUBLE AS boost FROM (SELECT DISTINCT symbol FROM bars) b CROSS JOIN g LEFT JOIN k ON k.symbol = b.symbol""", ())
_WORDS = "|".join(textchecks.ERROR_WORDS)
_add("x07_error_mentions", lambda s, d: textchecks.error_mentions(table(s, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Error: "), "text")).otherwise(F.col("text")))).withColumn("samples", F.array_join("samples", "|")),
     f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Error: ' || text ELSE text END AS text FROM conversations), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c WHERE regexp_matches(lower(text), '{_WORDS}'))
    SELECT conv_id, count(*) AS n, string_agg(substr(text, 1, 200), '|' ORDER BY k) FILTER (k <= 5) AS samples FROM e GROUP BY conv_id""", ())
