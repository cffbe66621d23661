"""Readers, writers and checks of bars and other inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import trading_days_between
from tapeworks.operators.textchecks import ERROR_WORDS

COLUMNS = ["symbol", "timestamp", "open", "high", "low", "close", "volume"]
#: Header names of exports, the preferred first, and date formats.
ALIASES = {
    "date": ("date", "datetime", "time", "trade date", "tradedate", "report_date", "day", "تاريخ", "اليوم"),
    "open": ("open", "o", "openprice", "open price", "افتتاح"), "high": ("high", "h", "highprice", "high price", "اعلى", "أعلى"), "low": ("low", "l", "lowprice", "low price", "ادنى", "أدنى"),
    "close": ("close", "current_close", "c", "closeprice", "close price", "last_price", "last", "ltp", "اغلاق", "إغلاق"),
    "volume": ("volume", "trade_volume", "vol", "qty", "quantity", "shares", "حجم", "الكمية"), "symbol": ("symbol", "ticker", "code", "company", "security", "name", "الرمز", "الشركة"),
}
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy", "dd-MMM-yyyy")


def clean_bars(raw: DataFrame) -> DataFrame:
    """Lower-case names, upper-case symbols, UTC time stamps; rows with a null are dropped; missing columns are an error."""
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    num = [F.col(c).try_cast("double").alias(c) for c in COLUMNS[2:]]
    rows = raw.select(F.upper(F.trim("symbol")).alias("symbol"), F.try_to_timestamp(F.col("timestamp").cast("string")).alias("ts"), *num).dropna()
    return rows.withColumn("date", F.to_date("ts"))


def load_bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_bars(spark.read.parquet(path))


def parse_date(text: Column) -> Column:
    """A date in one of the formats, with or without a time of day."""
    day = F.regexp_replace(F.trim(text), r"(T| +)\d{1,2}:.*$", "")
    return F.coalesce(*[F.try_to_date(day, f) for f in DATE_FORMATS])


def load_bars_csv(spark: SparkSession, path: str, default_symbol: str | None = None) -> DataFrame:
    """Exports with varying headers and date formats; blank volume is 0, bars without a trade are dropped."""
    raw = spark.read.option("header", True).csv(path)
    lower = {c.strip().lower(): c for c in reversed(raw.columns)}

    def pick(name: str) -> Column | None:
        found = next((lower[a] for a in ALIASES[name] if a in lower), None)
        return F.col(f"`{found}`") if found else None

    needed = {n: pick(n) for n in ("date", "open", "high", "low", "close")}
    if any(v is None for v in needed.values()):
        raise ValueError(f"no column for {[n for n, v in needed.items() if v is None]}")
    num = {n: F.regexp_replace(c, ",", "").cast("double") for n, c in needed.items() if n != "date"}
    volume, symbol = pick("volume"), pick("symbol")
    name = symbol if symbol is not None else F.lit(default_symbol) if default_symbol else F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    rows = raw.select(F.upper(F.trim(name)).alias("symbol"), parse_date(needed["date"]).alias("date"), *[c.alias(n) for n, c in num.items()], (F.coalesce(F.regexp_replace(volume, ",", "").try_cast("double"), F.lit(0.0)) if volume is not None else F.lit(0.0)).alias("volume"))
    return rows.where("least(open, high, low, close) > 0")


def flatten_price_json(rows: DataFrame) -> DataFrame:
    """Bars of rows (symbol, historical array of date, open, high, low, close, adjClose, volume); adjusted close first."""
    one = rows.select(F.upper("symbol").alias("symbol"), F.explode_outer("historical").alias("b")).where("b is not null")
    return one.select("symbol", F.try_to_date(F.col("b.date")).alias("date"), "b.open", "b.high", "b.low", F.coalesce("b.adjClose", "b.close").alias("close"), "b.volume")


def flatten_day_json(rows: DataFrame) -> DataFrame:
    """Bars of rows (date, sectors array of securities); non-numeric or non-positive closes are dropped."""
    one = rows.select("date", F.explode("sectors").alias("s")).select("date", F.explode("s.securities").alias("x"))
    num = [F.col(f"x.{c}").try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return one.select(F.col("x.symbol").alias("symbol"), F.try_to_date(F.col("date")).alias("date"), *num).where("close > 0")


def load_flagged_csv(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """Typed columns (date, double, int, boolean: true / 1 / yes) of a CSV; rows without a date are skipped; '' is null."""
    raw = spark.read.option("header", True).csv(path)

    def typed(name: str, kind: str) -> Column:
        x = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        if kind == "boolean":
            return F.lower(x).isin("true", "1", "yes").alias(name)
        if kind == "date":
            return F.try_to_date(x).alias(name)
        return (x.try_cast("double").cast("int") if kind == "int" else x.try_cast(kind)).alias(name)

    rows = raw.select(*[typed(n, k) for n, k in kinds.items()])
    dates = [n for n, k in kinds.items() if k == "date"]
    return rows.dropna(subset=dates) if dates else rows


def load_session_logs(spark: SparkSession, path: str) -> DataFrame:
    """type, timestamp, role, text of JSON lines; malformed lines and side chains are skipped; content text or blocks."""
    schema = "type string, timestamp string, isSidechain boolean, message struct<role: string, content: string>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("x")).where("x.type is not null and not coalesce(x.isSidechain, false)")
    blocks = F.from_json("x.message.content", "array<struct<type: string, text: string>>")
    text = F.when(F.col("x.message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("x.message.content"))
    return rows.select("x.type", "x.timestamp", F.col("x.message.role").alias("role"), text.alias("text"))


#: Fixed value: characters kept of a tool's error output.
ERROR_OUTPUT = 500


def load_session_calls(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, kind, name, output of JSON lines: tool_use blocks of assistant entries, and tool_error for tool results that
    are marked as errors or whose text has an error word. Malformed lines and side chains are skipped."""
    schema = "type string, timestamp string, isSidechain boolean, is_error boolean, message struct<role: string, content: string, isSidechain: boolean, is_error: boolean>"
    off = lambda c: F.coalesce(c, F.lit(False))
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("x")).where("x.type is not null").select("x.*")
    rows = rows.where(~off(F.col("isSidechain")) & ~off(F.col("message.isSidechain"))).withColumn("content", F.col("message.content"))
    blocks = F.when((F.col("type") == "assistant") & F.col("content").startswith("["), F.from_json("content", "array<struct<type: string, name: string>>"))
    uses = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(F.lit("tool_use").alias("kind"), F.coalesce(b["name"], F.lit("")).alias("name"), F.lit(None).cast("string").alias("output")))
    failed = off(F.col("is_error")) | off(F.col("message.is_error")) | off(F.lower("content").rlike("|".join(ERROR_WORDS)))
    error = F.struct(F.lit("tool_error").alias("kind"), F.lit("__tool_result_error__").alias("name"), F.substring("content", 1, ERROR_OUTPUT).alias("output"))
    found = F.when(F.col("type") == "tool_result", F.when(failed, F.array(error))).otherwise(uses)
    return rows.select("timestamp", F.explode(found).alias("c")).select("timestamp", "c.*")


def write_partitioned(df: DataFrame, path: str, by: str = "symbol", form: str = "parquet") -> None:
    """One folder per value; rows of a value meet in few files first. form: parquet, csv (with a header) or json."""
    out = df.repartition(by).write.mode("overwrite").partitionBy(by)
    (out.option("header", True) if form == "csv" else out).format(form).save(path)


def dedupe_bars(bars: DataFrame, arrival: str, keep: str = "first") -> DataFrame:
    """One bar per symbol and date: the first or the last to arrive."""
    order = F.asc(arrival) if keep == "first" else F.desc(arrival)
    return bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(order))).where("_n = 1").drop("_n")


def audit_bars(bars: DataFrame, gap_days: int = 3) -> DataFrame:
    """One row per problem of a bar: invalid close, invalid volume, a calendar gap before it."""
    bars = bars.withColumn("_gap", F.datediff("date", F.lag("date").over(Window.partitionBy("symbol").orderBy("date"))))
    found = F.array_compact(F.array(F.when(F.col("close").isNull() | (F.col("close") <= 0), "invalid_close"), F.when(F.col("volume").isNull() | (F.col("volume") < 0), "invalid_volume"), F.when(F.col("_gap") > gap_days, "gap")))
    return bars.select("symbol", "date", F.explode(found).alias("problem"))


def upsert_history(history: DataFrame, new: DataFrame, key: str, day: str, keep: int = 20) -> DataFrame:
    """New rows replace those of their date; the newest `keep` dates of each key stay."""
    both = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy(key, day).orderBy(F.desc("_new")))).where("_n = 1")
    return one.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day)))).where(F.col("_k") <= keep).drop("_n", "_k", "_new")


def freshness(df: DataFrame, source: str, as_of: str, limit: int = 5) -> DataFrame:
    """Latest date of each source, its age in days, and whether it is stale."""
    out = df.groupBy(source).agg(F.max("date").alias("latest"))
    age = F.datediff(F.lit(as_of).cast("date"), "latest")
    return out.select(source, "latest", age.alias("age"), (age > limit).alias("is_stale"))


def weekday_freshness(df: DataFrame, source: str, as_of: str, limit: int = 2) -> DataFrame:
    """The same by Mondays to Fridays since the latest date; a source without dates is stale."""
    out = df.groupBy(source).agg(F.max("date").alias("latest"))
    age = trading_days_between(F.col("latest"), F.lit(as_of).cast("date"))
    return out.select(source, "latest", F.when(F.col("latest").isNotNull(), age).alias("age"), (F.col("latest").isNull() | (age > limit)).alias("is_stale"))
