"""Boundary cases of operators on small frames, folds against plain loops, stream against batch, no look-ahead."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import scalars as x
from tapeworks.jobs import signal_queries
from tapeworks.operators import features, folds, pairs, patterns, signals
from tapeworks.sources import bars as src
from tapeworks.streaming import intraday as live

START = dt.date(2024, 1, 1)


def panel(spark, closes, volumes=None, symbol="AAA"):
    volumes = volumes or [100.0] * len(closes)
    rows = [(symbol, START + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, v) for i, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize(("closes", "volumes", "n"), [([100.0, 99.80], [1.0, 2.0], 1), ([100.0, 99.81], [1.0, 2.0], 0), ([100.0, 99.0], [2.0, 2.0], 0)])
def test_distribution_day_boundaries(spark, closes, volumes, n):
    assert patterns.distribution_days(panel(spark, closes, volumes)).count() == n


def test_sma_is_null_until_full(spark):
    got = [r.sma_3 for r in features.sma(panel(spark, [1.0, 2.0, 3.0, 4.0]), 3).orderBy("date").collect()]
    assert got == [None, None, 2.0, 3.0]


def test_no_look_ahead(spark):
    rng = np.random.default_rng(1)
    closes = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150)))).tolist()
    whole = features.daily_features(panel(spark, closes), ma=(5, 10, 20), rs=10)
    part = features.daily_features(panel(spark, closes[:100]), ma=(5, 10, 20), rs=10)
    day = START + dt.timedelta(days=99)
    assert whole.where(F.col("date") == day).collect() == part.where(F.col("date") == day).collect()


def test_scalars(spark):
    row = spark.range(1).select(
        x.linear_score(F.lit(None).cast("double"), 0, 1).alias("a"), x.clamp(F.lit(7.0), 0, 5).alias("b"), x.horizon_bucket(F.lit("6M")).alias("c"), x.horizon_bucket(F.lit("3-6 months")).alias("d"),
        x.normalize_score(F.lit("b")).alias("e"), x.trading_days_between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-08").cast("date")).alias("f"), x.ticker_array(F.lit(" spy,,Qqq, SPY")).alias("g"),
        x.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("h"), x.sanitize_identifier(F.lit(" A--b! ")).alias("i"), x.cagr(F.lit(100.0), F.lit(133.1), 3).alias("j")).first()
    assert tuple(row) == (0.0, 5.0, "medium", "medium", 0.8, 1, ["QQQ", "SPY"], 0.5, "a_b", 10.0)


def test_rsi_and_ema():
    c = np.array([44, 44.3, 44.1, 43.6, 44.3, 44.8, 45.1, 45.4, 45.8, 46.1, 45.9, 46.2, 45.6, 46.3, 46.3, 46.0])
    got = folds.rsi(c, 14)
    d = np.diff(c[:15])
    g, b = d[d > 0].sum() / 14, -d[d < 0].sum() / 14
    assert np.isnan(got[13]) and got[14] == pytest.approx(100 - 100 / (1 + g / b))
    assert folds.rsi(np.arange(20.0))[-1] == 100
    e = folds.ema(np.array([1.0, 2, 3, 4]), 3)
    assert e[2] == pytest.approx(2) and e[3] == pytest.approx(3)
    assert folds.ema(np.array([1.0, 3]), 3, True)[1] == pytest.approx(2)


def test_unit_root():
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=500), np.cumsum(rng.normal(size=500))
    assert pairs.unit_root_p(pairs.adf_statistic(noise)) < 0.01
    assert pairs.unit_root_p(pairs.adf_statistic(walk)) > 0.05
    assert pairs.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.005)


def test_greedy_dedupe_compares_with_primaries_only(spark):
    rows = [("s1", "a", "LONG", 0.9, ["A", "B"]), ("s2", "a", "LONG", 0.8, ["B", "C"]), ("s3", "a", "LONG", 0.7, ["C", "D"]), ("s4", "a", "SHORT", 0.95, ["A", "B"]), ("s5", "a", "LONG", 0.6, [])]
    df = spark.createDataFrame(rows, "signal_ref string, skill string, direction string, raw_score double, tickers array<string>").withColumn("title", F.lit(""))
    got = {r.signal_ref: r.primary for r in signals.dedupe_signals(df).collect()}
    assert got == {"s1": "s1", "s2": "s1", "s3": "s3", "s4": "s4", "s5": "s5"}


@pytest.mark.parametrize(("n", "small"), [(450, 100_000), (8, 0)])
def test_dedupe_decides_long_chains(spark, n, small):
    """Each signal is similar to the next one only: every second one is a primary, however long the chain."""
    rows = [(f"s{i:04d}", "a", "LONG", 1 - i / 1000, [f"t{i}", f"t{i + 1}"], "") for i in range(n)]
    df = spark.createDataFrame(rows, "signal_ref string, skill string, direction string, raw_score double, tickers array<string>, title string")
    got = {r.signal_ref: r.primary for r in signals.dedupe_signals(df.union(df.limit(1)), small=small).collect()}
    assert got == {f"s{i:04d}": f"s{i - i % 2:04d}" for i in range(n)}


def test_audit_and_dedupe_bars(spark):
    df = spark.createDataFrame([("A", START, 1.0, 5.0, 1), ("A", START, 2.0, 5.0, 2), ("A", START + dt.timedelta(days=5), -1.0, None, 3)], "symbol string, date date, close double, volume double, n int")
    assert src.dedupe_bars(df, "n", "last").where("close = 2").count() == 1
    assert sorted(r.problem for r in src.audit_bars(src.dedupe_bars(df, "n")).collect()) == ["gap", "invalid_close", "invalid_volume"]


def test_load_csv_aliases(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("Date,Open,High,Low,Last,Vol\n31/01/2024,1,2,0.5,\"1,500\",\n01/02/2024,0,2,1,1,5\n")
    rows = src.load_bars_csv(spark, str(tmp_path / "abc.csv")).collect()
    assert [(r.symbol, str(r.date), r.close, r.volume) for r in rows] == [("ABC", "2024-01-31", 1500.0, 0.0)]


def bars5(rows):
    t = dt.datetime(2024, 1, 2, 14, 30)
    return [("AAA", dt.date(2024, 1, 2), t + dt.timedelta(minutes=5 * i), *r) for i, r in enumerate(rows)]


INTRADAY = "ticker string, session date, ts timestamp, o double, h double, l double, c double, v long"


@pytest.mark.parametrize(("kind", "rows", "phase"), [
    ("orl", [(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 130)], "triggered"), ("orl", [(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 110)], "armed"),
    ("first_red", [(10, 11, 9, 9.5, 1), (9.5, 12, 8, 9, 1)], "invalidated"), ("first_red", [(10, 11, 9, 9.5, 1), (9.5, 10, 8, 9, 1)], "triggered"),
    ("vwap_fail", [(10, 11, 9, 10.5, 100), (10, 10.4, 8, 8.5, 100), (9, 10.6, 8.6, 10, 100), (9, 9.5, 8.4, 8.8, 100), (9, 9, 7, 7.5, 100)], "triggered"),
])
def test_trigger_machines_and_stream(spark, tmp_path, kind, rows, phase):
    df = spark.createDataFrame(bars5([tuple(float(v) for v in r[:4]) + (r[4],) for r in rows]), INTRADAY)
    batch = live.fold_sessions(df, kind).first()
    assert batch.phase == phase
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 2)):
        df.orderBy("ts").limit(int(part[-1]) + 1 if len(part) else 0).subtract(df.orderBy("ts").limit(int(part[0]) if len(part) else 0)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.stream_sessions(stream, kind).writeStream.outputMode("update").format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("state").orderBy(F.desc("bars")).first()
    assert (last.phase, last.bars) == (batch.phase, batch.bars)


def test_similar_pairs_by_title_and_ticker(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i:02d}", ["LONG", "SHORT"][i % 2], [f"t{k}" for k in rng.integers(0, 40, 4)], f"customer c{rng.integers(0, 6)} order {i}") for i in range(60)]
    got = {(r.a, r.b) for r in signals.similar_pairs(spark.createDataFrame(rows, "signal_ref string, direction string, tickers array<string>, title string")).collect()}

    def near(p, q, least):
        return len(set(p) & set(q)) >= least * len(set(p) | set(q))

    want = {(a[0], b[0]): (near(a[2], b[2], 0.3), near(a[3].split(), b[3].split(), 0.6)) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]}
    assert got == {k for k, v in want.items() if any(v)} and any(t and not k for k, t in want.values())


def test_signal_queries_cover_all_orders(spark):
    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/orders.parquet").count()
    q = signal_queries.Q
    assert q["u01_union_signals"](spark, data).count() == q["h11_dedupe_signals"](spark, data).count() == n
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct()
    one, two = lines.where("l_orderkey % 2 = 0").withColumnRenamed("l_orderkey", "a"), lines.where("l_orderkey % 2 = 1").withColumnRenamed("l_orderkey", "b")
    assert q["h12_contradictions"](spark, data).count() == one.join(two, "l_partkey").select("a", "b").distinct().count()
    assert q["h13_merge_concepts"](spark, data).agg(F.sum("n")).first()[0] == lines.select("l_orderkey").distinct().count()
