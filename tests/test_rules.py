"""Rules against plain Python: range-sorted ranks and sums, rally states, dividend basis, candidate states, reviews."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import folds, macro, ordered, pairs, reviews, screens, themes, vcp
from tapeworks.streaming import intraday


def test_numbers_ranks_and_drawdowns_over_hot_groups(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"g": rng.choice(["a", "a", "a", "a", "b", None], 400), "k": rng.integers(0, 60, 400), "i": range(400), "v": rng.normal(0, 1, 400)})
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "g string, k long, i long, v double").repartition(5)
    key = rows["g"].fillna("-")
    got = ordered.numbered(df, ["g"], [F.desc("k"), F.col("i")], "n").toPandas().sort_values("i")
    want = rows.assign(g=key).sort_values(["k", "i"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
    assert got["n"].tolist() == want.tolist() and got["_size"].tolist() == key.map(key.value_counts()).tolist()
    got = ordered.numbered(df, ["g"], [F.desc("k")], "n", ranked=True).toPandas().sort_values("i")
    assert got["n"].tolist() == rows.assign(g=key).groupby("g")["k"].rank("min", ascending=False).astype(int).tolist()
    got = ordered.drawdowns(df, ["g"], [F.col("i")], "v").toPandas().sort_values("i")
    eq = rows.assign(g=key).groupby("g")["v"].cumsum()
    assert np.allclose(got["eq"], eq) and np.allclose(got["dd"], eq.groupby(key).cummax().clip(lower=0) - eq)
    assert ordered.numbered(df.limit(0), ["g"], [F.col("i")], "n").count() == 0


def path(*moves: float) -> np.ndarray:
    return 100 * np.cumprod([1.0, *(1 + m / 100 for m in moves)])


@pytest.mark.parametrize(
    ("moves", "want"),
    [
        ([0.1] * 12, "NO_SIGNAL"), ([0.1] * 6 + [-1.5, -1.5, -1.5], "CORRECTION"), ([0.1] * 6 + [-1.5, -1.5, -1.5, 0.5], "RALLY_ATTEMPT"),
        ([0.1] * 6 + [-1.5, -1.5, -1.5, 0.5, 0.2, 0.2, 0.1], "FTD_WINDOW"), ([0.1] * 6 + [-1.5, -1.5, -1.5, 0.5, 0.2, 0.2, 2.1], "FTD_CONFIRMED"),
        ([0.1] * 6 + [-1.5, -1.5, -1.5, 0.5, 0.2, 0.2, 2.1, 0.2, -0.5, 0.3], "FTD_INVALIDATED"), ([0.1] * 6 + [-1.5, -1.5, -1.5] + [0.1] * 12, "RALLY_FAILED"),
    ],
)
def test_rally_states(moves, want):
    c = path(*moves)
    v = 1000.0 + 10 * np.arange(len(c))
    found = folds.rally_state(c * 1.001, c * 0.999, c, v)
    assert found["state"] == want
    if want == "FTD_CONFIRMED":
        assert found["ftd_day"] == 4 and found["tier"] == "strong"
        assert folds.rally_state(c * 1.001, c * 0.999, c, v[::-1].copy())["state"] == "FTD_WINDOW"  # falling volume


def test_dividend_basis():
    days = np.arange(0, 91 * 16, 91)
    steady = np.full(16, 0.5)
    none = np.zeros(16, bool)
    flat = folds.dividend_basis(days, steady, none)
    assert flat["cadence"] == "quarterly" and flat["frozen"] and not flat["cut"] and flat["annualized"] == 2.0 and flat["regular_ttm"] == pytest.approx(2.5)
    spike = steady.copy()
    spike[10] = 1.6
    found = folds.dividend_basis(days, spike, none)
    assert found["specials"] == 1 and not found["variable"]
    growth = np.where(np.arange(16) < 12, 0.5, 0.8)  # a lasting rise is no special
    assert folds.dividend_basis(days, growth, none)["specials"] == 0
    middle = steady.copy()
    middle[10] = 0.9  # nearly twice, and back
    assert folds.dividend_basis(days, middle, none)["specials"] == 1
    assert folds.dividend_basis(days, np.append(steady[:-1], 0.4), none)["cut"]
    named = none.copy()
    named[3] = True
    assert folds.dividend_basis(days, steady, named)["specials"] == 1
    assert folds.dividend_basis(days, steady, none, as_of=int(days[-1]) + 200)["suspended"]
    assert folds.dividend_basis(days[:3], steady[:3], none[:3])["status"] == "ASSUMPTION-REQUIRED"
    assert folds.cadence(np.array([0, 10, 400, 420, 900]))[0] == "irregular"


def test_candidate_states(spark):
    rows = [  # price, sma50, sma200, last low, distance, breakout on volume, state
        (90.0, 100.0, 110.0, 80.0, -1.0, False, "Invalid"), (90.0, 80.0, 70.0, 95.0, -1.0, False, "Damaged"), (90.0, 95.0, 70.0, 80.0, -1.0, False, "Damaged"),
        (120.0, 100.0, 75.0, 80.0, 1.0, True, "Overextended"), (120.0, 110.0, 100.0, 80.0, 11.0, True, "Overextended"), (120.0, 110.0, 100.0, 80.0, 6.0, True, "Extended"),
        (120.0, 110.0, 100.0, 80.0, 4.0, True, "Early-post-breakout"), (120.0, 110.0, 100.0, 80.0, 1.0, True, "Breakout"), (120.0, 110.0, 100.0, 80.0, 1.0, False, "Early-post-breakout"),
        (120.0, 110.0, 100.0, 80.0, -1.0, False, "Pre-breakout"), (120.0, None, None, None, None, False, "Pre-breakout"),
    ]
    df = spark.createDataFrame(rows, "p double, a double, b double, l double, d double, v boolean, want string")
    state = vcp.execution_state(*(F.col(c) for c in "pabldv"))
    valid = F.lit(True)
    got = df.select("want", state.alias("state"), vcp.pivot_score(F.col("d"), F.col("v")).alias("s"), vcp.capped_rating(F.lit(92.0), valid, state, F.lit(False)).alias("r"), vcp.pattern_class(state, valid, F.lit(3), F.lit(8.0), F.lit(0.6), F.lit(False)).alias("k")).collect()
    assert [r.state for r in got] == [r.want for r in got]
    assert [r.s for r in got][:4] == [90, 90, 90, 100] and got[-1].s == 0
    assert {r.state: r.r for r in got} == {"Invalid": "No VCP", "Damaged": "No VCP", "Overextended": "Weak VCP", "Extended": "Developing VCP", "Early-post-breakout": "Strong VCP", "Breakout": "Textbook VCP", "Pre-breakout": "Textbook VCP"}
    assert {r.state: r.k for r in got} == {"Invalid": "Damaged", "Damaged": "Damaged", "Overextended": "Extended Leader", "Extended": "Extended Leader", "Early-post-breakout": "Post-breakout", "Breakout": "Post-breakout", "Pre-breakout": "Textbook VCP"}


def test_power_trend_uses_the_exponential_mean(spark):
    c = np.concatenate([np.linspace(100, 130, 80), np.linspace(130, 100, 40)])
    df = spark.createDataFrame([("x", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(v)) for i, v in enumerate(c)], "symbol string, date timestamp, close double").select("symbol", F.to_date("date").alias("date"), F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(1.0).alias("volume"))
    got = [r.power for r in screens.power_trend(df).orderBy("date").collect()]
    s = pd.Series(c)
    m, e = s.rolling(50).mean(), pd.Series(folds.ema(c, 21))
    assert got == [bool(i >= 54 and e[i] > m[i] > m[i - 5] and c[i] > e[i]) for i in range(len(c))] and any(got)


def test_theme_and_macro_scores(spark):
    x = spark.range(1).select(themes.volume_intensity(F.lit(1.2), F.lit(1.0)).alias("v"), themes.volume_intensity(F.lit(None).cast("double"), F.lit(1.0)).alias("n"), themes.breadth_signal(F.lit(0.7), F.lit(4)).alias("b")).first()
    assert x.v == pytest.approx(100 * (0.4 / 1.2) ** 0.5) and x.n == 50 and x.b == pytest.approx(0.7**2.5 * 80 + 8)
    months = [f"20{y:02d}-{m:02d}" for y in (20, 21, 22) for m in range(1, 13)]
    rows = [("credit_conditions", m, 1 - 0.01 * i if i < 30 else 0.7 + 0.08 * (i - 29)) for i, m in enumerate(months)] + [("size_factor", m, 1.0) for m in months[:11]]
    got = {r.name: r for r in macro.components(spark.createDataFrame(rows, "name string, month string, value double")).collect()}
    assert set(got) == {"credit_conditions"} and got["credit_conditions"].crossover == "golden_cross" and got["credit_conditions"].direction == "easing" and got["credit_conditions"].qualifier == "confirmed"
    ladder = spark.createDataFrame([(0.05, "up", None), (0.097, "Down", -0.1), (0.31, "up", 0.1), (0.6, "up", 0.1), (None, "up", 0.1)], "ratio double, trend string, slope double")
    assert [r.score for r in macro.uptrend_level(ladder).collect()] == [5, 5, 60, 100, 50]


def test_verdicts(spark):
    rows = [("STEP1-PASS", "PASS", None, False), ("STEP1-PASS", "CAUTION", None, False), ("STEP1-PASS", "PASS", "HOLD-REVIEW", False), ("HOLD-REVIEW", "PASS", None, False), ("HOLD-REVIEW", "PASS", None, True), ("FAIL", "PASS", None, False), (None, "PASS", None, False), ("STEP1-PASS", None, None, False)]
    df = spark.createDataFrame(rows, "s string, f string, c string, b boolean")
    got = [r[0] for r in df.select(reviews.final_verdict(*(F.col(x) for x in "sfcb"))).collect()]
    assert got == ["CLEAN-PASS", "PASS-CAUTION", "HOLD-REVIEW", "CONDITIONAL-PASS", "HOLD-REVIEW", "FAIL", "STEP1-RECHECK", "HOLD-REVIEW"]


def test_pairs_by_block_products(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (300, 1))
    x = pd.DataFrame(1e6 + 50 * (base + rng.normal(0, 1, (300, 9)) * np.linspace(0.2, 2, 9)), columns=[f"s{i}" for i in range(9)]).mask(rng.random((300, 9)) < 0.1)
    x["s8"] = 5.0  # no spread, no correlation
    long = x.reset_index().melt("index", var_name="symbol", value_name="close").dropna()
    df = spark.createDataFrame([(s, (pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(i))).date(), float(v)) for i, s, v in long[["index", "symbol", "close"]].itertuples(index=False)], "symbol string, date date, close double")
    got = {(r.a, r.b): r for r in pairs.pair_statistics(df, least_bars=100, least_common=50, block=3).collect()}
    assert set(got) == {(a, b) for a in x for b in x if a < b}
    for (a, b), r in got.items():
        both = x[[a, b]].dropna()
        assert r.n == len(both)
        if "s8" not in (a, b):
            beta = both.cov().loc[a, b] / both[b].var()
            assert r.corr == pytest.approx(both.corr().loc[a, b]) and r.beta == pytest.approx(beta) and r.alpha == pytest.approx(both[a].mean() - beta * both[b].mean())
    strong = {(r.a, r.b) for r in pairs.correlated_pairs(df, 0.6, least_bars=100, least_common=50).collect()}
    assert strong == {k for k, r in got.items() if "s8" not in k and r.corr >= 0.6}


def test_stream_keeps_the_last_arrival(spark, tmp_path):
    at = pd.Timestamp("2024-01-02 14:30")
    rows = [("x", at, 1, 10.0), ("x", at, 3, 12.0), ("x", at, 2, 11.0), ("y", at, 1, 5.0), ("x", at + pd.Timedelta(hours=2), 4, 20.0), ("x", at + pd.Timedelta(hours=3), 5, 21.0), ("x", at, 6, 99.0)]
    df = spark.createDataFrame([(a, t.to_pydatetime(), n, c) for a, t, n, c in rows], "ticker string, ts timestamp, arrival long, c double")
    for k, part in enumerate(("arrival <= 3 and c < 20", "c = 20", "c = 21", "c = 99")):  # the last one comes after the watermark has passed it
        df.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = intraday.stream_latest(stream, "arrival").writeStream.format("memory").queryName("latest_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.ticker, r.c) for r in spark.table("latest_bars").where("c < 20 or c = 99").collect()} == {("x", 12.0), ("y", 5.0)}
    assert intraday.latest_arrivals(df.where("c < 20"), "arrival").where("ticker = 'x'").first().c == 12.0
