"""Trigger machines, monitored plans, silent sessions, repaired sessions and restrictions that outlive a session."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tapeworks.streaming import intraday as live
from tapeworks.streaming.triggers import Bar, fresh, step

BARS = "ticker string, session date, ts timestamp, o double, h double, l double, c double, v long"
DAY = dt.date(2024, 1, 2)


def bars5(rows, ticker="AAA", day=DAY, first=(14, 30)):
    t = dt.datetime.combine(day, dt.time(*first))
    return [(ticker, day, t + dt.timedelta(minutes=5 * i), *map(float, r[:4]), r[4]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(
    ("kind", "rows", "phase", "entry", "stop"),
    [
        ("orl", [(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 120)], "triggered", 8.45, 11.5), ("orl", [(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 119)], "armed", None, None),
        ("orl", [(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 120), (9, 12, 9, 9.9, 10)], "invalidated", 8.45, 11.5), ("orl", [(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 120), (9, 12, 9, 9.1, 10)], "triggered", 8.45, 11.5),
        ("first_red", [(9, 10, 9, 10, 1), (10, 11, 9, 9.5, 1)], "red_marked", None, None), ("first_red", [(10, 11, 9, 9.5, 1), (9.5, 12, 8, 9, 1)], "invalidated", None, None),
        ("first_red", [(10, 11, 9, 9.5, 1), (9.5, 11, 8.9, 9, 1)], "triggered", 8.95, 11.0), ("first_red", [(10, 11, 9, 9.5, 1), (9.5, 11, 8, 9, 1), (9, 11.1, 9, 9, 1)], "invalidated", 8.95, 11.0),
        ("vwap_fail", [(10, 10, 9, 9.0, 100), (9, 9, 8, 8.5, 100)], "first_crack_seen", None, None),
        ("vwap_fail", [(10, 11, 9, 10.5, 100), (10, 10.4, 8, 8.5, 100), (9, 10.6, 8.6, 10, 100), (9, 9.5, 8.4, 8.8, 100), (9, 9, 8.3, 8.9, 100)], "triggered", 8.35, 10.6),
        ("vwap_fail", [(10, 11, 9, 10.5, 100), (10, 10.4, 8, 8.5, 100), (9, 10.6, 8.6, 10, 100), (9, 9.5, 8.4, 8.8, 100), (9, 9, 8.3, 8.9, 100), (9, 12, 9, 11, 1)], "invalidated", 8.35, 10.6),
    ],
)
def test_machines(kind, rows, phase, entry, stop):
    s = fresh()
    for i, r in enumerate(rows):
        step(s, Bar(f"2024-01-02 14:{30 + 5 * i}", *map(float, r)), kind, 2.0)
    assert (s["phase"], s["entry"], s["stop"], s["n"]) == (phase, entry, stop, len(rows))
    assert (s["triggered_at"] is None) == (entry is None) and (s["reason"] is None) == (phase != "invalidated")


def plans(spark, rows):
    return spark.createDataFrame(rows, "plan_id string, ticker string, kind string, risk_usd double, cap_usd double, atr_14 double")


BROKEN = [(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 120)]


def test_plans_are_sized_at_the_trigger(spark):
    df = spark.createDataFrame([*bars5(BROKEN), *bars5(BROKEN, "BBB", first=(14, 35))], BARS)
    rows = [("risk", "AAA", "orl", 100.0, 1e9, 2.0), ("cap", "AAA", "orl", 1e9, 1000.0, 2.0), ("red", "AAA", "first_red", 100.0, 1e9, None), ("no_range", "AAA", "orl", 1.0, 1.0, None), ("late", "BBB", "orl", 1.0, 1.0, 2.0), ("silent", "ZZZ", "vwap_fail", 1.0, 1.0, 2.0)]
    got = {r.plan_id: r for r in live.plan_monitor(plans(spark, rows), df).collect()}
    assert (got["risk"].state, got["risk"].shares, got["risk"].risk_at_trigger) == ("triggered", 32, 97.6)  # floor(100 / 3.05)
    assert got["cap"].shares == 118 and got["red"].state == "red_marked" and got["red"].shares is None
    assert (got["no_range"].status, got["no_range"].skip_reason, got["no_range"].session_high) == ("skipped", "atr_14_unavailable", None)
    assert got["late"].skip_reason == "opening_range_bar_unavailable" and got["silent"].status == "no_bars" and got["silent"].state == "armed"


def test_a_silent_session_is_told_and_never_moves(spark, tmp_path):
    table = plans(spark, [("p1", "AAA", "orl", 100.0, 1e9, 2.0), ("p2", "ZZZ", "orl", 100.0, 1e9, 2.0)])
    spark.createDataFrame(bars5(BROKEN), BARS).coalesce(1).write.parquet(str(tmp_path / "bars"))
    spark.createDataFrame([("AAA", DAY), ("ZZZ", DAY)], "ticker string, session date").coalesce(1).write.parquet(str(tmp_path / "watch"))
    bars = spark.readStream.schema(BARS).parquet(str(tmp_path / "bars"))
    watch = spark.readStream.schema("ticker string, session date").parquet(str(tmp_path / "watch"))
    q = live.stream_monitor(table, bars, watch, silence="2 seconds", keep=3).writeStream.outputMode("update").format("memory").queryName("monitored").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    end = time.time() + 150
    while time.time() < end and spark.table("monitored").where("status = 'no_bars'").count() < 6:
        time.sleep(1)
    q.stop()
    rows = spark.table("monitored").collect()
    silent = [r for r in rows if r.status == "no_bars"]
    assert {(r.plan_id, r.state, r.bars) for r in silent} == {("p1", "triggered", 2), ("p2", "armed", 0)} and len(silent) == 6  # three each, then the watch ends
    assert {(r.state, r.shares) for r in rows if r.plan_id == "p1" and r.bars == 2} == {("triggered", 32)}


def test_repair_equals_batch_in_any_order(spark, tmp_path):
    rows = [*bars5([(10, 11, 9, 10.5, 100), (10, 10.4, 8, 8.5, 100), (9, 10.6, 8.6, 10, 100), (9, 9.5, 8.4, 8.8, 100), (9, 9, 8.3, 8.9, 100)]), *bars5(BROKEN, "BBB")]
    df = spark.createDataFrame([(*r, 1) for r in rows], BARS + ", arrival long")
    fixed = spark.createDataFrame([(*bars5([(10, 11, 9, 10, 100), (10, 10, 8, 8.5, 500)], "BBB")[1], 2)], BARS + ", arrival long")
    writer = live.SessionRepair(str(tmp_path / "r"), "vwap_fail")
    late = "ticker = 'AAA' and hour(ts) * 60 + minute(ts) between 875 and 885"
    writer(df.where(f"not ({late})"), 0)
    assert {r.bars for r in writer.states(spark).where("ticker = 'AAA'").collect()} == {2}
    for _ in range(2):  # a repeated batch changes nothing
        writer(df.where(late), 1)
    assert writer.late(spark).count() == 3
    writer(fixed, 2)  # a bar again, with another volume: the last arrival counts
    want = live.fold_sessions(df.where("not (ticker = 'BBB' and v = 120)").unionByName(fixed), "vwap_fail")
    key = F.struct("ticker", "phase", "bars", "entry", "stop", "last_ts")
    assert {r[0] for r in writer.states(spark).select(key).collect()} == {r[0] for r in want.select(key).collect()}
    assert writer.states(spark).where("ticker = 'AAA'").first().phase == "triggered"


def test_restriction_carries_over_a_session(spark, tmp_path):
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    moves = [(100, 100), (89, 95), (94, 96), (95, 97)]  # low and close: the second day falls by 11 %, the third is carried over
    prints = [("A", d, dt.datetime.combine(d, dt.time(10, 5 * k)), float(x), float(x)) for d, m in zip(days, moves, strict=True) for k, x in enumerate(m)]
    schema = "symbol string, date date, ts timestamp, low double, close double"
    for i, d in enumerate(days):
        spark.createDataFrame([p for p in prints if p[1] == d], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        time.sleep(0.3)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.stream_short_sale(stream, keep=None).writeStream.outputMode("update").format("memory").queryName("restricted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.date, r.hit, r.restricted) for r in spark.table("restricted").collect()}
    daily = spark.createDataFrame([("A", d, float(m[0]), float(m[1])) for d, m in zip(days, moves, strict=True)], "symbol string, date date, low double, close double")
    assert got == {(r.date, r.hit, r.restricted) for r in live.short_sale_state(daily).collect()}
    assert [x[2] for x in sorted(got)] == [False, True, True, False]


def test_session_runs_in_batch(spark):
    t = dt.datetime(2024, 1, 2, 10)
    times = [0, 299, 598, 898, 5000]  # 300 seconds part, 299 do not
    df = spark.createDataFrame([(1, i, t + dt.timedelta(seconds=x)) for i, x in enumerate(times)], "user_id long, event_id long, ts timestamp")
    assert sorted((r.event_id, r.events) for r in live.stream_session_gaps(df).collect()) == [(2, 3), (3, 1), (4, 1)]
