"""Contradictions, similar pairs and merging against plain Python; what their plans may hold."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest

from tapeworks.operators import signals

SCHEMA = "signal_ref string, skill string, title string, raw_score double, tickers array<string>, direction string, horizon string"


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(4)
    rows = [(f"s{i:03d}", rng.choice("abc"), f"customer c{rng.randrange(30)} order {i}", rng.random(), rng.sample("ABCDEFGHIJKL", rng.choice([0, 1, 2, 4, 9])), rng.choice(["LONG", "SHORT"]), rng.choice(["20D", "5M", "soon"])) for i in range(120)]
    return rows, spark.createDataFrame([*rows, rows[0]], SCHEMA).cache()


def test_contradictions_are_made_once_without_grouping_pairs(some):
    rows, df = some
    want = {(a[0], b[0]): min(set(a[4]) & set(b[4])) for a in rows for b in rows if a[5] == "LONG" and b[5] == "SHORT" and set(a[4]) & set(b[4])}
    out = signals.contradictions(df)
    got = out.collect()
    assert len(got) == len(want) and {(r.long_ref, r.short_ref): r.ticker for r in got} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_counts_of_contradictions(some, spark):
    rows, _ = some
    df = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for r in signals.contradictions(df).collect():
        want.update([(r.long_ref, r.severity.lower()), (r.short_ref, r.severity.lower())])
    got = {(r.signal_ref, k): r[k] for r in signals.contradiction_counts(df, wide=5).collect() for k in ("high", "medium", "low") if r[k]}
    assert got == want


def test_subsets_are_of_tickers_that_meet_again(spark):
    """No two of the tickers are held by the other direction, so a signal of 20 has 20 sets, not a million."""
    df = spark.createDataFrame([("l", "a", "", 1.0, [f"t{i:02d}" for i in range(20)], "LONG", "20D"), *[(f"s{i:02d}", "b", "", 1.0, [f"t{i:02d}", f"u{i}"], "SHORT", "20D") for i in range(20)]], SCHEMA)
    got = {r.signal_ref: r.medium for r in signals.contradiction_counts(df, wide=20).collect()}
    assert got == {"l": 20} | {f"s{i:02d}": 1 for i in range(20)}


def test_similar_pairs_against_all_pairs(some):
    rows, df = some
    near = lambda x, y, least: bool(x & y) and len(x & y) >= least * len(x | y)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[5] == b[5] and (near(set(a[4]), set(b[4]), 0.3) or near(set(a[2].split()), set(b[2].split()), 0.6))}
    got = [(r.a, r.b) for r in signals.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("step", [signals.dedupe_signals, signals.contradiction_counts])
def test_steps_leave_no_shuffle_files(some, spark, step):
    _, df = some
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = manager.getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = files()
    step(df)
    for _ in range(100):  # files are dropped by a thread of their own
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_counts_are_summed_before_the_last_action(some):
    _, df = some
    assert "Join" not in signals.contradiction_counts(df)._jdf.queryExecution().optimizedPlan().toString()
