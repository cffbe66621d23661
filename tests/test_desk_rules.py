"""Contradiction counts, greedy merging, clusters and budgets against plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tapeworks.operators import plans, screens, signals

SIGNALS = "signal_ref string, skill string, direction string, horizon string, tickers array<string>, title string, raw_score double"


def some_signals(n: int, seed: int, most: int = 5):
    rng = np.random.default_rng(seed)
    return [
        (f"s{i:03d}", f"p{rng.integers(0, 3)}", ["LONG", "SHORT", "NEUTRAL"][int(rng.choice(3, p=[0.48, 0.48, 0.04]))], ["20D", "5M", "soon"][int(rng.integers(0, 3))], [f"t{k}" for k in rng.integers(0, 14, rng.integers(0, most + 1))], f"c{rng.integers(0, 9)} order {i}", float(np.round(rng.random(), 2)))
        for i in range(n)
    ]


@pytest.mark.parametrize("wide", [8, 2, 0])
def test_contradictions_counted_without_pairs(spark, wide):
    rows = [*some_signals(120, 1), ("big", "p1", "LONG", "20D", [f"t{k}" for k in range(14)], "x", 0.5)]
    df = spark.createDataFrame(rows, SIGNALS)
    want: dict[str, Counter] = {}
    for r in signals.contradictions(df).collect():
        for ref in (r.long_ref, r.short_ref):
            want.setdefault(ref, Counter())[r.severity] += 1
    got = {r.signal_ref: (r.high, r.medium, r.low) for r in signals.contradiction_counts(df, wide=wide).collect()}
    assert got == {k: (c["HIGH"], c["MEDIUM"], c["LOW"]) for k, c in want.items()} and "big" in got
    assert signals.contradiction_counts(df.limit(0)).count() == 0


def test_greedy_rounds_equal_the_sequential_pass(spark):
    rows = [(f"s{i:03d}", "a", ["LONG", "SHORT"][i % 2], None, t, title, score) for i, (_, _, _, _, t, title, score) in enumerate(some_signals(150, 2, 3))]
    rows += [(f"z{i:02d}", "a", "LONG", None, [f"q{i}", f"q{i + 1}"], f"u{i}", 0.99 - i / 1000) for i in range(25)]  # a chain
    df = spark.createDataFrame(rows, SIGNALS)
    near = {frozenset((r.a, r.b)) for r in signals.similar_pairs(df).collect()}
    taken: dict[str, str] = {}
    order = sorted(rows, key=lambda r: (-r[6], r[1], r[0]))
    for i, r in enumerate(order):
        if r[0] not in taken:
            taken[r[0]] = r[0]
            for later in order[i + 1 :]:
                if later[0] not in taken and frozenset((r[0], later[0])) in near:
                    taken[later[0]] = r[0]
    assert {r.signal_ref: r.primary for r in signals.dedupe_signals(df).collect()} == taken


def test_clusters_by_gap_and_vector(spark):
    rng = np.random.default_rng(4)
    words = ["Oil", "Gas", "Services", "Bank", "(Regional)", "and", "Gold,"]
    rows = [(["g1", "g1", "g1", None][i % 4], f"{words[rng.integers(0, 7)]} {words[rng.integers(0, 7)]} {i:03d}", None if i % 40 == 0 else float(rng.integers(0, 400) / 4), float(rng.integers(0, 9)), 5.0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, name string, v double, a double, flat double").repartition(6)
    got = {(r.g, r.n, round(r["mean"], 6), r.label) for r in screens.discover_clusters(df, ["g"], "v", "name", ["a", "flat"], gap=0.5, far=0.6).collect()}
    want = set()
    for g in ("g1", None):
        mine = sorted(((-(v or 0.0), n, a) for gg, n, v, a, _ in rows if gg == g))
        span = max(x[2] for x in mine) - min(x[2] for x in mine)
        runs = [[mine[0]]]
        for x in mine[1:]:
            p = runs[-1][-1]
            (runs[-1].append(x) if abs(p[0] - x[0]) <= 0.5 and abs(p[2] - x[2]) / span <= 0.6 else runs.append([x]))
        for run in runs:
            if len(run) > 1:
                tokens = Counter(t for x in run for t in (w.strip("(),") for w in x[1].split()) if t and t not in screens.STOP_WORDS)
                want.add((g, len(run), round(sum(-x[0] for x in run) / len(run), 6), " & ".join(w for w, _ in tokens.most_common(2)) + " Related"))
    assert got == want and len(want) > 5
    assert {r.n for r in screens.discover_clusters(df, [], "v", "name", ["a"], gap=1e9, far=9.0).collect()} == {200}
    assert screens.discover_clusters(df.limit(0), ["g"], "v", "name", ["a"]).count() == 0


def candidate(name: str, **changes):
    row = {"account": "A", "account_size": 100_000.0, "open_risk_pct": 0.0, "candidate": name, "sector": "tech", "price": 99.0, "score": 85.0, "state": "Pre-breakout", "valid": True, "pivot": 100.0, "last_low": 98.0, "breakout_volume": False, "distance_pct": -1.0} | changes
    return tuple(row.values())


CANDIDATES = "account string, account_size double, open_risk_pct double, candidate string, sector string, price double, score double, state string, valid boolean, pivot double, last_low double, breakout_volume boolean, distance_pct double"


def test_plans_and_what_binds(spark):
    rows = [
        candidate("a", score=95.0), candidate("b", score=90.0), candidate("c", score=88.0), candidate("d", score=86.0), candidate("e", score=84.0, sector="bank"), candidate("f", score=82.0, sector="x", last_low=96.0),
        candidate("watch", score=65.0), candidate("weak", score=50.0), candidate("bad", valid=False), candidate("risky", last_low=90.0), candidate("broken", pivot=None), candidate("damaged", state="Damaged"),
        candidate("again", state="Breakout", breakout_volume=True, distance_pct=1.0), candidate("gone", state="Breakout", breakout_volume=True, distance_pct=3.0),
        candidate("hot", account="B", open_risk_pct=5.9),
    ]
    got = {r.candidate: r for r in plans.generate_plans(spark.createDataFrame(rows, CANDIDATES)).collect()}
    # 102.00 worst, 97.02 stop: 4.98 at risk; a tenth of the account is 98 shares, three of them fill a sector but for 0.012 %
    assert [(got[k].plan, got[k].shares, got[k].binding) for k in "abc"] == [("actionable", 98, "max_position_pct")] * 2 + [("actionable", 98, "max_sector_pct")]
    assert (got["d"].plan, got["d"].shares, got["d"].binding) == ("constrained", None, "max_sector_pct")
    assert got["e"].plan == "actionable" and got["f"].plan == "actionable" and got["f"].shares == 71 and got["f"].binding is None
    assert got["a"].risk_dollars == 488.04 and got["c"].cumulative_risk_pct == pytest.approx(1.46412)
    assert {k: (got[k].plan, got[k].reason) for k in ("watch", "weak", "bad", "risky", "broken", "damaged", "again", "gone")} == {
        "watch": ("watchlist", None), "weak": ("rejected", "band weak"), "bad": ("rejected", "not valid"), "risky": ("rejected", "risk"), "broken": ("rejected", "prices"), "damaged": ("rejected", "state Damaged"),
        "again": ("revalidation", None), "gone": ("rejected", "breakout"),
    }
    assert got["hot"].plan == "deferred"
    assert plans.generate_plans(spark.createDataFrame([], CANDIDATES)).count() == 0


def test_budgets_run_over_partitions_and_batches(spark):
    """Accounts interleaved over batches of two rows have the budgets that each has alone; none has a call of its own."""
    rows = [candidate(f"{a}{i}", account=a, open_risk_pct=float(i_a), score=95.0 - i, sector="tech" if i % 3 else "bank") for i in range(7) for i_a, a in enumerate(("A", "B", None, "C", "D"))]
    df = spark.createDataFrame(rows, CANDIDATES)
    assert "FlatMapGroups" not in plans.generate_plans(df)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r.account, tuple(r)) for r in plans.generate_plans(df.coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = {(a, tuple(r)) for a in ("A", "B", None, "C", "D") for r in plans.generate_plans(df.where(df.account.eqNullSafe(a))).collect()}
    assert got == alone and len(got) == 35 and len({x[1][2] for x in got}) > 1
