"""Signals of several producers: one schema, duplicates, contradictions, conviction, outcomes and producer weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import clamp, horizon_bucket, horizons_overlap, normalize_direction, ticker_array
from tapeworks.operators.ordered import drawdowns, tidy, written

SIGNAL_COLUMNS = ["signal_ref", "skill", "title", "raw_score", "tickers", "direction", "horizon", "ts"]


def union_signals(parts: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Producers with field names of their own (signal field -> source field) on one schema."""
    out = None
    for skill, (df, names) in parts.items():
        tickers = F.col(names["tickers"])
        tickers = ticker_array(tickers) if df.schema[names["tickers"]].dataType.simpleString() == "string" else F.array_sort(F.array_distinct(tickers))
        one = df.select(
            F.col(names["signal_ref"]).cast("string").alias("signal_ref"), F.lit(skill).alias("skill"), F.col(names["title"]).alias("title"), F.col(names["raw_score"]).cast("double").alias("raw_score"), tickers.alias("tickers"),
            normalize_direction(F.col(names["direction"])).alias("direction"), F.col(names["horizon"]).alias("horizon"), F.col(names["ts"]).cast("date").alias("ts"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def title_words(title: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+")), lambda w: w != "")


def similar_pairs(signals: DataFrame, tickers: float = 0.30, titles: float = 0.60) -> DataFrame:
    """(a, b): unordered pairs of one direction with enough ticker or title overlap.

    A pair needs a common ticker or word; shared counts come from joins on those, so no pair without one is made. Each step
    is written, so that its shuffle files are gone before the next.
    """
    base = written(signals.select("signal_ref", "direction", F.array_distinct("tickers").alias("t"), title_words(F.col("title")).alias("w")))

    def overlap(col: str, least: float) -> DataFrame:
        # A set's items, rare ones first: pairs above the threshold share one of the first n - ceil(least * n) + 1 items. Items
        # of one signal only meet nothing.
        each = base.where(F.size(col) > 0).select("signal_ref", "direction", F.xxhash64(F.array_sort(col)).alias("row"), F.explode(col).alias("x"))
        count = each.groupBy("direction", "x").agg(F.count("*").alias("c")).where("c > 1")
        ranked = each.join(count, ["direction", "x"], "left").groupBy("signal_ref", "direction", "row").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "x"))).alias("s"))
        n = F.size("s")
        items = written(ranked).select("signal_ref", "direction", F.transform("s", lambda i: i["x"]).alias("p"), F.explode(F.slice("s", F.lit(1), (n - F.ceil(n * least) + 1).cast("int"))).alias("i")).where("i.c > 1")
        one, two = (items.select("direction", F.col("i.x").alias("x"), F.col("signal_ref").alias(k), F.col("p").alias(f"p{k}")) for k in "ab")
        k, m = F.size("pa"), F.size("pb")
        pairs = one.join(two, ["direction", "x"]).where("a < b").where(F.least(k, m) >= least * F.greatest(k, m))
        need = F.ceil(least * (k + m) / (1 + least) - 1e-9)  # the same as common >= least * union, with the common items found once
        return written(pairs.where(F.size(F.array_intersect("pa", "pb")) >= need).select("a", "b"))

    return overlap("t", tickers).union(overlap("w", titles)).distinct()


def size(df: DataFrame) -> int:
    with tidy(df.sparkSession):
        return df.count()  # one number


def dedupe_signals(signals: DataFrame, tickers: float = 0.30, titles: float = 0.60, small: int = 100_000) -> DataFrame:
    """(signal_ref, primary): greedy in descending score: a signal absorbs every later similar one not yet absorbed.

    Decided in rounds over the similar pairs, each of them two joins: a signal without an undecided better neighbour is a
    primary, its worse neighbours are absorbed, and their own pairs fall away. Every round writes its decisions and what is
    left, two links of a chain of ever worse signals a round; the last pairs, `small` at most, are decided in one pass in one
    task, so that a few long chains do not cost a job for each of their links. An absorbed signal then goes to the best of its primaries. This equals the sequential pass, whatever a component's size or shape. Repeated
    references rank by their best row.
    """
    rank = signals.select("signal_ref", F.struct((-F.col("raw_score")).alias("s"), F.col("skill"), F.col("signal_ref").alias("r")).alias("rank")).groupBy("signal_ref").agg(F.min("rank").alias("rank"))
    rank, pairs = written(rank), written(similar_pairs(signals, tickers, titles))
    ra, rb = rank.select(F.col("signal_ref").alias("a"), F.col("rank").alias("ra")), rank.select(F.col("signal_ref").alias("b"), F.col("rank").alias("rb"))
    edges = pairs.join(ra, "a").join(rb, "b")
    better = F.col("ra") < F.col("rb")
    left = edges = written(edges.select(F.when(better, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(better, F.col("ra")).otherwise(F.col("rb")).alias("hr"), F.when(better, F.col("b")).otherwise(F.col("a")).alias("lo")))
    gone = edges.select("lo").limit(0)
    while (n := size(left)) > small:
        blocked = left.select(F.col("lo").alias("hi")).distinct()
        new = written(left.join(blocked, "hi", "left_anti").select("lo").distinct())
        left = written(left.join(new, "lo", "left_anti").join(new.select(F.col("lo").alias("hi")), "hi", "left_anti"))
        gone = gone.unionByName(new)

    def decide(g: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, None] = {}
        for hi, lo in g.sort_values(["s", "skill", "hi"])[["hi", "lo"]].itertuples(index=False):
            if hi not in out:
                out[lo] = None
        return pd.DataFrame({"lo": list(out)}, dtype=object)

    if n:
        gone = gone.unionByName(left.select("hi", "lo", "hr.s", F.coalesce("hr.skill", F.lit("")).alias("skill"), F.lit(0).alias("all")).groupBy("all").applyInPandas(decide, "lo string"))
    taken = edges.join(gone.select(F.col("lo").alias("hi")), "hi", "left_anti").groupBy("lo").agg(F.min_by("hi", "hr").alias("primary"))
    return signals.select("signal_ref").join(taken.withColumnRenamed("lo", "signal_ref"), "signal_ref", "left").withColumn("primary", F.coalesce("primary", "signal_ref"))


def contradictions(signals: DataFrame) -> DataFrame:
    """LONG and SHORT signals on a common ticker, once per pair: HIGH from one producer, LOW if horizons differ."""
    base = signals.select("signal_ref", "skill", "direction", horizon_bucket(F.col("horizon")).alias("h"), F.array_sort(F.array_distinct("tickers")).alias("t"))
    base = base.groupBy("signal_ref", "skill", "direction", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("t"))
    rows = base.select("*", F.posexplode("t").alias("at", "ticker")).withColumn("before", F.slice("t", F.lit(1), F.col("at")))
    one = rows.where("direction = 'LONG'").select(F.col("signal_ref").alias("long_ref"), F.col("skill").alias("s1"), F.col("h").alias("h1"), "ticker", F.col("before").alias("b1"))
    two = rows.where("direction = 'SHORT'").select(F.col("signal_ref").alias("short_ref"), F.col("skill").alias("s2"), F.col("h").alias("h2"), "ticker", F.col("before").alias("b2"))
    both = one.join(two, "ticker").where(~F.arrays_overlap("b1", "b2"))  # at their first common ticker only, so pairs are never grouped
    level = F.when(F.col("s1") == F.col("s2"), "HIGH").when(~horizons_overlap(F.col("h1"), F.col("h2")), "LOW").otherwise("MEDIUM")
    return both.select("long_ref", "short_ref", "ticker", level.alias("severity"))


def contradiction_counts(signals: DataFrame, wide: int = 8) -> DataFrame:
    """signal_ref, high, medium, low: how many opposite signals each one shares a ticker with, by severity as in
    contradictions(), each opposite signal once however many tickers are shared; signals without any have no row.

    No pair is made. An opposite signal that shares some of a signal's tickers is counted by the sets they share: the
    sum over the signal's subsets of tickers, odd sizes added and even ones taken off, of the opposite signals that hold
    the subset. Those are grouped by subset, direction, producer and horizon, so that a popular ticker is one row of each.
    Pairs with a signal of more than `wide` tickers, whose subsets would be too many, are counted as pairs on tickers.
    """
    base = signals.where(F.col("direction").isin("LONG", "SHORT")).select("signal_ref", "skill", "direction", horizon_bucket(F.col("horizon")).alias("h"), F.array_sort(F.array_distinct("tickers")).alias("t"))
    base = written(base.where(F.size("t") > 0))
    narrow, broad = base.where(F.size("t") <= wide), base.where(F.size("t") > wide)
    # Subsets of two and more count only where both directions hold them, and so all of their pairs: of a signal, only the
    # tickers of such pairs make subsets. Pairs are told apart by hash: one too many is a subset that nobody else holds.
    # A signal's tickers travel as their places in t.
    place = lambda x: x.cast("byte")
    duo = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y, j: F.struct(F.xxhash64(x, y).alias("p"), place(i).alias("i"), place(i + j + 1).alias("j")))))
    duos = narrow.where(F.size("t") > 1).select("signal_ref", "direction", F.explode(duo).alias("d")).select("signal_ref", "direction", "d.p", "d.i", "d.j")
    shared = duos.groupBy("p").agg(F.min("direction").alias("lo"), F.max("direction").alias("hi")).where("lo <> hi").select("p")
    crossed = written(duos.join(shared, "p").groupBy("signal_ref").agg(F.array_distinct(F.flatten(F.collect_list(F.array("i", "j")))).alias("u")))
    subsets = F.aggregate("u", F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    single = narrow.select("signal_ref", "skill", "direction", "h", F.explode(F.transform("t", lambda x: F.array(x))).alias("s"))
    more = narrow.join(crossed, "signal_ref").withColumn("u", F.filter("t", lambda x, i: F.array_contains("u", place(i)))).select("signal_ref", "skill", "direction", "h", F.explode(F.filter(subsets, lambda s: F.size(s) > 1)).alias("s"))
    parts = written(single.unionByName(more))
    held = parts.groupBy("s", "direction", F.col("skill").alias("s2"), F.col("h").alias("h2")).agg(F.count("*").alias("n"))
    held = written(held).withColumn("direction", F.when(F.col("direction") == "LONG", "SHORT").otherwise("LONG"))
    signed = F.when(F.size("s") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    names, key = ("high", "medium", "low"), ["signal_ref", "skill", "h", "s2", "h2"]

    def counted(df: DataFrame) -> DataFrame:
        level = F.when(F.col("skill") == F.col("s2"), "high").when(~horizons_overlap(F.col("h"), F.col("h2")), "low").otherwise("medium")
        return df.withColumn("level", level).groupBy("signal_ref").agg(*[F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(k) for k in names])

    rows = written(counted(parts.join(held, ["s", "direction"]).select(*key, signed.alias("n"))))

    each = lambda df: df.select("signal_ref", "skill", "direction", "h", F.size("t").alias("k"), F.explode("t").alias("ticker"))
    one, two = each(broad), each(base).select(F.col("signal_ref").alias("r2"), F.col("skill").alias("s2"), F.col("direction").alias("d2"), F.col("h").alias("h2"), F.col("k").alias("k2"), "ticker")
    both = written(one.join(two, "ticker").where("direction <> d2").select("signal_ref", "skill", "h", "r2", "s2", "h2", "k2").distinct())
    back = both.where(F.col("k2") <= wide).select(F.col("r2").alias("signal_ref"), F.col("s2").alias("skill"), F.col("h2").alias("h"), F.col("skill").alias("s2"), F.col("h").alias("h2"))
    for more in (both.select(*key), back):
        rows = rows.unionByName(counted(more.withColumn("n", F.lit(1).cast("long"))))
    return rows.groupBy("signal_ref").agg(*[F.sum(k).alias(k) for k in names]).where("high + medium + low > 0")


def adjust_for_contradictions(scores: DataFrame, counts: DataFrame, penalty: float = 0.10) -> DataFrame:
    """score times (1 - penalty) per medium contradiction; signals in a high one are excluded. counts: contradiction_counts()."""
    out = scores.join(counts.select("signal_ref", F.col("medium").alias("m"), F.col("high").alias("x")), "signal_ref", "left").where(F.coalesce("x", F.lit(0)) == 0)
    return out.withColumn("score", F.col("score") * F.pow(F.lit(1 - penalty), F.coalesce("m", F.lit(0)))).drop("m", "x")


def conviction(signals: DataFrame, merged: DataFrame, weights: dict[str, float], as_of: str) -> DataFrame:
    """Score of each primary: weighted mean raw score of its signals, agreement bonus by producers (two 0.10, three or
    more 0.20), 0.05 per absorbed signal up to 0.15, times recency, at most 1."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("skill")), F.lit(0.1))
    rows = signals.join(merged, "signal_ref").withColumn("w", w)
    own = F.col("signal_ref") == F.col("primary")
    out = rows.groupBy("primary").agg((F.sum(F.col("raw_score") * F.col("w")) / F.sum("w")).alias("base"), F.countDistinct("skill").alias("k"), (F.count("*") - 1).alias("merged"), F.max(F.when(own, F.col("ts"))).alias("ts"))
    age = F.datediff(F.lit(as_of).cast("date"), "ts")
    fresh = F.when(age < 1, 1.0).when(age <= 3, 0.95).when(age <= 7, 0.9).otherwise(0.85)
    score = F.least(F.lit(1.0), (F.col("base") + F.when(F.col("k") >= 3, 0.2).when(F.col("k") == 2, 0.1).otherwise(0.0) + F.least(F.lit(0.15), F.col("merged") * 0.05)) * fresh)
    return out.select(F.col("primary").alias("signal_ref"), score.alias("score"))


def classify_outcome(direction: Column, ret: Column, regime_changed: Column, neutral: float = 0.005, severe: float = 0.02) -> Column:
    """TRUE_POSITIVE, NEUTRAL, REGIME_MISMATCH (a large loss after the regime changed), FALSE_POSITIVE(_SEVERE)."""
    signed = F.when(direction == "SHORT", -ret).otherwise(ret)
    return F.when(ret.isNull(), None).when(F.abs(ret) < neutral, "NEUTRAL").when(signed > 0, "TRUE_POSITIVE").when(regime_changed & (signed < -severe), "REGIME_MISMATCH").when(signed < -severe, "FALSE_POSITIVE_SEVERE").otherwise("FALSE_POSITIVE")


def skill_metrics(outcomes: DataFrame) -> DataFrame:
    """Per producer: counts, accuracy = TP / (TP + FP), FP rate, mean return."""

    def n(*names: str) -> Column:
        return F.count_if(F.col("category").isin(*names))

    tp, fp = n("TRUE_POSITIVE"), n("FALSE_POSITIVE", "FALSE_POSITIVE_SEVERE")
    return outcomes.groupBy("skill").agg(
        F.count("*").alias("n"), tp.alias("tp"), fp.alias("fp"), n("FALSE_POSITIVE_SEVERE").alias("severe"), n("REGIME_MISMATCH").alias("mismatch"), n("NEUTRAL").alias("neutral"),
        F.when(tp + fp > 0, tp / (tp + fp)).alias("accuracy"), (fp / F.count("*")).alias("fp_rate"), F.avg("ret5").alias("mean_ret"),
    )


def weight_feedback(metrics: DataFrame, least: int = 20, target: float = 0.55) -> DataFrame:
    """New weight of producers with enough outcomes, where it moves by 0.05 or more."""
    weight = clamp(1 + (F.col("accuracy") - target) * 0.5, 0.3, 2.0)
    return metrics.where(F.col("n") >= least).select("skill", "n", weight.alias("weight"), F.when(F.col("accuracy") >= target, "raise").otherwise("lower").alias("action")).where(F.abs(F.col("weight") - 1) >= 0.05)


def improvement_backlog(metrics: DataFrame) -> DataFrame:
    """One row per producer and rule that it breaks: FP rate over 0.15, mismatch over 0.25, severe over 0.10."""
    n = F.col("n")
    rules = (("fp_rate", F.col("fp") / n, 0.15), ("mismatch", F.col("mismatch") / n, 0.25), ("severe", F.col("severe") / n, 0.10))
    found = F.explode(F.array_compact(F.array(*[F.when(x > lim, F.struct(F.lit(k).alias("rule"), x.alias("rate"))) for k, x, lim in rules])))
    return metrics.select("skill", found.alias("x")).select("skill", "x.*")


def worst_regime(outcomes: DataFrame, least: int = 5, rate: float = 0.2) -> DataFrame:
    fp = F.count_if(F.col("category").startswith("FALSE_POSITIVE")) / F.count("*")
    rows = outcomes.groupBy("skill", "regime").agg(F.count("*").alias("n"), fp.alias("rate"))
    ok = (F.col("n") >= least) & (F.col("rate") > rate)
    return rows.groupBy("skill").agg(F.coalesce(F.max_by("regime", F.when(ok, F.struct("rate", "regime"))), F.lit("NONE")).alias("regime"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Outcomes by producer, by month and by category, in one pass."""
    rows = outcomes.withColumn("month", F.date_format("date", "yyyy-MM"))
    return rows.groupingSets([["skill"], ["month"], ["category"]], "skill", "month", "category").agg(F.count("*").alias("n"), F.avg("ret5").alias("mean_ret"), F.grouping_id().cast("int").alias("level"))


def concept_clusters(tickets: DataFrame, top: int = 10) -> DataFrame:
    """By (hypothesis, regime): count, mean priority and the commonest symbols."""
    key = ["hypothesis", "regime"]
    ranked = tickets.groupBy(*key, "symbol").agg(F.count("*").alias("c")).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), "symbol"))).where(F.col("k") <= top)
    names = ranked.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "symbol"))), lambda x: x["symbol"]), ",").alias("symbols"))
    return tickets.groupBy(*key).agg(F.count("*").alias("n"), F.avg("priority").alias("mean_priority")).join(names, key)


def merge_concepts(concepts: DataFrame, least: float = 0.75) -> DataFrame:
    """Greedy merge within a hypothesis where one concept's conditions hold over `least` of the smaller set."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n", "concept_id"], ascending=[False, True])
        kept: list[dict] = []
        for row in g.to_dict("records"):
            mine = set(row["conditions"])
            for k in kept:
                low = min(len(mine), len(k["set"]))
                if low and len(mine & k["set"]) / low > least:
                    k["priority"] = (k["priority"] * k["n"] + row["priority"] * row["n"]) / (k["n"] + row["n"])
                    k["n"] += row["n"]
                    k["set"] |= mine
                    break
            else:
                kept.append({"hypothesis": row["hypothesis"], "concept_id": row["concept_id"], "n": row["n"], "priority": row["priority"], "set": mine})
        return pd.DataFrame([{k: v for k, v in x.items() if k != "set"} | {"conditions": len(x["set"])} for x in kept])

    return concepts.groupBy("hypothesis").applyInPandas(run, "hypothesis string, concept_id string, n long, priority double, conditions long")


def position_outcomes(fills: DataFrame) -> DataFrame:
    """Closed positions from fills (position, kind, date, shares, price; sells negative): realised P&L, % of cost, days."""
    buy = F.col("shares") > 0
    cost = F.sum(F.when(buy, F.col("shares") * F.col("price")))
    out = fills.groupBy("position", "kind").agg(F.sum("shares").alias("left"), cost.alias("cost"), (-F.sum(F.col("shares") * F.col("price"))).alias("pnl"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    return out.where("left = 0").select("position", "kind", "pnl", (F.col("pnl") / F.col("cost") * 100).alias("pnl_pct"), "days")


def outcome_stats(positions: DataFrame) -> DataFrame:
    """Win rate and means, overall and by kind."""
    return positions.rollup("kind").agg(F.count("*").alias("n"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("pnl_pct").alias("mean_pct"), F.avg("days").alias("mean_days"), F.grouping_id().cast("int").alias("level"))


def backtest_quality(trades: DataFrame, parameters: int, slippage_tested: bool) -> DataFrame:
    """Per strategy from trades (strategy, at, date, pnl in %): win rate, expectancy, profit factor (null without losses),
    largest drawdown of the running sum, whole years; scores of 0 to 20 for sample, expectancy, risk, robustness and
    realism, their total, verdict and red flags. A strategy's trades are range-sorted, so it may hold most of the table.
    """
    rows = drawdowns(trades, ["strategy"], [F.col("at")], "pnl")
    win, pnl = F.col("pnl") > 0, F.col("pnl")
    m = rows.groupBy("strategy").agg(
        F.count("*").alias("n"), (F.avg(F.when(win, 1.0).otherwise(0.0)) * 100).alias("win_rate"), F.coalesce(F.avg(F.when(win, pnl)), F.lit(0.0)).alias("aw"), F.coalesce(-F.avg(F.when(~win, pnl)), F.lit(0.0)).alias("al"),
        F.max("dd").alias("max_drawdown"), F.floor(F.datediff(F.max("date"), F.min("date")) / 365).alias("years"))
    share = F.col("win_rate") / 100
    m = m.withColumn("expectancy", F.round(share * F.col("aw") - (1 - share) * F.col("al"), 9)).withColumn("profit_factor", F.round(share * F.col("aw") / F.nullif((1 - share) * F.col("al"), F.lit(0.0)), 9))
    n, ex, pf, dd, yr = F.col("n"), F.col("expectancy"), F.col("profit_factor"), F.round("max_drawdown", 9), F.col("years")
    params = 5 if parameters <= 4 else 3 if parameters <= 6 else 1 if parameters == 7 else 0
    scores = {
        "sample": F.when(n < 30, 0).when(n < 100, 8 + F.floor((n - 30) / 70 * 7)).when(n < 200, 15 + F.floor((n - 100) / 100 * 5)).otherwise(20),
        "expectancy_score": F.when(ex <= 0, 0).when(ex < 0.5, 5 + F.floor(ex / 0.5 * 5)).when(ex < 1.5, 10 + F.floor((ex - 0.5) * 8)).otherwise(20),
        "risk": F.when(dd >= 50, 0).otherwise(F.least(F.lit(20), F.when(dd < 20, 12).otherwise(F.floor(12 * (50 - dd) / 30)) + F.when(pf.isNull() | (pf >= 3), 8).when(pf < 1, 0).otherwise(F.floor((pf - 1) / 2 * 8)))),
        "robustness": F.least(F.lit(20), F.when(yr < 5, 0).when(yr >= 10, 15).otherwise(5 + F.floor((yr - 5) / 5 * 10)) + params), "realism": F.lit(20 if slippage_tested else 0),
    }
    flags = [
        (n < 30, "small_sample"), (F.lit(not slippage_tested), "no_slippage_test"), (F.col("max_drawdown") > 50, "excessive_drawdown"), (F.lit(parameters >= 7), "over_optimized"), (yr < 5, "short_test_period"),
        (ex < 0, "negative_expectancy"), ((F.col("win_rate") > 90) & (F.col("max_drawdown") < 5), "too_good"),
    ]
    out = m.select("strategy", "n", "win_rate", "expectancy", "profit_factor", "max_drawdown", "years", *[c.cast("long").alias(k) for k, c in scores.items()], F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in flags])), ",").alias("red_flags"))
    out = out.withColumn("total", sum((F.col(k) for k in scores), F.lit(0)).cast("long"))
    return out.withColumn("verdict", F.when(F.col("total") >= 70, "Deploy").when(F.col("total") >= 40, "Refine").otherwise("Abandon"))


def best_per_key(rows: DataFrame, key: str, score: str, ties: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), ties))).where("_n = 1").drop("_n")


def top_bottom(rows: DataFrame, score: str, ties: str, n: int) -> DataFrame:
    """Both ends of one ranking, no row at both: end = top or bottom, place from 1."""
    top = rows.orderBy(F.desc(score), ties).limit(n).withColumn("end", F.lit("top"))
    low = rows.orderBy(F.asc(score), F.desc(ties)).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(low.join(top.select(ties), ties, "left_anti"))


def merge_and_rank(rows: DataFrame, key: str, score: str, source: str, n: int) -> DataFrame:
    """One row per key: sorted distinct sources, largest score, first n."""
    return rows.groupBy(key).agg(F.max(score).alias(score), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources")).orderBy(F.desc(score), key).limit(n)


def differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys on one side only, and fields that differ."""
    left, right = a.select(key, F.struct(*fields).alias("l")), b.select(key, F.struct(*fields).alias("r"))
    both = left.join(right, key, "full")
    what = F.when(F.col("r").isNull(), F.array(F.lit("only_left"))).when(F.col("l").isNull(), F.array(F.lit("only_right"))).otherwise(F.array_compact(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields])))
    return both.select(key, F.explode(what).alias("difference"))
