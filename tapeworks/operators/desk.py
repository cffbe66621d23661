"""Selections for the trading desk: recent reversals, pair order, diverse picks, futures shocks, named holders, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.features import by, full, rolling_zscore
from tapeworks.operators.patterns import candlestick_patterns, volume_bucket


def recent_volume_reversals(bars: DataFrame, patterns: tuple[str, ...] = ("hanging_man", "shooting_star"), n: int = 20, high: float = 1.5, within: int = 1) -> DataFrame:
    """Chosen patterns completed on a symbol's last `within` bars with a high volume bucket: symbol, pattern, date,
    bars_ago and the volume's ratio to the n bars before. Symbols of under n + 3 bars are left out."""
    last = bars.groupBy("symbol").agg(F.count("*").alias("last")).where(F.col("last") >= n + 3)
    base = full(F.avg("volume"), "volume", n, 1)
    volume = volume_bucket(bars, n, high).withColumn("ratio", F.round(F.col("volume") / base, 2)).where("bucket = 'high'").select("symbol", "date", "ratio")
    hits = candlestick_patterns(bars).where(F.col("pattern").isin(*patterns)).join(last, "symbol").withColumn("bars_ago", F.col("last") - F.col("bar")).where(F.col("bars_ago") < within)
    return hits.join(volume, ["symbol", "date"]).select("symbol", "pattern", "date", "bars_ago", F.col("ratio").alias("vol_ratio")).orderBy("bars_ago", F.desc("vol_ratio"), "symbol", "pattern")


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs by p-value, then by |z| (null as 0), as one range sort."""
    return pairs.orderBy("p_value", F.desc(F.abs(F.coalesce("z", F.lit(0.0)))), "a", "b")


def novelty(source: Column, target: Column) -> Column:
    """Jaccard distance of two sets; 0 for two empty ones."""
    both, either = F.size(F.array_intersect(source, target)), F.size(F.array_union(source, target))
    return F.when(either == 0, 0.0).otherwise(1 - both / either)


def diverse_top(proposals: DataFrame, k: int = 3) -> DataFrame:
    """The k best proposals of each source, one for each archetype: 0.6 quality and 0.4 novelty, then novelty, then id.

    proposals: source, id, archetype, quality, source_modules, target_modules."""
    rows = proposals.withColumn("novelty", novelty(F.col("source_modules"), F.col("target_modules"))).withColumn("combined", F.round(0.6 * F.col("quality") + 0.4 * F.col("novelty"), 4))
    order = F.struct((-F.col("combined")).alias("c"), (-F.col("novelty")).alias("n"), F.col("id"))
    best = rows.groupBy("source", "archetype").agg(F.min(order).alias("b"))  # combined before the shuffle
    kept = best.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("b"))).where(F.col("k") <= k)
    return kept.select("source", "archetype", F.col("b.id").alias("id"), (-F.col("b.c")).alias("combined"), F.round(-F.col("b.n"), 4).alias("novelty"), F.col("k").cast("long").alias("place"))


def futures_trigger(futures: DataFrame, related: DataFrame, limit: float = 2.0) -> DataFrame:
    """Candidates of each session: symbols related to a future whose return is `limit` deviations out (60 bars, 30 at
    least), with 20 points and 15 for each deviation up to 4. futures: symbol, date, close; related: future, symbol."""
    w = by()
    rows = futures.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    shocks = rolling_zscore(rows, "ret").where(F.abs("ret_z") >= limit).select(F.col("symbol").alias("future"), "date", F.col("ret_z").alias("z"))
    score = F.least(F.abs("z") / 4, F.lit(1.0)) * 60 + 20
    return shocks.join(related, "future").select("date", F.upper("symbol").alias("symbol"), "future", F.round("z", 3).alias("z"), F.round(score, 2).alias("score"))


def named_holders(holders: DataFrame, names: list[str]) -> DataFrame:
    """symbol, whether a holder's name contains one of a short list of names (in any case), and those holders."""
    held = F.upper("holder")
    hit = F.coalesce(F.reduce(F.array(*[F.contains(held, F.lit(n.upper())) for n in names]), F.lit(False), lambda a, x: a | x), F.lit(False))
    found = holders.groupBy("symbol").agg(F.array_sort(F.collect_set(F.when(hit, F.col("holder")))).alias("found"))
    return found.select("symbol", (F.size("found") > 0).alias("flag"), F.array_join("found", ",").alias("names"))


def rule_hints(days: DataFrame, anomalies: DataFrame, news: DataFrame, most: int = 6, news_limit: float = 0.06) -> DataFrame:
    """Hints of each date from its regime, its `most` largest anomalies of 2.5 or more and its large news reactions:
    date, title, hypothesis, family, symbol, regime, mechanism.

    days: date, regime; anomalies: date, symbol, metric (gap, rel_volume), z; news: date, symbol, reaction."""
    cols = ["date", "title", "hypothesis", "family", "symbol", "regime", "mechanism"]

    def hint(rows: DataFrame, title: Column, hypothesis: Column, family: Column, symbol: Column, mechanism: Column) -> DataFrame:
        return rows.select("date", title.alias("title"), hypothesis.alias("hypothesis"), family.alias("family"), symbol.alias("symbol"), "regime", mechanism.alias("mechanism")).select(*cols)

    on = F.col("regime") == "RiskOn"
    none = F.lit(None).cast("string")
    market = hint(
        days.where(F.col("regime").isin("RiskOn", "RiskOff")), F.when(on, "Breadth-supported breakout regime").otherwise("Risk-off selectivity"), F.when(on, "breakout").otherwise("regime_shift"),
        F.when(on, "pivot_breakout"), none, F.when(on, "behavior").otherwise("risk_premium"),
    )
    top = anomalies.withColumn("_k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("z")), "symbol", "metric"))).where(F.col("_k") <= most)
    up, down, flow = (F.col("metric") == "gap") & (F.col("z") >= 2.5), (F.col("metric") == "gap") & (F.col("z") <= -2.5), (F.col("metric") == "rel_volume") & (F.abs("z") >= 2.5)
    top = top.where(up | down | flow).where("symbol <> ''").withColumn("symbol", F.upper("symbol")).join(days, "date", "left")
    odd = hint(
        top, F.concat(F.when(up, "Positive gap shock in ").when(down, "Downside overreaction watch in ").otherwise("Participation spike in "), F.col("symbol")), F.when(down, "panic_reversal").otherwise("breakout"),
        F.when(up, "gap_up_continuation").when(down, "panic_reversal").otherwise("pivot_breakout"), F.col("symbol"), F.when(flow, "flow").otherwise("behavior"),
    )
    moved = news.where((F.abs("reaction") >= news_limit) & (F.col("symbol") != "")).withColumn("symbol", F.upper("symbol")).join(days, "date", "left")
    said = hint(moved, F.concat(F.when(F.col("reaction") >= 0, "News drift continuation in ").otherwise("News shock reversal in "), F.col("symbol")), F.lit("news_reaction"), F.lit("news_reaction"), F.col("symbol"), F.lit("behavior"))
    return market.unionByName(odd).unionByName(said)
