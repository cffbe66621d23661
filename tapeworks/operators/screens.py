"""Filters, gates and small rankings of screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.features import by, frame, full
from tapeworks.operators.folds import fold
from tapeworks.operators.ordered import islands, numbered


def prefilter_quote(quotes: DataFrame, price: float = 10.0, volume: float = 200_000.0, above: float = 0.2, below: float = 0.3) -> DataFrame:
    """passed, likelihood from close, avg_volume, year_high, year_low."""
    up, down = F.col("close") / F.col("year_low") - 1, 1 - F.col("close") / F.col("year_high")
    ok = (F.col("close") > price) & (F.col("avg_volume") >= volume) & (up >= above) & (down <= below)
    return quotes.select("symbol", "date", ok.alias("passed"), (F.least(up, F.lit(1.0)) * 50 + (1 - down) * 50).alias("likelihood"))


def tradable_common_stock(profiles: DataFrame) -> DataFrame:
    """Active common stocks with a symbol."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return profiles.where(~flag("is_etf") & ~flag("is_fund") & F.coalesce("is_active", F.lit(True)) & (F.trim("symbol") != ""))


def stale_price(bars: DataFrame, n: int = 10, limit: float = 1.0) -> DataFrame:
    """Symbols whose mean daily range of the last n bars is under limit %; fewer bars are not stale."""
    last = bars.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_k") <= n)
    return last.groupBy("symbol").agg(((F.count("*") == n) & (F.avg((F.col("high") - F.col("low")) / F.col("close") * 100) < limit)).alias("is_stale"))


def entry_ready(rows: DataFrame) -> DataFrame:
    """entry_ready: a valid pattern in an entry state, -8 to 3 % from its pivot, dry volume, risk of 0 to 15 %."""
    bad = F.col("state").isin("Invalid", "Damaged", "Overextended", "Extended", "Early-post-breakout")
    ok = ~bad & F.col("distance_pct").between(-8, 3) & (F.col("dry_up") <= 1) & (F.col("risk_pct") > 0) & (F.col("risk_pct") <= 15) & F.col("valid")
    return rows.withColumn("entry_ready", F.coalesce(ok, F.lit(False)))


def earnings_entry_filter(rows: DataFrame, price: float = 30.0, gap: float = 0.10, score: float = 85.0) -> DataFrame:
    """Drops cheap symbols, and large gaps with high scores."""
    return rows.where((F.col("price") >= price) & ~((F.abs("gap") >= gap) & (F.col("score") >= score)))


#: Limits by mode (market cap, dollar volume).
MODES = {"largecap": (2e9, 2e7), "classic": (3e8, 5e6)}


def hard_invalidation(rows: DataFrame, mode: str = "largecap", price: float = 5.0, listed: int = 60, blackout: int = 2) -> DataFrame:
    """reasons: why a candidate is out."""
    cap, adv = MODES[mode]
    tests = (("earnings", F.col("earnings_in") <= blackout), ("market_cap", F.col("market_cap") < cap), ("liquidity", F.col("adv") < adv), ("price", F.col("price") < price), ("listed", F.col("days_listed") < listed))
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))


def filter_earnings_calendar(earnings: DataFrame, profiles: DataFrame, least: float = 2e9, exchanges: tuple[str, ...] = ("NYSE", "NASDAQ", "AMEX")) -> DataFrame:
    return earnings.join(profiles.where((F.col("market_cap") >= least) & F.col("exchange").isin(*exchanges)), "symbol")


def grade_gate(rows: DataFrame, grade: str) -> DataFrame:
    """Rows of the grade or a better one; A is best."""
    return rows.where(F.col("grade") <= grade)


def review_due(ledger: DataFrame, as_of: str) -> DataFrame:
    return ledger.where(~F.col("status").isin("CLOSED", "INVALIDATED") & (F.try_to_date("next_review") <= F.lit(as_of).cast("date")))


def share_class_group(symbol: Column) -> Column:
    """The base symbol of a share class such as BRK.A or BRK-B; null for others."""
    base = F.regexp_extract(symbol, r"^([A-Z]+)[.\-][A-Z]$", 1)
    return F.when(base != "", base)


def dedupe_share_classes(profiles: DataFrame) -> DataFrame:
    """One row per share-class group: the largest market cap."""
    key = F.coalesce(share_class_group(F.col("symbol")), F.col("symbol"))
    return profiles.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("market_cap"), "symbol"))).where("_k = 1").drop("_k")


def cap_synthetic(tickets: DataFrame, ratio: float = 0.5, least: int = 3) -> DataFrame:
    """Synthetic rows, best first, up to max(ceil(real * ratio), least) per group; all real rows."""
    real = tickets.groupBy("grp").agg(F.count_if(~F.col("synthetic")).alias("_r"))
    rows = numbered(tickets, ["grp", "synthetic"], [F.desc("priority"), F.col("id")], "_k").join(real, "grp")
    return rows.where(~F.col("synthetic") | (F.col("_k") <= F.greatest(F.ceil(F.col("_r") * ratio), F.lit(least)))).drop("_k", "_r", "_size")


def rank_composite(rows: DataFrame, weights: dict[str, float], group: str) -> DataFrame:
    """Weighted (n - rank + 1) / n of each metric in its group (ties: symbol); a missing metric's weight goes to the others.

    Ranks come from a range sort for each metric, so a group may hold most rows.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, (c, w) in enumerate(weights.items()):
        counts = rows.groupBy(F.col(group).alias(f"_g{i}")).agg(F.count(c).alias(f"_n{i}"))
        rows = numbered(rows, [group], [F.desc_nulls_last(c), F.col("symbol")], f"_k{i}").drop("_size").join(counts, F.col(group).eqNullSafe(F.col(f"_g{i}"))).drop(f"_g{i}")
        have = F.col(c).isNotNull()
        total = total + F.when(have, (F.col(f"_n{i}") - F.col(f"_k{i}") + 1) / F.col(f"_n{i}") * w).otherwise(0.0)
        weight = weight + F.when(have, w).otherwise(0.0)
    return rows.withColumn("composite", F.when(weight > 0, total / weight)).drop(*[f"_{x}{i}" for i in range(len(weights)) for x in "nk"])


def sector_strength(rows: DataFrame, ret: str) -> DataFrame:
    """Rank of a return in its sector as (n - rank) / n * 100 over rows that have one; leaders from 80."""
    ranked = numbered(rows.where(F.col(ret).isNotNull()), ["sector"], [F.desc(ret)], "_k", ranked=True)
    x = (F.col("_size") - F.col("_k")) / F.col("_size") * 100
    return ranked.select("symbol", "sector", x.alias("strength"), (x >= 80).alias("leader"))


def score_trend(history: DataFrame, n: int = 5) -> DataFrame:
    """Change over the last n stored scores: improving over 2, deteriorating under -2, else stable."""
    last = history.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_k") <= n)
    d = F.max_by("score", "date") - F.min_by("score", "date")
    return last.groupBy("symbol").agg(d.alias("delta"), F.when(d > 2, "improving").when(d < -2, "deteriorating").otherwise("stable").alias("trend"))


def plateau(iterations: DataFrame, n: int = 3, band: float = 3.0, low: float = 30.0) -> DataFrame:
    """Per strategy: a plateau if the last n scores lie within the band, and abandon / pivot / continue."""
    last = iterations.withColumn("_k", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("i")))).where(F.col("_k") <= n)
    out = last.groupBy("strategy").agg(F.count("*").alias("k"), (F.max("score") - F.min("score")).alias("spread"), F.max_by("score", "i").alias("now"), F.min_by("score", "i").alias("then"))
    flat = (F.col("k") == n) & (F.col("spread") <= band)
    return out.select("strategy", flat.alias("plateau"), F.when((F.col("now") < low) & (F.col("now") <= F.col("then")), "abandon").when(flat, "pivot").otherwise("continue").alias("advice"))


def stagnation(iterations: DataFrame, n: int = 3, band: float = 3.0, low: float = 30.0) -> DataFrame:
    """Per strategy from its evaluations (strategy, i, total, expectancy_score, risk, robustness, expectancy, profit_factor,
    max_drawdown in %, red_flags joined by commas, slippage_tested): what its latest one or its last n totals trigger, and
    the advice: abandon (n totals that never rise, the last under `low`), else pivot on a trigger, else continue.

    plateau: n totals with a spread under the band. overfitting: expectancy and risk scores of 15 or more, robustness under
    10, and a flag of over-optimisation or a short test. cost_defeat: tested for slippage with expectancy under 0.3 and a
    profit factor under 1.3. tail_risk: drawdown over 35 % or a risk score of 5 at most. Null values trigger nothing."""
    last = iterations.withColumn("_k", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("i")))).where(F.col("_k") <= n)
    fields = ["total", "expectancy_score", "risk", "robustness", "expectancy", "profit_factor", "max_drawdown", "red_flags", "slippage_tested"]
    runs = F.array_sort(F.collect_list(F.struct("_k", "total")))
    out = last.groupBy("strategy").agg(F.count("*").alias("k"), (F.max("total") - F.min("total")).alias("spread"), runs.alias("runs"), F.min_by(F.struct(*fields), "_k").alias("e"))
    falls = F.forall(F.sequence(F.lit(1), F.lit(n - 1)), lambda j: F.col("runs")[j - 1]["total"] <= F.col("runs")[j]["total"])
    tests = {
        "plateau": (F.col("k") == n) & (F.col("spread") < band),
        "overfitting": (F.col("e.expectancy_score") >= 15) & (F.col("e.risk") >= 15) & (F.col("e.robustness") < 10) & F.arrays_overlap(F.split("e.red_flags", ","), F.array(F.lit("over_optimized"), F.lit("short_test_period"))),
        "cost_defeat": F.col("e.slippage_tested") & (F.col("e.expectancy") < 0.3) & (F.col("e.profit_factor") < 1.3),
        "tail_risk": F.coalesce(F.col("e.max_drawdown") > 35, F.lit(False)) | F.coalesce(F.col("e.risk") <= 5, F.lit(False)),
    }
    flags = {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}
    give_up = F.coalesce(F.when(F.col("k") == n, (F.col("e.total") < low) & falls), F.lit(False))
    advice = F.when(give_up, "abandon").when(F.greatest(*flags.values()), "pivot").otherwise("continue")
    return out.select("strategy", *[c.alias(name) for name, c in flags.items()], advice.alias("advice"))


#: Words that name no theme.
STOP_WORDS = ("Services", "Products", "Equipment", "Materials", "General", "Other", "Specialty", "Diversified", "Regulated", "Independent", "&", "-", "and")


def discover_clusters(rows: DataFrame, group: list[str], value: str, name: str, vector: list[str], gap: float = 3.0, far: float = 0.5) -> DataFrame:
    """group, cluster, n, mean and label of runs of two rows or more: sorted by value from the highest (ties: name), a row
    joins the one before it if their values are at most gap apart and their vectors, each component divided by its range in
    the group, at most far.

    A missing value or component counts as 0; a component without range plays no part. The label joins the two commonest
    words of the names (ties: the word that comes first in the run), without stop words, brackets and commas.
    """
    zero = rows.select(*group, name, *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in dict.fromkeys([value, *vector])])
    spans = zero.groupBy(*group).agg(*[(F.max(c) - F.min(c)).alias(f"_r_{c}") for c in vector]) if group else zero.agg(*[(F.max(c) - F.min(c)).alias(f"_r_{c}") for c in vector])
    if group:
        spans = spans.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[f"_r_{c}" for c in vector])
        on = F.lit(True)
        for c in group:
            on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        zero = zero.join(spans, on).drop(*[f"_g_{c}" for c in group])
    else:
        found = spans.first()  # one row
        zero = zero.select("*", *[F.lit(found[f"_r_{c}"]).alias(f"_r_{c}") for c in vector])
    gaps = [F.when(F.col(f"_r_{c}") > 0, F.pow((F.col(c) - F.col(f"_p_{c}")) / F.col(f"_r_{c}"), 2)).otherwise(0.0) for c in vector]
    near = (F.abs(F.col(value) - F.col(f"_p_{value}")) <= gap) & (F.sqrt(sum(gaps, F.lit(0.0))) <= far)
    rows = islands(zero, group, [F.desc(value), F.col(name)], list(dict.fromkeys([value, *vector])), near, "cluster")
    key = [*group, "cluster"]
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where("n >= 2")
    words = rows.select(*key, value, name, F.posexplode(F.split(name, r"\s+")).alias("_i", "_w")).withColumn("_w", F.regexp_replace("_w", r"^[(),]+|[(),]+$", "")).where((F.col("_w") != "") & ~F.col("_w").isin(*STOP_WORDS))
    counts = words.groupBy(*key, "_w").agg(F.count("*").alias("_c"), F.min(F.struct((-F.col(value)).alias("v"), F.col(name), F.col("_i"))).alias("_f"))
    best = counts.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("c"), F.col("_f"), F.col("_w").alias("w")))), 1, 2).alias("_b"))
    best = best.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.concat(F.array_join(F.transform("_b", lambda x: x["w"]), " & "), F.lit(" Related")).alias("label"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return out.join(best, on, "left").select(*key, "n", "mean", F.coalesce("label", F.lit("Unknown Cluster")).alias("label"))


def theme_match(industries: DataFrame, themes: dict[str, list[str]], key: str, least: int = 2) -> DataFrame:
    """Themes whose keywords occur in at least `least` industries: theme and number of members."""
    hits = F.array_compact(F.array(*[F.when(F.lower(key).rlike("|".join(words)), F.lit(t)) for t, words in themes.items()]))
    return industries.select(key, F.explode(hits).alias("theme")).groupBy("theme").agg(F.count("*").alias("members")).where(F.col("members") >= least)


def unmatched(industries: DataFrame, themes: dict[str, list[str]], key: str) -> DataFrame:
    every = "|".join(w for words in themes.values() for w in words)
    return industries.where(~F.lower(key).rlike(every)).select(key)


def news_reaction(news: DataFrame, tradable: DataFrame, n: int = 10) -> DataFrame:
    """The n largest reactions with the tradable row where there is one; score 70 * size / 12 % + 20, at most 90."""
    rows = news.join(tradable, "symbol", "left")
    score = 70 * F.least(F.lit(1.0), F.abs("reaction") / 0.12) + 20
    return rows.withColumn("score", F.round(score, 2)).orderBy(F.desc(F.abs("reaction")), "symbol").limit(n)


def trend_trades(bars: DataFrame, n: int = 20) -> DataFrame:
    """Long while the close is above its mean: entry, exit (or the last bar) and return of every stay."""
    rows = bars.withColumn("m", full(F.avg("close"), "close", n)).withColumn("on", F.coalesce(F.col("close") > F.col("m"), F.lit(False)))
    rows = rows.withColumn("next", F.lead("close").over(by())).withColumn("nextd", F.lead("date").over(by())).withColumn("g", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(by()))
    out = rows.where("on").groupBy("symbol", "g").agg(F.min("date").alias("entry"), F.min_by("close", "date").alias("a"), F.max_by(F.coalesce("next", "close"), "date").alias("b"), F.max_by(F.coalesce("nextd", "date"), "date").alias("exit"))
    return out.select("symbol", "entry", "exit", (F.col("b") / F.col("a") - 1).alias("ret"))


def trade_summary(trades: DataFrame, bars: DataFrame, warm: int) -> DataFrame:
    """Per symbol with bars: trades (symbol, entry, exit, ret), share won, mean return, compounded return, mean bars held, and
    the return of holding from the bar `warm` (the last one if there are fewer) to the last. Each trade counts at four decimals; a null share without trades."""
    numbered = bars.select("symbol", "date", F.row_number().over(by()).alias("i"), "close")
    at = numbered.select("symbol", "date", "i")
    rows = trades.join(at.withColumnRenamed("date", "entry").withColumnRenamed("i", "i0"), ["symbol", "entry"]).join(at.withColumnRenamed("date", "exit").withColumnRenamed("i", "i1"), ["symbol", "exit"]).withColumn("r", F.round("ret", 4))
    total = F.when(F.min("r") <= -1, -1.0).otherwise(F.exp(F.sum(F.log1p("r"))) - 1)
    won = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("r").alias("mean_return"), total.alias("total_return"), F.avg(F.col("i1") - F.col("i0")).alias("mean_bars"))
    hold = numbered.groupBy("symbol").agg(F.max_by("close", "i").alias("b"), F.coalesce(F.max(F.when(F.col("i") == warm, F.col("close"))), F.max_by("close", "i")).alias("a"))
    out = hold.join(won, "symbol", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("mean_return", "total_return", "mean_bars")}
    return out.select("symbol", F.coalesce("n", F.lit(0)).alias("trades"), F.round("win_rate", 3).alias("win_rate"), F.round(zero["mean_return"], 4).alias("mean_return"), F.round(zero["total_return"], 4).alias("total_return"), F.round(F.when(F.col("a") != 0, F.col("b") / F.col("a") - 1).otherwise(0.0), 4).alias("hold_return"), F.round(zero["mean_bars"], 1).alias("mean_bars"))


def power_trend(bars: DataFrame) -> DataFrame:
    """Close over the 21 bar exponential mean, that over the 50 bar mean, and this one above its value five bars ago."""
    means = fold(bars, "indicators").select("symbol", "date", F.col("ema21").alias("s"))
    rows = bars.withColumn("m", full(F.avg("close"), "close", 50)).withColumn("m5", F.lag("m", 5).over(by())).join(means, ["symbol", "date"])
    return rows.select("symbol", "date", F.coalesce((F.col("s") > F.col("m")) & (F.col("m") > F.col("m5")) & (F.col("close") > F.col("s")), F.lit(False)).alias("power"))


def gap_downs(bars: DataFrame, gap: float = -0.005, times: float = 1.1, n: int = 5) -> DataFrame:
    """Opens at least 0.5 % under the close before on 1.1 times the volume, counted over n bars."""
    return bars.withColumn("_h", _gap_down(gap, times)).select("symbol", "date", F.sum("_h").over(frame(n)).alias("gap_downs"))


def _gap_down(gap: float, times: float) -> Column:
    hit = (F.col("open") / F.lag("close").over(by()) - 1 <= gap) & (F.col("volume") > times * F.lag("volume").over(by()))
    return F.coalesce(hit, F.lit(False)).cast("int")


def weakness(bars: DataFrame, n: int = 20, rally: int = 15, drop: float = -2.0) -> DataFrame:
    """Per bar: lower_highs (the last two highs over both neighbours among n bars fall), failed_rally (the highest close of
    `rally` bars, the latest of equals, lies 3 to 10 bars back and the close over 2 % under it), gap_down (gap_downs in the
    last five bars). False with fewer bars than that, six for gaps."""
    h, bar = F.col("high"), F.row_number().over(by())
    rows = bars.withColumn("_h", _gap_down(-0.005, 1.1)).withColumn("gap_downs", F.sum("_h").over(frame(5))).withColumn("i", bar)
    rows = rows.withColumn("top", F.when((h > F.lag("high").over(by())) & (h > F.lead("high").over(by())), h))
    tops = F.collect_list("top").over(by().rowsBetween(2 - n, -1))  # the next bar of each is within reach
    peak = F.max(F.struct("close", "i")).over(frame(rally))
    rows = rows.withColumn("tops", tops).withColumn("peak", peak)
    back, fall = F.col("i") - F.col("peak.i"), F.round((F.col("close") / F.col("peak.close") - 1) * 100, 9)
    flags = {
        "lower_highs": (F.col("i") >= n) & (F.size("tops") >= 2) & (F.try_element_at("tops", F.lit(-1)) < F.try_element_at("tops", F.lit(-2))),
        "failed_rally": (F.col("i") >= rally) & back.between(3, 10) & (fall < drop),
        "gap_down": (F.col("i") >= 6) & (F.col("gap_downs") > 0),
    }
    return rows.select("symbol", "date", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])


def forward_outcome(detections: DataFrame, bars: DataFrame, n: int = 60) -> DataFrame:
    """What the n bars after each detection (symbol, bar, pivot, stop) did: whichever comes first of a close over the
    pivot (breakout) and one under the stop (stop hit), else timeout; largest gain and loss over the whole window."""
    numbered = bars.select("symbol", F.row_number().over(by()).alias("b"), F.col("close").alias("c"))
    start = numbered.select("symbol", F.col("b").alias("bar"), F.col("c").alias("c0"))
    rows = detections.join(start, ["symbol", "bar"]).withColumn("b", F.explode(F.sequence(F.col("bar") + 1, F.col("bar") + n))).join(numbered, ["symbol", "b"])
    out = rows.groupBy("symbol", "bar", "pivot", "stop", "c0").agg(F.min(F.when(F.col("c") > F.col("pivot"), F.col("b"))).alias("up"), F.min(F.when(F.col("c") < F.col("stop"), F.col("b"))).alias("down"), F.max("c").alias("hi"), F.min("c").alias("lo"))
    what = F.when(F.col("up") <= F.coalesce("down", "up"), "breakout").when(F.col("down").isNotNull(), "stop_hit").otherwise("timeout")
    return out.select("symbol", "bar", what.alias("outcome"), (F.least("up", "down") - F.col("bar")).alias("days"), (F.col("hi") / F.col("c0") - 1).alias("max_gain"), (F.col("lo") / F.col("c0") - 1).alias("max_loss"))


def distinct_hints(hints: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each lower-cased key."""
    key = F.concat_ws("|", *[F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys])
    return hints.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


def common_dates(bars: DataFrame, a: str, b: str) -> DataFrame:
    """Dates on which both symbols have a positive close."""
    one = lambda s: bars.where((F.col("symbol") == s) & (F.col("close") > 0)).select("date")
    return one(a).intersect(one(b))


def index_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table only, with the side."""
    left, right = a.select(key), b.select(key)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
