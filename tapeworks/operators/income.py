"""Statements, dividends, ownership and earnings calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import cagr


def fundamental_growth(statements: DataFrame) -> DataFrame:
    """Year-on-year growth of revenue and eps against four quarters before (absolute base; null on 0)."""
    w = Window.partitionBy("symbol").orderBy("period")

    def yoy(c: str) -> Column:
        back = F.lag(c, 4).over(w)
        return F.when(back != 0, (F.col(c) - back) / F.abs(back) * 100)

    return statements.select("symbol", "period", yoy("revenue").alias("revenue_yoy"), yoy("eps").alias("eps_yoy"))


def annual_growth(statements: DataFrame, years: int = 3) -> DataFrame:
    """By symbol: growth over the last whole years and whether no year fell."""
    w = Window.partitionBy("symbol").orderBy("year")
    rows = statements.groupBy("symbol", F.year("period").alias("year")).agg(F.sum("revenue").alias("revenue"), F.count("*").alias("q")).where("q = 4")
    rows = rows.withColumn("prev", F.lag("revenue").over(w)).withColumn("old", F.lag("revenue", years).over(w))
    rows = rows.withColumn("down", F.when(F.col("revenue") < F.col("prev"), 1).otherwise(0)).withColumn("downs", F.sum("down").over(w.rowsBetween(-(years - 1), 0)))
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("old", "revenue", "downs"), "year").alias("x"))
    return last.select("symbol", cagr(F.col("x.old"), F.col("x.revenue"), years).alias("cagr"), (F.col("x.downs") == 0).alias("no_down_year"))


def dividend_growth_calendar(dividends: DataFrame, as_of_year: int, years: int = 3) -> DataFrame:
    """Sums of whole years before as_of_year (to nine decimals, so that the order of adding decides no tie): growth over the last years, no cut over 5 %, trailing growth run."""
    w = Window.partitionBy("symbol").orderBy("year")
    rows = dividends.groupBy("symbol", F.year("date").alias("year")).agg(F.round(F.sum("dividend"), 9).alias("paid")).where(F.col("year") < as_of_year)
    rows = rows.withColumn("prev", F.lag("paid").over(w)).withColumn("old", F.lag("paid", years).over(w)).withColumn("up", F.coalesce(F.col("paid") > F.col("prev"), F.lit(False)))
    rows = rows.withColumn("cut", F.coalesce(F.col("paid") < F.col("prev") * 0.95, F.lit(False))).withColumn("g", F.sum(F.when(F.col("up"), 0).otherwise(1)).over(w))
    rows = rows.withColumn("run", F.sum(F.when(F.col("up"), 1).otherwise(0)).over(Window.partitionBy("symbol", "g").orderBy("year"))).withColumn("cuts", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(-(years - 1), 0)))
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("old", "paid", "run", "cuts"), "year").alias("x"))
    return last.select("symbol", cagr(F.col("x.old"), F.col("x.paid"), years).alias("cagr"), F.col("x.run").alias("growth_years"), (F.col("x.cuts") == 0).alias("no_cut"))


def dividend_growth_ttm(dividends: DataFrame, as_of: str, years: int = 4) -> DataFrame:
    """Rolling 365-day sums ending k years before as_of, their growth, and whether none fell below 95 % of the last."""
    age = F.datediff(F.lit(as_of).cast("date"), "date")
    sums = [F.sum(F.when((age >= 365 * k) & (age < 365 * (k + 1)), F.col("dividend")).otherwise(0.0)).alias(f"y{k}") for k in range(years)]
    out = dividends.groupBy("symbol").agg(*sums)
    steady = F.lit(True)
    for k in range(years - 1):
        steady = steady & (F.col(f"y{k}") >= 0.95 * F.col(f"y{k + 1}"))
    return out.select("*", cagr(F.col(f"y{years - 1}"), F.col("y0"), years - 1).alias("cagr"), steady.alias("consistent"))


def dividend_stability(dividends: DataFrame) -> DataFrame:
    """(largest - smallest) / mean of yearly sums."""
    rows = dividends.groupBy("symbol", F.year("date").alias("year")).agg(F.sum("dividend").alias("paid"))
    return rows.groupBy("symbol").agg(F.count("*").alias("years"), ((F.max("paid") - F.min("paid")) / F.avg("paid")).alias("spread"))


def stability_score(dividends: DataFrame, as_of_year: int) -> DataFrame:
    """Per symbol with three or more whole years before as_of_year and four or more pays: spread in % of the mean (stable
    under 50), years in a row without a cut of over 5 % (a cut starts anew), growing (two such years and the last sum over
    the first), and the score: 40 if stable, else 40 less 0.4 a point of spread under 100; 30 if growing; 10 a year up to 30."""
    w = Window.partitionBy("symbol").orderBy("year")
    pays = dividends.groupBy("symbol").agg(F.count("*").alias("pays")).where("pays >= 4")
    rows = dividends.groupBy("symbol", F.year("date").alias("year")).agg(F.round(F.sum("dividend"), 9).alias("paid")).where(F.col("year") < as_of_year)
    rows = rows.withColumn("prev", F.lag("paid").over(w)).withColumn("held", F.coalesce(F.col("paid") >= F.col("prev") * 0.95, F.lit(False)))
    rows = rows.withColumn("g", F.sum(F.when(F.col("held"), 0).otherwise(1)).over(w)).withColumn("run", F.sum(F.when(F.col("held"), 1).otherwise(0)).over(Window.partitionBy("symbol", "g").orderBy("year")))
    out = rows.groupBy("symbol").agg(F.count("*").alias("years"), F.when(F.avg("paid") > 0, F.round((F.max("paid") - F.min("paid")) / F.avg("paid") * 100, 9)).alias("spread"), F.max_by("run", "year").alias("run"), F.min_by("paid", "year").alias("first"), F.max_by("paid", "year").alias("last"))
    out = out.where("years >= 3").join(pays, "symbol", "left_semi")
    stable, growing = F.coalesce(F.col("spread") < 50, F.lit(False)), (F.col("run") >= 2) & (F.col("last") > F.col("first"))
    calm = F.when(stable, 40.0).when(F.round("spread", 1) < 100, F.greatest(F.lit(0.0), 40 - F.round("spread", 1) * 0.4)).otherwise(0.0)
    score = F.round(calm + F.when(growing, 30).otherwise(0) + F.least(F.col("run") * 10, F.lit(30)), 1)
    return out.select("symbol", "years", "spread", F.col("run").alias("growth_years"), stable.alias("stable"), growing.alias("growing"), score.alias("score"))


def positive_trend(statements: DataFrame, value: str, years: int = 4) -> DataFrame:
    """Per symbol: whether the sums of its last `years` whole years rose from first to last with one fall at most; false
    with under three."""
    w = Window.partitionBy("symbol").orderBy("year")
    rows = statements.groupBy("symbol", F.year("period").alias("year")).agg(F.sum(value).alias("v"), F.count("*").alias("q")).where("q = 4")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year")))).where(F.col("k") <= years).withColumn("fell", F.coalesce(F.col("v") < F.lag("v").over(w), F.lit(False)))
    up = (F.count("*") >= 3) & (F.min_by("v", "year") < F.max_by("v", "year")) & (F.count_if(F.col("fell")) <= 1)
    return rows.groupBy("symbol").agg(F.count("*").alias("years"), F.count_if(F.col("fell")).alias("falls"), F.coalesce(up, F.lit(False)).alias("positive"))


def payout_and_health(latest: DataFrame) -> DataFrame:
    """Ratios of one row per symbol: payout of eps (or FFO for trusts), of free cash flow, debt / equity, current ratio."""
    base = F.when(F.col("is_reit"), F.col("ffo")).otherwise(F.col("net_income"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    out = latest.select("symbol", ratio(F.col("paid"), base).alias("payout"), ratio(F.col("paid"), F.col("fcf")).alias("fcf_payout"), ratio(F.col("debt"), F.col("equity")).alias("debt_equity"), ratio(F.col("current_assets"), F.col("current_liabilities")).alias("current_ratio"))
    return out.withColumn("sustainable", F.coalesce((F.col("payout") < 0.8) & (F.col("fcf_payout") < 1.0), F.lit(False))).withColumn("healthy", F.coalesce((F.col("debt_equity") < 2.0) & (F.col("current_ratio") > 1.0), F.lit(False)))


def ownership_change(holdings: DataFrame) -> DataFrame:
    """Per symbol from (symbol, quarter, shares, holders, coverage): the latest quarter against the one before; grade by
    coverage A from 0.9, B from 0.7; lower ones are left out."""
    w = Window.partitionBy("symbol").orderBy("quarter")
    rows = holdings.withColumn("ps", F.lag("shares").over(w)).withColumn("ph", F.lag("holders").over(w)).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("quarter")))).where("k = 1")
    out = rows.select("symbol", "quarter", F.when(F.col("ps") > 0, (F.col("shares") - F.col("ps")) / F.col("ps") * 100).alias("share_change_pct"), (F.col("holders") - F.col("ph")).alias("holder_change"), F.when(F.col("coverage") >= 0.9, "A").when(F.col("coverage") >= 0.7, "B").otherwise("C").alias("grade"))
    return out.where("grade <> 'C'")


def ownership_trend(holdings: DataFrame, quarters: int = 8) -> DataFrame:
    """Per symbol from (symbol, quarter, shares, holders): change over its last `quarters` quarters, shares in % (null from no
    shares) and holders."""
    rows = holdings.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("quarter")))).where(F.col("k") <= quarters)
    ends = rows.groupBy("symbol").agg(F.count("*").alias("quarters"), F.min_by(F.struct("shares", "holders"), "quarter").alias("a"), F.max_by(F.struct("shares", "holders"), "quarter").alias("b"))
    change = F.when(F.col("a.shares") > 0, (F.col("b.shares") - F.col("a.shares")) / F.col("a.shares") * 100)
    return ends.select("symbol", "quarters", change.alias("shares_trend_pct"), (F.col("b.holders") - F.col("a.holders")).alias("holders_trend"))


def holder_changes(holders: DataFrame) -> DataFrame:
    """Each holder's move in a symbol between its quarters: new, increased, decreased, unchanged, and the change in %."""
    w = Window.partitionBy("symbol", "holder").orderBy("quarter")
    prev = F.lag("shares").over(w)
    kind = F.when(prev.isNull(), "new").when(F.col("shares") > prev, "increased").when(F.col("shares") < prev, "decreased").otherwise("unchanged")
    return holders.select("symbol", "holder", "quarter", kind.alias("move"), F.when(prev > 0, (F.col("shares") - prev) / prev * 100).alias("change_pct"))


def calendar_summary(rows: DataFrame) -> DataFrame:
    """Counts of reports by date and timing with all subtotals."""
    return rows.cube("date", "timing").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def calendar_stats(rows: DataFrame, large: float = 10e9) -> DataFrame:
    """(kind, name, n) of reports (date, timing, sector, market_cap): all, large caps and the others, each sector (N/A for
    null), and the day with most reports (the earliest of equals)."""
    big = F.coalesce(F.col("market_cap") >= large, F.lit(False))
    totals = rows.agg(F.count("*").alias("total"), F.count_if(big).alias("large_cap"), F.count_if(~big).alias("mid_cap")).unpivot([], ["total", "large_cap", "mid_cap"], "name", "n").select(F.lit("total").alias("kind"), "name", "n")
    sectors = rows.groupBy(F.coalesce("sector", F.lit("N/A")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("sector").alias("kind"), "name", "n")
    days = rows.groupBy("date").agg(F.count("*").alias("n"))
    peak = days.orderBy(F.desc("n"), "date").limit(1).select(F.lit("peak").alias("kind"), F.col("date").cast("string").alias("name"), "n")
    return totals.unionByName(sectors).unionByName(peak)


#: Order of report times within a day; others last.
TIMINGS = {"bmo": 1, "amc": 2}


def calendar_order(rows: DataFrame) -> DataFrame:
    """Each day's reports numbered: before the open, after the close, others; the largest cap first, then the symbol."""
    first = F.coalesce(*[F.when(F.lower("timing") == k, v) for k, v in TIMINGS.items()], F.lit(3))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(first, F.desc_nulls_last("market_cap"), "symbol")))


#: Holding days for a qualified dividend, common and preferred.
COMMON_DAYS, PREFERRED_DAYS = 61, 91


def tax_class(kind: Column, days: Column) -> Column:
    return F.when(kind.isin("REIT", "BDC", "MLP"), "ORDINARY").when(days.isNull(), "ASSUMPTION").when(kind == "PREFERRED", F.when(days >= PREFERRED_DAYS, "QUALIFIED").otherwise("ORDINARY")).otherwise(F.when(days >= COMMON_DAYS, "QUALIFIED").otherwise("ORDINARY"))


def yield_entry(holdings: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Target yield = mean yield + alpha points, the price that gives it, and whether it is reached."""
    target = F.col("mean_yield") + alpha
    price = F.when((target > 0) & (F.col("annual_dividend") > 0), F.col("annual_dividend") / target * 100)
    return holdings.select("symbol", target.alias("target_yield"), price.alias("buy_price"), F.when(price.isNull(), "NO_DATA").when(F.col("price") <= price, "TRIGGERED").otherwise("WAIT").alias("signal"))


def dividend_yields(basis: DataFrame, prices: DataFrame) -> DataFrame:
    """The basis of each payer with its yields in % of the price: of the annualised pay, of the regular and of all pays of
    the last year; null without a positive price."""
    out = basis.join(prices.select("symbol", "price"), "symbol", "left")
    share = {"yield_pct": "annualized", "regular_ttm_yield_pct": "regular_ttm", "ttm_yield_pct": "ttm"}
    return out.select(*basis.columns, *[F.when(F.col("price") > 0, F.round(F.col(c) / F.col("price") * 100, 2)).alias(n) for n, c in share.items()])


def yield_signal(holdings: DataFrame, yields: DataFrame, alpha: float = 0.5, years: int = 5) -> DataFrame:
    """Per holding (symbol, price, declared, profile) with yearly yields (symbol, year, yield_pct): the annual dividend (the
    declared one, else the profile's), the mean of the last `years` yields, the target yield alpha points over it, the price
    that gives it, how far the price must fall, and TRIGGERED, WAIT, or ASSUMPTION-REQUIRED where a part is missing."""
    two = lambda x: F.round(F.round(x, 9), 2)
    rows = yields.where("yield_pct is not null").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year")))).where(F.col("k") <= years)
    means = rows.groupBy("symbol").agg(two(F.avg("yield_pct")).alias("mean_yield"), F.count("*").alias("observations"))
    out = holdings.join(means, "symbol", "left").withColumn("annual", F.coalesce("declared", "profile")).withColumn("target", two(F.col("mean_yield") + alpha))
    out = out.withColumn("buy_price", F.when(F.col("target") > 0, two(F.col("annual") / (F.col("target") / 100))))
    fall = F.when(F.col("price") > 0, two(F.greatest(F.lit(0.0), (F.col("price") - F.col("buy_price")) / F.col("price") * 100)))
    signal = F.when(F.col("price").isNull() | F.col("buy_price").isNull(), "ASSUMPTION-REQUIRED").when(F.col("price") <= F.col("buy_price"), "TRIGGERED").otherwise("WAIT")
    now = F.when(F.col("price") > 0, two(F.col("annual") / F.col("price") * 100))
    return out.select("symbol", now.alias("current_yield"), "mean_yield", F.coalesce("observations", F.lit(0)).alias("observations"), F.col("target").alias("target_yield"), "buy_price", F.when(F.col("buy_price").isNotNull(), fall).alias("drop_needed"), signal.alias("signal"))


def account_summary(positions: DataFrame, accounts: DataFrame, top: int = 10) -> DataFrame:
    """Per account from positions (account, symbol, value) and (account, cash): equity (cash and values), gross long value,
    cash %, number of positions, and the `top` largest as (symbol, % of gross long, % of equity); ties by symbol."""
    rows = positions.groupBy("account", "symbol").agg(F.sum("value").alias("value")).where("value > 0")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("value"), "symbol")))
    largest = F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.struct("k", "symbol", "value"))))
    held = ranked.groupBy("account").agg(F.sum("value").alias("gross_long"), F.count("*").alias("positions"), largest.alias("t"))
    out = accounts.join(held, "account", "left").withColumn("gross_long", F.coalesce("gross_long", F.lit(0.0))).withColumn("equity", F.coalesce("cash", F.lit(0.0)) + F.col("gross_long"))

    def share(x: Column, of: Column) -> Column:
        return F.when(of > 0, x / of * 100)

    weights = F.transform("t", lambda x: F.struct(x["symbol"].alias("symbol"), F.round(share(x["value"], F.col("gross_long")), 4).alias("of_long"), F.round(share(x["value"], F.col("equity")), 4).alias("of_equity")))
    return out.select("account", "equity", "gross_long", share(F.coalesce("cash", F.lit(0.0)), F.col("equity")).alias("cash_pct"), F.coalesce("positions", F.lit(0)).alias("positions"), F.coalesce(weights, F.array().cast("array<struct<symbol:string,of_long:double,of_equity:double>>")).alias("largest"))


def portfolio_summary(positions: DataFrame) -> DataFrame:
    """Weights of each (account, sector) in the account's gross long value."""
    rows = positions.groupBy("account", "sector").agg(F.sum("value").alias("value"))
    return rows.withColumn("weight_pct", F.col("value") / F.sum("value").over(Window.partitionBy("account")) * 100)
