"""Breakout plans of an account's candidates: prices and gates as expressions, and the running budget of risk and sectors as
one fold over the candidates that pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rating bands from the highest on with the factor of risk that each allows, the risk per trade that rejects,
# and the scores that are watched.
BANDS = ((90, "textbook", 1.75), (80, "strong", 1.0), (70, "good", 0.75), (60, "developing", 0.0))
MOST_RISK_PCT, WATCHED = 8.0, (60.0, 70.0)

PLAN = "account string, candidate string, plan string, reason string, shares long, position_value double, risk_dollars double, cumulative_risk_pct double, binding string"

#: Columns of an eligible candidate that the running budget reads.
FOLDED = ("account", "candidate", "account_size", "open_risk_pct", "sector", "worst_entry", "stop", "factor")


def tick(price: Column) -> Column:
    """Rounded to cents from one dollar on, else to hundredths of them."""
    return F.when(price >= 1, F.round(price, 2)).otherwise(F.round(price, 4))


def with_prices(rows: DataFrame, pivot_buffer: float = 0.1, chase: float = 2.0, stop_buffer: float = 1.0) -> DataFrame:
    """signal_entry, worst_entry and stop from pivot and last_low (percentages), the risks of both entries in %, band and factor."""
    rows = rows.withColumn("signal_entry", tick(F.col("pivot") * (1 + pivot_buffer / 100))).withColumn("worst_entry", tick(F.col("pivot") * (1 + chase / 100))).withColumn("stop", tick(F.col("last_low") * (1 - stop_buffer / 100)))
    for name in ("signal", "worst"):
        rows = rows.withColumn(f"risk_pct_{name}", F.round((F.col(f"{name}_entry") - F.col("stop")) / F.col(f"{name}_entry") * 100, 2))
    band, factor = F.lit("weak"), F.lit(0.0)
    for least, name, times in reversed(BANDS):
        band, factor = F.when(F.col("score") >= least, name).otherwise(band), F.when(F.col("score") >= least, times).otherwise(factor)
    return rows.withColumn("band", band).withColumn("factor", factor)


def gated(rows: DataFrame, chase: float = 2.0) -> DataFrame:
    """with_prices() and plan: eligible, revalidation, watchlist or rejected with its reason; the first rule that holds."""
    known = F.coalesce((F.col("pivot") > 0) & (F.col("last_low") > 0) & (F.col("stop") < F.col("signal_entry")), F.lit(False))
    rated = F.col("valid") & (F.col("score") >= BANDS[2][0]) & (F.col("risk_pct_worst") <= MOST_RISK_PCT)
    watched = F.col("valid") & (F.col("score") >= WATCHED[0]) & (F.col("score") < WATCHED[1])
    before, broke = F.col("state") == "Pre-breakout", F.col("state") == "Breakout"
    again = rated & F.coalesce("breakout_volume", F.lit(False)) & (F.col("distance_pct") <= chase) & (F.col("price") <= F.col("worst_entry"))
    plan = F.when(~known, "rejected").when(before & rated, "eligible").when(broke & F.coalesce(again, F.lit(False)), "revalidation").when(~broke & (before | (F.col("state") == "Early-post-breakout")) & watched, "watchlist").otherwise("rejected")
    why = F.when(~known, "prices").when(~F.col("valid"), "not valid").when(~before & ~broke, F.concat(F.lit("state "), F.col("state"))).when(F.col("score") < BANDS[2][0], F.concat(F.lit("band "), F.col("band"))).when(F.col("risk_pct_worst") > MOST_RISK_PCT, "risk")
    return rows.withColumn("plan", plan).withColumn("reason", F.when(F.col("plan") == "rejected", F.coalesce(why, F.lit("breakout"))))


def generate_plans(candidates: DataFrame, risk_pct: float = 0.5, position_pct: float = 10.0, sector_pct: float = 30.0, heat_pct: float = 6.0, chase: float = 2.0) -> DataFrame:
    """Candidates (account, account_size, open_risk_pct, candidate, sector, price, score, state, valid, pivot, last_low,
    breakout_volume, distance_pct) to plans.

    Eligible ones are taken by score (ties: candidate) and sized by risk, by position and by what their sector has left;
    the least counts, and the limit that binds is named. None left: constrained; above the portfolio's heat: deferred; else
    actionable, which adds to heat and sector. Only eligible rows, and of them eight columns and the score, reach the fold: it runs over
    whole partitions sorted by account, so that an account costs its rows and not a call of its own, and one of any size is
    never held whole.
    """
    rows = gated(with_prices(candidates, chase=chase), chase)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, size, heat, sectors = None, None, 0.0, {}
        for g in batches:
            out = []
            for account, candidate, account_size, open_risk, sector, entry, stop, factor in zip(*(g[c].tolist() for c in FOLDED), strict=True):
                if size is None or account != now:
                    now, size, heat, sectors = account, float(account_size), float(open_risk), {}
                per = entry - stop
                by_risk = int(size * risk_pct * factor / 100 / per)
                limits = {"max_position_pct": int(size * position_pct / 100 / entry), "max_sector_pct": int(max(0.0, (sector_pct - sectors.get(sector, 0.0)) / 100 * size) / entry)}
                shares = max(0, min(by_risk, *limits.values()))
                binding = next((k for k in reversed(limits) if limits[k] == shares < by_risk), None)
                value, risk = round(shares * entry, 2), round(shares * per, 2)
                total = heat + risk / size * 100
                plan = "constrained" if shares == 0 else "deferred" if total > heat_pct else "actionable"
                if plan == "actionable":
                    heat, sectors[sector] = total, sectors.get(sector, 0.0) + value / size * 100
                done = plan == "actionable"
                out.append((account, candidate, plan, None, shares if done else None, value if done else None, risk if done else None, total if done else None, binding))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

    eligible = rows.where("plan = 'eligible'").select(*FOLDED, "score").repartition("account")
    found = eligible.sortWithinPartitions("account", F.desc("score"), F.asc_nulls_last("candidate")).select(*FOLDED).mapInPandas(run, PLAN)
    rest = rows.where("plan <> 'eligible'").select("account", "candidate", "plan", "reason")
    return found.unionByName(rest, allowMissingColumns=True)
