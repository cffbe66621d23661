"""Rule reviews of holdings and trades: each rule is a column expression, a finding an entry of an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a filing, sectors with rules of their own, payout limits, and phrases of a journal.
FILING_WORDS = ["item 4.02", "non-reliance", "restatement", "material weakness", "sec investigation"]
SECTORS = {"bank": ["bank", "banks", "financial", "financials", "financial services"], "utility": ["utility", "utilities"], "insurer": ["insurance", "insurer", "insurers"]}
LIMITS = {"payout": 0.85, "payout_caution": 0.70, "fcf": 0.80, "fcf_fail": 1.0, "divergence": 0.25, "ffo_debt": 0.13, "insurer": 0.85, "deposit_beta": 0.50}
PHRASES = {
    "fomo_entry": r"didn'?t want to miss|fomo|chase|miss the move|moving fast",
    "revenge_trade": r"revenge|make it back|win it back|after.*loss",
    "premature_exit": r"got scared|took it off early|couldn'?t hold",
    "overconfidence_after_winner": r"easy money|can'?t lose|sure thing|increased size after win",
    "hesitation": r"hesitat|froze|missed my entry",
}


def yes(x: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(x, F.lit(False))


def listed(*items: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in items]))


def dividend_triggers(holdings: DataFrame) -> DataFrame:
    """holding's columns ticker, status (OK, WARN, REVIEW), findings (trigger:status) and actions.

    holdings: ticker, kind (stock, etf, reit, bdc), latest, prior, missing; fcf, ffo, nii, dividends_paid, coverage (array,
    oldest first); net_debt, interest_coverage (arrays); buybacks; filings (array of texts); revenue_cagr, margin,
    guidance (up, down), stalled; cut, variable, freeze, special. Nulls in arrays are left out.
    """
    cover, debt, icov = (F.filter(F.col(c), lambda x: x.isNotNull()) for c in ("coverage", "net_debt", "interest_coverage"))
    c1, c2 = (F.get(cover, F.size(cover) - k) for k in (1, 2))
    i1, i2 = (F.get(icov, F.size(icov) - k) for k in (1, 2))
    d1, d2, d3 = (F.get(debt, F.size(debt) - k) for k in (1, 2, 3))
    latest, prior, paid = F.col("latest"), F.col("prior"), F.col("dividends_paid")
    base = F.when(F.lower("kind") == "reit", F.col("ffo")).when(F.lower("kind") == "bdc", F.col("nii")).otherwise(F.col("fcf"))
    now = F.when(base > 0, paid / base)
    t1 = yes(F.col("missing")) | yes(latest <= 0) | yes((prior > 0) & (latest < prior * 0.99))
    t2 = (
        F.when(yes((base <= 0) & (paid > 0)) | yes((c1 > 1) & (c2 > 1)) | yes((now > 1) & (c1 > 1)), "REVIEW")
        .when(yes(now > 1) | yes((c1 > 0.8) & (c1 > c2)), "WARN")
    )
    rising, falling, weak = yes((d3 < d2) & (d2 < d1)), yes(i1 < i2), yes(i1 < 2.5)
    given = F.when(F.coalesce(paid, F.lit(0.0)) != 0, paid).otherwise(0.0)
    stretched = yes((F.col("fcf") > 0) & (F.coalesce("buybacks", F.lit(0.0)) + given > F.col("fcf") * 1.10))
    t3 = F.when(rising & (falling | weak | stretched), "REVIEW").when(rising | falling & weak, "WARN")
    text = F.lower(F.array_join(F.coalesce("filings", F.array().cast("array<string>")), " "))
    t4 = F.reduce(F.array(*[F.contains(text, F.lit(w)) for w in FILING_WORDS]), F.lit(False), lambda a, x: a | x)
    down = [yes(F.col("revenue_cagr") < 0), yes(F.lower("margin") == "down"), yes(F.lower("guidance") == "down"), yes(F.col("stalled"))]
    score = sum((c.cast("int") for c in down), F.lit(0))
    t5 = F.when(score >= 3, "REVIEW").when(score >= 2, "WARN")
    t6 = F.when(yes(F.col("cut")) | yes(F.col("variable")), "REVIEW").when(yes(F.col("freeze")) | yes(F.col("special")), "WARN")
    states = [F.when(t1, "REVIEW"), t2, t3, F.when(t4, "REVIEW"), t5, t6]
    found = F.array_compact(F.array(*[F.when(s.isNotNull(), F.concat(F.lit(f"T{k}:"), s)) for k, s in enumerate(states, 1)]))
    rows = holdings.select(F.upper(F.trim("ticker")).alias("ticker"), found.alias("findings"))
    rows = rows.withColumn("status", F.when(F.exists("findings", lambda x: x.endswith("REVIEW")), "REVIEW").when(F.size("findings") > 0, "WARN").otherwise("OK"))
    todo = F.when(F.col("status") == "REVIEW", F.lit("pause_buy_adds,create_review_ticket,human_read_full_disclosure")).when(F.col("status") == "WARN", F.lit("pause_buy_adds_optional,append_next_earnings_checklist")).otherwise("")
    return rows.select("ticker", "status", F.array_join("findings", ",").alias("findings"), todo.alias("actions"))


def payout_safety(holdings: DataFrame) -> DataFrame:
    """ticker, kind, safety, blockers and the three payouts.

    holdings: ticker, sector, dividend, gaap_eps, adjusted_eps, fcf_per_share, merged (a merger within four quarters); cet1,
    cre, npl, nco, deposit_beta; ffo_debt, rate_case, issuance, roe_trend; combined_ratio, reserves, statutory.
    """
    sector = F.lower(F.trim(F.coalesce("sector", F.lit(""))))
    kind = F.lit("consumer")
    for name, words in SECTORS.items():
        kind = F.when(sector.isin(words), name).otherwise(kind)
    adjusted = F.col("adjusted_eps")
    gaap_payout, adj_payout, fcf_payout = (F.col("dividend") / F.nullif(F.col(c), F.lit(0.0)) for c in ("gaap_eps", "adjusted_eps", "fcf_per_share"))
    rows = holdings.select("*", kind.alias("kind"), gaap_payout.alias("gaap_payout"), adj_payout.alias("adj_payout"), fcf_payout.alias("fcf_payout"))
    over = yes(F.abs(F.col("gaap_eps") - adjusted) / F.abs(F.nullif(adjusted, F.lit(0.0))) > LIMITS["divergence"])
    gaap, adj, fcf = F.col("gaap_payout"), F.col("adj_payout"), F.col("fcf_payout")
    worse = {c: yes(F.lower(c) == "deteriorating") for c in ("npl", "nco")}
    credit = worse["npl"] | worse["nco"]
    consumer = (
        F.when(yes(fcf > LIMITS["fcf_fail"]) | yes(adj > LIMITS["payout"]), "FAIL").when(adjusted.isNull(), "HOLD-REVIEW")
        .when(yes(adj > LIMITS["payout_caution"]) | yes(fcf > LIMITS["fcf"]), "CAUTION").otherwise("PASS")
    )
    bank = F.when(yes(gaap > LIMITS["payout"]), "FAIL").when(F.col("cet1").isNull() | F.col("cre").isNull() | credit | yes(F.col("deposit_beta") > LIMITS["deposit_beta"]), "CAUTION").otherwise("PASS")
    adverse = yes(F.lower("rate_case").isin("adverse", "pending_adverse"))
    thin, unknown = yes(F.col("ffo_debt") < LIMITS["ffo_debt"]), F.col("ffo_debt").isNull()
    utility = F.when(yes(gaap > 1.0), "FAIL").when(adverse, "HOLD-REVIEW").when(unknown | thin | yes(F.lower("roe_trend").isin("falling", "adverse")) | yes(F.lower("issuance").isin("high", "dilutive")), "CAUTION").otherwise("PASS")
    bad_reserves = yes(F.lower("reserves") == "adverse")
    insurer = F.when(yes(F.coalesce(adj, gaap) > LIMITS["insurer"]), "FAIL").when(bad_reserves | yes(F.lower("statutory") == "weak"), "HOLD-REVIEW").when(F.col("combined_ratio").isNull() | yes(F.col("combined_ratio") > 1), "CAUTION").otherwise("PASS")
    is_ = {k: F.col("kind") == k for k in ("bank", "utility", "insurer", "consumer")}
    merged = yes(F.col("merged")) & adjusted.isNull()
    verdict = F.when(merged, "HOLD-REVIEW").when(is_["bank"], bank).when(is_["utility"], utility).when(is_["insurer"], insurer).otherwise(consumer)
    alone = ~merged
    blockers = F.array_sort(listed(
        (over, "gaap_adjusted_divergence_gt_25pct"), (merged | is_["consumer"] & adjusted.isNull(), "adjusted_eps_unavailable"),
        (alone & is_["bank"] & F.col("cet1").isNull(), "bank_capital_unavailable"), (alone & is_["bank"] & F.col("cre").isNull(), "bank_cre_concentration_unavailable"), (alone & is_["bank"] & credit, "bank_npl_nco_deteriorating"),
        (alone & is_["utility"] & unknown, "utility_ffo_debt_unavailable"), (alone & is_["utility"] & thin, "utility_ffo_debt_weak"), (alone & is_["utility"] & adverse, "utility_rate_case_adverse"),
        (alone & is_["insurer"] & F.col("combined_ratio").isNull(), "insurer_combined_ratio_unavailable"), (alone & is_["insurer"] & bad_reserves, "insurer_reserve_development_adverse"),
    ))
    return rows.select("ticker", "kind", verdict.alias("safety"), F.array_join(blockers, ",").alias("blockers"), *[F.round(c, 4).alias(c) for c in ("gaap_payout", "adj_payout", "fcf_payout")])


def structural_event(deals: DataFrame) -> DataFrame:
    """ticker and result: MAJOR_EVENT where a deal is large, dilutive, levering, changes control, form or policy, or adds
    up over two years. deals: ticker, tx_value, market_cap, issuance_pct, leverage_delta, control, structure, policy, rolling."""
    cap = F.nullif(F.coalesce("market_cap", F.lit(0.0)), F.lit(0.0))
    hit = yes(F.col("tx_value") / cap > 0.10) | yes(F.col("issuance_pct") > 10) | yes(F.col("leverage_delta") > 0.5) | yes(F.col("control")) | yes(F.col("rolling") / cap > 0.15)
    hit = hit | yes(F.col("structure").isin("merger_of_equals", "reverse_morris_trust", "spinoff", "large_asset_sale")) | yes(F.col("policy").isin("dividend", "rating", "leverage"))
    return deals.groupBy("ticker").agg(F.max(hit.cast("int")).alias("m")).select("ticker", F.when(F.col("m") == 1, "MAJOR_EVENT").otherwise("CLEAN_CONFIRMED").alias("result"))


def event_cap(result: Column, triggered: Column) -> tuple[Column, Column]:
    """(cap or null, whether the first tranche is blocked) of an event scan's result; unknown results count as failed."""
    clear = yes(result.isin("MINOR_EVENT_CAUTION", "CLEAN_CONFIRMED"))
    cap = F.when(result == "MAJOR_EVENT", "HOLD-REVIEW").when(~clear & yes(triggered), "HOLD-REVIEW")
    return cap, ~clear


def final_verdict(yield_step: Column, safety: Column, cap: Column, blocked: Column) -> Column:
    """Verdict from the yield step, safety, event cap and whether blockers are open."""
    held = F.when((safety == "PASS") & ~blocked, "CONDITIONAL-PASS").otherwise("HOLD-REVIEW")
    return (
        F.when(yes(yield_step == "FAIL") | yes(safety == "FAIL"), "FAIL").when(~yes(yield_step.isin("STEP1-PASS", "HOLD-REVIEW")), "STEP1-RECHECK")
        .when(yes(cap == "HOLD-REVIEW") | safety.isNull() | yes(safety == "HOLD-REVIEW"), "HOLD-REVIEW").when(yield_step == "HOLD-REVIEW", held)
        .when((safety == "CAUTION") | blocked, "PASS-CAUTION").otherwise("CLEAN-PASS")
    )


def trade_review(trades: DataFrame) -> DataFrame:
    """trade_id, criticals, warnings, process score, behaviour tags and verdict.

    trades: trade_id, thesis_recorded, setup_confirmed, early_entry, regime, against_regime, stop_moved, stop_planned,
    premature_exit, hesitated, actual_r, planned_r, max_r, heat, max_heat, losses, journal.
    """
    c = {n: yes(F.col(n)) for n in ("early_entry", "against_regime", "stop_moved", "stop_planned", "premature_exit", "hesitated")}
    loose = c["stop_moved"] & ~c["stop_planned"]
    process = [
        (F.lit("warning"), ~yes(F.col("thesis_recorded"))), (F.lit("critical"), c["early_entry"] | yes(~F.col("setup_confirmed"))),
        (F.lit("critical"), c["against_regime"] | yes(F.lower("regime").isin("restrictive", "cash_priority", "cash-priority"))), (F.lit("critical"), loose),
    ]
    limit = F.coalesce("max_r", "planned_r")
    risk, heat, losses = F.col("actual_r"), F.col("heat"), F.col("losses")
    known = risk.isNotNull() & limit.isNotNull()
    notes = [
        (F.when(yes(risk > limit * 1.25), "critical").otherwise("warning"), ~known | yes(risk > limit)),
        (F.when(heat > F.col("max_heat"), "critical").otherwise("warning"), yes(heat > F.col("max_heat") * 0.9)),
        (F.when(losses >= 4, "critical").otherwise("warning"), yes(losses >= 3)),
    ]
    execution = [(F.lit("critical"), c["early_entry"]), (F.when(c["stop_planned"], "warning").otherwise("critical"), c["stop_moved"]), (F.lit("warning"), c["premature_exit"])]

    def count(items: list[tuple[Column, Column]], level: str) -> Column:
        return sum((F.when(hit & (kind == level), 1).otherwise(0) for kind, hit in items), F.lit(0))

    text = F.lower(F.coalesce("journal", F.lit("")))
    said = {tag: text.rlike(p) for tag, p in PHRASES.items()}
    drift = count(process, "warning") + count(process, "critical") >= 3
    tags = listed(
        (c["early_entry"] | said["fomo_entry"], "fomo_entry"), (said["revenge_trade"], "revenge_trade"), (c["premature_exit"] | said["premature_exit"], "premature_exit"),
        (said["overconfidence_after_winner"], "overconfidence_after_winner"), (loose, "stop_moved"), (known & yes(risk > limit), "size_creep"), (~known, "unknown_size_discipline"),
        (c["hesitated"] | said["hesitation"], "hesitation"), (drift, "rule_drift"),
    )
    everything = process + notes + execution
    rows = trades.select("trade_id", count(everything, "critical").alias("criticals"), count(everything, "warning").alias("warnings"), (100 - 30 * count(process, "critical") - 15 * count(process, "warning")).alias("raw"), tags.alias("tags"), F.coalesce("losses", F.lit(0)).alias("_losses"))
    cool = (F.col("criticals") >= 2) | F.array_contains("tags", "revenge_trade") & (F.col("_losses") >= 2) | (F.col("_losses") >= 4)
    verdict = F.when(cool, "COOL_DOWN").when(F.col("criticals") >= 1, "RULE_VIOLATION").when(F.col("warnings") > 0, "REVIEW_REQUIRED").otherwise("OK")
    return rows.select("trade_id", "criticals", "warnings", F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw"))).alias("score"), F.when(F.size("tags") == 0, "no_pattern_detected").otherwise(F.array_join("tags", ",")).alias("tags"), verdict.alias("verdict"))
