"""Every market query with SQL against DuckDB, and every query for rows, on the smallest tables that fill it."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from tapeworks.jobs.catalog import market_queries, market_sql

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = market_queries(), market_sql()
#: One or two queries of each module; the whole catalogue is compared by the driver.
CHOSEN = ["bars_daily", "w01_sma", "w05_atr", "w13_multi_period_return", "w21_distribution_days", "w28_candlestick_patterns", "a12_pattern_backtest", "a45_dd_status", "w32_rs_rank_percentile", "j01_relative_strength", "j03_earnings_gap",
          "j05_nearest_earnings", "j06_holding_returns", "a01_market_breadth", "j17_lead_lag_market", "f09_normalize_score", "f16_trading_days", "a14_skill_metrics", "a18_outcome_summary", "h12_contradictions", "a31_dividend_growth_calendar",
          "a38_calendar_summary", "t01_session_vwap", "t06_regular_session", "s11_upsert_history", "k02_top_bottom", "a30_theme_heat", "j21_theme_overlap", "a28_macro_components", "a29_macro_regime",
          "a46_dividend_triggers", "a47_payout_safety", "a50_trade_review", "u05_rule_hints", "a40_backtest_quality", "w27_power_trend", "h01_zigzag_swings", "h02_contraction_patterns", "h05_forward_outcome", "t05_plan_monitor", "t_vwap_fail_fsm", "t08_short_sale_stream", "t09_repaired_sessions", "t10_session_runs", "x01_x05_report_checks", "h14_discover_clusters", "h12_contradiction_counts", "h15_risk_budget",
          "w36_cycle_score", "w38_divergence_score", "w39_momentum_score", "a08_event_weeks", "a33_stability_score", "h18_stagnation", "w26_weakness", "s07_session_calls", "a48_yield_signal", "h16_drift_setups"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    return float(f"{v:.8g}") if isinstance(v, (int, float)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_are_consistent():
    assert set(SQL) <= set(QUERIES)
