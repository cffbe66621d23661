"""All registered market queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.jobs import desk_queries, drift_queries, event_queries, feature_queries, ladder_queries, pattern_queries, plan_queries, report_queries, screen_queries, signal_queries, source_queries, stream_queries, theme_queries

_PARTS = (feature_queries, event_queries, signal_queries, screen_queries, theme_queries, desk_queries, source_queries, pattern_queries, stream_queries, report_queries, plan_queries, ladder_queries, drift_queries)


def market_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, run in part.Q.items()}


def market_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.SQL.items()}
