"""Queries of breakout plans, with SQL: customers are accounts and their orders candidates; the budget is a recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.tables import rounded, table
from tapeworks.operators import plans

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def candidates(s: SparkSession, d: str) -> DataFrame:
    k, pivot = F.col("o_orderkey"), F.col("o_totalprice") / 1000
    price = pivot * (F.lit(0.98) + (k % 6) / 100)
    return table(s, d, "orders").where("o_totalprice > 0").select(
        F.col("o_custkey").cast("string").alias("account"), (F.col("o_custkey") % 50 * 1000 + 50000).cast("double").alias("account_size"), (F.col("o_custkey") % 4 * 0.5).cast("double").alias("open_risk_pct"), F.lpad(k.cast("string"), 9, "0").alias("candidate"), F.col("o_orderpriority").alias("sector"),
        price.alias("price"), (k % 46 + 55).cast("double").alias("score"), F.when(k % 5 == 0, "Breakout").when(k % 5 == 1, "Early-post-breakout").otherwise("Pre-breakout").alias("state"), (k % 11 != 0).alias("valid"),
        pivot.alias("pivot"), (pivot * (F.lit(0.93) + (k % 6) / 100)).alias("last_low"), (k % 2 == 0).alias("breakout_volume"), ((price - pivot) / pivot * 100).alias("distance_pct"),
    )


def _tick(x: str) -> str:
    return f"CASE WHEN {x} >= 1 THEN round({x}, 2) ELSE round({x}, 4) END"


_CANDIDATES = f"""c AS (SELECT CAST(o_custkey AS VARCHAR) AS account, CAST(o_custkey % 50 * 1000 + 50000 AS DOUBLE) AS size, o_custkey % 4 * 0.5::DOUBLE AS open, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS candidate, o_orderpriority AS sector, o_orderkey AS k, o_totalprice / 1000 AS pv,
    o_totalprice / 1000 * (0.98::DOUBLE + o_orderkey % 6 / 100) AS price, o_orderkey % 46 + 55 AS score, o_orderkey % 11 <> 0 AS valid FROM orders WHERE o_totalprice > 0),
p AS (SELECT *, {_tick("pv * 1.001::DOUBLE")} AS se, {_tick("pv * 1.02::DOUBLE")} AS we, {_tick("(pv * (0.93::DOUBLE + k % 6 / 100) * 0.99::DOUBLE)")} AS st, (price - pv) / pv * 100 AS dist FROM c),
q AS (SELECT *, round((we - st) / we * 100, 2) AS rw, CASE WHEN score >= 90 THEN 1.75::DOUBLE WHEN score >= 80 THEN 1 WHEN score >= 70 THEN 0.75::DOUBLE ELSE 0 END AS f, CASE WHEN score >= 60 THEN 'developing' ELSE 'weak' END AS band FROM p),
r AS (SELECT *, st < se AS ok, valid AND score >= 70 AND rw <= 8 AS rated, valid AND score >= 60 AND score < 70 AS watched FROM q),
g AS (SELECT *, CASE WHEN NOT ok THEN 'rejected' WHEN k % 5 > 1 AND rated THEN 'eligible' WHEN k % 5 = 0 AND rated AND k % 2 = 0 AND dist <= 2 AND price <= we THEN 'revalidation' WHEN k % 5 <> 0 AND watched THEN 'watchlist' ELSE 'rejected' END AS plan,
    CASE WHEN NOT ok THEN 'prices' WHEN NOT valid THEN 'not valid' WHEN k % 5 = 1 THEN 'state Early-post-breakout' WHEN score < 70 THEN 'band ' || band WHEN rw > 8 THEN 'risk' ELSE 'breakout' END AS why FROM r),
e AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY score DESC, candidate) AS n, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], sector) AS si FROM g WHERE plan = 'eligible'),
z(account, n, heat, used, candidate, plan, shares, value, risk, total, binding) AS (SELECT DISTINCT account, 0::BIGINT, open, [0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE], NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR FROM e
    UNION ALL SELECT account, n, CASE WHEN plan = 'actionable' THEN total ELSE heat END, CASE WHEN plan = 'actionable' THEN list_transform(used, lambda x, i: x + CASE WHEN i = si THEN value / size * 100 ELSE 0 END) ELSE used END, candidate, plan, shares, value, risk, total, binding
    FROM (SELECT *, CASE WHEN shares = 0 THEN 'constrained' WHEN total > 6 THEN 'deferred' ELSE 'actionable' END AS plan FROM (SELECT *, heat + risk / size * 100 AS total FROM (SELECT *, round(shares * we, 2) AS value, round(shares * (we - st), 2) AS risk, CASE WHEN shares < br AND bs = shares THEN 'max_sector_pct' WHEN shares < br AND bp = shares THEN 'max_position_pct' END AS binding
        FROM (SELECT *, CAST(greatest(0, least(br, bp, bs)) AS BIGINT) AS shares FROM (SELECT e.account, e.n, heat, used, e.candidate, si, size, we, st, trunc(size * 0.5::DOUBLE * f / 100 / (we - st)) AS br, trunc(size * 10 / 100 / we) AS bp, trunc(greatest(0, (30 - used[si]) / 100 * size) / we) AS bs FROM z JOIN e ON e.account = z.account AND e.n = z.n + 1))))))
SELECT account, candidate, plan, CASE WHEN plan = 'rejected' THEN why END AS reason, NULL::BIGINT AS shares, NULL::DOUBLE AS position_value, NULL::DOUBLE AS risk_dollars, NULL::DOUBLE AS cumulative_risk_pct, NULL::VARCHAR AS binding FROM g WHERE plan <> 'eligible'
UNION ALL SELECT account, candidate, plan, NULL, CASE WHEN plan = 'actionable' THEN shares END, CASE WHEN plan = 'actionable' THEN value END, CASE WHEN plan = 'actionable' THEN risk END, CASE WHEN plan = 'actionable' THEN floor(total * 10000 + 0.500001::DOUBLE) / 10000 END, binding FROM z WHERE n > 0"""
Q["h15_risk_budget"] = lambda s, d: rounded(plans.generate_plans(candidates(s, d)).withColumn("cumulative_risk_pct", F.floor(F.col("cumulative_risk_pct") * 10000 + 0.500001) / 10000))
SQL["h15_risk_budget"] = "WITH RECURSIVE " + _CANDIDATES
