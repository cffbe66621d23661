"""Queries of the report checks, on the documents and on reports that each customer's orders give: allocations by priority
with their rounding, a table of ranges, and a log of dated prices. Their SQL counts from the orders, not from the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.jobs.tables import rounded, table
from tapeworks.operators import reportchecks as r

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        SQL[name] = sql


def reports(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text: one report for each customer with orders."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    of = o.groupBy("doc_id").agg(F.sum(F.floor("o_totalprice")).alias("whole"))
    share = o.groupBy("doc_id", "o_orderpriority").agg(F.sum(F.floor("o_totalprice")).alias("part")).join(of, "doc_id").withColumn("pct", F.floor(F.col("part") * 100 / F.col("whole") + 0.5))
    lo = F.greatest(F.col("pct") - 2, F.lit(0))
    hi = F.greatest(F.col("pct") - 1 + F.col("doc_id") % 3, lo)
    fixed, ranged = F.format_string("- %s: %d%%", "o_orderpriority", "pct"), F.format_string("| %s | %d-%d%% |", F.col("o_orderpriority"), lo, hi)
    shares = share.groupBy("doc_id").agg(F.array_sort(F.collect_list(fixed)).alias("fixed"), F.array_sort(F.collect_list(ranged)).alias("ranged"))
    k = F.col("o_orderkey")
    said = F.date_add("day", F.when(k % 5 == 0, 1).otherwise(0))
    price = F.floor(F.col("o_totalprice") / 100).cast("long")
    line = F.concat(F.date_format("day", "MMMM d, yyyy"), F.lit(" ("), F.date_format(said, "EEEE"), F.lit(") GLD: $"), price.cast("string"), F.when(k % 4 == 0, F.concat(F.lit(" GC: $"), (price * F.when(k % 8 == 0, 15).otherwise(5)).cast("string"))).otherwise(""))
    moved = F.when(k % 7 == 0, F.format_string("\nGold rose %d", k % 100)).when(k % 7 == 1, F.format_string("\nGold rose %d%%", k % 100)).otherwise("")
    log = o.where("o_totalprice >= 100").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(line, moved).alias("t")))).alias("log"))
    text = F.concat(F.lit("## Sector allocation\n"), F.array_join("fixed", "\n"), F.lit("\n## Plan\n| Sector | Weight |\n|---|---|\n"), F.array_join("ranged", "\n"), F.lit("\n## Log\n"), F.coalesce(F.array_join(F.transform("log", lambda x: x["t"]), "\n"), F.lit("")))
    return shares.join(log, "doc_id", "left").select("doc_id", text.alias("text"))


_COUNTS = """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderpriority AS p, floor(o_totalprice) AS v, CAST(floor(o_totalprice / 100) AS BIGINT) AS gld, o_totalprice >= 100 AS l FROM orders),
w AS (SELECT doc_id, sum(v) AS whole FROM o GROUP BY doc_id), sh AS (SELECT doc_id, p, floor(sum(v) * 100 / any_value(whole) + 0.5::DOUBLE) AS pct FROM o JOIN w USING (doc_id) GROUP BY doc_id, p),
rg AS (SELECT doc_id, pct, greatest(pct - 2, 0) AS lo, greatest(pct - 1 + doc_id % 3, greatest(pct - 2, 0)) AS hi FROM sh),
al AS (SELECT doc_id, CAST(count(*) > 1 AND abs(sum(pct) - 100) > 0.5 AS INTEGER) + CAST(count(*) > 1 AND CASE WHEN sum(lo) = sum(hi) THEN abs(sum(lo) - 100) > 0.5 ELSE sum(lo) > 100.5 OR sum(hi) < 99.5 END AS INTEGER) AS n FROM rg GROUP BY doc_id),
g AS (SELECT *, CASE WHEN k % 4 = 0 THEN gld * CASE WHEN k % 8 = 0 THEN 15 ELSE 5 END END AS gc FROM o WHERE l),
e AS (SELECT doc_id, min(gc) AS least, max(gc) AS most FROM g GROUP BY doc_id),
pr AS (SELECT doc_id, count(*) FILTER (len(CAST(gld AS VARCHAR)) NOT BETWEEN 2 AND 3) + count(*) FILTER (len(CAST(gc AS VARCHAR)) NOT BETWEEN 3 AND 4) + count(*) FILTER (greatest(abs(most / gld - 15), abs(least / gld - 15)) / 15 > 0.5) AS n FROM g JOIN e USING (doc_id) GROUP BY doc_id),
da AS (SELECT doc_id, count(*) FILTER (k % 5 = 0) AS n, count(*) FILTER (k % 7 = 0) AS bare, CAST(count(*) > 0 AND count(*) FILTER (k % 7 < 2) + count(*) FILTER (gc IS NOT NULL) > 0 AS INTEGER) AS mixed FROM g GROUP BY doc_id)
SELECT doc_id, "check", CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT w.doc_id, unnest(['price_scale', 'notation', 'dates', 'allocations', 'units']) AS "check", unnest([pr.n, mixed, da.n, al.n, bare]) AS n FROM w LEFT JOIN al USING (doc_id) LEFT JOIN pr USING (doc_id) LEFT JOIN da USING (doc_id))"""


def _by_function(s: SparkSession, d: str) -> DataFrame:
    """The same counts through the table function."""
    r.register(s)
    docs = reports(s, d)
    found = s.sql("SELECT d.doc_id, f.check FROM {docs} d, LATERAL report_checks(d.text) f", docs=docs).groupBy("doc_id", "check").agg(F.count("*").alias("n"))
    every = docs.select("doc_id", F.explode(F.array(*map(F.lit, r.CHECKS))).alias("check"))
    return every.join(found, ["doc_id", "check"], "left").select("doc_id", "check", F.coalesce("n", F.lit(0)).alias("n"))


_add("x01_x05_report_checks", lambda s, d: r.run_checks(reports(s, d)), _COUNTS)
_add("g03_report_checks_function", _by_function, _COUNTS)
_add("x01_x05_text_checks", lambda s, d: r.run_checks(table(s, d, "documents")))
_add("x05_unit_check", lambda s, d: r.run_checks(table(s, d, "documents"), ["units"]), r"""SELECT doc_id, 'units' AS "check", CAST(regexp_matches(text, '(?i)\d+\s*bp') AND regexp_matches(text, '(?i)(?:yield|rate|利回り|金利).*?\d+(?:\.\d+)?%') AS BIGINT)
    + len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i)\b(?:Gold|Silver|Oil|Crude|WTI|SPY|SPX|VIX|GLD|GC|TLT|SLV|USO|CL|SI)\b') AND regexp_matches(l, '(?i)\b(?:moved|rose|fell|dropped|gained|lost|up|down|changed|increased|decreased)\b')
        AND regexp_matches(l, '\b\d+(?:\.\d+)?\b') AND NOT regexp_matches(l, '(?i)(?:\$\d|\d\s*%|\d\s*bps?)'))) AS n FROM documents""")
