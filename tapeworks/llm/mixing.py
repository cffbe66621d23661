"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums of
word counts, and a cut at each source's exact budget, with whole epochs before the cut where a budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut, written

WORD = r"[^\x20\x09-\x0D]+"


def prefix_sums(df: DataFrame, group: list[str], order: list[str | Column], sums: list[str]) -> DataFrame:
    """df with before_<name>: the sum of earlier rows of the same group, for each name in sums.

    A range sort by group and order spreads a large group over many partitions; the sorted rows are written, so that a
    row's partition stays what it was; the partitions' totals (one row per group and partition) give the offsets.
    """
    done = cut(df.orderBy(*group, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = done.groupBy(*group, "_part").agg(*[F.sum(x).alias(x) for x in sums])
    totals = totals.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"_o_{x}") for x in sums])
    out = done.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_i_{x}") for x in sums])
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = out.join(totals, same)
    return out.select(*df.columns, *[(F.col(f"_i_{x}") + F.col(f"_o_{x}")).alias(f"before_{x}") for x in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: share * all words dealt by weight, no target above most * its source's size.

    Sources are ranked by code point, null last, and take the weights in turn. Raising one common level until the
    targets meet the total: below it a source gets level * weight, and sources that reach their cap first stop there.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)).withColumn("last", F.col("source").isNull())
    ranked = prefix_sums(sources, [], [F.col("last"), F.col("source")], ["one"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("before_one", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    steps = prefix_sums(ranked.select("source", "last", "source_size", "weight", "cap", (F.col("cap") / F.col("weight")).alias("ratio")), [], [F.col("ratio"), F.col("last"), F.col("source")], ["cap", "weight"])
    steps = cut(steps)
    total = steps.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    words, heavy = total["s"] or 0, total["w"] or 0
    level = (F.lit(share) * F.lit(words) - F.col("before_cap")) / (F.lit(heavy) - F.col("before_weight")).cast("double")
    found = steps.select(level.alias("level"), "ratio").where("level <= ratio").agg(F.max("level")).first()[0]
    level = float(found) if found is not None else float("inf")
    return steps.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """id, th (hash of the text), size, source_size, target, taken of every row.

    A null text has size 0, a very long one counts whole; a null source is a source of its own; sources without words have target 0. The key is a
    hash of id and text, so reruns agree; repeated rows share a key and may swap places, which leaves the result as it
    is. An empty table gives an empty table; other columns play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("th"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    rows = written(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, most).withColumnRenamed("source", "of")
    sums = prefix_sums(rows, ["source"], ["key"], ["size"])
    out = sums.join(targets, F.col("source").eqNullSafe(F.col("of")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    out = out.withColumn("epochs", epochs.cast("long")).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before_size")))
    return out.select(F.col("id").alias(id_col), "th", "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM s),
p AS (SELECT *, cap / weight AS ratio,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
        coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_weight,
        sum(source_size) OVER () AS words, sum(weight) OVER () AS heavy FROM w),
l AS (SELECT max(level) AS level FROM (SELECT (CAST(1.5 AS DOUBLE) * words - before_cap) / CAST(heavy - before_weight AS DOUBLE) AS level, ratio FROM p) WHERE level <= ratio),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM l) * weight) AS target FROM p),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target,
    CAST(CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) * size
        + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
"""
