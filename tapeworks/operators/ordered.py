"""Row numbers, ranks and running values over groups that may hold most of a table: a range sort spreads each group over
tasks, each task works on its stretch, and one row of totals per stretch and group carries over what came before."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, below the warehouse where that is unset (tests, a single machine)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


@contextmanager
def tidy(spark: SparkSession, name: str = "spark.sql.classic.shuffleDependency.fileCleanup.enabled") -> Iterator[None]:
    """Let Spark drop an action's shuffle files as soon as it ends; what was computed is in the shared folder by then."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """df written by checkpoint() into the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_path(df.sparkSession))
    with tidy(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A large df, written as compressed Parquet into the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_path(spark)}/rows-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stretches(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows range-sorted by group and order, with the stretch (_part) that each row is in; equal keys share one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id()))


def carried(totals: DataFrame, group: list[str], aggs: dict[str, Column]) -> DataFrame:
    """What earlier stretches of a group add up to; totals has a row per stretch and group."""
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_part", *[c.over(before).alias(name) for name, c in aggs.items()])


def with_carried(rows: DataFrame, group: list[str], found: DataFrame) -> DataFrame:
    """rows with the columns of carried(), a row per stretch and group; Spark chooses the join by its size."""
    names = {c: f"_g_{c}" for c in [*group, "_part"]}
    right = found.select(*[F.col(c).alias(n) for c, n in names.items()], *[c for c in found.columns if c not in names])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(right, on, "left").drop(*names.values())


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str, ranked: bool = False) -> DataFrame:
    """rows with their number in the group's order from 1 (ranked: equal keys share the least number) and _size, the
    group's rows."""
    parts = stretches(rows, group, order)
    w = Window.partitionBy("_part", *group).orderBy(*order)
    totals = parts.groupBy("_part", *group).agg(F.count("*").alias("c"))
    found = carried(totals, group, {"_before": F.sum("c")})
    found = found.join(totals.groupBy(*[F.col(c).alias(f"_s_{c}") for c in group]).agg(F.sum("c").alias("_size")), [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group]).drop(*[f"_s_{c}" for c in group])
    out = with_carried(parts.withColumn(name, (F.rank() if ranked else F.row_number()).over(w)), group, found)
    return out.withColumn(name, F.col(name).cast("long") + F.coalesce("_before", F.lit(0))).drop("_before", "_part")


def islands(rows: DataFrame, group: list[str], order: list[Column], columns: list[str], joined: Column, name: str) -> DataFrame:
    """rows with a running number of their stretch of neighbours: a row goes on with the one before it in the group's
    order where `joined` holds, an expression of its columns and of the neighbour's, named _p_<column>.

    The last row of each stretch of the sort is carried to the next, and so are the breaks before it.
    """
    parts = stretches(rows, group, order)
    w = Window.partitionBy("_part", *group).orderBy(*order)
    ends = parts.withColumn("_k", F.row_number().over(w)).withColumn("_c", F.count("*").over(Window.partitionBy("_part", *group))).where("_k = _c").select("_part", *group, F.struct(*columns).alias("l"))
    seen = with_carried(parts.withColumn("_l", F.lag(F.struct(*columns)).over(w)), group, carried(ends, group, {"_e": F.last("l", ignorenulls=True)}))
    before = F.coalesce("_l", "_e")
    seen = seen.select("*", *[before[c].alias(f"_p_{c}") for c in columns])
    seen = stored(seen.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).drop("_l", "_e", *[f"_p_{c}" for c in columns]))
    sums = carried(seen.groupBy("_part", *group).agg(F.sum("_new").alias("s")), group, {"_s": F.sum("s")})
    out = with_carried(seen.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))), group, sums)
    return out.withColumn(name, F.col(name) + F.coalesce("_s", F.lit(0))).drop("_new", "_s", "_part")


def drawdowns(rows: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """rows with eq, the running sum of a value in the group's order, and dd, how far it is below its highest so far (0
    at least)."""
    parts = stretches(rows, group, order)
    w = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = carried(parts.groupBy("_part", *group).agg(F.sum(value).alias("s")), group, {"_s": F.sum("s")})
    parts = with_carried(parts.withColumn("eq", F.sum(value).over(w)), group, sums).withColumn("eq", F.col("eq") + F.coalesce("_s", F.lit(0.0))).drop("_s")
    tops = carried(parts.groupBy("_part", *group).agg(F.max("eq").alias("t")), group, {"_t": F.max("t")})
    out = with_carried(parts.withColumn("_top", F.max("eq").over(w)), group, tops)
    return out.withColumn("dd", F.greatest(F.lit(0.0), F.col("_top"), F.coalesce("_t", F.lit(0.0))) - F.col("eq")).drop("_top", "_t", "_part")
