"""Tables that cut lineage, and connected components; all state that outlives a job is in shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests, a single machine), one below the warehouse."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return place.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder if nothing has done so."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop an action's shuffle files as soon as it ends; what was computed is in shared storage by then."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most this size instead of Spark's default of 64 MB, of which a task holds several copies in the
    JVM and in Python; a size that the session sets itself stays."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, size)


def cut(df: DataFrame) -> DataFrame:
    """A small table, written by checkpoint(): executors may be lost afterwards without a recomputation."""
    ready(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """A large table, written as compressed Parquet into the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() whose every reader is itself written; a later loss of executors needs them no more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node that has an edge, and the smallest node it reaches.

    edges has columns a and b of one orderable type. Alternating large-star and small-star steps: every step is a
    grouped minimum (combined before the shuffle) and one join on the node, which Spark splits when a node has very
    many edges. No step gathers a component in one place. Edges with a null end or to the node itself are ignored.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
