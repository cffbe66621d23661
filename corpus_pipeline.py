"""A training corpus from documents: language, near copies, repeated passages, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages tell rows apart by id and text; rows alike in both count as one document from the second stage on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.jaccard import ngram_jaccard_join
from tapeworks.llm.language import document_rows, identify
from tapeworks.llm.mixing import mix_sources
from tapeworks.llm.packing import pack_documents
from tapeworks.llm.quality_rules import words_of
from tapeworks.llm.queries import tokenizer_path
from tapeworks.llm.shared import bounded_batches, written
from tapeworks.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text hash are in gone (id, th)."""
    gone = written(gone.select(F.col("id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct(), "gone")
    rows = docs.withColumn("_th", F.xxhash64("text"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th")), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages, or too short to tell."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    found = identify(document_rows(docs).withColumn("th", F.xxhash64("text")), carry=("th",))
    return _without(docs, found.where(~F.col("kept"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8: the least id (null last)."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    found = ngram_jaccard_join(docs, n=5, num=80, den=100)
    kept = _without(docs, found.where(~F.col("lead")).withColumnRenamed("doc_id", "id"))
    repeated = docs.groupBy("doc_id", F.xxhash64("text").alias("_th")).agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # rows alike in id and text
        kept = kept.dropDuplicates(["doc_id", "_th"])
    return kept.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes all bytes of 200-byte strings that start more than once in what is left."""
    bounded_batches(spark)
    out = remove_repeats(docs, carry=["lang", "source"])
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: whole documents as often as taken, and the one at each source's cut up to its last word.

    A document without words is not taken. In a cut text, white space between words becomes single blanks.
    """
    docs = docs.select(*COLUMNS)
    taken = mix_sources(docs).withColumnRenamed("doc_id", "id").where("taken > 0")
    taken = taken.groupBy("id", "th").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    rows = docs.withColumn("_th", F.xxhash64("text")).dropDuplicates(["doc_id", "_th"])
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")))
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    parts = F.filter(F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.array(rest)), lambda x, i: (i < whole) | (x > 0))
    rows = rows.withColumn("_cut", F.explode(parts))
    cut = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col("_cut").cast("int")), " ")
    text = F.when(F.col("_cut") > 0, cut).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    bounded_batches(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL cannot express the model of the first stage nor packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
