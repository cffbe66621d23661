"""The thin opN_ queries over the driver's tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.centroids import centroid_clusters, clusters_sql
from tapeworks.llm.importance import IMPORTANCE_SQL, importance_resample
from tapeworks.llm.jaccard import ngram_jaccard_join
from tapeworks.llm.language import document_rows, identify, page_rows
from tapeworks.llm.licenses import license_scan
from tapeworks.llm.media import media_columns
from tapeworks.llm.mixing import MIX_SQL, mix_sources
from tapeworks.llm.packing import pack_documents
from tapeworks.llm.quality_model import quality_scores
from tapeworks.llm.quality_rules import RULES_SQL, quality_rules
from tapeworks.llm.sentence_pieces import piece_ids
from tapeworks.llm.suffix_dedup import remove_repeats
from tapeworks.llm.toxicity import toxicity


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, a Jaccard similarity of 0.9 or more."""
    return ngram_jaccard_join(_docs(spark, sf_dir), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as an 8-bit picture in a tar shard and read back."""
    out = media_columns(_docs(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each text; every fifth id by crc32 is held out of learning."""
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 200-byte strings that also start elsewhere."""
    return remove_repeats(_docs(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each text; every fourth id by crc32 is held out of learning."""
    return quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 by source; 150 % of all words, no source above twice its size."""
    return mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and of every web page; a page's doc_id is -1 - page_id."""
    docs = document_rows(_docs(spark, sf_dir))
    pages = page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("id", F.lit(-1) - F.col("id"))
    return identify(docs.unionByName(pages)).withColumnRenamed("id", "doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each document and of its source."""
    return quality_rules(_docs(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in each text."""
    return license_scan(_docs(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look most like the benchmark's texts: a tenth of those with 20 words or more."""
    return importance_resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of the 64-component embeddings after five rounds."""
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text with an end id, and the text decoded from them."""
    return piece_ids(_docs(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard, op2_media_columns, op3_toxicity, op4_suffix_dedup, op5_quality_classifier, op6_source_mixing, op7_language_id, op8_quality_rules, op9_packing, op10_license_scan, op11_importance_resampling, op12_centroid_clusters, op13_sentence_pieces)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": MIX_SQL, "op8_quality_rules": RULES_SQL, "op11_importance_resampling": IMPORTANCE_SQL, "op12_centroid_clusters": clusters_sql()}
