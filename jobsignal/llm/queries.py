"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobsignal.llm import centroids, decontaminate, embedding_dedup, filter_audit, line_dedup, log_bilinear, ngram_join, oracles, packing, quality, quotes, sentencepiece_codec, suffix_dedup, toxicity
from jobsignal.llm.common import read_table, workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_import(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return deco


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again and compared with the text."""
    return sentencepiece_codec.round_trip(read_table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard", oracles.NGRAM_JACCARD)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return ngram_join.components(spark, read_table(spark, sf_dir, "documents"), 3, 90, 100)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels.toxic."""
    return toxicity.score(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels.quality."""
    return quality.score(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op8_decontaminate", oracles.DECONTAMINATE)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    return decontaminate.contamination(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op2_line_dedup", oracles.LINE_DEDUP)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines."""
    return line_dedup.dedup(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


@query("op10_embedding_dedup", oracles.EMBEDDING_DEDUP)
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.9 or more."""
    return embedding_dedup.near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without byte strings of 100 that start earlier."""
    return suffix_dedup.dedup(spark, read_table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2,048."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op7_quotation_linking")
def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered messages without quotes, linked to what they quote."""
    return quotes.conversations(spark, read_table(spark, sf_dir, "conversations"))


@query("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by unigram counts and by the log-bilinear model."""
    return log_bilinear.score(spark, read_table(spark, sf_dir, "documents"))


@query("op12_filter_audit", oracles.FILTER_AUDIT)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of five filters in all 120 orders."""
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op13_centroid_clustering", oracles.CENTROIDS)
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the embeddings after three rounds."""
    return centroids.cluster(spark, read_table(spark, sf_dir, "embeddings"))
