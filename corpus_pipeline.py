"""Corpus pipeline: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignal.llm import decontaminate, line_dedup, ngram_join, sentencepiece_codec, toxicity
from jobsignal.llm.common import Tables, read_table, workers_import

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5 (rows without an id are judged by their text alone)."""
    workers_import(spark)
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs, model).where("_toxic_score < 0.5").drop("_toxic_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; ``n_chars`` follows the text."""
    return line_dedup.dedup(spark, docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked at a Jaccard similarity of 0.8 over five-word shingles."""
    return ngram_join.keep_one(spark, docs, 5, 80, 100)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows."""
    return decontaminate.clean(spark, docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every remaining document."""
    workers_import(spark)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", similar),
                                   ("benchmark decontamination", uncontaminated), ("SentencePiece encoding and decoding", tokens)]

#: Learned scores and sub-word ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
