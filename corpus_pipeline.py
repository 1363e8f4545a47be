"""A training-data pipeline over `documents`: five stages, each over all rows that the one before kept.

In all stages a null text counts as empty and stays null where the row stays, rows of null or repeated ids are judged each by
their own text, texts of any length are read whole, and columns beyond the needed ones, of whatever name, pass through (but
for the last stage, whose columns are its own). An empty table goes through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locspark.llm.common import written
from locspark.llm.decontaminate import without_benchmark
from locspark.llm.ngram_join import one_of_each_group
from locspark.llm.piece_encoding import encode_pieces
from locspark.llm.quality_classifier import good_documents
from locspark.llm.queries import piece_model_path, table
from locspark.llm.suffix_dedup import dedup_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; equal texts have equal scores, so copies stay or go together."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link by word n-grams, the one with the smallest id; rows without text or id stay, and rows equal in both."""
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat (of repeated rows all copies lose them); n_chars follows. A document can end up empty."""
    out = dedup_documents(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no piece of a benchmark item; rows without text stay."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text; none for an empty one."""
    return encode_pieces(docs, piece_model_path()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("encoded", encoded)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
