"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsilt.llm import decontaminate, packing, repeats, simhash, toxicity
from netsilt.llm.common import stored
from netsilt.llm.queries import TOKENIZER, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores 0.7 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of exact and near copies the one with the smallest doc_id stays."""
    return simhash.distinct_documents(docs)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that an earlier document has go."""
    kept = repeats.documents_without_repeats(docs)
    return kept.withColumn("n_chars", _length(kept)) if "n_chars" in docs.columns else kept


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, TOKENIZER)


def _length(docs: DataFrame) -> Column:
    return F.char_length("text").cast(docs.schema["n_chars"].dataType)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("repeated_passages", passages_once),
    ("benchmark_leaks", not_leaked),
    ("packing", packed),
]

#: SQL cannot express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
