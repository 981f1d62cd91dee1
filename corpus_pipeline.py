"""The corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the docs of the next.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import jaccard, language, packing, substring_dedup, toxicity
from larder.llm.common import documents, stage
from larder.llm.tokens import vocabulary_path

#: Documents whose language is less certain than this go, as do those without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return language.reject(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingles the one of smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a smaller doc_id has too leave the text."""
    return substring_dedup.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their ids.

    The stages share their Python workers, so packing keeps fewer pieces there than it does alone.
    """
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), cached=150_000)


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed),
]

#: SQL cannot express the classifiers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(spark, apply(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
