"""Corpus cleaning: five stages over ``documents``, each on what its predecessor kept.

Language ID drops texts of no accepted language, the n-gram join keeps one document of each class of
near copies, suffix-array removal cuts repeated passages, decontamination drops documents that
benchmark items cover, and BPE encodes and decodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlens.llm import bpe, decontaminate, language, ngram_join, suffix_dedup
from claimlens.llm.queries import byte_bpe
from claimlens.session import work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accepted_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; learnt from a bounded sample of labelled rows."""
    return language.accepted(docs, language.fit(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard 0.8 or more."""
    return ngram_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier string of 100 bytes."""
    return suffix_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than one word in twenty."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.encode_decode(docs, byte_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("language", accepted_language),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = work_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
