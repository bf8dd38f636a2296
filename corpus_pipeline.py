"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import decontam, exact_dedup, jaccard_join, langid, sentencepiece_fst
from bitloom.llm.common import MADE, clear, shared_path, table

#: A document whose language can't be told is rejected, and one in which no language has this share.
LEAST_SHARE = 0.35
#: Words of a shingle and least similarity (as a fraction) of the near stage.
NEAR_WORDS, NEAR_RATE = 5, (80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and documents that are no language's for the most part."""
    model = langid.train(docs.where(~langid.held_out()))
    label = langid.labels(spark, model, F.col("text"))
    return docs.where((label.lang_pred != langid.UNKNOWN) & (label.score >= LEAST_SHARE))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of the n-gram join connect, the smallest doc_id stays."""
    return jaccard_join.one_per_group(docs, words=NEAR_WORDS, rate=NEAR_RATE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to edits, go."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and whether they decode to it."""
    return sentencepiece_fst.op7(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: Language models and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path, made = shared_path(spark, f"stage-{name}", lasting=True), len(MADE)
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, made)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
