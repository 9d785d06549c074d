"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import Folders, stage
from veilspark.llm import decontaminate, jaccard_join, lpf_dedup, mil_toxicity, queries, sentencepiece_codec


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3; the others go."""
    model = mil_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil_toxicity.score(docs, model, column="toxicity_score").where("toxicity_score < 0.3").drop("toxicity_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id."""
    return jaccard_join.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes or more that an earlier document, or the text before, has too."""
    return lpf_dedup.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; the others go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to."""
    return sentencepiece_codec.encode(docs, queries.PIECE_MODEL)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("encoding", encoding),
]

#: SQL can't express the fitted classifier, the merge rounds or the suffix arrays.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder before the next one reads it.

    Once a stage's result is written, what it wrote on its way and what it read from the stage before are deleted. Only
    folders of this run are; that of the last but one stage is the caller's, who reads it with the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Folders() as mine:
        for name, apply in STAGES[:-1]:
            docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
            mine.delete(spark, docs)
        return STAGES[-1][1](spark, docs, sf_dir)
