"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bitsliced, brown_lm, decontaminate, filter_audit, hard_negatives, jaccard_join, license_scan, lpf_dedup, mil_toxicity, sentencepiece_codec, shuffle_shards, token_count, url_reputation

_FILES = {"WORD_VOCABULARY": "word_bpe_49k.json", "PIECE_MODEL": "piece_bpe_32k.model"}


def __getattr__(name: str) -> str:
    """The vocabularies' paths, looked up when they are asked for: without their package all other queries work."""
    if name not in _FILES:
        raise AttributeError(name)
    import public_tokenizers

    return public_tokenizers.path(_FILES[name])


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"), url_reputation.RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), __getattr__("WORD_VOCABULARY"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.repeats(_read(spark, sf_dir, "documents"), keep_first=False).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_toxicity.toxicity_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return bitsliced.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.alignments(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scores(_read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), __getattr__("PIECE_MODEL"), digests=True)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_shards.shard_digest(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_reputation.ORACLE_SQL, "op5_exact_topk": bitsliced.ORACLE_SQL, "op9_jaccard_join": jaccard_join.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_license_scan": license_scan.ORACLE_SQL}
