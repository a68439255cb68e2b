"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filters, lm, neardup, ngramjoin, oracle, packing, passages, pii, quality, secrets, sharding, tokenfiles
from .base import documents


def _vocabulary(name: str) -> str:
    """A public tokenizer's file, installed on every machine; never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


def op3_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(documents(spark, sf_dir))


def op4_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op5_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.report(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op6_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(documents(spark, sf_dir))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.report(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_secret_scan,
        op2_line_quality,
        op3_minhash_bayes,
        op4_dp_packing,
        op5_arrow_token_files,
        op6_pii_boosting,
        op7_pitman_yor,
        op8_compact_windows,
        op9_wu_manber,
        op10_histogram_sort,
        op11_ngram_join,
        op12_filter_audit,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": oracle.SECRETS, "op2_line_quality": oracle.LINE_QUALITY, "op3_minhash_bayes": oracle.NEAR_DUPLICATES, "op9_wu_manber": oracle.DECONTAMINATION, "op11_ngram_join": oracle.NGRAM_JOIN, "op12_filter_audit": oracle.FILTER_AUDIT}
