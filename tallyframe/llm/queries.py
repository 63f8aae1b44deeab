"""The queries of this subpackage, one per operator, over whole tables; and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import audit, bpe, fingerprints, language, maxent, packing, quality, resampling, sharding, simhash, suffixes, token_index, warc
from tallyframe.llm.common import table

#: Where the public vocabularies are; a caller may point elsewhere.
JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), JSON_VOCABULARY).drop("source")


def op4_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(table(spark, sf_dir, "documents"))


def op6_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.token_index(table(spark, sf_dir, "documents"), JSON_VOCABULARY, end_id=0).drop("shard")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANK_VOCABULARY)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for n, f in list(globals().items()) if n.startswith("op") and n[2].isdigit()}
ORACLES: dict[str, str] = {"op1_warc_derivatives": warc.oracle(), "op7_suffix_array_dedup": suffixes.oracle(), "op8_quality_lines": quality.oracle(), "op11_filter_audit": audit.oracle(), "op12_importance_resampling": resampling.oracle()}
