"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import language, packing, quality, simhash, suffixes
from tallyframe.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Repeated passages from this many words on are removed.
PASSAGE = 51
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those unlike every language learned from the labelled ones."""
    predicted = language.predict(docs.select(*COLUMNS), language.train(docs))
    return predicted.filter((F.col("lang_pred") != language.UNKNOWN) & F.col("like")).select(*COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or that boilerplate lines deplete; the others lose those lines."""
    judged = quality.quality(docs.select(*COLUMNS), keep=True).filter("kept")
    return judged.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group of five-word shingle similarity 0.8 or more."""
    return simhash.deduplicate(docs.select(*COLUMNS), words=5, similarity=0.8)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of more than fifty words that stand more than once."""
    kept = suffixes.deduplicate_words(docs.select(*COLUMNS), PASSAGE)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2,048 tokens, each with the corpus's mixture of sources."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_mixture", identify_languages),
    ("quality_lines", filter_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_passages),
    ("mixture_packing", pack_sequences),
]

#: SQL expresses none of the stages after the second; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
