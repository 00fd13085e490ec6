"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from abacist.llm import packing, quality, simhash, substring
from abacist.llm.queries import vocabulary_file
from abacist.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; models and bands are those of ``docs``."""
    return quality.Rules(docs).keep(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus."""
    return substring.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

# Perplexity, XXH64 and tokenizers are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
