"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm import (
    chats,
    collocations,
    first_fit,
    hnsw,
    licenses,
    lm_scoring,
    packing,
    periods,
    quality,
    sentencepieces,
    simhash,
    substring,
    token_files,
)

Query = Callable[[SparkSession, str], DataFrame]
# Ids of the vocabulary file: 49,408.
WORD_VOCABULARY = 49_408


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark, sf_dir):
    """The target is what the labels call good; the background is every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lm_scoring.score_documents(_documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id"))


def op2_chat_formatting(spark, sf_dir):
    return chats.collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_sentencepiece(spark, sf_dir):
    """Ids of every text, and whether decoding them gives the text back."""
    model = vocabulary_file("piece_bpe_32k.model")
    docs = _documents(spark, sf_dir).select(
        "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("given")
    )
    back = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.xxhash64("text") == F.col("given")).alias("round_trip"),
    )


def op4_quality_rules(spark, sf_dir):
    return quality.judge_quality(_documents(spark, sf_dir))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6_substring_dedup(spark, sf_dir):
    clean = substring.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    one_blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return clean.select("doc_id", "n_words", "n_removed", F.sha2(one_blank, 256).alias("kept_sha256"))


def op7_embedding_near_dedup(spark, sf_dir):
    return hnsw.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_token_files(spark, sf_dir):
    return token_files.encode_documents(
        _documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"), end_id=2, vocabulary=WORD_VOCABULARY
    )


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"))


def op10_license_scans(spark, sf_dir):
    return licenses.scan_licenses(_documents(spark, sf_dir))


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``, where the texts that the contract chooses repeat a stretch of their words up to the end."""
    blanks, h = "[\\x20\\x09-\\x0D]+", F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", blanks), ""))
    docs = docs.select(F.col("doc_id").cast("long"), "text", words.alias("words"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("n", F.size("words"))
    docs = docs.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    said = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n"))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(said, " ")).otherwise(F.col("text")).alias("text"))


def op11_run_detection(spark, sf_dir):
    found = periods.find_runs(with_periods(_documents(spark, sf_dir)))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    columns = ["doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), "text"]
    found = found.select(*columns, F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"))
    start, length, period = F.col("longest.start"), -F.col("longest.less"), F.col("longest.period")
    return found.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * -longest.less div longest.period").alias("exponent_milli"),
        "runs_sha256", F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_first_fit_packing(spark, sf_dir):
    """Pieces with their checksums in place of their ids."""
    packed = first_fit.pack_documents(_documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))
    return first_fit.with_crc(packed)


def op13_collocations(spark, sf_dir):
    return collocations.mine(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_chat_formatting,
        op3_sentencepiece,
        op4_quality_rules,
        op5_simhash_near_dedup,
        op6_substring_dedup,
        op7_embedding_near_dedup,
        op8_token_files,
        op9_best_fit_packing,
        op10_license_scans,
        op11_run_detection,
        op12_first_fit_packing,
        op13_collocations,
    )
}
