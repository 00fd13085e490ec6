"""Response chunks scored as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from abacist.operators.scoring import score_responses
from abacist.sources.sinks import write_chunks

COUNTERS = "n_examples bigint, equation_extracted bigint, equation_correct bigint"


def _arriving(spark: SparkSession, in_dir: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(in_dir)


def stream_score(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType | str
) -> StreamingQuery:
    """Score new files and append the verdicts; stateless, exactly once by the file sink."""
    return (
        score_responses(_arriving(spark, in_dir, schema))
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_counters(
    spark: SparkSession,
    in_dir: str,
    table: str,
    checkpoint: str,
    schema: StructType | str,
    chunk: str = "chunk",
) -> StreamingQuery:
    """Running counts per chunk, as a table with one folder per chunk. State is one row per chunk.

    A batch writes the chunks it has new rows of, with their counts so far, and
    leaves the folders of all others alone. The counts of a batch come from the state
    its checkpoint names, so repeating it after a failure writes the same
    rows to the same folders.
    """
    counters = (
        score_responses(_arriving(spark, in_dir, schema))
        .groupBy(chunk)
        .agg(
            F.count(F.lit(1)).alias("n_examples"),
            F.count("equation").alias("equation_extracted"),
            F.count_if("correct").alias("equation_correct"),
        )
    )
    return (
        counters.writeStream.outputMode("update")
        .foreachBatch(lambda batch, _: upsert_counters(batch, table, chunk))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_counters(batch: DataFrame, table: str, chunk: str = "chunk") -> None:
    """Put the counts of ``batch``, one row per chunk, in place of what ``table`` has of these chunks."""
    write_chunks(batch, table, chunk)


def read_counters(spark: SparkSession, table: str, chunk: str = "chunk") -> DataFrame:
    """The counts of every chunk after the last batch; a filter on ``chunk`` opens its folder only."""
    return spark.read.schema(f"{COUNTERS}, {chunk} bigint").parquet(table)
