"""Sinks. All are written by the executors and overwrite the named folder, or of a table by chunk the chunks they bring."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from abacist.operators.curation import SAVED
from abacist.operators.ordering import sample_exact_n
from abacist.session import setting
from abacist.sources.readers import FILE_ORDER
from abacist.sources.schemas import SFT_TRAIN


def write_splits(df: DataFrame, path: str) -> None:
    """A table with a ``split`` column, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Rows with a ``chunk`` column, one folder per chunk; folders of chunks that ``df`` has no rows of stay as they are.

    Rows gather by chunk, so a chunk is few files, and adaptive execution splits a chunk
    that is much larger than others. It does not merge tasks with few bytes: their work is
    the number of folders, also where a chunk is one row. Writing the same rows again
    changes nothing.
    """
    by_chunk = df.hint("rebalance", F.col(chunk)).write.mode("overwrite").partitionBy(chunk)
    with setting(df.sparkSession, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        by_chunk.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_summaries(df: DataFrame, path: str, first_chunk: int, n_chunks: int) -> None:
    """Rows with a ``chunk`` column, one per chunk, in one folder for the range of chunks they were asked for.

    The same range replaces its folder, another one gets its own and touches none.
    ``written`` says which row of a chunk is the last.
    """
    named = {"written": time.time_ns(), "first_chunk": first_chunk, "n_chunks": n_chunks}
    of_range = df.withColumns({c: F.lit(v).cast("bigint") for c, v in named.items()}).write.mode("overwrite")
    of_range = of_range.partitionBy("first_chunk", "n_chunks").option("partitionOverwriteMode", "dynamic")
    of_range.parquet(path)


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], summary: list[Column]) -> DataFrame:
    """``write(df)``, and the one row of the aggregates ``summary`` over what was written, from the same pass.

    The figures are collected by the tasks that write, and of each partition once, so
    a lost executor or a repeated task counts nothing twice.
    """
    seen = Observation()
    write(df.observe(seen, *summary))
    found, schema = seen.get, df.agg(*summary).schema
    return df.sparkSession.createDataFrame([tuple(found[name] for name in schema.names)], schema)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of one row, or one per metric, as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_results_json(df: DataFrame, summary: list[Column], path: str) -> tuple[DataFrame, DataFrame]:
    """``path/per_example`` as JSON lines and ``path/summary``, in one pass; returns both, the rows as stored."""
    row = write_observed(df, lambda rows: rows.write.mode("overwrite").json(f"{path}/per_example"), summary)
    write_summary(row, f"{path}/summary")
    return df.sparkSession.read.schema(df.schema).json(f"{path}/per_example"), row


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "idx") -> None:
    """A catalog table bucketed by ``key``. Puzzles and responses stored with the
    same bucket count are joined without moving either."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)


def write_submission(df: DataFrame, path: str, order_cols: list[str] = FILE_ORDER) -> None:
    """CSV with a header. Part files in name order hold the rows in template order.

    Quotes are doubled and blanks stay, so columns that pass through do not change.
    """
    helpers = {*order_cols, "matched", "extracted", "valid"}
    out = df.orderBy(*order_cols).select(*[c for c in df.columns if c not in helpers])
    write_csv(out, path)


def write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(**blanks).csv(path)


def write_sft(
    df: DataFrame, path: str, small_n: int = 2000, seed: int = 42, summary: list[Column] | None = None
) -> DataFrame:
    """The full training set and an exact-size sample of it, same columns; returns one row of ``summary`` of the set.

    The sample is drawn from the written table, so the rows are computed once.
    """
    full = f"{path}/full"
    write = partial(write_results, path=full)
    seen = write_observed(df.select(*SAVED), write, summary or [F.count(F.lit(1)).alias("n")])
    stored = df.sparkSession.read.schema(SFT_TRAIN).parquet(full)
    # One puzzle may keep several equations, which the completion tells apart.
    small = sample_exact_n(stored, small_n, seed, key="train_idx", ties=("completion",))
    small.write.mode("overwrite").parquet(f"{path}/small")
    return seen
