"""Summaries of scored responses. One aggregation each, partially aggregated
before the shuffle; ratios of empty tables are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.operators.ordering import first_by_index

PROJECTED = [1000, 5000, 10000, 20000]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _rows() -> Column:
    return F.count(F.lit(1))


def _correct() -> Column:
    return F.count_if(F.col("correct"))


def chars_summary(dataset_len: int | None = None, text_col: str = "response") -> list[Column]:
    """Aggregates: counts, rates and mean response length in characters, per ``dataset_len`` rows."""
    n = _rows() if dataset_len is None else F.lit(dataset_len).cast("bigint")
    return [
        n.alias("dataset_len"),
        F.count("equation").alias("equation_extracted"),
        _correct().alias("equation_correct"),
        _share(F.count("equation"), n).alias("extracted_rate"),
        _share(_correct(), n).alias("accuracy"),
        _share(F.sum(F.length(text_col)), n).alias("avg_response_chars"),
    ]


def eval_summary_chars(
    df: DataFrame, dataset_len: int | None = None, text_col: str = "response"
) -> DataFrame:
    """Counts, rates and mean response length in characters, per ``dataset_len`` rows."""
    return df.agg(*chars_summary(dataset_len, text_col))


def _token_sums() -> list[Column]:
    return [
        _rows().alias("n_examples"),
        F.count("equation").alias("equation_extracted"),
        _correct().alias("equation_correct"),
        F.sum("response_n_tokens").alias("_tokens"),
    ]


def _with_token_rates(sums: DataFrame) -> DataFrame:
    n = F.col("n_examples")
    return sums.withColumns(
        {
            "extracted_rate": _share(F.col("equation_extracted"), n),
            "accuracy": _share(F.col("equation_correct"), n),
            "avg_response_tokens": _share(F.col("_tokens"), n),
        }
    ).drop("_tokens")


def tokens_summary() -> list[Column]:
    """Aggregates: counts, rates and mean response length in tokens."""
    return [
        *_token_sums()[:-1],
        _share(F.count("equation"), _rows()).alias("extracted_rate"),
        _share(_correct(), _rows()).alias("accuracy"),
        _share(F.sum("response_n_tokens"), _rows()).alias("avg_response_tokens"),
    ]


def eval_summary_tokens(df: DataFrame) -> DataFrame:
    """Counts, rates and mean response length in tokens."""
    return df.agg(*tokens_summary())


def dev_metrics(df: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    out = df.agg(
        _share(_correct(), _rows()).alias("dev_accuracy"),
        _share(F.count("equation"), _rows()).alias("dev_extracted_rate"),
        _rows().alias("n_dev"),
    )
    return out if elapsed_s is None else out.withColumn("dev_eval_time_s", F.round(F.lit(elapsed_s), 1))


def _chunk_sums(df: DataFrame, chunk: str, index: str) -> DataFrame:
    has_run = {"elapsed_s", "model_id"} <= set(df.columns)
    run = [F.max("elapsed_s").alias("elapsed_s"), F.max("model_id").alias("model_id")]
    return df.groupBy(chunk).agg(
        *_token_sums(),
        F.min(index).alias("start_idx"),
        (F.max(index) + 1).alias("end_idx"),
        *(run if has_run else []),
    )


def chunk_summaries(df: DataFrame, chunk: str = "chunk", index: str = "idx") -> DataFrame:
    """The token summary per chunk, with index range."""
    return _with_token_rates(_chunk_sums(df, chunk, index))


def chunk_rollup(df: DataFrame, chunk: str = "chunk", index: str = "idx") -> DataFrame:
    """The token summary per chunk and over all (``is_total``), with index range.

    Chunks are summed first, so the rollup doubles one row per chunk, not the data.
    """
    per_chunk = _chunk_sums(df, chunk, index)
    summed = ["n_examples", "equation_extracted", "equation_correct", "_tokens"]
    over_chunks = [F.sum("elapsed_s").alias("elapsed_s"), F.max("model_id").alias("model_id")]
    rolled = per_chunk.rollup(chunk).agg(
        *[F.sum(c).alias(c) for c in summed],
        F.min("start_idx").alias("start_idx"),
        F.max("end_idx").alias("end_idx"),
        F.grouping(chunk).cast("bigint").alias("is_total"),
        *(over_chunks if "model_id" in per_chunk.columns else []),
    )
    return _with_token_rates(rolled)


def due_steps(
    df: DataFrame, eval_steps: int, eval_n_quick: int | None = None, index: str = "idx"
) -> DataFrame:
    """Predictions at every ``eval_steps``-th step but step 0, of the first ``eval_n_quick`` dev rows.

    ``df`` holds dev rows only. Which of them are first goes by their place among
    the dev rows, in the order of ``index``, whatever their indices are. Apply it
    before scoring, so only rows that are reported get scored.
    """
    if eval_n_quick:
        df = first_by_index(df, eval_n_quick, index)
    return df.filter((F.col("step") > 0) & (F.col("step") % eval_steps == 0))


def metrics_by_step(scored: DataFrame) -> DataFrame:
    """Dev metrics of every step present."""
    return scored.groupBy("step").agg(
        _share(_correct(), _rows()).alias("dev_accuracy"),
        _share(F.count("equation"), _rows()).alias("dev_extracted_rate"),
        _rows().alias("n_dev"),
    )


def reason_histogram(df: DataFrame) -> DataFrame:
    """How often every reason occurs, and its share of all rows."""
    per_reason = df.groupBy("reason_code").agg(_rows().alias("n"))
    # The window sees one row per reason code, a handful whatever the table.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return per_reason.select("reason_code", "n", _share(F.col("n"), total).alias("share"))


def token_histogram(df: DataFrame, width: int = 500) -> DataFrame:
    """Responses per token-length bucket and correctness."""
    bucket = (F.floor(F.col("response_n_tokens") / width) * width).alias("bucket_from")
    return df.groupBy(bucket, "correct").agg(_rows().alias("n"))


def cap_share(df: DataFrame, cap: int, short: int = 1000) -> DataFrame:
    """Share of responses that hit the token cap, and of correct ones below ``short`` tokens."""
    tokens = F.col("response_n_tokens")
    return df.agg(
        _rows().alias("n"),
        F.count_if(tokens >= cap).alias("n_capped"),
        _share(F.count_if(tokens >= cap), _rows()).alias("capped_share"),
        F.count_if(F.col("correct") & (tokens < short)).alias("n_correct_short"),
        _share(F.count_if(F.col("correct") & (tokens < short)), _correct()).alias(
            "correct_short_share"
        ),
    )


def throughput(df: DataFrame, run: str = "run", targets: list[int] = PROJECTED) -> DataFrame:
    """Speed of every run and hours it would take for each target row count.

    ``elapsed_s`` is the run's duration, repeated on its rows.
    """
    per_run = df.groupBy(run).agg(
        _rows().alias("n_examples"),
        F.sum("response_n_tokens").alias("total_tokens"),
        F.max("elapsed_s").alias("elapsed_s"),
    )
    seconds = _share(F.col("elapsed_s"), F.col("n_examples"))
    return per_run.withColumns(
        {
            "tokens_per_s": _share(F.col("total_tokens"), F.col("elapsed_s")),
            "s_per_example": seconds,
        }
    ).select(
        "*",
        F.explode(F.array(*[F.lit(t).cast("bigint") for t in targets])).alias("target_examples"),
    ).withColumn("projected_hours", F.col("s_per_example") * F.col("target_examples") / 3600)


def length_stats(df: DataFrame, metrics: list[str], exact: bool = True) -> DataFrame:
    """mean, std, min, p50, p95, max of every metric, one row each.

    Equal values are counted first, so quantiles work on distinct lengths with
    their frequencies instead of on the rows. Percentiles interpolate and are
    then cut to whole numbers. ``exact=False`` takes them from a sketch, for
    metrics with very many distinct values.
    """
    pairs = ", ".join(f"'{m}', cast(`{m}` as bigint)" for m in metrics)
    long = df.select(F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)")).filter(
        "value is not null"
    )
    v = F.col("value")
    if not exact:
        return long.groupBy("metric").agg(
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.percentile_approx(v, 0.5).alias("p50"),
            F.percentile_approx(v, 0.95).alias("p95"),
            F.max(v).alias("max"),
        )
    counted = long.groupBy("metric", "value").agg(_rows().alias("n"))
    n, wide = F.col("n"), "decimal(19,0)"
    rows = F.sum(n)
    total = F.sum(v.cast(wide) * n.cast(wide)).cast("double")
    squares = F.sum(v.cast(wide) * v.cast(wide) * n.cast(wide)).cast("double")
    variance = F.try_divide(squares - total * total / rows, (rows - 1).cast("double"))
    return counted.groupBy("metric").agg(
        (total / rows).alias("mean"),
        F.when(rows > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        F.min(v).alias("min"),
        F.percentile(v, 0.5, n).cast("bigint").alias("p50"),
        F.percentile(v, 0.95, n).cast("bigint").alias("p95"),
        F.max(v).alias("max"),
    )
