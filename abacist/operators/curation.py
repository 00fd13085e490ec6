"""From scored responses to training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import prompts as P
from abacist.functions import text as T
from abacist.operators.dedup import dedup_keep_first
from abacist.operators.ordering import global_index

# Fixed value: the columns of a saved training set.
SAVED = [
    "messages",
    "completion",
    "nums",
    "target",
    "train_idx",
    "prompt_tokens",
    "completion_tokens",
]


def filter_correct(df: DataFrame) -> DataFrame:
    """Rows marked correct that have an equation; both tests reach the scan."""
    return df.filter(F.col("correct") & F.col("equation").isNotNull())


def curated(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Correct rows with ``equation_norm``, first of each duplicate kept."""
    kept = filter_correct(df).withColumn("equation_norm", T.normalize_equation(F.col("equation")))
    return dedup_keep_first(kept, order_cols)


def build_sft_rows(
    df: DataFrame,
    order_cols: list[str],
    template: P.ChatTemplate = P.ChatTemplate(),
    counter: Callable[[Column], Column] = T.word_count,
) -> DataFrame:
    """Messages, completion and token counts for curated rows.

    ``train_idx`` is kept where the table has it, else rows are numbered in
    ``order_cols``.
    """
    if "train_idx" not in df.columns:
        df = global_index(df, order_cols, out="train_idx")
    built = df.withColumn("messages", P.puzzle_messages(F.col("nums"), F.col("target")))
    rows = built.withColumns(
        {
            "completion": P.completion(F.col("equation_norm")),
            "prompt_tokens": counter(P.render_chat(F.col("messages"), template)),
        }
    )
    return rows.withColumn("completion_tokens", counter(F.col("completion"))).withColumn(
        "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")
    )


def curation_funnel(raw: DataFrame) -> DataFrame:
    """Rows read, kept as correct, and left after dedup, without carrying any row."""
    kept = F.coalesce(F.col("correct") & F.col("equation").isNotNull(), F.lit(False))
    key = F.struct(
        F.sort_array("nums").alias("nums"),
        F.col("target").alias("target"),
        T.normalize_equation(F.col("equation")).alias("equation_norm"),
    )
    # A key is one row after the first step, however often it occurs.
    per_key = (
        raw.select(F.when(kept, key).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n_raw = F.coalesce(F.sum("n"), F.lit(0))
    n_correct = F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0))
    n_kept = F.count("key")
    return per_key.agg(
        n_raw.alias("n_raw"),
        n_correct.alias("n_correct"),
        n_kept.alias("n_after_dedup"),
        F.coalesce(F.try_divide(n_correct.cast("double"), n_raw.cast("double")), F.lit(0.0)).alias(
            "correct_share"
        ),
        (n_correct - n_kept).alias("n_removed"),
    )


def funnel_of(raw: DataFrame, n_after_dedup: int, chunk: str | None = None) -> DataFrame:
    """The same funnel where the number of curated rows is known: counts alone, of two columns, no shuffle of rows.

    With ``chunk``, the column of that name tells how many chunks were read (``chunks_used``).
    """
    kept = F.col("correct") & F.col("equation").isNotNull()
    n_kept = F.lit(n_after_dedup).cast("bigint")
    per = raw.groupBy(*([chunk] if chunk else [])).agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(kept).alias("n_correct")
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_raw", "n_correct")]
    counts = per.agg(*sums, *([F.count(F.lit(1)).alias("chunks_used")] if chunk else []))
    share = F.try_divide(F.col("n_correct").cast("double"), F.col("n_raw").cast("double"))
    return counts.select(
        "n_raw",
        "n_correct",
        n_kept.alias("n_after_dedup"),
        F.coalesce(share, F.lit(0.0)).alias("correct_share"),
        (F.col("n_correct") - n_kept).alias("n_removed"),
        *(["chunks_used"] if chunk else []),
    )


def budget_flags(df: DataFrame, cap: int = 256, prompt_cap: int = 2048) -> DataFrame:
    """Whether a training row fits the length cap and whether its prompt would be cut."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return df.withColumns(
        {
            "fits_budget": total <= cap,
            "was_truncated": F.col("prompt_tokens") > prompt_cap,
        }
    )


def render_sft(
    df: DataFrame, template: P.ChatTemplate = P.ChatTemplate(), eos: str = ""
) -> DataFrame:
    """The prompt and completion strings a trainer reads."""
    return df.select(
        P.render_chat(F.col("messages"), template).alias("prompt"),
        P.with_eos(F.col("completion"), eos).alias("completion"),
    )
