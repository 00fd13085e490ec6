"""Lengths and distinct keys by chunk, as sketches that merge.

A chunk is read once and leaves a row of bounded size. Any range of chunks is then
answered from these rows alone, in whatever order and grouping they are merged;
scoring a chunk again replaces its row. The exact ways stay the default:
:func:`abacist.operators.metrics.length_stats` and
:func:`abacist.operators.curation.curation_funnel`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import text as T

# Size parameter of a quantile sketch. The rank of a quantile is off by less than
# RANK_ERROR of all values, in 99 of 100 sketches; up to this many values it is exact.
K, RANK_ERROR = 400, 0.0075
# Binary logarithm of the number of hashes in a distinct-count sketch: up to that many keys are counted exactly,
# beyond, the standard error is 1 / sqrt(hashes), and of a difference that of the larger set.
LG_HASHES = 14
DISTINCT_ERROR = 2**-7


def length_sketches(df: DataFrame, metrics: list[str], chunk: str = "chunk", k: int = K) -> DataFrame:
    """``chunk, metric, n, total, squares, min, max, sketch``: one row per chunk and metric, NULL values left out."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as bigint)" for m in metrics)
    long = df.select(chunk, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)")).filter("value is not null")
    v = F.col("value")
    wide = v.cast("decimal(19,0)")
    return long.groupBy(chunk, "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(wide).alias("total"),
        F.sum(wide * wide).alias("squares"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.kll_sketch_agg_bigint(v, F.lit(k)).alias("sketch"),
    )


def merged_lengths(sketches: DataFrame, keys: list[str] = (), k: int = K) -> DataFrame:
    """``metric, n, mean, std, min, p50, p95, max`` over all chunks of ``sketches``, or for each value of ``keys``.

    All but the percentiles are exact. A percentile is the value of a rank that is
    off by less than :data:`RANK_ERROR`.
    """
    n = F.sum("n")
    total, squares = (F.sum(c).cast("double") for c in ("total", "squares"))
    variance = F.try_divide(squares - total * total / n, (n - 1).cast("double"))
    merged = F.kll_merge_agg_bigint("sketch", F.lit(k))
    sums = sketches.groupBy(*keys, "metric").agg(
        n.alias("n"),
        (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        merged.alias("sketch"),
    )
    quantiles = F.kll_sketch_get_quantile_bigint("sketch", F.array(F.lit(0.5), F.lit(0.95)))
    return sums.withColumn("at", quantiles).select(
        *keys, "metric", "n", "mean", "std", "min", F.col("at")[0].alias("p50"), F.col("at")[1].alias("p95"), "max"
    )


def _key() -> Column:
    """What the curation holds to be one example, as one value."""
    numbers = F.to_json(F.sort_array("nums"))
    return F.sha2(F.concat_ws("|", numbers, F.col("target").cast("string"), T.normalize_equation(F.col("equation"))), 256)


def key_sketches(scored: DataFrame, chunk: str = "chunk", lg_hashes: int = LG_HASHES) -> DataFrame:
    """``chunk, n_raw, n_correct, keys``: counts of a chunk, and a sketch of the different examples it would give.

    A key leaves its task as a hash, so no key is shuffled.
    """
    kept = F.coalesce(F.col("correct") & F.col("equation").isNotNull(), F.lit(False))
    return scored.groupBy(chunk).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(kept).alias("n_correct"),
        F.theta_sketch_agg(F.when(kept, _key()), F.lit(lg_hashes)).alias("keys"),
    )


def merged_funnel(sketches: DataFrame, keys: list[str] = (), lg_hashes: int = LG_HASHES) -> DataFrame:
    """The curation's funnel over all chunks of ``sketches``; ``n_after_dedup`` is an estimate (:data:`DISTINCT_ERROR`)."""
    sums = sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("n_raw"), F.lit(0)).alias("n_raw"),
        F.coalesce(F.sum("n_correct"), F.lit(0)).alias("n_correct"),
        F.theta_union_agg("keys", F.lit(lg_hashes)).alias("keys"),
    )
    n_kept = F.coalesce(F.theta_sketch_estimate("keys"), F.lit(0)).cast("bigint")
    share = F.try_divide(F.col("n_correct").cast("double"), F.col("n_raw").cast("double"))
    return sums.select(
        *keys,
        "n_raw",
        "n_correct",
        n_kept.alias("n_after_dedup"),
        F.coalesce(share, F.lit(0.0)).alias("correct_share"),
        (F.col("n_correct") - n_kept).alias("n_removed"),
    )


def new_keys(sketches: DataFrame, before: DataFrame, lg_hashes: int = LG_HASHES) -> DataFrame:
    """``n_new``: how many different examples the chunks of ``sketches`` have that those of ``before`` lack."""
    one, two = (
        x.agg(F.theta_union_agg("keys", F.lit(lg_hashes)).alias(name))
        for x, name in ((sketches, "these"), (before, "those"))
    )
    # One row on either side.
    both = one.join(two)
    left = F.when(F.col("those").isNull(), F.col("these")).otherwise(F.theta_difference("these", "those"))
    return both.select(F.coalesce(F.theta_sketch_estimate(left), F.lit(0)).cast("bigint").alias("n_new"))
