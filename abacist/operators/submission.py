"""Assemble a keyed submission from a template and model results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import text as T
from abacist.operators.dedup import last_wins
from abacist.operators.scoring import verify_equations
from abacist.sources.schemas import require_columns


def check_inputs(
    template: DataFrame,
    results: DataFrame,
    needed: set[str] = frozenset({"id", "equation", "nums", "target"}),
) -> DataFrame:
    """Fail on missing columns or ids; one row of counts otherwise.

    The counts take one pass here and now, so give it stored rows, or responses
    before extraction with ``needed`` naming what they must have.
    """
    require_columns(template, {"id", "equation"}, "the template")
    require_columns(results, set(needed), "the results")
    counts = contract_counts(results)
    row = counts.first()
    if row["n_missing_id"]:
        raise ValueError("some results have no id")
    return results.sparkSession.createDataFrame([row], counts.schema)


def with_ids(results: DataFrame) -> DataFrame:
    """``results``, which fail in the pass that reads them if a row has no id."""
    missing = F.raise_error(F.lit("some results have no id")).cast(results.schema["id"].dataType)
    return results.withColumn("id", F.when(F.col("id").isNull(), missing).otherwise(F.col("id")))


def contract_counts(results: DataFrame) -> DataFrame:
    counts = [F.count(F.lit(1)).alias("n_results"), F.count_if(F.col("id").isNull()).alias("n_missing_id")]
    if "equation" in results.columns:
        counts.append(F.count_if(F.col("equation").isNull()).alias("n_missing_equation"))
    return results.agg(*counts)


def stats_warning(n_fallback: int) -> str | None:
    """What to tell the user when rows had to fall back."""
    if not n_fallback:
        return None
    return f"{n_fallback} rows have no equation and carry the fallback {T.FALLBACK!r}"


def matched_ids(template: DataFrame, results: DataFrame) -> DataFrame:
    """Template rows that have a result. Ids are made distinct before they travel."""
    return template.join(results.select("id").distinct(), "id", "left_semi")


def missing_ids(template: DataFrame, results: DataFrame) -> DataFrame:
    """Template rows that have none."""
    return template.join(results.select("id").distinct(), "id", "left_anti")


def build_submission(
    template: DataFrame, results: DataFrame, order_col: str = "idx", tolerance: float = 1e-6
) -> DataFrame:
    """Every template row, duplicates too, with the equation of the last result of its id.

    Each result is verified once, before the join, as it will be emitted. The
    right side has one row per id, so a frequent template id cannot multiply
    rows and adaptive execution may split it. Results of ids the template lacks
    go before anything is computed for them. Adds ``matched``, ``extracted``
    and ``valid`` for :func:`submission_stats`.
    """
    require_columns(template, {"id", "equation"}, "the template")
    wanted = results.select("id", "equation", "nums", "target", order_col).join(
        template.select("id").distinct(), "id", "left_semi"
    )
    latest = last_wins(wanted, "id", order_col)
    emitted = latest.select(
        "id",
        "nums",
        "target",
        F.col("equation").isNotNull().alias("extracted"),
        T.equation_or_fallback(F.col("equation")).alias("_emitted"),
    )
    verified = verify_equations(emitted, "_emitted", tolerance=tolerance).select(
        "id", "_emitted", "extracted", F.col("ok").alias("valid"), F.lit(True).alias("matched")
    )
    joined = template.drop("equation").join(verified, "id", "left")
    no = F.lit(False)
    return joined.select(
        *[
            F.coalesce("_emitted", F.lit(T.FALLBACK)).alias("equation") if c == "equation" else c
            for c in template.columns
        ],
        F.coalesce("matched", no).alias("matched"),
        F.coalesce("extracted", no).alias("extracted"),
        F.coalesce("valid", no).alias("valid"),
    )


def stats_columns() -> list[Column]:
    """Aggregates over a built submission. A blank equation counts as extracted."""
    n = F.count(F.lit(1))

    def share(part):
        return F.coalesce(F.try_divide(part.cast("double"), n.cast("double")), F.lit(0.0))

    extracted, valid = F.count_if("extracted"), F.count_if("valid")
    return [
        n.alias("n_total"),
        extracted.alias("n_extracted"),
        (n - extracted).alias("n_fallback"),
        share(extracted).alias("extracted_rate"),
        valid.alias("n_valid_by_local_validator"),
        share(valid).alias("expected_accuracy"),
    ]


def submission_stats(built: DataFrame) -> DataFrame:
    """Counts over a built submission."""
    return built.agg(*stats_columns())
