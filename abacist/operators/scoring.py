"""Extract an equation from every response and verify it.

Both jobs are narrow: no shuffle, whatever the sizes or repetitions. Each adds
one Arrow stage that only sees the rows the native columns cannot settle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.functions import arithmetic as A
from abacist.functions import text as T
from abacist.functions.residual import DIVISION, SYNTAX_DETAIL, residual_verdict

# --- fixed values: reason texts ---
NOT_EXTRACTED = "Failed to extract equation from response"
INVALID = "Invalid equation"
SYNTAX = "SyntaxError="
PROCESSING = "While ast processing raised Error="
NUMBERS = "Numbers in equation do not match nums list"
GOOD = "All good"
# --- end of fixed values ---


def _screened(cands: Column) -> Column:
    """Cleaned candidates with their status, hopeless ones dropped."""
    rated = F.transform(
        F.transform(cands, T.lhs_of_equals),
        lambda c: F.struct(
            c.alias("text"),
            F.when(T.is_candidate(c), A.grammar_status(c)).otherwise(A.BAD).alias("status"),
        ),
    )
    return F.filter(rated, lambda c: c["status"] != A.BAD)


@lru_cache(maxsize=4)
def _pick_columns(session: SparkSession) -> tuple[Column, Column]:
    """``pick`` and ``rest`` of :func:`_with_pick`; large, so built once per session."""
    space = F.col("_space")
    first = F.lit(0)
    pick = F.coalesce(
        F.get(_screened(F.array(T.first_tag(space))), first),
        F.get(_screened(T.tag_candidates(space)), first),
        F.get(_screened(T.label_candidates(space)), first),
        F.get(_screened(F.array(T.last_line(space))), first),
        F.get(_screened(F.array(space)), first),
    )
    rest = F.transform(_screened(T.candidates(space)), lambda c: c["text"])
    return pick, F.when(F.col("_pick.status") == A.OTHER, rest)


@lru_cache(maxsize=4)
def _value_column(session: SparkSession) -> Column:
    return A.evaluate_native(F.col("_e"))


@lru_cache(maxsize=4)
def _exact_column(session: SparkSession) -> Column:
    return A.evaluate_exact(F.col("_e"))


def _with_exact(df: DataFrame) -> DataFrame:
    """``_exact``: the value of plain expressions with more digits than a double holds; ``_beyond`` marks those of them
    that columns can't tell."""
    long = (F.col("_status") == A.OK) & ~A.exactly_evaluable(F.col("_e"))
    exact = df.withColumn("_exact", F.when(long, _exact_column(df.sparkSession)))
    unknown = F.col("_exact.value").isNull() & ~F.col("_exact.zero_division")
    return exact.withColumn("_beyond", F.col("_exact").isNotNull() & unknown)


def _with_pick(df: DataFrame, text_col: str) -> DataFrame:
    """``_pick``: the first candidate that is or may be an expression.

    ``_rest``: every candidate left, only where the pick needs the host grammar
    and might still be refused by it. Later sources of candidates are evaluated
    only where the earlier ones gave none.
    """
    pick, rest = _pick_columns(df.sparkSession)
    return (
        df.withColumn("_space", T.search_space(F.col(text_col)))
        .withColumn("_pick", pick)
        .withColumn("_rest", rest)
    )


def extract_equation(df: DataFrame, text_col: str = "response", out: str = "equation") -> DataFrame:
    """Add the equation found in ``text_col``; NULL where there is none."""
    picked = _with_pick(df, text_col)
    nothing = F.array().cast("array<bigint>")
    asked = residual_verdict(F.col("_rest"), nothing, F.lit(0).cast("bigint"))
    native = F.when(F.col("_pick.status") == A.OK, F.col("_pick.text"))
    return (
        picked.withColumn("_asked", asked)
        .withColumn(out, F.coalesce(native, F.col("_asked.equation")))
        .drop("_space", "_pick", "_rest", "_asked")
    )


def _with_verdict(df: DataFrame, nums: Column, target: Column, tolerance: float) -> DataFrame:
    """From ``_e`` (text), ``_status`` and ``_rest`` (texts for the host grammar) to a verdict.

    Status is ``ok`` / ``bad`` / ``other`` as in :mod:`abacist.functions.arithmetic`,
    or the reason code to give outright.
    """
    asking = F.col("_rest").isNotNull()
    settled = ~asking & (F.col("_status") == A.OK)
    short = settled & F.col("_exact").isNull()
    e = F.col("_e")
    # Costly columns come before the Arrow stage, which no filter is pushed
    # through, so a filter on the verdict does not evaluate them again. Taking
    # ``_value`` apart keeps their projection from being merged into the next.
    judged = (
        df.withColumns(
            {
                "_value": F.when(short, _value_column(df.sparkSession)),
                "_match": F.when(settled, A.number_match(A.equation_numbers(e), nums)),
            }
        )
        .withColumns(
            {
                "_asked": residual_verdict(F.col("_rest"), nums, target, tolerance),
                "_number": F.coalesce("_value.value", "_exact.value"),
                "_zero": F.coalesce("_value.zero_division", "_exact.zero_division"),
                "_whole": F.col("_exact.whole"),
            }
        )
        .drop("_value", "_exact", "_beyond")
    )
    value = F.col("_number")
    # Of a long integer the difference is taken before it is rounded.
    gap = F.abs(F.try_subtract("_whole", target.cast("decimal(38,0)"))).cast("double") <= F.lit(tolerance)
    code = (
        F.when(asking, F.col("_asked.code"))
        .when(F.col("_status") == A.BAD, "syntax")
        .when(F.col("_status") != A.OK, F.col("_status"))
        .when(F.col("_zero"), "processing")
        .when(~F.coalesce("_match", F.lit(False)), "numbers")
        .when(F.when(F.col("_whole").isNotNull(), gap).otherwise(A.within_tolerance(value, target, tolerance)), "ok")
        .otherwise("value")
    )
    judged = judged.withColumn("reason_code", code)
    return judged.withColumns(
        {
            "ok": F.col("reason_code") == "ok",
            "result": F.when(
                F.col("reason_code").isin("ok", "value"), F.coalesce(F.col("_asked.result"), value)
            ),
            "_detail": F.coalesce(
                F.col("_asked.detail"),
                F.when(F.col("reason_code") == "processing", DIVISION).otherwise(SYNTAX_DETAIL),
            ),
        }
    )


def _reason(equation: Column, target: Column) -> Column:
    code = F.col("reason_code")
    return (
        F.when(code == "ok", GOOD)
        .when(code == "value", F.concat(F.lit("Equation "), equation, F.lit(" != "), F.coalesce(target.cast("string"), F.lit("None"))))
        .when(code == "numbers", NUMBERS)
        .when(code == "processing", F.concat(F.lit(PROCESSING), F.col("_detail")))
        .when(code == "syntax", F.concat(F.lit(SYNTAX), F.col("_detail")))
        .when(code == "invalid", INVALID)
        .otherwise(NOT_EXTRACTED)
    )


def verify_equations(
    df: DataFrame,
    equation: str = "equation",
    nums: str = "nums",
    target: str = "target",
    tolerance: float = 1e-6,
    native: bool = True,
) -> DataFrame:
    """Add ``ok, reason_code, reason, result`` for an equation column.

    ``native=False`` sends every equation through the host grammar, as a cross-check.
    """
    e = F.col("_e")
    staged = df.withColumn("_e", T.strip(F.col(equation)))
    status = F.when(e.isNull() | (e == ""), "invalid")
    if native:
        status = status.otherwise(A.grammar_status(e))
    else:
        status = status.otherwise(A.OTHER)
    staged = _with_exact(staged.withColumn("_status", status))
    unsettled = (F.col("_status") == A.OTHER) | F.col("_beyond")
    staged = staged.withColumn("_rest", F.when(unsettled, F.array(e)))
    judged = _with_verdict(staged, F.col(nums), F.col(target), tolerance)
    return judged.withColumn("reason", _reason(e, F.col(target))).drop(
        "_e", "_status", "_rest", "_asked", "_number", "_zero", "_whole", "_match", "_detail"
    )


def register_view(spark: SparkSession, source: str, name: str, **how) -> None:
    """Make ``name`` a view of the table or view ``source`` with the verdict on its equations, for use from SQL.

    ``how`` is passed to :func:`verify_equations`. Plain equations are settled by
    column expressions, as there; :mod:`abacist.functions.sql` has the same as a function.
    """
    verify_equations(spark.table(source), **how).createOrReplaceTempView(name)


def score_responses(
    df: DataFrame,
    text_col: str = "response",
    nums: str = "nums",
    target: str = "target",
    tolerance: float = 1e-6,
) -> DataFrame:
    """Add ``equation, correct, reason_code, reason, result`` to a response table.

    Extraction and verification share one pass and one Arrow stage.
    """
    picked = _with_pick(df, text_col)
    e = F.col("_e")
    staged = _with_exact(
        picked.withColumns(
            {
                "_e": F.col("_pick.text"),
                "_status": F.coalesce(F.col("_pick.status"), F.lit("not_extracted")),
            }
        )
    ).withColumn("_rest", F.coalesce(F.col("_rest"), F.when(F.col("_beyond"), F.array(e))))
    judged = _with_verdict(staged, F.col(nums), F.col(target), tolerance)
    # A residual pick that the host grammar refuses was never an equation.
    refused = F.col("reason_code") == "syntax"
    judged = judged.withColumns(
        {
            "reason_code": F.when(refused, "not_extracted").otherwise(F.col("reason_code")),
            "equation": F.when(F.col("_rest").isNotNull(), F.col("_asked.equation")).otherwise(e),
        }
    )
    return (
        judged.withColumn("reason", _reason(F.col("equation"), F.col(target)))
        .withColumnRenamed("ok", "correct")
        .drop("_space", "_pick", "_e", "_status", "_rest", "_asked", "_number", "_zero", "_whole", "_match", "_detail")
    )


def parse_status(df: DataFrame, equation: str = "equation") -> DataFrame:
    """Add ``parses``: whether the host grammar accepts the stripped equation."""
    out = verify_equations(
        df.withColumn("_no_nums", F.array().cast("array<bigint>")).withColumn(
            "_no_target", F.lit(0).cast("bigint")
        ),
        equation,
        "_no_nums",
        "_no_target",
    )
    return out.withColumn("parses", ~F.col("reason_code").isin("invalid", "syntax")).select(
        *df.columns, "parses"
    )
