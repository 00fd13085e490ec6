"""Plans: what must, and must not, be in them."""

import re

import pytest

import __spark_entry__ as entry
from abacist.operators import dedup, scoring
from abacist.sources import puzzles

PYTHON = re.compile("ArrowEvalPython|BatchEvalPython|MapInPandas|PythonMapInArrow")
NATIVE = (
    "build_prompt render_chat chunk_slice join_responses make_splits sample_exact_n seeded_shuffle "
    "last_wins throughput length_stats tag_candidates label_candidates last_line lhs_of_equals "
    "candidate_filter normalize_equation fallback_equation token_counts equation_numbers "
    "evaluate_native number_match tolerance_check strip_think response_preview"
).split()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_native_queries(spark, sf, name):
    assert not PYTHON.search(_plan(entry.queries()[name](spark, sf)))


def test_scoring_has_one_python_stage_and_adds_no_shuffle(spark, sf):
    answered = puzzles.answered(spark, sf)
    for df in (
        scoring.score_responses(answered),
        scoring.score_responses(answered).filter("correct and equation is not null"),
    ):
        assert len(PYTHON.findall(_plan(df))) == 1
        # Each form of the evaluation, flat, nested and exact, is in the plan once, also below a filter on its result.
        assert len(re.findall(r"\baggregate\(", _plan(df))) == 3
        assert _plan(df).count("Exchange") == _plan(answered).count("Exchange")


def test_dedup_reduces_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey id", "o_orderkey idx")
    plan = _plan(dedup.last_wins(df))
    assert plan.index("Partial") > plan.index("Exchange")
    assert plan.count("WindowGroupLimit") >= 2


def test_splits_move_no_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey idx")
    from abacist.operators.ordering import make_splits

    plan = _plan(make_splits(df))
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["build_sft_rows", "build_submission", "reason_histogram", "global_index"])
def test_no_cartesian_products(spark, sf, name):
    plan = _plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bucketed_tables_join_without_a_shuffle(spark, sf, tmp_path):
    from abacist.operators.batchmap import join_responses
    from abacist.sources import sinks

    sinks.write_bucketed(puzzles.problems(spark, sf), "puzzles_b", f"{tmp_path}/p", 4)
    sinks.write_bucketed(puzzles.responses(spark, sf), "responses_b", f"{tmp_path}/r", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_responses(spark.table("puzzles_b"), spark.table("responses_b"))
        assert "Exchange" not in _plan(joined)
        assert joined.count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE puzzles_b")
        spark.sql("DROP TABLE responses_b")
