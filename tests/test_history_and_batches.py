"""Histories that grow by new steps only, samples by step, batches by length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.operators import batchmap, metrics, scoring
from abacist.plans import jobs
from abacist.sources import puzzles


@pytest.fixture
def stored(spark, sf, tmp_path):
    puzzles.predictions(spark, sf).write.partitionBy("step").parquet(f"{tmp_path}/predictions")
    return spark.read.parquet(f"{tmp_path}/predictions")


def figures(df):
    return {r.step: (r.dev_accuracy, r.dev_extracted_rate, r.n_dev) for r in df.collect()}


@pytest.mark.parametrize("quick", [None, 300])
def test_a_later_run_adds_new_steps(spark, stored, tmp_path, quick):
    path = f"{tmp_path}/history"
    first = jobs.evaluate_history(stored.filter("step <= 50"), path, 25, quick)
    assert {r.step: r.run for r in first.collect()} == {25: 1, 50: 1}
    both = jobs.evaluate_history(stored, path, 25, quick)
    assert {r.step: r.run for r in both.collect()} == {25: 1, 50: 1, 75: 2, 100: 2}
    rows = stored
    if quick:
        few = stored.filter("step <= 50").select("idx").distinct().orderBy("idx").limit(quick)
        rows = stored.filter(F.col("idx") <= few.agg(F.max("idx")).first()[0])
    assert figures(both) == figures(metrics.metrics_by_step(scoring.score_responses(metrics.due_steps(rows, 25))))
    third = jobs.evaluate_history(stored, path, 25, quick)
    assert {r.step: r.run for r in third.collect()} == {25: 1, 50: 1, 75: 2, 100: 2}
    again = jobs.evaluate_history(stored, path, 25, quick, again=(50,))
    assert {r.step: r.run for r in again.collect()}[50] == 3 and figures(again) == figures(both)
    assert spark.read.parquet(path).count() == 5


def test_a_later_run_reads_new_predictions_only(spark, stored, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    path = f"{tmp_path}/history"
    jobs.evaluate_history(stored.filter("step <= 50"), path, 25, 200)
    new = stored.filter("step = 75")
    jobs.evaluate_history(stored.filter("step <= 50").union(new.mapInArrow(counting, new.schema)), path, 25, 200)
    first = seen.value
    jobs.evaluate_history(stored.filter("step <= 75"), path, 25, 200)
    assert first == new.count()
    due = metrics.due_steps(stored, 25).filter(~F.col("step").isin([25, 50]))
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "NOT step" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_samples_of_every_step(spark, stored):
    scored = scoring.score_responses(stored)
    rows = jobs.samples_by_step(scored, 4).collect()
    for step in (0, 25, 50, 75, 100):
        want = sorted(r.idx for r in stored.filter(F.col("step") == step).select("idx").collect())[:4]
        assert sorted(r.idx for r in rows if r.step == step) == want
    assert "WindowGroupLimit" in jobs.samples_by_step(scored, 4)._jdf.queryExecution().executedPlan().toString()


def test_batches_keep_to_the_budget():
    lengths = np.random.default_rng(1).integers(0, 300, 500)
    batches = batchmap.by_length(lengths, 1000)
    assert sorted(np.concatenate(batches).tolist()) == list(range(500))
    assert all(len(b) * lengths[b].max() <= 1000 for b in batches)
    assert [len(b) for b in batchmap.by_length(np.array([5000, 10, 5000]), 1000)] == [1, 1, 1]
    assert batchmap.by_length(np.zeros(0, np.int64), 10) == []


@pytest.fixture
def echo():
    return lambda: lambda prompts: [p.upper() if p is not None else None for p in prompts]


@pytest.mark.parametrize("window, budget, partitions", [(50, 200, 1), (2048, 900, 3), (7, 10, 5)])
def test_answers_do_not_depend_on_the_batches(spark, echo, window, budget, partitions):
    df = spark.range(700).select("id", F.repeat(F.lit("w "), (F.col("id") * 7919 % 90).cast("int")).alias("prompt"))
    df = df.repartition(partitions)
    got = batchmap.map_by_length(df, echo, budget, window=window, key="id")
    rows = {r.id: r.response for r in got.collect()}
    assert rows == {r.id: r.prompt.upper() for r in df.collect()}
    assert got.filter("n_tokens > padded_to").count() == 0
    total = batchmap.padding_share(got).first()
    assert total.n_tokens == sum(i * 7919 % 90 for i in range(700)) <= total.padded_tokens


def test_less_padding_than_in_row_order(spark, echo):
    df = spark.range(3000).select("id", F.repeat(F.lit("w "), (F.col("id") * 7919 % 200).cast("int")).alias("prompt"))
    sorted_ = batchmap.padding_share(batchmap.map_by_length(df.coalesce(2), echo, 2000, key="id")).first()
    lengths = np.array([i * 7919 % 200 for i in range(3000)])
    rows = [lengths[i : i + 10] for i in range(0, 3000, 10)]
    in_order = 1 - lengths.sum() / sum(len(r) * r.max() for r in rows)
    assert sorted_.padding_share < 0.1 < 0.4 < in_order


def test_no_rows_and_wrong_numbers_of_answers(spark, echo):
    df = spark.range(5).select("id", F.lit("a b").alias("prompt"))
    none = batchmap.map_by_length(df.filter("id > 9"), echo, 100, key="id")
    assert none.count() == 0 and tuple(batchmap.padding_share(none).first()) == (0, 0, 0.0)
    with pytest.raises(Exception, match="1 responses"):
        batchmap.map_by_length(df.coalesce(1), lambda: lambda prompts: ["x"], 100, key="id").collect()
