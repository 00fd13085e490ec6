"""Ordering, dedup, curation, metrics and submission on small tables with known answers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from abacist.functions import prompts as P
from abacist.operators import curation, dedup, metrics, ordering, submission
from abacist.operators.batchmap import map_batches
from abacist.plans import jobs


def _key(seed, idx):
    return hashlib.md5(f"{seed}:{idx}".encode()).hexdigest(), idx


@pytest.mark.parametrize("partitions, few", [(1, 0), (4, 10_000), (64, 0), (64, 10_000)])
def test_seeded_operators_ignore_partitioning(spark, monkeypatch, partitions, few):
    monkeypatch.setattr(ordering, "_FEW", few)
    n = 5000
    df = spark.range(n).withColumnRenamed("id", "idx").repartition(partitions)
    order = sorted(range(n), key=lambda i: _key(7, i))
    split = {r.idx: r.split for r in ordering.make_splits(df, 200, 7).collect()}
    assert {i for i, s in split.items() if s == "dev"} == set(order[:200])
    assert len(split) == n
    sample = [r.idx for r in ordering.sample_exact_n(df, 50, 7).collect()]
    assert sample == order[:50]
    placed = {r.idx: r.at for r in ordering.seeded_shuffle(df, 7, position="at").collect()}
    assert [placed[i] for i in order] == list(range(n))
    assert [r.idx for r in ordering.seeded_shuffle(df, 7).collect()] == order


@pytest.mark.parametrize("few", [0, 10_000])
def test_samples_and_splits_of_short_tables(spark, monkeypatch, few):
    monkeypatch.setattr(ordering, "_FEW", few)
    df = spark.range(5).withColumnRenamed("id", "idx")
    assert ordering.sample_exact_n(df, 10).count() == 5
    assert ordering.sample_exact_n(df, 0).count() == 0
    assert ordering.make_splits(df, 10).filter("split = 'dev'").count() == 5
    assert ordering.make_splits(df, 0).filter("split = 'train'").count() == 5
    assert ordering.make_splits(df.filter("idx < 0"), 3).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_sample_size_is_exact_with_repeated_keys(spark, monkeypatch, few):
    monkeypatch.setattr(ordering, "_FEW", few)
    df = spark.range(1000).select((F.col("id") % 3).alias("idx"), "id")
    assert ordering.sample_exact_n(df, 10).count() == 10
    assert ordering.sample_exact_n(df, 700).count() == 700


@pytest.mark.parametrize("partitions", [1, 16])
def test_global_index_with_a_hot_leading_value(spark, partitions):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("k"), "id"
    ).repartition(partitions)
    out = ordering.global_index(df, ["k", "id"], start=10).collect()
    ranked = sorted(out, key=lambda r: (r.k, r.id))
    assert [r.idx for r in ranked] == list(range(10, 3010))


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_dedup_keeps_the_first_of_a_hot_key(spark, partitions):
    df = spark.range(2000).select(
        F.col("id").alias("idx"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(2), F.lit(1)))
        .when(F.col("id") % 3 == 1, F.array(F.lit(1), F.lit(2)))
        .otherwise(F.array(F.col("id"), F.lit(1)))
        .cast("array<bigint>")
        .alias("nums"),
        F.lit(3).cast("bigint").alias("target"),
        F.lit("1 + 2").alias("equation_norm"),
    ).repartition(partitions)
    kept = sorted(r.idx for r in dedup.dedup_keep_first(df, ["idx"]).collect())
    # id 2 has the numbers (2, 1) as well.
    assert kept == [0] + [i for i in range(2000) if i % 3 == 2 and i != 2]
    last = dedup.last_wins(df.withColumn("id", F.col("idx") % 2)).collect()
    assert sorted(r.idx for r in last) == [1998, 1999]


def _scored(spark, n, extracted, correct):
    return spark.range(n).select(
        F.when(F.col("id") < extracted, "1+1").alias("equation"),
        (F.col("id") < correct).alias("correct"),
        F.lit("abcd").alias("response"),
        F.col("id").alias("response_n_tokens"),
        F.col("id").alias("idx"),
        (F.col("id") % 2).alias("chunk"),
    )


@pytest.mark.parametrize(
    "n, extracted, correct, rate, accuracy",
    [(200, 171, 162, 0.855, 0.81), (2000, 1787, 1698, 0.8935, 0.849), (200, 21, 1, 0.105, 0.005)],
)
def test_published_rates(spark, n, extracted, correct, rate, accuracy):
    df = _scored(spark, n, extracted, correct)
    for row in (metrics.eval_summary_chars(df).first(), metrics.eval_summary_tokens(df).first()):
        assert (row.equation_extracted, row.equation_correct) == (extracted, correct)
        assert (row.extracted_rate, row.accuracy) == (rate, accuracy)
    assert metrics.dev_metrics(df, 1.26).first().asDict() == {
        "dev_accuracy": accuracy, "dev_extracted_rate": rate, "n_dev": n, "dev_eval_time_s": 1.3,
    }
    assert metrics.eval_summary_chars(df, 2 * n).first().accuracy == accuracy / 2


def test_empty_tables_give_zero_rates(spark):
    df = _scored(spark, 0, 0, 0)
    for make in (metrics.eval_summary_chars, metrics.eval_summary_tokens, metrics.dev_metrics):
        assert all(v == 0 for v in make(df).first())
    assert curation.curation_funnel(
        df.withColumns({"nums": F.array("idx"), "target": F.col("idx")})
    ).first().correct_share == 0


def test_chunk_rollup_carries_run_columns(spark):
    df = _scored(spark, 10, 6, 4).withColumns(
        {"elapsed_s": F.lit(2.0) + F.col("chunk"), "model_id": F.lit("m")}
    )
    rows = {r.chunk: r for r in metrics.chunk_rollup(df).collect()}
    assert rows[None].n_examples == 10 and rows[None].is_total == 1
    assert rows[None].elapsed_s == 5.0 and rows[0].elapsed_s == 2.0
    assert (rows[1].start_idx, rows[1].end_idx) == (1, 10)


def test_length_stats(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (10,)], "n bigint")
    row = metrics.length_stats(df, ["n"]).first()
    assert (row.min, row.p50, row.p95, row.max) == (1, 2, 8, 10)
    assert row.mean == 3.75 and row.std == pytest.approx(4.193249, abs=1e-6)
    assert metrics.length_stats(df.limit(1), ["n"]).first().std is None
    assert metrics.length_stats(df, ["n"], exact=False).first().max == 10


def test_steps(spark):
    df = spark.range(20).select(
        (F.col("id") % 4 * 5).alias("step"), F.floor(F.col("id") / 4).alias("idx"),
        F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("nums"),
        F.lit(3).cast("bigint").alias("target"), F.lit("<answer>1+2</answer>").alias("response"),
    )
    rows = jobs.evaluate_steps(df, 10, 2).collect()
    assert [(r.step, r.n_dev, r.dev_accuracy) for r in rows] == [(10, 2, 1.0)]


def test_submission(spark):
    template = spark.createDataFrame(
        [(1, "x", "a"), (2, "x", "b"), (2, "x", "c"), (3, "x", "d"), (4, "x", "e"), (5, "x", "f")],
        "id bigint, equation string, note string",
    )
    results = spark.createDataFrame(
        [
            (0, 1, "9+9", [1, 2], 3), (1, 1, " 1+2 ", [1, 2], 3), (2, 2, "1+1", [1, 1], 2),
            (3, 3, "1+1", [1, 1], 2), (4, 3, None, [1, 1], 2), (5, 4, "  ", [0], 0),
        ],
        "idx bigint, id bigint, equation string, nums array<bigint>, target bigint",
    )
    built = submission.build_submission(template, results)
    assert sorted((r.note, r.equation, r.matched, r.valid) for r in built.collect()) == [
        ("a", "1+2", True, True), ("b", "1+1", True, True), ("c", "1+1", True, True),
        ("d", "0", True, False), ("e", "0", True, True), ("f", "0", False, False),
    ]
    assert built.columns[:3] == template.columns
    stats = submission.submission_stats(built).first()
    assert (stats.n_total, stats.n_extracted, stats.n_fallback) == (6, 4, 2)
    assert stats.n_valid_by_local_validator == 4
    assert submission.missing_ids(template, results).count() == 1
    assert submission.matched_ids(template, results).count() == 5
    assert submission.stats_warning(2) and submission.stats_warning(0) is None
    with pytest.raises(ValueError):
        submission.check_inputs(template.drop("equation"), results)
    with pytest.raises(ValueError):
        submission.check_inputs(template, results.withColumn("id", F.lit(None).cast("bigint")))


def test_prompts(spark):
    row = spark.sql("SELECT array(75L, 80L) AS nums, 5L AS target")
    messages = row.select(P.build_prompt(row).alias("m")).first().m
    assert [m.role for m in messages] == ["system", "user"]
    assert "the numbers [75, 80], create an equation that equals 5." in messages[1].content
    own = row.withColumn("prompt", F.array(P.message(F.lit("hi"), "user")))
    assert own.select(P.build_prompt(own).alias("m")).first().m[0].content == "hi"
    chat = own.select(P.render_chat(F.col("prompt"), enable_thinking=False).alias("c")).first().c
    assert chat.startswith("<|im_start|>user\nhi<|im_end|>") and chat.endswith("</think>\n\n")
    done = own.select(P.with_eos(F.lit("a</s>"), "</s>"), P.with_eos(F.lit("a"), "</s>"),
                      P.with_eos(F.lit("a"), "")).first()
    assert list(done) == ["a</s>", "a</s>", "a"]


def test_sft_rows_are_numbered_without_train_idx(spark):
    df = spark.createDataFrame(
        [(i, [1, i], 1 + i, f"1 +  {i} = x", True) for i in range(20)],
        "pos bigint, nums array<bigint>, target bigint, equation string, correct boolean",
    )
    rows = curation.build_sft_rows(curation.curated(df, ["pos"]), ["pos"]).collect()
    assert sorted((r.train_idx, r.pos) for r in rows) == [(i, i) for i in range(20)]
    assert {r.completion for r in rows if r.pos == 3} == {"<answer> 1 + 3 </answer>"}


def test_map_batches_calls_once_per_task_and_checks_sizes(spark):
    def responder():
        calls = []

        def respond(prompts):
            calls.append(len(prompts))
            return [f"{p}/{max(calls)}" for p in prompts]

        return respond

    df = spark.range(50).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("prompt"))
    rows = map_batches(df.repartition(3), responder, batch_size=4).collect()
    assert sorted(r.idx for r in rows) == list(range(50))
    assert all(r.response.split("/")[0] == str(r.idx) for r in rows)
    assert {int(r.response.split("/")[1]) for r in rows} == {4}
    with pytest.raises(Exception, match="responses to"):
        map_batches(df, lambda: lambda prompts: []).collect()
