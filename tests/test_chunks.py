"""Tables by chunk, summaries collected in the pass that writes, streamed counts that are put in place."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from abacist.operators import metrics, scoring, submission
from abacist.plans import jobs
from abacist.sources import puzzles, readers, schemas, sinks
from abacist.streaming import scoring as streaming


def files(path):
    """Data files below ``path`` and when each was written."""
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*")}


def files_opened(df):
    """How many files the scan of ``df`` opened."""
    plan = df._jdf.queryExecution().executedPlan()
    assert plan.executeCollect() is not None
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def counting(df, seen):
    """``df``, adding to ``seen`` each row that is computed."""

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


@pytest.fixture
def inputs(spark, sf):
    return puzzles.problems(spark, sf), puzzles.responses(spark, sf)


def test_scoring_a_chunk_again_replaces_its_folder_only(spark, inputs, tmp_path):
    problems, responses = inputs
    blank = responses.withColumn("response", F.when(F.col("chunk") == 0, F.col("response")))
    rows, summaries = jobs.score_chunks(problems, blank, 0, 2000, f"{tmp_path}")
    assert rows.filter("correct and chunk = 1").count() == 0
    before = files(tmp_path)
    rows, summaries = jobs.score_chunks(problems, responses, 1000, 1000, f"{tmp_path}")
    after = files(tmp_path)
    assert {f for f in before if "chunk=0" in f} == {f for f in after if before.get(f) == after[f]}
    assert not {f for f in before if "chunk=1" in f} & set(after)
    assert [r.chunk for r in summaries.collect()] == [1] and rows.count() == 500
    table = readers.read_results(spark, f"{tmp_path}/rows")
    want = scoring.score_responses(puzzles.answered(spark, "/root/testdata/sf0.001"))
    assert table.count() == 1500 and table.filter("correct").count() == want.filter("correct").count()
    # Once more changes nothing that can be read.
    jobs.score_chunks(problems, responses, 1000, 1000, f"{tmp_path}")
    assert readers.read_results(spark, f"{tmp_path}/rows").exceptAll(want.selectExpr(
        "idx % 1000 idx", "nums", "target", "response", "response_n_tokens", "equation", "correct", "reason",
        "idx train_idx", "floor(idx / 1000) chunk")).count() == 0


def test_a_filter_on_the_chunk_opens_its_files_only(spark, inputs, tmp_path):
    jobs.score_chunks(*inputs, 0, 2000, f"{tmp_path}")
    table = readers.read_results(spark, f"{tmp_path}/rows")
    one = table.filter("chunk = 1")
    assert 0 < files_opened(one) < files_opened(table) == len(files(f"{tmp_path}/rows"))
    plan = one.select("correct")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "response" not in plan


def test_chunks_must_be_whole(inputs, tmp_path):
    with pytest.raises(ValueError, match="whole chunks"):
        jobs.score_chunks(*inputs, 500, 1000, f"{tmp_path}")


def test_a_large_chunk_is_split(spark, tmp_path):
    """One chunk with nearly all rows is not one task's work."""
    df = spark.range(400_000).selectExpr("id", "md5(cast(id as string)) a", "if(id < 100, id, 0) chunk")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        sinks.write_chunks(df, f"{tmp_path}")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "chunk=0").glob("part-*"))) > 2
    assert spark.read.parquet(f"{tmp_path}").count() == 400_000


def test_many_small_chunks_are_the_work_of_many_tasks(spark, tmp_path):
    """Folders are what writing and listing them costs, however few rows they hold."""
    df = spark.range(400).selectExpr("id chunk", "id a")
    sinks.write_chunks(df, f"{tmp_path}")
    assert len({f.name.split("-")[1] for f in tmp_path.rglob("part-*")}) > 1
    spark.sparkContext.setJobGroup("listing", "")
    table = readers.read_results(spark, f"{tmp_path}", "a bigint")
    spark.sparkContext.setJobGroup("", "")
    track = spark.sparkContext.statusTracker()
    stages = [i for job in track.getJobIdsForGroup("listing") for i in track.getJobInfo(job).stageIds]
    limit = readers.LISTING * spark.sparkContext.defaultParallelism
    assert limit < 400 and 0 < sum(track.getStageInfo(i).numTasks for i in stages) <= limit
    assert table.filter("a = chunk").count() == 400


def test_summaries_are_a_folder_per_range(spark, inputs, tmp_path):
    problems, responses = inputs
    blank = responses.withColumn("response", F.lit(""))
    jobs.score_chunks(problems, blank, 0, 2000, f"{tmp_path}")
    jobs.score_chunks(problems, responses, 1000, 1000, f"{tmp_path}")
    _, own = jobs.score_chunks(problems, responses, 1000, 1000, f"{tmp_path}")
    assert len(list((tmp_path / "summary").rglob("part-*"))) == 2
    schema = ", ".join(f"{c} {t}" for c, t in own.dtypes if c != "chunk")
    last = {r.chunk: r for r in readers.read_summaries(spark, f"{tmp_path}/summary", schema).collect()}
    rows = readers.read_results(spark, f"{tmp_path}/rows")
    assert last == {r.chunk: r for r in metrics.chunk_summaries(rows, index="train_idx").select(own.columns).collect()}
    assert last[0].equation_correct == 0 < last[1].equation_correct and [r.chunk for r in own.collect()] == [1]


def test_summaries_come_from_the_pass_that_writes(spark, inputs, tmp_path):
    problems, responses = inputs
    seen = spark.sparkContext.accumulator(0)
    rows, summary = jobs.score_chunk(problems, counting(responses, seen), 0, 2000, f"{tmp_path}")
    assert seen.value == 1500
    assert summary.first() == jobs._with_run(metrics.eval_summary_tokens(rows), start_idx=0, end_idx=2000).first()
    none, summary = jobs.score_chunk(problems, responses, 10**6, 10, f"{tmp_path}/none")
    assert none.count() == 0 and summary.first()[:3] == (0, 0, 0) and summary.first().accuracy == 0


def test_submission_reads_its_responses_once(spark, sf, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    last = puzzles.test_puzzles(spark, sf)
    answers = last.select("id", "idx", "response", "response_n_tokens")
    template = puzzles.template(spark, sf)
    n = answers.count()
    built, stats = jobs.make_submission(last, counting(answers, seen), template, f"{tmp_path}")
    assert seen.value == n
    assert stats.first() == submission.submission_stats(built).first()
    lost = answers.withColumn("id", F.when(F.col("idx") % 2 == 0, F.col("id")))
    for path in (None, f"{tmp_path}/lost"):
        with pytest.raises(Exception, match="some results have no id"):
            jobs.make_submission(last, lost, template, path)
    with pytest.raises(ValueError, match="results lacks"):
        jobs.make_submission(last, answers.drop("response"), template)


def test_curation_counts_in_the_pass_that_writes(spark, sf, tmp_path):
    scored = jobs.teacher_records(scoring.score_responses(puzzles.answered(spark, sf))).drop("reason_code")
    scored.repartition(3).write.parquet(f"{tmp_path}/chunks")
    chunks = readers.read_chunks(spark, f"{tmp_path}/chunks", schemas.TEACHER_CHUNK)
    out = jobs.curate(chunks, f"{tmp_path}/sft")
    row, full = out["funnel"].first(), out["full"]
    assert (row.n_raw, row.n_after_dedup, row.chunks_used) == (1500, full.count(), 3)
    assert row.example_completion == full.orderBy("train_idx", "completion").first().completion
    none = jobs.curate(chunks.filter("false"), f"{tmp_path}/none")
    assert none["funnel"].first()[:3] == (0, 0, 0) and "example_completion" not in none["funnel"].columns


def test_streamed_counts_touch_new_chunks_only(spark, sf, tmp_path):
    answered = puzzles.answered(spark, sf).withColumn("chunk", F.floor(F.col("idx") / 100))
    at = {k: f"{tmp_path}/{k}" for k in ("in", "table", "marks")}

    def run(part):
        answered.filter(part).coalesce(1).write.mode("append").parquet(at["in"])
        streaming.stream_counters(spark, at["in"], at["table"], at["marks"], answered.schema).awaitTermination()
        return files(at["table"])

    first, second = run("idx < 730"), run("idx >= 730")
    assert {f for f in first if second.get(f) == first[f]} == {f for f in first if "chunk=7/" not in f}
    batch = scoring.score_responses(answered).groupBy("chunk").agg(
        F.count(F.lit(1)), F.count("equation"), F.count_if("correct")
    )
    counts = ["chunk", *[c.split()[0] for c in streaming.COUNTERS.split(", ")]]
    table = streaming.read_counters(spark, at["table"])
    assert sorted(table.select(*counts).collect()) == sorted(map(tuple, batch.collect()))
    one = table.filter("chunk = 7")
    repeated = spark.createDataFrame(one.collect(), one.schema)
    streaming.upsert_counters(repeated, at["table"])
    table = streaming.read_counters(spark, at["table"])
    assert sorted(table.select(*counts).collect()) == sorted(map(tuple, batch.collect()))
    third = files(at["table"])
    assert {f for f in second if third.get(f) == second[f]} == {f for f in second if "chunk=7/" not in f}


def test_results_documents(spark, tmp_path):
    for i in range(2):
        rows = [{"idx": 10 * i + k, "equation": None if k else "1+1", "nums": [1, 1], "correct": k == 0} for k in range(3)]
        document = {"summary": {"n_examples": 3, "accuracy": 1 / 3}, "per_example": rows}
        (tmp_path / f"chunk_{i}.json").write_text(json.dumps(document, indent=2))
    schema = "idx bigint, nums array<bigint>, equation string, correct boolean"
    rows, summary = readers.read_results_json(spark, f"{tmp_path}/*.json", schema)
    assert sorted(r.idx for r in rows.collect()) == [0, 1, 2, 10, 11, 12]
    assert rows.dtypes == [("idx", "bigint"), ("nums", "array<bigint>"), ("equation", "string"), ("correct", "boolean")]
    assert [r.n_examples for r in summary.collect()] == [3, 3]
