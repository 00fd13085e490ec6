"""Sources, sinks, whole jobs and streams on real files."""

import pytest
from pyspark.sql import functions as F

from abacist.operators import metrics, scoring
from abacist.operators.curation import filter_correct
from abacist.plans import jobs
from abacist.sources import puzzles, readers, schemas, sinks
from abacist.streaming import scoring as streaming


def test_chunks_are_read_in_path_order(spark, tmp_path):
    for name, start in (("c_1", 0), ("c_10", 100), ("c_2", 200)):
        spark.range(start, start + 10).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    df = readers.read_chunks(spark, f"{tmp_path}/c_*", index="at")
    assert [r.id for r in df.orderBy("at").collect()] == [
        *range(0, 10), *range(100, 110), *range(200, 210)
    ]
    assert sorted(r["at"] for r in df.collect()) == list(range(30))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_chunks(spark, f"{tmp_path}/none_*")


def test_union_fills_missing_columns(spark):
    out = readers.union_chunks(spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 3 AS b"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2), (None, 3)]


def test_template_needs_its_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,other\n1,x\n")
    with pytest.raises(ValueError, match="equation"):
        readers.read_template(spark, f"{tmp_path}/t.csv")


def test_json_problems(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"idx": 1, "nums": [7, 5], "target": 12}\n')
    assert readers.read_problems(spark, f"{tmp_path}/p.json", "json").first().nums == [7, 5]


def test_submission_job_keeps_template_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,equation,note\n5,x,a\n1,x,b\n5,x,c\n9,x,d\n")
    (tmp_path / "test.csv").write_text('id,nums,target\n1,"[1, 2]",3\n5,"[4, 5]",20\n')
    responses = spark.createDataFrame(
        [(0, 5, "<answer>4*5</answer>", 3), (1, 1, "nothing", 2)],
        "idx bigint, id bigint, response string, response_n_tokens bigint",
    )
    _, stats = jobs.make_submission(
        readers.read_test_csv(spark, f"{tmp_path}/test.csv"),
        responses,
        readers.read_template(spark, f"{tmp_path}/t.csv"),
        f"{tmp_path}/out",
    )
    lines = []
    for part in sorted((tmp_path / "out" / "submission").glob("part-*.csv")):
        lines += part.read_text().splitlines()[1:]
    assert lines == ["5,4*5,a", "1,0,b", "5,4*5,c", "9,0,d"]
    row = stats.first()
    assert (row.n_total, row.n_extracted, row.n_valid_by_local_validator) == (4, 2, 2)
    assert spark.read.parquet(f"{tmp_path}/out/raw").count() == 2


def test_curation_job(spark, sf, tmp_path):
    scored = jobs.teacher_records(scoring.score_responses(puzzles.answered(spark, sf)))
    scored.drop("reason_code").repartition(5).write.parquet(f"{tmp_path}/chunks")
    chunks = readers.read_chunks(spark, f"{tmp_path}/chunks", schemas.TEACHER_CHUNK)
    out = jobs.curate(chunks, f"{tmp_path}/sft", small_n=100)
    funnel = out["funnel"].first()
    assert out["full"].count() == funnel.n_after_dedup
    assert out["small"].count() == 100
    assert out["small"].join(out["full"], "train_idx", "left_anti").count() == 0
    rendered = jobs.render_training_set(spark, f"{tmp_path}/sft/full", eos="</s>")
    assert rendered.filter(~F.col("completion").endswith("</s>")).count() == 0


def test_score_chunk_and_evaluate_write_what_they_return(spark, sf, tmp_path):
    p, r = puzzles.problems(spark, sf), puzzles.responses(spark, sf)
    rows, summary = jobs.score_chunk(p, r, 100, 200, f"{tmp_path}/chunk")
    assert rows.agg(F.min("train_idx"), F.max("train_idx"), F.max("idx")).first() == (100, 299, 199)
    assert summary.first().n_examples == 200
    rows, summary = jobs.evaluate(p, r, f"{tmp_path}/eval")
    stored = spark.read.json(f"{tmp_path}/eval/per_example")
    assert stored.count() == rows.count() == summary.first().dataset_len


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_scores_ignore_partitioning(spark, sf, partitions):
    df = puzzles.answered(spark, sf).repartition(partitions)
    got = metrics.reason_histogram(scoring.score_responses(df)).collect()
    of_kind = [len(range(kind, 1500, puzzles.KINDS)) for kind in range(puzzles.KINDS)]
    assert {r.reason_code: r.n for r in got} == {
        "ok": sum(of_kind[k] for k in (0, 1, 3, 4, 12)),
        "value": of_kind[2] + of_kind[8],
        "numbers": of_kind[6] + of_kind[7],
        "processing": of_kind[9] + of_kind[11],
        "not_extracted": of_kind[5] + of_kind[10],
    }
    assert sum(r.share for r in got) == pytest.approx(1)


def test_stream_resumes_where_it_stopped(spark, sf, tmp_path):
    answered = puzzles.answered(spark, sf)
    at = {k: f"{tmp_path}/{k}" for k in ("in", "out", "m1", "table", "m2")}

    def run():
        streaming.stream_score(spark, at["in"], at["out"], at["m1"], answered.schema).awaitTermination()
        streaming.stream_counters(
            spark, at["in"], at["table"], at["m2"], answered.schema
        ).awaitTermination()

    for half in ("idx < 700", "idx >= 700"):
        answered.filter(half).write.mode("append").parquet(at["in"])
        run()
    batch = scoring.score_responses(answered)
    shown = ["idx", "equation", "correct", "reason"]
    streamed = spark.read.parquet(at["out"]).select(*shown)
    assert streamed.exceptAll(batch.select(*shown)).count() == 0
    assert streamed.count() == batch.count()
    counts = {r.chunk: r.n_examples for r in streaming.read_counters(spark, at["table"]).collect()}
    assert counts == {0: 1000, 1: 500}


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path):
    jobs.teacher_records(scoring.score_responses(puzzles.answered(spark, sf))).write.parquet(
        f"{tmp_path}/c"
    )
    kept = filter_correct(spark.read.parquet(f"{tmp_path}/c")).select("equation")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(equation)" in plan and "IsNotNull(correct)" in plan
    assert "response" not in plan
