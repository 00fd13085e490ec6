
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from abacist.functions import arithmetic as A
from abacist.functions import prompts as P
from abacist.functions import text as T
from abacist.functions.sql import register_sql
from abacist.operators import curation, dedup, metrics, ordering, scoring, sketches, submission
from abacist.operators.batchmap import join_responses
from abacist.plans import jobs
from abacist.session import scratch_path
from abacist.sources import puzzles, readers, schemas, sinks
from abacist.streaming import scoring as streaming

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
ALL_ROWS = 10**15


def query(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def _nums_text(df: DataFrame) -> DataFrame:
    return df.withColumn("nums", F.col("nums").cast("string"))


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.score_responses(puzzles.answered(spark, sf_dir))


def _documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _chunk_files(spark, df: DataFrame, name: str) -> str:
    """Write ``df`` as chunk files in index order."""
    path = scratch_path(spark, name)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(files, "idx").sortWithinPartitions("idx").write.parquet(path)
    return path


def _curated_rows(spark, sf_dir) -> DataFrame:
    raw = _scored(spark, sf_dir).withColumn("train_idx", F.col("idx"))
    return curation.build_sft_rows(curation.curated(raw, ["idx"]), ["idx"])


def _curate(spark, sf_dir) -> dict[str, DataFrame]:
    scored = jobs.teacher_records(_scored(spark, sf_dir)).drop("reason_code")
    path = _chunk_files(spark, scored, "teacher")
    chunks = readers.read_chunks(spark, f"{path}/*.parquet", schemas.TEACHER_CHUNK)
    return jobs.curate(chunks, scratch_path(spark, "sft"))


def _flat_sft(df: DataFrame) -> DataFrame:
    return _nums_text(df).select(
        "train_idx",
        F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["content"].alias("user_text"),
        "completion",
        "nums",
        "target",
        "prompt_tokens",
        "completion_tokens",
    )


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


# --- sources and sinks ---


@query
def scan_problems(spark, sf_dir):
    path = scratch_path(spark, "problems")
    puzzles.problems(spark, sf_dir).write.parquet(path)
    return _nums_text(readers.read_problems(spark, path))


@query
def scan_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    jobs.prepare_splits(puzzles.problems(spark, sf_dir), path)
    train, dev = readers.read_splits(spark, path)
    both = train.withColumn("split", F.lit("train")).unionByName(
        dev.withColumn("split", F.lit("dev"))
    )
    return _nums_text(both)


@query
def scan_chunks(spark, sf_dir):
    path = _chunk_files(spark, puzzles.responses(spark, sf_dir), "responses")
    return readers.read_chunks(spark, f"{path}/*.parquet", index="position").select(
        "position", "idx", "response"
    )


@query
def scan_test_csv(spark, sf_dir):
    """Columns in an order of their own, and one more."""
    path = scratch_path(spark, "test-csv")
    test = _nums_text(puzzles.problems(spark, sf_dir))
    note = F.concat(F.lit(' say "'), F.col("idx").cast("string"), F.lit('", then, ')).alias("note")
    key = F.concat(F.lit("test_"), F.col("idx").cast("string")).alias("id")
    sinks.write_csv(test.select("target", note, "nums", key), path)
    return _nums_text(readers.read_test_csv(spark, path)).select("id", "nums", "target", "note")


@query
def scan_template(spark, sf_dir):
    path = scratch_path(spark, "template")
    ordered = puzzles.template(spark, sf_dir).orderBy("pos")
    sinks.write_csv(ordered.select("note", F.concat(F.lit("test_"), "id").alias("id"), "equation"), path)
    return readers.read_template(spark, path).select("id", "equation", "note")


@query
def roundtrip_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    jobs.prepare_splits(puzzles.problems(spark, sf_dir), path)
    return _nums_text(spark.read.schema(schemas.SPLITS).parquet(path))


@query
def roundtrip_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    sinks.write_results(_scored(spark, sf_dir), path)
    return spark.read.parquet(path).select("idx", "equation", "correct", "reason")


@query
def results_json(spark, sf_dir):
    path = scratch_path(spark, "results-json")
    rows, _ = sinks.write_results_json(
        _scored(spark, sf_dir), metrics.tokens_summary(), path
    )
    return rows.select("idx", "equation", "correct", "reason")


@query
def summary_json(spark, sf_dir):
    path = scratch_path(spark, "summary")
    summary = metrics.eval_summary_tokens(_scored(spark, sf_dir))
    sinks.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path).select(*summary.columns)


@query
def roundtrip_submission(spark, sf_dir):
    path = scratch_path(spark, "submission")
    built = submission.build_submission(
        puzzles.template(spark, sf_dir), puzzles.results(spark, sf_dir)
    )
    sinks.write_submission(built, path, ["pos"])
    back = readers.read_template(spark, path, id_type="bigint")
    return ordering.global_index(back, readers.FILE_ORDER, out="position").select(
        "position", "id", "equation", "note"
    )


@query
def sft_full(spark, sf_dir):
    return _flat_sft(_curate(spark, sf_dir)["full"])


@query
def sft_small(spark, sf_dir):
    return _flat_sft(_curate(spark, sf_dir)["small"])


# --- projections and filters ---


@query
def build_prompt(spark, sf_dir):
    df = puzzles.problems(spark, sf_dir)
    return df.withColumn("m", P.build_prompt(df)).select(
        "idx",
        F.col("m")[0]["content"].alias("system_text"),
        F.col("m")[1]["content"].alias("user_text"),
    )


@query
def prompt_passthrough(spark, sf_dir):
    df = puzzles.problems_with_prompt(spark, sf_dir)
    return df.withColumn("m", P.build_prompt(df)).select(
        "idx",
        F.element_at("m", -1)["content"].alias("user_text"),
        F.size("m").alias("n_messages"),
    )


@query
def render_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return P.conversations(turns).select("conv_id", P.render_chat(F.col("messages")).alias("rendered"))


@query
def render_chat_folded(spark, sf_dir):
    """The same by a template without system turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return P.conversations(turns).select(
        "conv_id", P.render_chat(F.col("messages"), P.FOLDED).alias("rendered")
    )


@query
def build_sft_rows(spark, sf_dir):
    return _curated_rows(spark, sf_dir).select(
        "train_idx", "equation_norm", "completion", "prompt_tokens", "completion_tokens"
    )


@query
def render_sft(spark, sf_dir):
    return curation.render_sft(_curated_rows(spark, sf_dir), eos="<eos>")


@query
def score_responses(spark, sf_dir):
    return _nums_text(_scored(spark, sf_dir)).select(
        "idx", "nums", "target", "equation", "correct", "reason_code", "reason", "result"
    )


@query
def filter_correct(spark, sf_dir):
    return curation.filter_correct(_scored(spark, sf_dir)).select("idx", "equation")


@query
def chunk_slice(spark, sf_dir):
    return _nums_text(ordering.chunk_slice(puzzles.problems(spark, sf_dir), 1000, ALL_ROWS))


@query
def global_index(spark, sf_dir):
    return ordering.global_index(
        puzzles.problems(spark, sf_dir), ["target", "idx"], start=1000, out="position"
    ).select("idx", "position")


@query
def dev_samples(spark, sf_dir):
    return _nums_text(jobs.dev_samples(_scored(spark, sf_dir), 10))


@query
def response_preview(spark, sf_dir):
    return puzzles.responses(spark, sf_dir).select(
        "idx", T.response_preview(F.col("response")).alias("preview")
    )


@query
def budget_flags(spark, sf_dir):
    return curation.budget_flags(_curated_rows(spark, sf_dir), 150, 138).select(
        "train_idx", "fits_budget", "was_truncated"
    )


# --- joins ---


@query
def join_responses_query(spark, sf_dir):
    joined = join_responses(puzzles.problems(spark, sf_dir), puzzles.responses(spark, sf_dir))
    return _nums_text(joined).select("idx", "nums", "target", "response")


REGISTERED["join_responses"] = REGISTERED.pop("join_responses_query")


@query
def build_submission(spark, sf_dir):
    return submission.build_submission(
        puzzles.template(spark, sf_dir), puzzles.results(spark, sf_dir)
    )


@query
def matched_ids(spark, sf_dir):
    return submission.matched_ids(
        puzzles.template(spark, sf_dir), puzzles.results(spark, sf_dir)
    ).select("id", "note")


@query
def missing_ids(spark, sf_dir):
    return submission.missing_ids(
        puzzles.template(spark, sf_dir), puzzles.results(spark, sf_dir)
    ).select("id", "note")


@query
def make_splits(spark, sf_dir):
    return ordering.make_splits(puzzles.problems(spark, sf_dir)).select("idx", "split")


# --- summaries ---


@query
def eval_summary_chars(spark, sf_dir):
    return metrics.eval_summary_chars(_scored(spark, sf_dir))


@query
def eval_summary_tokens(spark, sf_dir):
    return metrics.eval_summary_tokens(_scored(spark, sf_dir))


@query
def dev_metrics(spark, sf_dir):
    return metrics.dev_metrics(_scored(spark, sf_dir))


@query
def submission_stats(spark, sf_dir):
    """Extraction, lookup and statistics, from responses keyed by customer."""
    answered = puzzles.answered(spark, sf_dir)
    template = puzzles.template(spark, sf_dir)
    submission.check_inputs(template, answered, {"id", "idx", "response"})
    results = jobs.student_records(answered)
    return submission.submission_stats(submission.build_submission(template, results))


@query
def length_stats(spark, sf_dir):
    lengths = _documents(spark, sf_dir).select(
        T.char_count(F.col("text")).alias("chars"), T.word_count(F.col("text")).alias("words")
    )
    return _rounded(metrics.length_stats(lengths, ["chars", "words"]))


@query
def curation_funnel(spark, sf_dir):
    return curation.curation_funnel(_scored(spark, sf_dir))


@query
def throughput(spark, sf_dir):
    runs = puzzles.responses(spark, sf_dir).withColumns(
        {"run": F.col("chunk"), "elapsed_s": (60 + F.col("chunk") % 7).cast("double")}
    )
    return metrics.throughput(runs)


@query
def chunk_rollup(spark, sf_dir):
    return metrics.chunk_rollup(_scored(spark, sf_dir))


@query
def metrics_by_step(spark, sf_dir):
    """Over the dev part of a split, the first hundred of its rows."""
    split = ordering.make_splits(puzzles.predictions(spark, sf_dir))
    dev = split.filter("split = 'dev'").drop("split")
    return jobs.evaluate_steps(dev, eval_steps=50, eval_n_quick=100)


@query
def metrics_history(spark, sf_dir):
    """Two runs over the stored predictions of a training run: the second adds the steps that came since."""
    split = ordering.make_splits(puzzles.predictions(spark, sf_dir))
    dev = split.filter("split = 'dev'").drop("split")
    path = scratch_path(spark, "history")
    jobs.evaluate_history(dev.filter("step <= 50"), path, eval_steps=25)
    return jobs.evaluate_history(dev, path, eval_steps=25)


@query
def samples_by_step(spark, sf_dir):
    return _nums_text(jobs.samples_by_step(scoring.score_responses(puzzles.predictions(spark, sf_dir)), 5))


@query
def lengths_by_chunk(spark, sf_dir):
    """Lengths from merged sketches of chunks, and whether the percentiles are within the stated error."""
    answered = puzzles.responses(spark, sf_dir)
    merged = sketches.merged_lengths(sketches.length_sketches(answered, ["response_n_tokens"]))
    tokens = answered.select(F.col("response_n_tokens").alias("v"))
    ranked = tokens.join(merged).groupBy("metric", "n", "mean", "std", "min", "max", "p50", "p95").agg(
        *[F.count_if(F.col("v") < F.col(p)).alias(f"below_{p}") for p in ("p50", "p95")],
        *[F.count_if(F.col("v") <= F.col(p)).alias(f"upto_{p}") for p in ("p50", "p95")],
    )
    slack = sketches.RANK_ERROR * F.col("n")
    near = [
        ((F.col(f"below_{p}") - slack <= q * F.col("n")) & (q * F.col("n") <= F.col(f"upto_{p}") + slack)).alias(f"{p}_near")
        for p, q in (("p50", 0.5), ("p95", 0.95))
    ]
    return _rounded(ranked.select("metric", "n", "mean", "std", "min", "max", *near))


@query
def funnel_by_chunk(spark, sf_dir):
    """The funnel from merged sketches of chunks, and whether the number of examples is within the stated error."""
    scored = _scored(spark, sf_dir)
    merged = sketches.merged_funnel(sketches.key_sketches(scored))
    exact = curation.curation_funnel(scored).select(F.col("n_after_dedup").alias("exact"))
    near = F.abs(F.col("n_after_dedup") - F.col("exact")) <= 4 * sketches.DISTINCT_ERROR * F.col("exact")
    return merged.join(exact).select("n_raw", "n_correct", "correct_share", near.alias("kept_near"))


@query
def reason_histogram(spark, sf_dir):
    return metrics.reason_histogram(_scored(spark, sf_dir))


@query
def token_histogram(spark, sf_dir):
    return metrics.token_histogram(_scored(spark, sf_dir), width=100)


@query
def cap_share(spark, sf_dir):
    return metrics.cap_share(_scored(spark, sf_dir), cap=puzzles.TOKEN_CAP, short=300)


@query
def contract_checks(spark, sf_dir):
    return submission.check_inputs(
        puzzles.template(spark, sf_dir), puzzles.results(spark, sf_dir)
    )


# --- dedup, order, sampling, union ---


@query
def dedup_keep_first(spark, sf_dir):
    return _nums_text(curation.curated(_scored(spark, sf_dir), ["idx"])).select(
        "idx", "nums", "target", "equation_norm"
    )


@query
def last_wins(spark, sf_dir):
    return dedup.last_wins(puzzles.results(spark, sf_dir)).select("id", "idx", "equation")


@query
def seeded_shuffle(spark, sf_dir):
    return ordering.seeded_shuffle(
        puzzles.problems(spark, sf_dir), position="position"
    ).select("idx", "position")


@query
def sample_exact_n(spark, sf_dir):
    return _nums_text(ordering.sample_exact_n(puzzles.problems(spark, sf_dir), 2000))


@query
def union_chunks(spark, sf_dir):
    teacher = _scored(spark, sf_dir).select("idx", "equation", "correct")
    student = scoring.extract_equation(puzzles.responses(spark, sf_dir)).select("equation", "idx")
    return readers.union_chunks(teacher, student)


# --- text ---


def _on_responses(column) -> Query:
    return lambda spark, sf_dir: puzzles.responses(spark, sf_dir).select(
        "idx", column(F.col("response"))
    )


def _on_documents(column) -> Query:
    return lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", column(F.col("text")))


def _joined(column):
    return lambda c: F.array_join(column(c), "|").alias("found")


@query
def extract_equation(spark, sf_dir):
    return scoring.extract_equation(puzzles.responses(spark, sf_dir)).select("idx", "equation")


@query
def strip_think(spark, sf_dir):
    return puzzles.responses(spark, sf_dir).select(
        "idx",
        T.strip_think(F.col("response")).alias("stripped"),
        T.search_space(F.col("response")).alias("space"),
    )


@query
def token_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id",
        T.char_count(F.col("text")).alias("chars"),
        T.word_count(F.col("text")).alias("words"),
    )


@query
def fallback_equation(spark, sf_dir):
    return puzzles.proposed(spark, sf_dir).select(
        "idx", T.equation_or_fallback(F.col("equation")).alias("emitted")
    )


REGISTERED |= {
    "tag_candidates": _on_responses(_joined(T.tag_candidates)),
    "label_candidates": _on_responses(_joined(T.label_candidates)),
    "last_line": _on_documents(lambda c: T.last_line(c).alias("line")),
    "lhs_of_equals": _on_documents(lambda c: T.lhs_of_equals(c).alias("lhs")),
    "candidate_filter": _on_documents(lambda c: T.is_candidate(c).alias("is_candidate")),
    "normalize_equation": _on_documents(lambda c: T.normalize_equation(c).alias("norm")),
}


# --- verification ---


@query
def verify_equations(spark, sf_dir):
    return scoring.verify_equations(puzzles.proposed(spark, sf_dir)).select(
        "idx", "reason_code", "ok", "reason", "result"
    )


@query
def verify_residual(spark, sf_dir):
    """What the native path leaves to the host grammar."""
    residual = puzzles.proposed(spark, sf_dir).filter(A.grammar_status(F.col("equation")) == A.OTHER)
    return scoring.verify_equations(residual, native=False).select(
        "idx", "reason_code", "ok", "reason", "result"
    )


@query
def verify_hard(spark, sf_dir):
    return scoring.verify_equations(puzzles.hard(spark, sf_dir)).select(
        "idx", "reason_code", "ok", "reason", F.round("result", 9).alias("result")
    )


@query
def extract_documents(spark, sf_dir):
    """Whole documents, each with an answer at its end."""
    key = F.col("doc_id").cast("string")
    tail = F.concat(F.lit("\n<answer>"), key, F.lit(" + 7 = "), (F.col("doc_id") + 7).cast("string"), F.lit("</answer>"))
    asked = _documents(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), tail))
    return scoring.extract_equation(asked, "text").select("doc_id", "equation")


@query
def sql_verify(spark, sf_dir):
    """Through the function with an inlined body; undecided texts alone leave the JVM."""
    register_sql(spark)
    return spark.sql(
        "SELECT idx, v.code, v.ok, v.result FROM "
        "(SELECT idx, verify_equation(equation, nums, target) AS v FROM {proposed})",
        proposed=puzzles.proposed(spark, sf_dir),
    )


@query
def sql_view(spark, sf_dir):
    """The same as a view with the verdicts of a table."""
    puzzles.proposed(spark, sf_dir).createOrReplaceTempView("proposed_equations")
    scoring.register_view(spark, "proposed_equations", "verified_equations")
    return spark.sql("SELECT idx, reason_code AS code, ok, result FROM verified_equations")


@query
def sql_verify_plain(spark, sf_dir):
    """The function that never leaves the JVM, over equations of harder kinds; undecided ones say so."""
    register_sql(spark)
    return spark.sql(
        "SELECT idx, v.code, v.ok, round(v.result, 9) AS result FROM "
        "(SELECT idx, verify_plain_equation(equation, nums, target) AS v FROM {hard})",
        hard=puzzles.hard(spark, sf_dir),
    )


@query
def sql_function(spark, sf_dir):
    """The function itself, for what the native path leaves undecided."""
    register_sql(spark)
    return spark.sql(
        "SELECT idx, v.code, v.ok, v.result FROM "
        "(SELECT idx, verify_equation(equation, nums, target) AS v FROM {residual})",
        residual=puzzles.proposed(spark, sf_dir).filter(A.grammar_status(F.col("equation")) == A.OTHER),
    )


@query
def parse_status(spark, sf_dir):
    e, kind = F.col("equation"), F.col("kind")
    damaged = (
        F.when(kind == 1, F.concat(e, F.lit(" )")))
        .when(kind == 4, F.concat(F.lit("0"), e))
        .when(kind == 12, F.concat(e, F.lit(" +")))
        .otherwise(e)
    )
    df = puzzles.proposed(spark, sf_dir).withColumn("equation", damaged)
    return scoring.parse_status(df).select("idx", "parses")


@query
def equation_numbers(spark, sf_dir):
    return (
        puzzles.proposed(spark, sf_dir)
        .filter("equation is not null")
        .select("idx", A.equation_numbers(F.col("equation")).cast("string").alias("numbers"))
    )


def _plain(spark, sf_dir) -> DataFrame:
    """Equations the native path settles, with their value."""
    plain = puzzles.proposed(spark, sf_dir).filter(
        A.grammar_status(F.col("equation")) == A.OK
    )
    return plain.withColumn("v", A.evaluate_native(F.col("equation")))


@query
def evaluate_native(spark, sf_dir):
    return _plain(spark, sf_dir).select("idx", "v.value", "v.zero_division")


@query
def number_match(spark, sf_dir):
    return (
        puzzles.proposed(spark, sf_dir)
        .filter("equation is not null")
        .select(
            "idx", A.number_match(A.equation_numbers(F.col("equation")), F.col("nums")).alias("same")
        )
    )


@query
def tolerance_check(spark, sf_dir):
    return (
        _plain(spark, sf_dir)
        .filter("v.value is not null")
        .select("idx", A.within_tolerance(F.col("v.value"), F.col("target")).alias("within"))
    )


# --- jobs ---


@query
def score_chunk(spark, sf_dir):
    rows, _ = jobs.score_chunk(
        puzzles.problems(spark, sf_dir), puzzles.responses(spark, sf_dir), 1000, ALL_ROWS
    )
    return rows.select("idx", "train_idx", "equation", "correct", "reason")


@query
def score_chunk_summary(spark, sf_dir):
    """The summary a chunk's job writes, as read back."""
    path = scratch_path(spark, "chunk")
    inputs = puzzles.problems(spark, sf_dir), puzzles.responses(spark, sf_dir)
    _, summary = jobs.score_chunk(*inputs, 1000, ALL_ROWS, path, elapsed_s=12.5, model_id="teacher")
    stored = spark.read.schema(summary.schema).json(f"{path}/summary")
    return stored.select(*summary.columns)


def _stored_chunks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All chunks, the second at first with blank responses, which its second run mends."""
    path = scratch_path(spark, "chunks")
    problems, responses = puzzles.problems(spark, sf_dir), puzzles.responses(spark, sf_dir)
    blank = F.when(F.col("chunk") == 1, F.lit("")).otherwise(F.col("response"))
    jobs.score_chunks(problems, responses.withColumn("response", blank), 0, ALL_ROWS, path)
    _, again = jobs.score_chunks(problems, responses, 1000, 1000, path)
    summaries = ", ".join(f"{c} {t}" for c, t in again.dtypes if c != "chunk")
    return readers.read_results(spark, f"{path}/rows"), readers.read_summaries(spark, f"{path}/summary", summaries)


@query
def results_by_chunk(spark, sf_dir):
    rows, _ = _stored_chunks(spark, sf_dir)
    return rows.select("chunk", "idx", "train_idx", "response", "equation", "correct", "reason")


@query
def summaries_by_chunk(spark, sf_dir):
    _, summaries = _stored_chunks(spark, sf_dir)
    return summaries


@query
def results_document(spark, sf_dir):
    """Results files of one JSON document each, as other tools write them: one per chunk, read as rows."""
    path = scratch_path(spark, "documents")
    row = F.struct("idx", "equation", "correct", "reason")
    counted = F.struct(F.count(F.lit(1)).alias("n_examples")).alias("summary")
    files = _scored(spark, sf_dir).groupBy("chunk").agg(counted, F.collect_list(row).alias("per_example"))
    files.repartition("chunk").write.partitionBy("chunk").option("maxRecordsPerFile", 1).json(path)
    rows, _ = readers.read_results_json(spark, path, "idx bigint, equation string, correct boolean, reason string")
    return rows


@query
def generate_chunk(spark, sf_dir):
    """A stand-in model answers, its responses are stored and scored."""
    rows, _ = jobs.generate_chunk(
        puzzles.problems(spark, sf_dir), _first_number_responder, 1000, ALL_ROWS, scratch_path(spark, "run")
    )
    return rows.select("idx", "train_idx", "response", "equation", "correct", "reason")


@query
def curate_sft(spark, sf_dir):
    return _rounded(_curate(spark, sf_dir)["length_stats"])


@query
def curate_summary(spark, sf_dir):
    return _curate(spark, sf_dir)["funnel"].drop("chunks_used")


@query
def render_training_set(spark, sf_dir):
    """A training set is written, and read with the columns a trainer needs."""
    path = scratch_path(spark, "sft")
    sinks.write_sft(_curated_rows(spark, sf_dir), path)
    return jobs.render_training_set(spark, f"{path}/full", P.FOLDED, eos="<eos>")


def _submission(spark, sf_dir) -> tuple[str, DataFrame]:
    """The whole job, from a test table and a template in CSV; ids are text, one in 17 has no response."""
    path = scratch_path(spark, "submission-job")
    last = puzzles.test_puzzles(spark, sf_dir).withColumn("id", F.concat(F.lit("c"), "id"))
    note = F.lit('a prompt, "quoted"').alias("prompt")
    sinks.write_csv(last.select(note, "target", "id", F.col("nums").cast("string")), f"{path}/test")
    ordered = puzzles.template(spark, sf_dir).orderBy("pos")
    sinks.write_csv(ordered.select(F.concat(F.lit("c"), "id").alias("id"), "note", "equation"), f"{path}/template")
    answers = last.filter("idx % 17 <> 0").select("id", "idx", "response", "response_n_tokens")
    _, stats = jobs.make_submission(
        readers.read_test_csv(spark, f"{path}/test"),
        answers,
        readers.read_template(spark, f"{path}/template"),
        f"{path}/out",
        model_path="student",
    )
    return f"{path}/out", stats


@query
def make_submission(spark, sf_dir):
    path, _ = _submission(spark, sf_dir)
    return readers.read_template(spark, f"{path}/submission").select("id", "equation", "note")


@query
def make_submission_stats(spark, sf_dir):
    path, stats = _submission(spark, sf_dir)
    return spark.read.schema(stats.schema).json(f"{path}/stats").select(*stats.columns)


@query
def evaluate_responses(spark, sf_dir):
    rows, _ = jobs.evaluate(puzzles.problems(spark, sf_dir), puzzles.responses(spark, sf_dir))
    return _nums_text(rows)


@query
def stream_score(spark, sf_dir):
    answered = puzzles.answered(spark, sf_dir)
    arriving = _chunk_files(spark, answered, "arriving")
    out, marks = scratch_path(spark, "verdicts"), scratch_path(spark, "marks")
    streaming.stream_score(spark, arriving, out, marks, answered.schema).awaitTermination()
    return spark.read.parquet(out).select("idx", "equation", "correct", "reason")


@query
def stream_counters(spark, sf_dir):
    answered = puzzles.answered(spark, sf_dir)
    arriving = _chunk_files(spark, answered, "arriving")
    table, marks = scratch_path(spark, "counters"), scratch_path(spark, "marks")
    streaming.stream_counters(spark, arriving, table, marks, answered.schema).awaitTermination()
    return streaming.read_counters(spark, table)


def _first_number_responder():
    """A stand-in for a model: answers with the first number of the prompt's list, twice."""

    def respond(prompts):
        firsts = [p.split("numbers [")[1].split(",")[0] for p in prompts]
        return [f"<answer>{n} + {n}</answer>" for n in firsts]

    return respond


def _length_responder():
    """A stand-in for a model: answers every prompt with its length."""
    return lambda prompts: [str(len(p)) for p in prompts]


@query
def map_batches(spark, sf_dir):
    return jobs.generate(puzzles.problems(spark, sf_dir), _length_responder)


@query
def map_by_length(spark, sf_dir):
    """Prompts in batches of like length under a budget of tokens."""
    return jobs.generate(puzzles.problems(spark, sf_dir), _length_responder, token_budget=4096)


# Operators for training corpora; the rest works without them.
try:
    import corpus_pipeline
    from abacist.llm import oracle as llm_oracle
    from abacist.llm import queries as llm_queries
except ImportError:
    LLM_QUERIES, LLM_STATEMENTS = {}, {}
else:
    LLM_QUERIES = llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    LLM_STATEMENTS = dict(llm_oracle.STATEMENTS)
    if corpus_pipeline.ORACLE_SQL:
        LLM_STATEMENTS["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Extraction, verification and accuracy over all responses."""
    return eval_summary_tokens(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return REGISTERED | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle_queries.statements() | LLM_STATEMENTS
