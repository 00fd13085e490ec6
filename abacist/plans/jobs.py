"""The jobs a user runs, composed from the operators."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.functions import prompts as P
from abacist.functions import text as T
from abacist.operators import curation, metrics, ordering, submission
from abacist.operators.batchmap import join_responses, map_batches, map_by_length
from abacist.operators.scoring import extract_equation, score_responses
from abacist.sources import readers, sinks
from abacist.sources.schemas import SFT_TRAIN, TEACHER_CHUNK, require_columns

RESULT = ["idx", "nums", "target", "response", "response_n_tokens", "equation"]
TEACHER = [*RESULT, "correct", "reason"]
HISTORY = (
    "run bigint, step bigint, dev_accuracy double, dev_extracted_rate double, n_dev bigint, "
    "n_quick bigint, last_idx bigint"
)


def prepare_splits(
    problems: DataFrame, path: str, dev_size: int = 200, seed: int = 42
) -> DataFrame:
    """Split a puzzle table and write it; returns the split table."""
    out = ordering.make_splits(problems, dev_size, seed)
    sinks.write_splits(out.select("idx", "nums", "target", "split"), path)
    return out


def with_prompts(
    problems: DataFrame,
    prompt_builder: Callable[[DataFrame], Column] = P.build_prompt,
    template: P.ChatTemplate = P.ChatTemplate(),
    enable_thinking: bool = True,
) -> DataFrame:
    """Add ``prompt_text``. The builder returns a column, so it stays in the plan."""
    return problems.withColumn(
        "prompt_text",
        P.render_chat(prompt_builder(problems), template, enable_thinking=enable_thinking),
    )


def generate(
    problems: DataFrame,
    make_responder,
    prompt_builder: Callable[[DataFrame], Column] = P.build_prompt,
    template: P.ChatTemplate = P.ChatTemplate(),
    batch_size: int = 8,
    enable_thinking: bool = True,
    token_budget: int | None = None,
) -> DataFrame:
    """Responses of a model to every puzzle, by index; with ``token_budget`` in batches of prompts of like length."""
    ready = with_prompts(problems, prompt_builder, template, enable_thinking)
    if token_budget:
        return map_by_length(ready, make_responder, token_budget, prompt="prompt_text").select("idx", "response")
    return map_batches(ready, make_responder, batch_size, prompt="prompt_text")


def teacher_records(scored: DataFrame, start: int = 0) -> DataFrame:
    """Result rows of a chunk that began at ``start`` of the stored index."""
    return scored.select(
        (F.col("idx") - start).alias("idx"),
        *TEACHER[1:],
        F.col("idx").alias("train_idx"),
        "reason_code",
    )


def student_records(responses: DataFrame) -> DataFrame:
    """Result rows without a verdict; ``id`` is kept where the table has one."""
    out = extract_equation(responses)
    return out.select(*RESULT, *(["id"] if "id" in responses.columns else []))


def eval_records(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("idx").alias("iteration"),
        "nums",
        "target",
        F.col("response").alias("model_output"),
        "equation",
        "correct",
        "reason",
    )


def _with_run(summary: DataFrame, **fields) -> DataFrame:
    """What is known of a run beside its rows; fields that are None are left out."""
    return summary.withColumns({k: F.lit(v) for k, v in fields.items() if v is not None})


def score_chunk(
    problems: DataFrame,
    responses: DataFrame,
    start: int,
    n: int,
    path: str | None = None,
    elapsed_s: float | None = None,
    model_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score responses to puzzles ``[start, start + n)``; returns (rows, summary).

    Both inputs are cut by index before they meet. With ``path`` the rows are
    written once and the summary is collected by the tasks that write them. The summary
    names the range, and the run's time and model where they are given.
    """
    run = {"start_idx": start, "end_idx": start + n, "elapsed_s": elapsed_s, "model_id": model_id}
    rows = teacher_records(_scored_range(problems, responses, start, n), start)
    if path is None:
        return rows, _with_run(metrics.eval_summary_tokens(rows), **run)
    write = partial(sinks.write_results, path=f"{path}/rows")
    seen = sinks.write_observed(rows.drop("reason_code"), write, metrics.tokens_summary())
    summary = _with_run(seen, **run)
    sinks.write_summary(summary, f"{path}/summary")
    return problems.sparkSession.read.schema(TEACHER_CHUNK).parquet(f"{path}/rows"), summary


def _scored_range(problems: DataFrame, responses: DataFrame, start: int, n: int) -> DataFrame:
    cut = ordering.chunk_slice(problems, start, n)
    return score_responses(join_responses(cut, ordering.chunk_slice(responses, start, n)))


def score_chunks(
    problems: DataFrame, responses: DataFrame, start: int, n: int, path: str, chunk_rows: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Score all chunks of ``[start, start + n)`` into one table; returns (rows, summaries) of these chunks, as stored.

    ``path/rows`` has a folder per chunk of ``chunk_rows`` stored indices. Scoring a chunk
    again replaces its folder and touches no other; a chunk that has no response any
    more keeps what it had. The summaries are read from the rows written, of whose columns
    they need three. They are a row each, so ``path/summary`` has a folder per range that
    was asked for, and of each chunk the row written last counts.
    """
    if start % chunk_rows or n % chunk_rows:
        raise ValueError(f"[{start}, {start + n}) is not made of whole chunks of {chunk_rows}")
    chunk = F.floor(F.col("train_idx") / chunk_rows)
    rows = teacher_records(_scored_range(problems, responses, start, n)).drop("reason_code")
    rows = rows.withColumn("idx", F.col("train_idx") % chunk_rows).withColumn("chunk", chunk)
    sinks.write_chunks(rows, f"{path}/rows")
    session, first, end = problems.sparkSession, start // chunk_rows, (start + n) // chunk_rows
    here = (F.col("chunk") >= first) & (F.col("chunk") < end)
    stored = readers.read_results(session, f"{path}/rows").filter(here)
    summaries = metrics.chunk_summaries(stored, index="train_idx")
    sinks.write_summaries(summaries, f"{path}/summary", first, end - first)
    schema = ", ".join(f"{c} {t}" for c, t in summaries.dtypes if c != "chunk")
    return stored, readers.read_summaries(session, f"{path}/summary", schema).filter(here)


def generate_chunk(
    problems: DataFrame,
    make_responder,
    start: int,
    n: int,
    path: str,
    count_tokens: Callable[[Column], Column] = T.word_count,
    model_id: str | None = None,
    **how,
) -> tuple[DataFrame, DataFrame]:
    """Responses of a model to puzzles ``[start, start + n)``, stored, then scored; returns (rows, summary).

    Responses are stored before anything reads them, so a model that samples
    runs once and rows and summary agree. ``how`` is passed to :func:`generate`.
    """
    began = time.time()
    cut = ordering.chunk_slice(problems, start, n)
    answers = generate(cut, make_responder, **how)
    answers = answers.withColumn("response_n_tokens", count_tokens(F.col("response")))
    sinks.write_results(answers, f"{path}/responses")
    elapsed = time.time() - began
    stored = problems.sparkSession.read.schema(answers.schema).parquet(f"{path}/responses")
    return score_chunk(problems, stored, start, n, path, elapsed, model_id)


def evaluate(
    problems: DataFrame, responses: DataFrame, path: str | None = None, dataset_len: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Score a model's responses; returns (rows, summary in characters)."""
    rows = eval_records(score_responses(join_responses(problems, responses)))
    summary = metrics.chars_summary(dataset_len, "model_output")
    if path is None:
        return rows, rows.agg(*summary)
    return sinks.write_results_json(rows, summary, path)


def evaluate_steps(
    predictions: DataFrame, eval_steps: int, eval_n_quick: int | None = None
) -> DataFrame:
    """Dev metrics over the course of a training run, from its stored predictions."""
    due = metrics.due_steps(predictions, eval_steps, eval_n_quick)
    return metrics.metrics_by_step(score_responses(due))


def evaluate_history(
    predictions: DataFrame, path: str, eval_steps: int, eval_n_quick: int | None = None, again: tuple[int, ...] = ()
) -> DataFrame:
    """Dev metrics of the steps that the table ``path`` lacks, added to it; returns the history (:func:`read_history`).

    Later runs read and score only predictions of steps not yet in the table, or
    named in ``again``: the steps known become a filter that reaches the scan. Which dev
    rows are the first ``eval_n_quick`` is found by the first run and kept in the table,
    so all steps are measured on the same rows. The table is only ever
    appended to; a run that failed has added nothing, or all its steps.
    """
    spark = predictions.sparkSession
    # One row per step and run.
    known = spark.read.schema(HISTORY).parquet(path).collect() if _exists(spark, path) else []
    done = sorted({r["step"] for r in known} - set(again))
    last = next((r["last_idx"] for r in known if r["n_quick"] == eval_n_quick), None)
    if eval_n_quick and last is None:
        last = ordering.last_of_first(predictions, eval_n_quick)
    new = metrics.due_steps(predictions, eval_steps)
    if done:
        new = new.filter(~F.col("step").isin(done))
    if eval_n_quick:
        new = new.filter(F.col("idx") <= F.lit(last))
    rows = metrics.metrics_by_step(score_responses(new))
    run = max((r["run"] for r in known), default=0) + 1
    tags = {"run": F.lit(run), "n_quick": F.lit(eval_n_quick), "last_idx": F.lit(last)}
    kept = [F.col(c).cast(t) for c, t in (x.split() for x in HISTORY.split(", "))]
    rows.withColumns(tags).select(*kept).coalesce(1).write.mode("append").parquet(path)
    return read_history(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(HISTORY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Dev metrics by step of all runs; of a step measured more than once, those of the latest run."""
    found = ["run", "dev_accuracy", "dev_extracted_rate", "n_dev"]
    latest = F.max_by(F.struct(*found), "run").alias("latest")
    table = spark.read.schema(HISTORY).parquet(path)
    return table.groupBy("step").agg(latest).select("step", *[f"latest.{c}" for c in found])


def samples_by_step(scored: DataFrame, n: int = 3) -> DataFrame:
    """The first responses of every step, cut for reading."""
    shown = scored.select("step", "idx", "nums", "target", T.sample_text(F.col("response")).alias("response"), "equation")
    return ordering.first_k_of_each(shown, n, "step")


def dev_samples(scored: DataFrame, n: int = 3) -> DataFrame:
    """The first responses, cut for reading."""
    return ordering.first_k(
        scored.select(
            "idx", "nums", "target", T.sample_text(F.col("response")).alias("response"), "equation"
        ),
        n,
    )


def curate(
    chunks: DataFrame,
    path: str,
    small_n: int = 2000,
    seed: int = 42,
    template: P.ChatTemplate = P.ChatTemplate(),
    order_cols: list[str] = readers.CHUNK_ORDER,
    tokenizer: str = "words",
    counter: Callable[[Column], Column] = T.word_count,
) -> dict[str, DataFrame]:
    """Build the training set from scored chunks and write it, sample and summaries.

    The response text is never read. The number of rows and the example are collected
    by the tasks that write the set, length statistics come from the written set.
    ``tokenizer`` names ``counter`` in the summary.
    """
    require_columns(chunks, {"nums", "target", "equation", "correct", *order_cols}, "the chunks")
    rows = curation.build_sft_rows(curation.curated(chunks, order_cols), order_cols, template, counter)
    first = F.min(F.struct("train_idx", "completion"))["completion"].alias("example")
    seen = sinks.write_sft(rows, path, small_n, seed, [F.count(F.lit(1)).alias("n"), first]).first()
    read = chunks.sparkSession.read
    full, small = (read.schema(SFT_TRAIN).parquet(f"{path}/{part}") for part in ("full", "small"))
    total = full.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    stats = metrics.length_stats(total, ["prompt_tokens", "completion_tokens", "total_tokens"])
    funnel = curation.funnel_of(chunks, seen["n"], "chunk_path" if "chunk_path" in chunks.columns else None)
    funnel = _with_run(funnel, tokenizer=tokenizer, example_completion=seen["example"])
    sinks.write_summary(stats, f"{path}/length_stats")
    sinks.write_summary(funnel, f"{path}/funnel")
    return {"full": full, "small": small, "length_stats": stats, "funnel": funnel}


def _stats_of(stats: DataFrame, model_path: str | None, inference_time_s: float | None) -> DataFrame:
    """Statistics of a submission with its run, and a warning where rows had to fall back."""
    warning = submission.stats_warning(stats.first()["n_fallback"])
    if warning:
        warnings.warn(warning, stacklevel=3)
    return _with_run(stats, model_path=model_path, inference_time_s=inference_time_s)


def make_submission(
    test: DataFrame,
    responses: DataFrame,
    template: DataFrame,
    path: str | None = None,
    model_path: str | None = None,
    inference_time_s: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Submission rows and their statistics from test puzzles and model responses.

    ``test`` and ``responses`` meet on ``id``; ``responses`` has ``idx`` for the
    order of its records. Columns of ``test`` beside the puzzle are left out. With
    ``path``, ``responses`` are read once: a row without an id fails that pass, and
    the statistics are collected by the tasks that write the rows.
    """
    test = test.select("id", "nums", "target")
    require_columns(template, {"id", "equation"}, "the template")
    require_columns(responses, {"id", "idx", "response"}, "the results")
    results = student_records(submission.with_ids(responses).join(test, "id", "inner"))
    if path is None:
        built = submission.build_submission(template, results)
        return built, _stats_of(submission.submission_stats(built), model_path, inference_time_s)
    read = template.sparkSession.read
    sinks.write_results(results, f"{path}/raw")
    raw = read.schema(results.schema).parquet(f"{path}/raw")
    built = submission.build_submission(template, raw)
    write = partial(sinks.write_results, path=f"{path}/built")
    seen = sinks.write_observed(built, write, submission.stats_columns())
    built = read.schema(built.schema).parquet(f"{path}/built")
    stats = _stats_of(seen, model_path, inference_time_s)
    order = [c for c in readers.FILE_ORDER if c in built.columns] or ["id"]
    sinks.write_submission(built, f"{path}/submission", order)
    sinks.write_summary(stats, f"{path}/stats")
    return built, stats


def render_training_set(
    spark: SparkSession, path: str, template: P.ChatTemplate = P.ChatTemplate(), eos: str = ""
) -> DataFrame:
    """Prompt and completion strings of a written training set; other columns stay unread."""
    return curation.render_sft(spark.read.schema(SFT_TRAIN).parquet(path), template, eos)
