"""Run a batch function, such as a model, over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abacist.functions import text as T

# Prompts that a task holds to choose batches from.
WINDOW = 2048


def map_batches(
    df: DataFrame,
    make_responder: Callable[[], Callable[[list[str]], list[str]]],
    batch_size: int = 8,
    key: str = "idx",
    prompt: str = "prompt",
    out: str = "response",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``key, out`` for every row, answered ``batch_size`` prompts at a time.

    ``profile`` asks for other executors, such as ones with a GPU, for this stage alone.

    ``make_responder`` is called once per task and returns a function from
    prompts to as many responses. Rows keep their key, so no order is relied on.
    """
    key_type = df.schema[key].dataType

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        respond = make_responder()
        for frame in frames:
            prompts, answers = frame[prompt].tolist(), []
            for at in range(0, len(prompts), batch_size):
                part = prompts[at : at + batch_size]
                given = respond(part)
                if len(given) != len(part):
                    raise ValueError(f"{len(given)} responses to {len(part)} prompts")
                answers += given
            yield pd.DataFrame({key: frame[key].to_numpy(), out: answers})

    schema = StructType().add(key, key_type).add(out, "string")
    return df.select(key, prompt).mapInPandas(answer, schema, profile=profile)


def by_length(lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """Rows in batches of like length, longest first; a batch padded to its longest row has ``budget`` tokens at most.

    A row longer than ``budget`` is a batch of its own.
    """
    order, batches, at = np.argsort(-lengths, kind="stable"), [], 0
    while at < len(order):
        size = max(1, budget // max(1, int(lengths[order[at]])))
        batches.append(order[at : at + size])
        at += size
    return batches


def map_by_length(
    df: DataFrame,
    make_responder: Callable[[], Callable[[list[str]], list[str]]],
    token_budget: int,
    count_tokens: Callable[[Column], Column] = T.word_count,
    window: int = WINDOW,
    key: str = "idx",
    prompt: str = "prompt",
    out: str = "response",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """:func:`map_batches` with batches of prompts of like length: ``key, out, n_tokens, padded_to`` for every row.

    A task gathers up to ``window`` prompts, whatever Arrow batches they come in, and
    answers them in batches that hold ``token_budget`` tokens once each prompt is padded to
    the longest of its batch. Prompts are counted by ``count_tokens``. Rows keep
    their key; where a responder treats prompts one by one the result does not depend
    on the batches. :func:`padding_share` says what the padding costs.
    """
    schema = StructType().add(key, df.schema[key].dataType).add(out, "string")
    schema = schema.add("n_tokens", "long").add("padded_to", "long")

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        respond = make_responder()

        def answered(frame: pd.DataFrame) -> pd.DataFrame:
            lengths, prompts = frame["n_tokens"].fillna(0).to_numpy(np.int64), frame[prompt].tolist()
            answers, padded = [None] * len(prompts), np.zeros(len(prompts), np.int64)
            for rows in by_length(lengths, token_budget):
                given = respond([prompts[i] for i in rows])
                if len(given) != len(rows):
                    raise ValueError(f"{len(given)} responses to {len(rows)} prompts")
                for i, text in zip(rows.tolist(), given):
                    answers[i] = text
                padded[rows] = lengths[rows].max()
            return pd.DataFrame({key: frame[key].to_numpy(), out: answers, "n_tokens": lengths, "padded_to": padded})

        held, n = [], 0
        for frame in frames:
            for at in range(0, len(frame), window):
                held.append(frame.iloc[at : at + window])
                n += len(held[-1])
                if n >= window:
                    yield answered(pd.concat(held))
                    held, n = [], 0
        if n:
            yield answered(pd.concat(held))

    counted = df.select(key, prompt, count_tokens(F.col(prompt)).cast("long").alias("n_tokens"))
    return counted.mapInPandas(answer, schema, profile=profile)


def padding_share(answered: DataFrame) -> DataFrame:
    """``n_tokens, padded_tokens, padding_share`` of the result of :func:`map_by_length`."""
    tokens, padded = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "padded_to"))
    share = 1 - F.coalesce(F.try_divide(tokens.cast("double"), padded.cast("double")), F.lit(1.0))
    return answered.agg(tokens.alias("n_tokens"), padded.alias("padded_tokens"), share.alias("padding_share"))


def join_responses(problems: DataFrame, responses: DataFrame, key: str = "idx") -> DataFrame:
    """Puzzles with their responses, matched by the stored index, never by row order."""
    return problems.join(responses, key, "inner")
