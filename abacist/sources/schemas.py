"""Declared schemas, as DDL; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

MESSAGES = "array<struct<content:string,role:string>>"

PROBLEMS = "idx bigint, nums array<bigint>, target bigint"
SPLITS = "idx bigint, nums array<bigint>, target bigint, split string"
TEACHER_CHUNK = (
    "idx bigint, nums array<bigint>, target bigint, response string, response_n_tokens bigint, "
    "equation string, correct boolean, reason string, train_idx bigint"
)
SFT_TRAIN = (
    f"messages {MESSAGES}, completion string, nums array<bigint>, target bigint, "
    "train_idx bigint, prompt_tokens bigint, completion_tokens bigint"
)


def require_columns(df: DataFrame, needed: set[str], what: str) -> DataFrame:
    """Fail on the driver, before any job runs, when columns are missing."""
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
    return df
