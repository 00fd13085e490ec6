"""One row per key.

Both are written as a row number filtered to 1, which Spark also applies before
the shuffle: every map task passes on at most one row per key, so a key that
holds a large part of the table does not travel or gather.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _best_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    ranked = keyed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    )
    return ranked.filter("_rank = 1").drop("_rank", *names)


def dedup_keep_first(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """First row, in ``order_cols``, of every (numbers as a multiset, target, equation_norm)."""
    return _best_per_key(
        df,
        [F.sort_array("nums"), F.col("target"), F.col("equation_norm")],
        [F.col(c) for c in order_cols],
    )


def last_wins(df: DataFrame, key: str = "id", order_col: str = "idx") -> DataFrame:
    """The last record of every key."""
    return _best_per_key(df, [F.col(key)], [F.col(order_col).desc()])
