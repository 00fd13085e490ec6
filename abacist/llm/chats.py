"""Logged conversations: snapshots that a longer one continues go, the others become training text.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.session import settle

START, END = "<|im_start|>", "<|im_end|>"


def _turn_order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, place, h1, h2, last``: rolling hashes of every turn prefix of every conversation.

    A prefix's hash is the exclusive or of the hashes of its turns, each taken
    with its place, so one running aggregate gives all of them. Two hashes make
    128 bits. ``last`` marks a conversation's full length.
    """
    within = Window.partitionBy("conv_id")
    placed = turns.select(
        "conv_id", F.row_number().over(within.orderBy(*_turn_order())).alias("place"), "turn", "role", "text"
    )
    running = within.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rolling(salt: int) -> Column:
        # NULL and empty differ: xxhash64 leaves out NULLs, so their presence is hashed as well.
        own = F.xxhash64(
            F.lit(salt), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"
        )
        return F.bit_xor(own).over(running)

    follows = F.lead("place").over(within.orderBy("place"))
    return placed.select(
        "conv_id", "place", rolling(1).alias("h1"), rolling(2).alias("h2"), follows.isNull().alias("last")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id`` of conversations that are no prefix of a longer one; of equal ones the smallest id."""
    known = settle(prefixes(turns), "turn-prefixes")
    whole = known.filter("last").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = known.filter("not last").select("place", "h1", "h2").distinct()
    return whole.join(longer, ["place", "h1", "h2"], "left_anti").select("conv_id")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, text``: one text for each conversation."""
    turn = F.struct(
        F.col("turn").isNull().alias("late"), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text"
    )
    lines = F.transform(
        F.array_sort(F.collect_list(turn)),
        lambda t: F.concat(
            F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n")
        ),
    )
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(lines, "").alias("text"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, text`` of the conversations in ``turns (conv_id, turn, role, text)`` that say something new.

    A conversation whose turns (role and text, in order) are the first turns of a
    longer one is a snapshot of it and goes; of equal conversations the one with
    the smallest id stays. The anti-join sees each distinct prefix once, however
    many conversations share it. Turns are ordered by ``turn``, NULL last, then by
    role and text; repeated rows are turns of their own. A NULL role or text is
    unlike an empty one but renders as such. Rows without ``conv_id`` belong to no
    conversation and are left out. A conversation is one text in the end, so its
    turns meet in one row; only those of conversations that stay do.
    """
    turns = turns.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    return render(turns.join(maximal(turns), "conv_id", "left_semi"))
