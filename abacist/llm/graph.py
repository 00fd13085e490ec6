"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.session import settle


def _pull(links: DataFrame, of: str, low: str) -> DataFrame:
    """Every link of ``of`` moved to the smallest value that ``of`` knows, itself included."""
    least = links.groupBy(of).agg(F.least(F.min(low), F.col(of)).alias("root"))
    return links.join(least, of)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``; component is the smallest node reachable.

    Alternates two star contractions until nothing changes; the number of rounds
    follows the logarithm of the longest path. Each round's links are written
    to the shared folder, so no lineage grows and a lost executor costs one round.
    A hub is no problem: minima are combined before the shuffle, and the join
    back has one row per node on its other side. Null ends and loops are dropped.
    """
    state = settle(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = None
    while True:
        both = state.union(state.select("b", "a"))
        large = _pull(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.filter("a <> b").distinct()
        small = _pull(large, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("root").alias("b")).union(
            small.select("a", F.col("root").alias("b"))
        )
        state = settle(small.filter("a <> b").distinct(), "links")
        now = state.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_if(F.col("a") < F.col("b"))
        ).first()
        if now == mark:
            break
        mark = now
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.union(roots)
