"""Sketches by chunk against exact values."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from abacist.operators import curation, metrics, scoring, sketches
from abacist.sources import puzzles, sinks


@pytest.fixture(scope="module")
def lengths(spark):
    rng = random.Random(3)
    values = [int(rng.lognormvariate(6, 1.5)) for _ in range(60_000)]
    rows = [(i % 97, v, i if i % 5 else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "chunk long, tokens long, other long").repartition(6)


def test_merged_quantiles_are_within_the_stated_error(lengths):
    per_chunk = sketches.length_sketches(lengths, ["tokens", "other"])
    assert per_chunk.count() == 2 * 97
    exact = {r.metric: r for r in metrics.length_stats(lengths, ["tokens", "other"]).collect()}
    for r in sketches.merged_lengths(per_chunk).collect():
        want, values = exact[r.metric], sorted(x[0] for x in lengths.select(r.metric).dropna().collect())
        assert (r.n, r.min, r.max) == (len(values), want.min, want.max)
        assert r.mean == pytest.approx(want.mean) and r.std == pytest.approx(want.std)
        for q, got in ((0.5, r.p50), (0.95, r.p95)):
            low, high = bisect.bisect_left(values, got) / r.n, bisect.bisect_right(values, got) / r.n
            assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR


def test_order_of_chunks_and_grouping_do_not_matter(spark, lengths):
    """Merges in other orders may draw otherwise; all stay within the error, and short ranges are exact."""
    per_chunk = sketches.length_sketches(lengths, ["tokens"])
    values = sorted(x[0] for x in lengths.select("tokens").collect())
    rows = per_chunk.collect()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        for parts in (1, 7):
            r = sketches.merged_lengths(spark.createDataFrame(rows, per_chunk.schema).repartition(parts)).first()
            low, high = bisect.bisect_left(values, r.p95) / r.n, bisect.bisect_right(values, r.p95) / r.n
            assert low - sketches.RANK_ERROR <= 0.95 <= high + sketches.RANK_ERROR
    few = lengths.filter("chunk < 40").filter(F.col("tokens") % 100 == 0)
    assert 40 < few.count() <= sketches.K
    one = sketches.merged_lengths(sketches.length_sketches(few, ["tokens"])).first()
    held = sorted(x[0] for x in few.select("tokens").collect())
    assert one.p50 in held and abs(held.index(one.p50) - len(held) / 2) <= 1.5


def test_a_range_is_answered_from_the_rows_of_its_chunks(spark, lengths, tmp_path):
    sinks.write_chunks(sketches.length_sketches(lengths, ["tokens"]), f"{tmp_path}")
    table = spark.read.parquet(f"{tmp_path}")
    some = table.filter("chunk between 10 and 19")
    assert sketches.merged_lengths(some).first().n == lengths.filter("chunk between 10 and 19").count()
    plan = sketches.merged_lengths(some)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan
    sinks.write_chunks(sketches.length_sketches(lengths.filter("chunk = 12 and tokens > 400"), ["tokens"]), f"{tmp_path}")
    kept = lengths.filter("chunk <> 12 or tokens > 400")
    assert sketches.merged_lengths(spark.read.parquet(f"{tmp_path}")).first().n == kept.count()


def test_no_rows(spark, lengths):
    none = lengths.filter("false")
    assert sketches.merged_lengths(sketches.length_sketches(none, ["tokens"])).count() == 0
    assert sketches.length_sketches(lengths.withColumn("tokens", F.lit(None).cast("long")), ["tokens"]).count() == 0


def test_funnel_of_sketches(spark, sf):
    scored = scoring.score_responses(puzzles.answered(spark, sf)).withColumn("chunk", F.floor(F.col("idx") / 100))
    per_chunk = sketches.key_sketches(scored)
    assert sketches.merged_funnel(per_chunk).first() == curation.curation_funnel(scored).first()
    empty = sketches.merged_funnel(per_chunk.filter("false")).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0)
    late, early = per_chunk.filter("chunk >= 7"), per_chunk.filter("chunk < 7")
    exact = curation.curation_funnel(scored).first().n_after_dedup
    before = curation.curation_funnel(scored.filter("chunk < 7")).first().n_after_dedup
    assert sketches.new_keys(late, early).first().n_new == exact - before
    assert sketches.new_keys(late, early.filter("false")).first().n_new > 0
    assert sketches.new_keys(late, late).first().n_new == 0


def test_many_keys_are_estimated_within_the_stated_error(spark):
    n = 200_000
    keys = spark.range(n).select(
        (F.col("id") % 50).alias("chunk"), F.array("id").alias("nums"), F.lit(1).cast("long").alias("target"),
        F.concat(F.col("id").cast("string"), F.lit(" + 1")).alias("equation"), F.lit(True).alias("correct"),
    )
    twice = sketches.key_sketches(keys.union(keys.withColumn("chunk", F.col("chunk") + 50)))
    row = sketches.merged_funnel(twice).first()
    assert (row.n_raw, row.n_correct) == (2 * n, 2 * n)
    # Four times the standard error.
    assert abs(row.n_after_dedup - n) < 4 * sketches.DISTINCT_ERROR * n
    first = twice.filter("chunk < 25")
    rest = sketches.new_keys(twice.filter("chunk < 50"), first).first().n_new
    assert abs(rest - n / 2) < 4 * sketches.DISTINCT_ERROR * n
