"""Registered queries, the pipeline, and their DuckDB statements."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from abacist.llm import oracle, packing, quality, queries, simhash, substring
from check_queries import connect, difference


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(oracle.STATEMENTS) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_matches(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(oracle.STATEMENTS[name]).df()) is None


def test_pipeline_stages(spark, sf):
    """Each stage, on what the one before kept, against what its operator says on that input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    verdicts = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    good = corpus_pipeline.keep_good(spark, docs, sf)
    rows = good.collect()
    assert good.columns == docs.columns
    assert {r.doc_id for r in rows} == {i for i, k in verdicts.items() if k} and all(given[r.doc_id] == r for r in rows)
    single = corpus_pipeline.keep_one_of_near_copies(spark, good, sf)
    parts = {r.component_id for r in simhash.near_duplicates(good).collect()}
    rows = single.collect()
    assert single.columns == docs.columns and sorted(r.doc_id for r in rows) == sorted(parts)
    clean = corpus_pipeline.cut_repeats(spark, single, sf)
    texts = {r.doc_id: r.text for r in substring.remove_repeats(single).collect()}
    rows = clean.collect()
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in rows} == texts
    assert all(r.n_chars == len(r.text) for r in rows if r.text != given[r.doc_id].text)
    packed = corpus_pipeline.pack(spark, clean, sf).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r.doc_id for r in packed)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd_docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
    assert packing.pack_documents(no_docs, queries.vocabulary_file("word_bpe_49k.json")).count() == 0
