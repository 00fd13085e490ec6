"""Runs against every stretch tried, and the query against its contract word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.llm import batches, periods, queries


def slow_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed):
    rng, hasher = random.Random(seed), batches.Hasher()
    for _ in range(20):
        least, docs = rng.choice([2, 3, 5, 8, 12, 13]), []
        for _ in range(rng.randint(0, 4)):
            words = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5:
                words += words[: rng.randint(0, 20)] * rng.randint(1, 6) + words[: rng.randint(0, 5)]
            docs.append(words * rng.choice([1, 1, 2]))
        bounds = np.cumsum([0, *map(len, docs)])
        hashes = batches.mix(np.array([x + 7 for d in docs for x in d], np.uint64))
        got = [tuple(r) for r in periods.runs_of(hashes, bounds, hasher.word_powers, least).T.tolist()]
        want = [(s + at, n, q) for d, at in zip(docs, bounds.tolist()) for s, n, q in slow_runs(d, least)]
        assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_work_does_not_grow_with_the_number_of_occurrences():
    """A million equal words, and a million with equal stretches between two marks: far from all pairs."""
    hasher = batches.Hasher()
    for words, n in ((np.zeros(10**6), 1), (np.array(([0] * 50 + [1] + [0] * 47 + [2]) * 5000), 10_001)):
        hashes = batches.mix(words.astype(np.uint64) + np.uint64(7))
        assert periods.runs_of(hashes, np.array([0, len(words)]), hasher.word_powers).shape[1] == n


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_odd_rows(spark, odd_docs, no_docs):
    short = odd_docs.filter("doc_id is null or doc_id <> 7")
    rows = periods.find_runs(short).collect()
    given = sorted((str(r.doc_id), words_of(r.text)) for r in short.collect())
    want = [(i, slow_runs(w), slow_collapse(w, slow_runs(w))) for i, w in given]
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.text) for r in rows) == sorted(want)
    long = periods.find_runs(odd_docs.filter("doc_id = 7")).first()
    assert long.runs == [] and len(long.text.split()) == 60_000
    assert periods.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(short, least=1)


def test_query_by_the_word(spark, sf, documents, odd_docs):
    def planted(i, words):
        if i is None or zlib.crc32(str(i).encode()) % 10 or not words:
            return words
        g, n = zlib.crc32(str(i).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return words[:a] + [words[a + (j - a) % p] for j in range(a, n)]

    given = {r.doc_id: words_of(r.text) for r in documents.collect()}
    for r in queries.op11_run_detection(spark, sf).collect():
        words = planted(r.doc_id, given.pop(r.doc_id))
        runs = slow_runs(words) if len(words) < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(slow_collapse(words, runs).encode()).hexdigest()
    assert not given
    turned = queries.with_periods(odd_docs.filter("doc_id is null or doc_id <> 7")).collect()
    for r, o in zip(turned, odd_docs.filter("doc_id is null or doc_id <> 7").collect()):
        assert r.doc_id == o.doc_id and words_of(r.text) == planted(o.doc_id, words_of(o.text))
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(" x  y\tz w ").alias("text"))
    for r in queries.with_periods(many).collect():
        assert words_of(r.text) == planted(r.doc_id, ["x", "y", "z", "w"])
