"""SimHash, substring and embedding deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from abacist.llm import graph, hnsw, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints_and_groups(documents):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    fp = {r.doc_id: slow_fingerprint(r.text) for r in documents.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    ids = sorted(fp)
    near = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == slow_components(near, ids)


@pytest.mark.parametrize("bucket", [4096, 8, 2])
def test_close_fingerprints_however_large_a_bucket(spark, bucket):
    rng = random.Random(bucket)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(25):
            value ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            values.add(value)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    parts = graph.components(simhash.near_links(frame, 3, bucket)).collect()
    got = defaultdict(set)
    for r in parts:
        got[r.component].add(r.node % (1 << 64))
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    want = defaultdict(set)
    for n, c in slow_components(near, values).items():
        want[c].add(n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rows = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert Counter(r.component for r in rows) == {0: 41, 100: 60, 200: 2}


def test_simhash_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {4, 5, 6, None} and {r.component_id for r in empty} == {4}
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 2, 3, 4, 7, 8, 9, 10, 11]
    assert simhash.keep_one(no_docs).count() == 0


def test_rows_with_one_id_are_documents_of_their_own(spark):
    """Two unrelated texts under one id both stay, each for its group; a copy under another id goes."""
    rng = random.Random(9)
    one, two, three = (" ".join(str(rng.random()) for _ in range(80)) for _ in range(3))
    rows = [(5, one), (5, two), (5, two), (7, one), (8, two), (9, three), (3, three), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == Counter([(5, one), (5, two), (3, three), (None, one)])


def test_large_buckets_of_far_values_are_split_by_their_other_bytes(spark, monkeypatch):
    seen, flipped = [], simhash._flipped

    def watching(values, distance):
        seen.append(values.count())
        return flipped(values, distance)

    monkeypatch.setattr(simhash, "_flipped", watching)
    rng = random.Random(2)
    values = {0xABCDEF << 40 | rng.getrandbits(40) for _ in range(3000)}
    values |= {v ^ 1 << rng.randrange(64) for v in rng.sample(sorted(values), 40)}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.near_links(frame, 3, 64).collect()}
    assert seen == [0]
    array = np.array(sorted(values), np.uint64)
    near = {
        frozenset((int(v), int(w)))
        for i, v in enumerate(array)
        for w in array[i + 1 :][np.bitwise_count(array[i + 1 :] ^ v) <= 3]
    }
    assert got <= near and slow_components([sorted(x) for x in got], values) == slow_components([sorted(x) for x in near], values)


def slow_removal(rows, length=20):
    """Flags of the words of each (id, text), by a table of all windows."""
    first = {}
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if (i, s) > first[tuple(w[s : s + length])]:
                gone[s : s + length] = [True] * length
        yield i, w, gone


def test_rows_without_an_id_share_no_key(spark):
    rng = random.Random(1)
    shared = " ".join(str(rng.random()) for _ in range(30))
    rows = [(None, f"{i} {shared} {rng.random()}") for i in range(300)] + [(None, shared)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.select(substring.document_id(docs)).distinct().count() == 301
    removal_of(docs)


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def removal_of(docs, length=20):
    want = Counter()
    rows = [(r.id, r.text) for r in docs.select(substring.document_id(docs).alias("id"), "text").collect()]
    for i, w, gone in slow_removal(rows, length):
        want[i, len(w), sum(gone), digest([x for x, g in zip(w, gone) if not g])] += 1
    got = Counter()
    for r in substring.remove_repeats(docs, length).select("doc_id", "text", "n_words", "n_removed").collect():
        got[r.doc_id, r.n_words, r.n_removed, digest(WORD.findall(r.text or ""))] += 1
    unnamed = Counter()
    for (i, *figures), n in want.items():
        unnamed[(None if i >= 2**63 - 2**40 else i, *figures)] += n
    assert got == unnamed


def test_substrings(documents):
    removal_of(documents)


def test_substrings_of_odd_rows(odd_docs, no_docs):
    removal_of(odd_docs)
    assert substring.remove_repeats(no_docs).count() == 0
    clean = substring.deduplicated(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    given = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in clean.filter("doc_id in (4, 5, 6, 7, 9, 11)").collect():
        assert r.text == given[r.doc_id]


@pytest.mark.parametrize("seed", range(4))
def test_substrings_of_few_words(spark, seed):
    """Few different words, so windows repeat in and across texts at many distances."""
    rng = random.Random(seed)
    texts = []
    for i in range(60):
        parts = [rng.choice(texts)[1] if texts and rng.random() < 0.4 else "" for _ in range(2)]
        cuts = [p.split()[rng.randint(0, 9) : rng.randint(10, 60)] for p in parts]
        own = [rng.choice(["a", "b", "ab"][: 1 + seed % 3]) for _ in range(rng.randint(0, 50))]
        texts.append((rng.randint(0, 30) if seed == 3 else i, " ".join(cuts[0] + own + cuts[1])))
    removal_of(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))


def test_text_around_removed_words_stays():
    cut = substring._cut
    text = b" a  b\tc\nd e "
    starts, ends = [1, 4, 6, 8, 10], [2, 5, 7, 9, 11]
    assert cut(text, starts, ends, [False] * 5) == text
    assert cut(text, starts, ends, [False, True, True, False, False]) == b" a\nd e "
    assert cut(text, starts, ends, [True, True, False, False, True]) == b"c\nd"
    assert cut(text, starts, ends, [True] * 5) == b""


def slow_vectors(rows, threshold):
    v = {}
    for r in rows:
        e = r.embedding
        if r.label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v[r.vec_id] = (r.label, np.array(e, float) / np.linalg.norm(np.array(e, float)))
    ids = [r.vec_id for r in rows]
    links = [
        (a, b) for a in v for b in v
        if a < b and v[a][0] == v[b][0] and len(v[a][1]) == len(v[b][1]) and v[a][1] @ v[b][1] >= threshold
    ]
    return links, slow_components(links, ids)


@pytest.mark.parametrize("shard", [8192, 40])
def test_embeddings(spark, shard):
    rng = np.random.default_rng(shard)
    centers = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        e = centers[rng.integers(30)] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])
        rows.append((i, [float(x) for x in np.float32(e)], int(rng.integers(3))))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1)]
    rows += [(404, rows[0][1], None), (405, [1.0, 2.0], 1), (406, [1.0, 2.0], 1), (407, [], 1), (408, [float("inf")] * 16, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in hnsw.near_duplicates(frame, 0.98, shard).collect()}
    links, parts = slow_vectors(frame.collect(), 0.98)
    degree = Counter(x for pair in links for x in pair)
    assert len(links) > 500 and set(got) == {r[0] for r in rows}
    found = sum(r.n_links for r in got.values()) / 2
    assert found >= 0.99 * len(links) and all(r.n_links <= degree[i] for i, r in got.items())
    assert {i: r.component_id for i, r in got.items()} == parts
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_repeated_rows(spark):
    e = [1.0, 0.0, 0.5]
    rows = [(1, e, 0, "x")] * 3 + [(2, e, 0, "y"), (None, e, 0, "z"), (3, e, 1, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 3, 1)] * 3 + [(2, 3, 1), (None, 0, None), (3, 0, 3)], key=str)


def test_one_id_under_several_labels_and_with_vectors_that_cannot_link(spark):
    """Each row has the links of its own label and vector, and no row is lost."""
    near = [1.0, 0.01, 0.0]
    rows = [
        (1, [1.0, 0.0, 0.0], "a"), (1, [1.0, 0.0, 0.0], "b"), (2, near, "a"), (3, near, "b"), (3, [0.0, 1.0, 0.0], "b"),
        (1, None, "a"), (2, [0.0, 0.0, 0.0], "a"), (3, [float("nan"), 1.0, 0.0], "b"), (1, near, None), (4, [1.0, 0.0], "a"),
        (5, [1.0, None, 0.0], "a"), (6, [float("inf"), 0.0, 0.0], "a"), (None, near, "a"), (0, [0.0, 1.0, 0.001], "b"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(frame).collect())
    assert got == Counter(
        [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 0, False), (0, 1, 0, True)]
        + [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (1, 0, 1, True), (4, 0, 4, True), (5, 0, 5, True)]
        + [(6, 0, 6, True), (None, 0, None, True)]
    )


@pytest.mark.parametrize("n, planted", [(5_000, 400), (24_000, 1_500)])
def test_planted_links_are_found_across_shards(spark, n, planted):
    """Recall of at least 0.99 of planted near copies, in one label of several shards."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 32))
    copies = base[:planted] + rng.normal(size=(planted, 32)) * 0.02
    vectors = np.concatenate([base, copies]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    rows = {r.vec_id: r for r in hnsw.near_duplicates(frame.repartition(8)).collect()}
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    true = np.zeros(len(exact), np.int64)
    for at in range(0, len(exact), 2000):
        true[at : at + 2000] = (exact[at : at + 2000] @ exact.T >= 0.98).sum(axis=1) - 1
    found = np.array([rows[i].n_links for i in range(len(exact))])
    assert true.sum() >= 1.9 * planted and (found <= true).all()
    assert found.sum() >= 0.99 * true.sum()
    joined = [rows[n + i].component_id == i for i in range(planted) if true[n + i] == 1 and true[i] == 1]
    assert sum(joined) >= 0.99 * len(joined) and len(joined) > planted / 2


def test_an_audit_counts_links_between_different_vectors():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(500, 16))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    own = np.arange(500)
    asked, true = hnsw.audit(hnsw.Graph(vectors), vectors, 0.999, own)
    assert len(asked) == 500 and sum(map(len, true)) == 0
    close = np.concatenate([vectors, vectors[:300]])
    asked, true = hnsw.audit(hnsw.Graph(close), close, 0.999, np.arange(800))
    assert hnsw.LINKS_SEEN <= sum(map(len, true)) < 600 and len(asked) < 800


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 32))
    vectors = np.concatenate([base, base[:300] + rng.normal(size=(300, 32)) * 0.1])
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    built = hnsw.Graph(vectors)
    hits = total = 0
    for q in vectors:
        true = set(np.flatnonzero(vectors @ q >= 0.95))
        hits += len(true & set(built.above(q, 0.95, hnsw.BEAM)))
        total += len(true)
    assert hits / total > 0.99
