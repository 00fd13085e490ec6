"""Language-model scores and quality rules against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from abacist.llm import batches, lm_scoring, ngrams, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_losses(texts, members, scale, without):
    """Mean loss of each text by the model of the texts ``members`` names; of texts ``without`` their own counts are left out."""
    every = [Counter(), Counter(), Counter()]
    own = {}
    for i, words in texts.items():
        pairs = Counter(zip(["<edge>", *words], words))
        own[i] = pairs, Counter(words), Counter({"<edge>": 1} if words else {})
        if i in members:
            for total, part in zip(every, own[i]):
                total.update(part)
    out = {}
    for i, words in texts.items():
        pairs, singles, edges = ({k: n - (p[k] if i in without else 0) for k, n in t.items()} for t, p in zip(every, own[i]))
        total = sum(singles.values())

        def p(a, b):
            share = (scale * singles.get(b, 0) + lm_scoring.EVEN) / (scale * total + lm_scoring.EVEN * lm_scoring.VOCABULARY)
            context = edges.get(a, 0) if a == "<edge>" else singles.get(a, 0)
            return (scale * pairs.get((a, b), 0) + lm_scoring.PRIOR * share) / (scale * context + lm_scoring.PRIOR)

        out[i] = -sum(math.log(p(a, b)) for a, b in zip(["<edge>", *words], words)) / max(1, len(words))
    return out


@pytest.mark.parametrize("held", [lm_scoring.IDS_HELD, 0])
def test_cross_entropy_difference(spark, documents, monkeypatch, held):
    monkeypatch.setattr(lm_scoring, "IDS_HELD", held)
    monkeypatch.setattr(lm_scoring, "BUCKET", 20_000)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1")
    got = {r.doc_id: r for r in lm_scoring.score_documents(documents.repartition(3), labels).collect()}
    texts = {r.doc_id: WORD.findall(r.text.translate({c: c + 32 for c in range(65, 91)})) for r in documents.collect()}
    good = {r.doc_id for r in labels.collect()} & set(texts)
    scale = sum(len(texts[i]) for i in good) / sum(map(len, texts.values()))
    target, background = slow_losses(texts, good, 1.0, good), slow_losses(texts, set(texts), scale, ())
    for i, words in texts.items():
        assert got[i].n_tokens == len(words)
        assert got[i].target_loss == pytest.approx(target[i], rel=1e-9)
        assert got[i].background_loss == pytest.approx(background[i], rel=1e-9)
        assert got[i].score == pytest.approx(target[i] - background[i], abs=1e-9)


def test_blocks_stay_where_they_are(spark, documents):
    """One shuffle of what is sent and one of what comes back; no name is left in the catalog."""
    ids = documents.select("doc_id").limit(9)
    plan = lm_scoring.score_documents(documents, ids)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("abacist_blocks")]


def area(low, high):
    """Share of pairs in which the one of ``low`` is the lower."""
    return sum((a < b) + 0.5 * (a == b) for a in low for b in high) / (len(low) * len(high))


def test_texts_of_the_target_score_like_others_of_their_kind(spark):
    """Half of the good documents as the target: the other half scores alike, bad ones do not."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = sorted(i for i, q in labels.items() if q == 1)
    ids = spark.createDataFrame([(i,) for i in good[::2]], "doc_id long")
    score = {r.doc_id: r.score for r in lm_scoring.score_documents(documents, ids).collect() if r.n_tokens >= 20}
    mine, held = ([score[i] for i in part if i in score] for part in (good[::2], good[1::2]))
    bad = [score[i] for i, q in labels.items() if q == 0 and i in score]
    assert min(map(len, (mine, held, bad))) >= 10
    assert 0.4 < area(mine, held) < 0.6
    assert area(held, bad) > 0.9


def test_score_prefers_texts_like_the_target(spark):
    rows = [(i, ("red green blue " if i % 2 else "one two three ") * 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id long")
    scores = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, ids).collect()}
    assert max(scores[i] for i in range(1, 40, 2)) < min(scores[i] for i in range(0, 40, 2))


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    ids = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    rows = lm_scoring.score_documents(odd_docs, ids).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_tokens, r.score) for r in rows if r.doc_id in (4, 5, 6)} == {(0, 0.0)}
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert all(math.isfinite(r.score) for r in lm_scoring.score_documents(odd_docs, ids.limit(0)).collect())
    assert lm_scoring.score_documents(no_docs, ids).count() == 0


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, lines, len(covered), failed


def base_of(docs):
    rows = quality.judge_quality(docs).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    got = Counter((r.doc_id, *[r[c] for c in names]) for r in rows)
    assert got == Counter((r.doc_id, *slow_base(r.text)) for r in docs.collect())
    assert all(not (r.base_failed and r.kept) for r in rows)
    return rows


def test_base_figures(documents):
    base_of(documents)


def test_verdicts_by_hand(spark):
    """``kept`` from the figures: quartiles and the lowest texts of each language's different texts."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(10**6 + i, t, "xx") for i, t in enumerate(["word " * 3, " ".join(map(str, range(90))), " ".join(map(str, range(90)))])]
    docs = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    texts = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = quality.judge_quality(docs).collect()
    of = {}
    for r in rows:
        if not r.base_failed:
            of.setdefault(texts[r.doc_id][0], {})[texts[r.doc_id][1]] = round(r.log_perplexity, 3)
    bands = {}
    for lang, found in of.items():
        values = sorted(found.values())
        low, high = np.percentile(values, [25, 75])
        lowest = max(v for v in values if sum(w < v for w in values) <= quality.LOW_SHARE * len(values))
        bands[lang] = lowest, high + quality.ABOVE * max(high - low, 0.01)
    below = Counter()
    for r in rows:
        lang = texts[r.doc_id][0]
        low, high = bands.get(lang, (-math.inf, math.inf))
        assert r.kept == (not r.base_failed and low <= round(r.log_perplexity, 3) <= high)
        below[lang] += not r.base_failed and round(r.log_perplexity, 3) < low
    assert set(bands) > {"xx", "en"} and not any(r.kept for r in rows if r.doc_id == 10**6)
    assert all(r.kept for r in rows if r.doc_id > 10**6)
    assert sum(not r.kept and not r.base_failed for r in rows) > 3


def test_the_lower_band_rejects_its_share(spark):
    rows = [("en", i, i / 1000) for i in range(5000)] + [("fr", i, 2.0) for i in range(9000)] + [("de", i, i / 10) for i in range(40)]
    names = "language string, text_hash long, log_perplexity double"
    scores = spark.createDataFrame(rows, names).selectExpr("*", "100L AS n_words", "0L AS n_repeat_words")
    scores = scores.union(scores.filter("language = 'en' and text_hash < 100"))
    low = {r.language: r.low for r in quality.bands(scores).collect()}
    assert low == {"en": 0.005, "fr": 2.0, "de": 0.0}


def test_base_figures_of_odd_rows(odd_docs, no_docs):
    rows = base_of(odd_docs)
    assert all(math.isfinite(r.log_perplexity) for r in rows)
    assert quality.judge_quality(no_docs).count() == 0
    kept = quality.Rules(odd_docs).keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality.Rules(no_docs).keep(no_docs).count() == 0
    plain = odd_docs.select("doc_id", "text")
    assert quality.judge_quality(plain).count() == odd_docs.count()


def test_every_byte_of_a_word_counts(spark):
    """Blanks are the six that part words, and besides capitals, digits and control characters no two bytes are one symbol."""
    fold = ngrams.symbol_table()
    assert {b for b in range(256) if fold[b] == ngrams.BLANK} == set(batches.BLANKS)
    apart = [48, 127, *(b for b in range(33, 256) if not chr(b).isascii() or not chr(b).isalnum() and b != 127), *range(97, 123)]
    assert len({*fold[apart].tolist()}) == len(apart) and fold.max() < ngrams.ALPHABET
    texts = ["\x00 a\x00b \x00\x00", "Ā一", "āä"]
    counts = [ngrams.count_trigrams(spark.createDataFrame([(t,)], "text string")).toPandas() for t in texts]
    assert [c["n"].sum() for c in counts] == [8, 5, 4]
    leads = [fold[t.encode()[0]] for t in ("Ā", "一")]
    assert leads[0] != leads[1] and set(leads) <= {c % ngrams.ALPHABET for c in counts[1]["code"]}


def slow_symbols(text):
    fold, out = ngrams.symbol_table(), []
    for b in text.encode():
        s = int(fold[b])
        if s != ngrams.BLANK or out and out[-1] != ngrams.BLANK:
            out.append(s)
    return out


def slow_kneser_ney(texts):
    """Interpolated modified Kneser-Ney of order three, entry by entry."""
    a = ngrams.ALPHABET
    tri = Counter()
    for text in texts:
        x = [0, 0, *slow_symbols(text)]
        tri.update(zip(x, x[1:], x[2:]))
    two = Counter((b, c) for _, b, c in tri)
    one = Counter(c for _, c in two)

    def off(counts):
        t = [sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
        d = [max(0.05, k - (k + 1) * y * t[k] / t[k - 1]) if t[k] and t[k - 1] else 0.5 for k in (1, 2, 3)]
        return lambda n: d[min(n, 3) - 1] if n else 0.0

    d1, d2, d3 = off(one), off(two), off(tri)
    after2, after1 = defaultdict(dict), defaultdict(dict)
    for (x, y, z), n in tri.items():
        after2[x, y][z] = n
    for (y, z), n in two.items():
        after1[y][z] = n
    total1 = sum(one.values())

    def p1(z):
        return (one[z] - d1(one[z])) / total1 + sum(map(d1, one.values())) / total1 / a

    def p2(y, z):
        seen = after1.get(y)
        if not seen:
            return p1(z)
        n, t = seen.get(z, 0), sum(seen.values())
        return (n - d2(n)) / t + sum(map(d2, seen.values())) / t * p1(z)

    def p3(x, y, z):
        seen = after2.get((x, y))
        if not seen:
            return p2(y, z)
        n, t = seen.get(z, 0), sum(seen.values())
        return (n - d3(n)) / t + sum(map(d3, seen.values())) / t * p2(y, z)

    return p3


def test_kneser_ney(documents):
    half = documents.filter("doc_id < 60")
    model = ngrams.train(half.select("text"))
    texts = [r.text for r in half.collect()]
    p3 = slow_kneser_ney(texts)
    fold = ngrams.symbol_table()
    for text in [*texts[:25], "Ünseen $$ text: 你好 zq\x01 qz", "", "a", "  b  "]:
        x = [0, 0, *slow_symbols(text)]
        want = -sum(math.log(p3(*t)) for t in zip(x, x[1:], x[2:]))
        assert model.losses([text.encode()], fold)[0] == pytest.approx(want, rel=1e-4, abs=1e-4)
    # What follows any two symbols adds up to one.
    for x, y in [(0, 0), (66, 67), (3, 180)]:
        z = np.arange(ngrams.ALPHABET)
        p = model.log_p(z, y * ngrams.ALPHABET + z, (x * ngrams.ALPHABET + y) * ngrams.ALPHABET + z)
        assert np.exp(p).sum() == pytest.approx(1, abs=1e-3)


def test_bands_reject_words_of_unusual_make_up(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in documents.filter("n_chars > 500").collect()]
    odd = [(10_000 + k, re.sub(r"(\S+)", r"\1" + mark * 4, rows[k][1]), rows[k][2]) for k, mark in enumerate("&%$#*")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert not any(got[i].kept for i, _, _ in odd)
    assert sum(got[i].kept for i, _, _ in rows) > 0.8 * len(rows)


def test_rare_words_tell_documents_apart(spark):
    """Words far down the list of frequencies count: the target's and the others' own ones are all rare."""
    common = [f"common{k}" for k in range(3000)]
    filler = [(i, " ".join(common) + " " + " ".join(common[::-1])) for i in range(4)]
    mine = [(10 + i, " ".join(f"mine{(i + k) % 12}" for k in range(12))) for i in range(8)]
    other = [(20 + i, " ".join(f"other{(i + k) % 12}" for k in range(12))) for i in range(8)]
    docs = spark.createDataFrame(filler + mine + other, "doc_id long, text string")
    ids = spark.createDataFrame([(10 + i,) for i in range(4)], "doc_id long")
    score = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, ids).collect()}
    assert max(score[10 + i] for i in range(8)) < min(score[20 + i] for i in range(8)) - 1


def test_copies_of_one_text_do_not_narrow_a_band(spark):
    """A third of all rows are copies of one text of a language that has fewer rows besides."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in documents.filter("n_chars > 500").collect()]
    german = {i: text for i, text, lang in rows if lang == "de"}
    copied = sorted(german)[len(german) // 2]
    copies = [(100_000 + k, german[copied], "de") for k in range(len(rows) // 2)]
    assert len(german) < len(copies)
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    passed = [i for i in german if not got[i].base_failed]
    assert sum(got[i].kept for i in passed) > 0.8 * len(passed) > 0
