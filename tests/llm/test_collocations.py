"""Phrases against a count of every phrase by hand."""

import random
import re
from collections import Counter, defaultdict

import pytest

from abacist.llm import collocations
from abacist.session import setting


def slow_mine(rows, least, longest, top, covered):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][words[i : i + k]] += 1
    out = []
    for lang, f in counts.items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        for p, a in often.items():
            best = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            holders = [c for q, c in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if all(100 * c < covered * a for c in holders):
                k = best[1]
                found.append((-best[0], -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, least, longest, top, covered", [(1, 3, 5, 2000, 100), (2, 2, 4, 7, 60), (3, 4, 2, 50, 100), (4, 1, 3, 90, 100)])
def test_small_texts(spark, seed, least, longest, top, covered):
    rng = random.Random(seed)
    words = ["a", "B", "b", "été", "İ", "x1", "don't", " ", "好", "z" * 40, "\x00", "É"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! ", "\r\n", ";:?"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), rng.choice([text, text, "a b été " * 9, None, ""])))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = rows_of(collocations.mine(docs, least, longest, top, covered, bits=18))
    assert got == slow_mine(rows, least, longest, top, covered) and got
    # Where many pairs share a value nothing changes.
    assert rows_of(collocations.mine(docs, least, longest, top, covered, bits=3)) == got


def test_counts_past_64_bits(spark):
    """The products, from a table of known counts."""
    big = 10**13
    known = [("en", [], "", 4 * big), ("en", ["a"], "a", big + 7), ("en", ["b"], "b", big + 9), ("en", ["a", "b"], "a b", big)]
    docs = spark.createDataFrame([("en", "x")], "lang string, text string")
    table = spark.createDataFrame(known, "lang string, words array<string>, phrase string, f long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocations, "phrases", lambda *_: table)
        row = collocations.mine(docs).first()
    assert (row.a, row.score) == (big, 1000 * big * 4 * big // ((big + 7) * (big + 9)))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect() if r.doc_id != 7]
    short = odd_docs.filter("doc_id is null or doc_id <> 7")
    assert rows_of(collocations.mine(short, least=2, bits=20)) == slow_mine(rows, 2, 5, 2000, 100)
    assert collocations.mine(odd_docs, bits=20).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.mine(no_docs).count() == 0


def test_what_a_task_hands_on_is_a_row_for_each_language_and_group(spark):
    """However many windows it counted."""
    rows = [(lang, " ".join(f"w{(i * k) % 1501}" for i in range(1500))) for lang in ("en", "fr") for k in range(1, 9)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    docs = docs.selectExpr("lang", "text", "xxhash64(lang) lang_hash")
    known = []
    for _ in range(2, 5):
        known.append(collocations._frequent(docs, 1, 18, known))
    windows = collocations._windows(docs, known, 5, 18)
    sent = windows.selectExpr("lang", "part", "size(n) size").collect()
    assert len({(r.lang, r.part) for r in sent}) == len(sent) <= 2 * collocations._GROUPS
    assert sum(r["size"] for r in sent) > 20_000
    heads = windows.selectExpr("lang", "part", "inline(arrays_zip(w1, n))").filter("w1 is not null").select("lang", "part", "w1")
    assert heads.distinct().count() == heads.select("lang", "w1").distinct().count()


def test_windows_that_arrive_after_a_sum_are_added_to_it(spark, monkeypatch):
    """A task sums its windows whenever it holds many; more batches follow."""
    monkeypatch.setattr(collocations, "_WINDOWS_HELD", 20)
    rng = random.Random(5)
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice("abcdefgh") for _ in range(80))) for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        got = rows_of(collocations.mine(docs, 5, 5, 50, 100, bits=18))
    assert got == slow_mine(rows, 5, 5, 50, 100) and got
