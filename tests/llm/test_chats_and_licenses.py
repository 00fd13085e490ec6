"""Conversations and licence notices."""

import random
import re
from collections import Counter

import pytest

from abacist.llm import chats, licenses


def slow_chats(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is None, turn or 0, role is None, role or "", text is None, text or "", role, text))
    said = {c: [t[6:] for t in sorted(turns, key=lambda t: t[:6])] for c, turns in talks.items()}
    kept = {}
    for c, mine in said.items():
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for o in said.values())
        earlier = any(o == mine and d < c for d, o in said.items())
        if not longer and not earlier:
            kept[c] = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in mine)
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_snapshots_collapse(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(80):
        n = rng.randint(1, 6)
        rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(["yes", "no"])) for t in range(n)]
    rows += [(100, 0, None, "yes"), (101, 0, "", "yes"), (102, None, "user", None), (103, 1, "user", ""), (None, 0, "user", "x")]
    rows += [(104, 5, "user", "twice"), (104, 5, "user", "twice"), (105, 0, "user", "twice")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = chats.collapse_and_render(frame).collect()
    assert {r.conv_id: r.text for r in got} == slow_chats(rows)
    assert {r.conv_id: r.n_turns for r in got} == {c: t.count("<|im_start|>") for c, t in slow_chats(rows).items()}


def test_empty_and_further_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi", 3, 4)], "conv_id long, turn long, role string, text string, place int, h1 int")
    assert chats.collapse_and_render(frame).count() == 1
    assert chats.collapse_and_render(frame.limit(0)).count() == 0


def test_main_path_is_native(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chats.collapse_and_render(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def slow_scan(text):
    """Every line, sentence, paragraph, whole text and window against every template; of overlapping places the best."""
    text, every, units, paragraph = text or "", [], [], []
    for line in [*text.split("\n"), ""]:
        words = re.findall(r"[^\W_]+", line.lower())
        if not words:
            units.append(([w for _, part in paragraph for w in part], paragraph[0][0] if paragraph else 0))
            paragraph = []
            continue
        at = len(every)
        paragraph.append((at, words))
        units.append((words, at))
        for sentence in re.split(r"(?<=[.;:!?])\s+", line):
            part = re.findall(r"[^\W_]+", sentence.lower())
            units.append((part, at))
            at += len(part)
        every += words
    units.append((every, 0))
    places = []
    notices = [(name, t) for name, templates in licenses.TEMPLATES.items() for t in templates]
    for name, template in [*notices, *licenses.full_texts().items()]:
        other = re.findall(r"[^\W_]+", template.lower())
        b, size = Counter(zip(other, other[1:])), len(other) - 1
        windows = [(every[i : i + size + 1], i) for i in range(len(every) - size)]
        for words, at in windows + (units if (name, template) in notices else [(every, 0)]):
            a = Counter(zip(words, words[1:]))
            score = 2 * sum((a & b).values()) / max(1, sum(a.values()) + size)
            if score >= 0.8:
                places.append((-score, -size, name, at, at + len(words)))
    kept = []
    for place in sorted(places):
        _, _, name, start, end = place
        over = [min(e, end) - max(s, start) for _, _, n, s, e in kept if n != name]
        sizes = [min(e - s, end - start) for _, _, n, s, e in kept if n != name]
        if not any(2 * o > z for o, z in zip(over, sizes)):
            kept.append(place)
    found = {}
    for score, _, name, *_ in kept:
        found[name] = max(-score, found.get(name, 0))
    return found


def notices(docs):
    rows = licenses.scan_licenses(docs).collect()
    got = Counter((r.doc_id, tuple(r.licenses), r.license, r.dice) for r in rows)
    want = Counter()
    for r in docs.collect():
        found = sorted(slow_scan(r.text).items())
        best = max(found, key=lambda x: x[1]) if found else (None, None)
        want[(r.doc_id, tuple(n for n, _ in found), *best)] += 1
    assert got == want
    return rows


def test_notices_in_documents(documents):
    """Those short enough for every window to be tried, of texts that speak of a licence and some others."""
    short = documents.filter("n_chars < 2500")
    assert any(r.license for r in notices(short.filter("lower(text) like '%licen%' or doc_id % 10 = 0")))


def test_notices_in_odd_texts(spark, odd_docs, no_docs):
    mit = licenses.TEMPLATES["MIT"][3]
    half = mit.split()
    rows = [
        (1, "Released under the MIT License."), (2, "RELEASED under the  MIT license"), (3, "Some words. Licensed under CC BY-SA 4.0. More words."),
        (4, "\n".join(mit.split(", "))), (5, "intro\n\n" + mit.replace(", ", ",\n") + "\n\nrest"), (6, "the MIT License"),
        (7, " ".join(half[: len(half) // 2])), (8, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (9, "This work is licensed under the GNU General Public License, version 2."), (10, "x"), (11, "x y"),
    ]
    found = {r.doc_id: r for r in notices(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert found[1].license == found[2].license == found[4].license == found[5].license == "MIT"
    assert found[3].license == "CC-BY-SA-4.0" and found[8].licenses == ["Apache-2.0", "MIT"]
    assert found[9].license == "GPL-2.0" and found[9].dice == 1.0
    assert found[6].license is None and found[7].license is None
    notices(odd_docs.filter("doc_id is null or doc_id <> 7"))
    assert licenses.scan_licenses(odd_docs.filter("doc_id = 7")).first().licenses == []
    assert licenses.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize("name, k", [("GPL-2.0", 1), ("GPL-3.0", 1), ("MPL-2.0", 0), ("CC-BY-4.0", 1)])
@pytest.mark.parametrize("width", [0, 6])
def test_notices_inside_prose(spark, name, k, width):
    prose = " ".join(f"word{i} other{i % 7}" for i in range(30))
    words = f"{prose} {licenses.TEMPLATES[name][k]} {prose}".split()
    text = "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width)) if width else " ".join(words)
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.license == name and row.dice == 1.0


def test_whole_licence_texts_and_headers(spark):
    """Each text gives its own name and no other, alone and inside prose; so do notices that differ in a name or number."""
    prose = " ".join(f"word{i} other{i % 7}" for i in range(30))
    given = [(name, text) for name, text in licenses.full_texts().items()]
    given += [(name, f"{prose}\n\n{text}\n\n{prose}") for name, text in given]
    given += [(name, f"{prose}\n{t}\n{prose}") for name, templates in licenses.TEMPLATES.items() for t in templates]
    rows = [(i, text) for i, (_, text) in enumerate(given)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    wrong = [(given[r.doc_id][0], r.licenses) for r in found if r.licenses != [given[r.doc_id][0]] or r.dice != 1.0]
    assert not wrong
    both = licenses.TEMPLATES["GPL-2.0"][1] + f"\n\n{prose}\n\n" + licenses.TEMPLATES["LGPL-3.0"][1]
    row = licenses.scan_licenses(spark.createDataFrame([(1, both)], "doc_id long, text string")).first()
    assert row.licenses == ["GPL-2.0", "LGPL-3.0"]
