"""Byte-level ids against the library, the tournament tree against plain first fit, and packed pieces put back."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from abacist.llm import byte_tokens, first_fit, queries

BYTES = queries.vocabulary_file("byte_bpe_50k.json")
PARTS = [
    " ", "  ", "\n", "\t", " ", "　", "a", "The", "é", "1", "23", ".", ",", "!", "'s", "'", "<|endoftext|>",
    "<|end", "\x1c", "\x85", "日本", "🙂", "́", "\x00", "\r\n", "ß", "​", "Ġ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.mark.parametrize("kept", [1 << 18, 60])
def test_ids_are_the_library_s(library, monkeypatch, kept):
    monkeypatch.setattr(byte_tokens, "_KEPT", kept)
    rng = random.Random(3)
    texts = [None, ""] + ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)]
    encoder = byte_tokens.ByteEncoder(open(BYTES, encoding="utf-8").read())
    found = []
    for i in range(0, len(texts), 500):
        ids, bounds = encoder.texts(pa.array(texts[i : i + 500], pa.string()))
        found += [ids[a:b] for a, b in zip(bounds, bounds[1:])]
    for text, ids in zip(texts, found):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(5))
def test_the_tree_finds_the_first_sequence_with_room(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65, rng.integers(0, 200))
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(64)
        room[at] -= sizes[i]
        want[i] = at
    assert first_fit.first_fit_decreasing(sizes, 64).tolist() == [want[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(8))
def test_arranged_pieces_are_whole_and_leave_no_gap(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 64, rng.integers(0, 300))
    held, covered = defaultdict(list), defaultdict(list)
    for piece, start, n, sequence, offset in first_fit.arrange(sizes, 64):
        held[sequence].append((offset, n))
        covered[piece].append((start, n))
    for spans, size in [(s, None) for s in held.values()] + [(covered[i], n) for i, n in enumerate(sizes)]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == size if size is not None else at == 64 or at & (at - 1) == 0
    assert sum(n for s in held.values() for _, n in s) == sizes.sum()
    cuts = sum(len(c) - 1 for c in covered.values())
    assert cuts <= len(held) and len(held) <= sizes.sum() // 64 + 6


def test_no_pieces():
    assert first_fit.arrange(np.zeros(0, np.int64), 64) == []


def check(rows, texts, library, length=2048):
    """All pieces of documents ``texts`` (by id, each once) are there and lie side by side."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4"))
            at += r.length
        assert at == len(ids)
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)


def test_packed_documents(spark, sf, documents, library):
    rows = queries.op12_first_fit_packing(spark, sf).collect()
    check(rows, {r.doc_id: r.text for r in documents.collect()}, library)


def test_odd_rows_and_small_groups(spark, odd_docs, no_docs, library):
    packed = first_fit.pack(first_fit.cut(odd_docs, BYTES, length=64), 64, group=4)
    rows = packed.collect()
    assert sum(r.length for r in rows if r.start == 0) > 0
    whole = {bytes(r.ids) for r in first_fit.sequences(packed).collect()}
    assert {len(w) // 2 for w in whole} <= {1, 2, 4, 8, 16, 32, 64}
    n = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert sum(r.length for r in rows) == n
    with_crc = first_fit.with_crc(packed.filter("doc_id > 2")).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.filter("doc_id > 2").collect()}
    encoded = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for r in with_crc:
        ids = encoded[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4"))
    assert first_fit.with_crc(first_fit.pack_documents(no_docs, BYTES)).count() == 0
