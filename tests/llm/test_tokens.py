"""Tokenizers, token files and packing against the libraries and brute force."""

import bisect
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from abacist.llm import byte_tokens, packing, sentencepieces, token_files, tokens
from abacist.session import setting

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a  b\tc\n", "x<|endoftext|>y", "don't STOP'S", "naïve café é ΑΣ ΣΆΣ. İi", "a\x1cb\x85c\xa0d e",
    "你好 мир 🙂🙂", "̈x ̈", "1234567 ### ...", "▁a ▁▁ b▁", "<0x0A> <s> <unk>", "aaaaaaaaaaaa" * 9, "\x00\x01",
]


@pytest.fixture(scope="module")
def texts(spark, documents):
    given = documents.select("doc_id", "text")
    more = spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string")
    return given.union(more).repartition(3)


def slow_ids(text, end):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, end]


@pytest.fixture(scope="module")
def word_ids(texts):
    rows = texts.collect()
    found = Tokenizer.from_file(WORDS).encode_batch([r.text for r in rows], add_special_tokens=False)
    return {r.doc_id: e.ids for r, e in zip(rows, found)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_sentencepiece_ids_are_the_library_s(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = sentencepieces.encode(texts, PIECES)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    given = {r.doc_id: r.text for r in texts.collect()}
    for i, text in given.items():
        assert got[i] == library.encode(text), text[:80]
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded, PIECES).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in given.items()}


def as_unigram(message: bytes) -> bytes:
    """The model file with its kind changed, so that the highest sum of scores is the cut wanted."""
    at = message.rindex(b"\x18\x02 \x80\xfa\x01")
    return message[:at] + b"\x18\x01" + message[at + 2 :]


def test_unigram_models_cut_by_the_highest_score(documents):
    vocabulary = sentencepieces.Vocabulary(as_unigram(open(PIECES, "rb").read()))
    assert vocabulary.kind == sentencepieces.UNIGRAM
    score = vocabulary.scores

    def best(word):
        """Highest sum over all cuts, each tried."""
        if not word:
            return 0.0
        cuts = [score[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in score]
        return max(cuts + ([vocabulary.missing + best(word[1:])] if word[0] not in score else []))

    words = {w for r in documents.limit(20).collect() for w in sentencepieces.marked_words(r.text)}
    words = sorted(w for w in words if len(w) <= 11) + ["▁日本語x"]
    words.sort()
    for word, numbers in zip(words, vocabulary.walk(words)):
        cut = [vocabulary._name(n) for n in numbers]
        assert "".join(cut) == word
        assert sum(score.get(p, vocabulary.missing) for p in cut) == pytest.approx(best(word))


def test_prefix_states_do_not_depend_on_the_words_before():
    vocabulary = sentencepieces.Vocabulary(open(PIECES, "rb").read())
    rng = random.Random(1)
    words = sorted({"▁" + "".join(rng.choices("abcdeäß你", k=rng.randint(1, 9))) for _ in range(400)})
    together = list(vocabulary.walk(words))
    assert all(list(vocabulary.walk([w])) == [cut] for w, cut in zip(words, together))
    assert all([vocabulary._name(n) for n in cut] == vocabulary.merged(w) for w, cut in zip(words, together))


def test_sentencepiece_of_odd_rows(odd_docs, no_docs):
    encoded = sentencepieces.encode(odd_docs, PIECES)
    assert encoded.count() == odd_docs.count() and "place" in encoded.columns
    back = sentencepieces.decode(encoded, PIECES)
    given = sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == given
    assert sentencepieces.decode(sentencepieces.encode(no_docs, PIECES), PIECES).count() == 0


MAKERS = pytest.mark.parametrize("maker, path", [(tokens.word_encoder, WORDS), (byte_tokens.byte_encoder, BYTES)])


@MAKERS
def test_tasks_of_a_worker_share_an_encoder(spark, maker, path):
    make = maker(spark, path)

    def run(batches):
        for _ in batches:
            pass
        encoder = make()
        encoder.tasks = getattr(encoder, "tasks", 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([encoder.tasks])], ["process", "tasks"])

    rows = spark.range(40).repartition(40).mapInArrow(run, "process long, tasks long").collect()
    assert len(rows) == 40
    most = defaultdict(int)
    for r in rows:
        most[r.process] = max(most[r.process], r.tasks)
    assert sum(most.values()) == 40 and len(most) < 40


@MAKERS
def test_encoders_of_many_tasks_take_the_memory_of_one(spark, documents, maker, path):
    make = maker(spark, path)
    some = pa.array([r.text for r in documents.collect()])

    def held():
        with open("/proc/self/smaps_rollup") as file:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", file.read())[1]) / 1024

    for _ in range(3):
        make().texts(some)
    before = held()
    for _ in range(12):
        make().texts(some)
    assert held() - before < 20


def test_token_files(spark, texts, word_ids):
    folder = token_files.token_folder(spark)
    files = token_files.write_tokens(texts, folder, WORDS, 2, 49_408, length=64)
    got = {r.doc_id: r for r in token_files.read_documents(files, folder, ids=True).collect()}
    start = 0
    for i in sorted(word_ids):
        want = [*word_ids[i], 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (start, len(want), crc(want), want)
        start += len(want)
    row = files.orderBy("first_id").first()
    file = token_files.TokenFile(folder, row.file)
    assert str(file.reader.schema.field("ids").type) == "fixed_size_list<item: uint16>[64]"
    # Sequences and masks put together are the documents, and the ids are views of the mapped file.
    joined, n = [], 0
    while len(joined) < row.tokens:
        ids, mask = file.sequence(n)
        assert len(ids) == len(mask) == 64 and ids.base is not None
        joined += ids[mask].tolist()
        n += 1
    first = [x for i in sorted(word_ids) if i <= row.last_id for x in [*word_ids[i], 2]]
    assert joined == first


def test_the_table_of_files_is_one_file(spark, texts):
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        files = token_files.write_tokens(texts, token_files.token_folder(spark), WORDS, 2, 49_408)
    assert files.count() > 1 and len(files.inputFiles()) == 1


def test_token_files_of_odd_rows(odd_docs, no_docs):
    rows = token_files.encode_documents(odd_docs, WORDS, 2, 49_408).collect()
    assert len(rows) == odd_docs.count()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id or 0 for r in rows] == sorted(r.doc_id or 0 for r in rows)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert {r.ids_crc32 for r in rows if r.doc_id in (4, 5, 6)} == {crc([2])}
    assert token_files.encode_documents(no_docs, WORDS, 2, 49_408).count() == 0


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(held)


def best_fit_decreasing(lengths, capacity):
    """Number of sequences when each piece, the largest first, goes where it fits best."""
    gaps, n = [], 0
    for size in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, size)
        gap, n = (gaps.pop(i), n) if i < len(gaps) else (capacity, n + 1)
        bisect.insort(gaps, gap - size)
    return n


def test_packing(texts, word_ids):
    rows = packing.pack_documents(texts, WORDS, end_id=1, length=512).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, ids in word_ids.items():
        want, mine = [*ids, 1], sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == list(range(0, len(want), 512))
        assert all(r.ids_crc32 == crc(want[r.start : r.start + r.length]) for r in mine)
        assert sum(r.length for r in mine) == len(want)
    used = check_packing(rows, 512)
    assert used <= 1.01 * best_fit_decreasing([r.length for r in rows], 512) + 1


def test_packed_sequences_hold_their_documents(texts, word_ids):
    packed = packing.pack(packing.cut(texts.filter("doc_id < 50"), WORDS, 1, 512, ids=True), 512)
    where = {(r.doc_id, r.piece): r for r in packed.collect()}
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for (i, _), r in where.items():
        part = whole[r.sequence_id][r.offset : r.offset + r.length].tolist()
        assert part == [*word_ids[i], 1][r.start : r.start + r.length]


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, WORDS, length=128).collect()
    check_packing(rows, 128)
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    assert {r.length for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert packing.pack_documents(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("kind", ["even", "large", "equal", "halves"])
def test_best_two_fit_fills_sequences(kind):
    rng = np.random.default_rng(4)
    lengths = {
        "even": rng.integers(1, 100, 3000),
        "large": rng.integers(40, 101, 3000),
        "equal": np.full(900, 34),
        "halves": np.array([51, 49, 30, 21, 50, 50] * 100),
    }[kind]
    sequence, offset = packing.best_two_fit(lengths, 100)
    filled = np.bincount(sequence, lengths)
    assert filled.max() <= 100 and filled.min() > 0
    assert len(filled) <= 1.01 * best_fit_decreasing(lengths.tolist(), 100)


def test_two_smaller_pieces_take_a_small_one_s_place():
    # Greedy takes 60 and 30; 20 and 20 fill the gap of 40 exactly.
    sequence, _ = packing.best_two_fit(np.array([60, 30, 20, 20]), 100)
    assert sequence.tolist() == [0, 1, 0, 0]


def test_two_fit_never_takes_one_piece_twice():
    stock = packing._Stock(np.array([20, 7]), 100)
    assert stock.two(40) == (7, 20)
    assert packing._Stock(np.array([20]), 100).two(40) == (0, 0)
