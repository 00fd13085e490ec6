"""SentencePiece ids of texts, and texts of ids, over one sorted trie of marked words at a time.

Every blank becomes the mark that starts a word. No piece holds a mark behind
another character, so a text's ids are those of its marked words. The distinct
words of a batch are sorted; one word after the other keeps the forward states
of the prefix it shares with the word before (a depth-first walk of their trie)
and adds a state for each further character.

A state is the best way to cut the prefix: score, last piece, where it starts.
For a unigram model any piece may follow any other and the highest sum of scores
wins. For a BPE model two neighbours must be what merging their joint text
leaves; then every prefix has exactly one way, the one that merging finds, and
the state's score only sums it up. (The highest sum of a BPE model's rank scores
would be another cut than the one the model's users expect.)
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from abacist.llm.tokens import slices

MARK = "▁"
PIECE_BYTES = 8 << 20
CACHED_PAIRS = 300_000
DECODED_ROWS = 1000
UNIGRAM, BPE = 1, 2
NO_PIECE = -(1 << 30)
_UNKNOWN_PENALTY = 10.0  # fixed value of the library's unigram models


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message."""

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        key = number()
        match key & 7:
            case 0:
                value = number()
            case 1:
                value, at = message[at : at + 8], at + 8
            case 5:
                value, at = message[at : at + 4], at + 4
            case _:
                size = number()
                value, at = message[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """Pieces of a model file, and how its texts are cut."""

    def __init__(self, message: bytes, decoding: bool = False):
        """``decoding``: only what :func:`decode` needs."""
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=message)
        parts = dict(_fields(message))
        self.kind = dict(_fields(parts[2])).get(3, UNIGRAM)
        normal = dict(_fields(parts[3])) if 3 in parts else {}
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("only models that leave texts as they are but for marks can be used")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a best cut")
        self.unknown = library.unk_id()
        self.ids, self.scores, self.texts, self.bytes = {}, {}, [], {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.texts.append(bytes([int(piece[3:-1], 16)]))
            elif library.is_unknown(i):
                self.texts.append(" ⁇ ".encode())
            elif library.is_control(i):
                self.texts.append(b"")
            else:
                self.texts.append(piece.replace(MARK, " ").encode())
                if not library.is_unused(i):
                    self.ids[piece], self.scores[piece] = i, library.get_score(i)
        if decoding:
            return
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece crosses a mark")
        self.missing = min(self.scores.values(), default=0.0) - _UNKNOWN_PENALTY
        # Every ending of a piece, with the piece's id where it is a whole one.
        self.endings = {piece[i:]: NO_PIECE for piece in self.ids for i in range(1, len(piece))}
        self.endings |= self.ids
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stable: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """``text`` after all merges of a BPE model, each time of the pair with the best score, the first of equal ones."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _name(self, number: int) -> str:
        """A piece, or the character that stands for itself, by its number in a state."""
        return self.pieces[number] if number >= 0 else chr(-1 - number)

    def follows(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces ``left`` and ``right`` side by side, and makes ``right`` at all."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        a, b = self._name(left), self._name(right)
        known = self.pairs[left, right] = self.reached(right) and self.merged(a + b) == [a, b]
        return known

    def reached(self, number: int) -> bool:
        """Whether merging makes a piece of its characters."""
        known = self.stable.get(number)
        if known is None:
            piece = self._name(number)
            known = self.stable[number] = self.merged(piece) == [piece]
        return known

    def walk(self, words: Iterable[str]) -> Iterator[list[int]]:
        """The best cut of each of ``words``, which are sorted: ids, or ``-1 - code`` for a character without one."""
        bpe, endings, scores = self.kind == BPE, self.endings, self.scores
        pairs, reached, follows, missing = self.pairs, self.reached, self.follows, self.missing
        # For each prefix of the word at hand: score, last piece, where it starts.
        score, last, begin = [0.0], [0], [0]
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, chosen, start = None, 0, end
                while start:
                    start -= 1
                    piece = word[start:end]
                    number = endings.get(piece)
                    if number is None or number == NO_PIECE:
                        if start < end - 1:
                            if number is None:
                                break
                            continue
                        own = -1 - ord(piece)
                    else:
                        own = number
                    if bpe:
                        if start:
                            fits = pairs.get((last[start], own))
                            if fits is None:
                                fits = follows(last[start], own)
                        else:
                            fits = reached(own)
                        if fits:
                            best, chosen, at = score[start] + scores.get(piece, missing), own, start
                            break
                    else:
                        total = score[start] + scores.get(piece, missing)
                        if best is None or total > best:
                            best, chosen, at = total, own, start
                    if number is None:
                        break
                score.append(best), last.append(chosen), begin.append(at)
            cut, end = [], len(word)
            while end:
                cut.append(last[end])
                end = begin[end]
            before = word
            cut.reverse()
            yield cut

    def numbers(self, cut: list[int]) -> list[int]:
        """Ids of a cut; a character without one gives the ids of its bytes, or one unknown id for a run of such."""
        if min(cut) >= 0:
            return cut
        found = []
        for number in cut:
            if number >= 0:
                found.append(number)
            elif self.bytes:
                found += [self.bytes[b] for b in chr(-1 - number).encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return found


_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def marked_words(text: str) -> list[str]:
    """The marked words of a text; an empty text has none."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def _ids_of(texts: pa.StringArray, vocabulary: Vocabulary) -> pa.ListArray:
    """Ids of each text; every distinct word is cut once."""
    counts, parts = [], []
    for _, some in slices(texts, 1 << 20):
        split = [marked_words(t or "") for t in some.to_pylist()]
        counts += map(len, split)
        parts.append(pa.array(list(chain.from_iterable(split)), pa.string()))
    words = pa.concat_arrays(parts).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    flat, ends = array("i"), [0]
    # By bytes of UTF-8, which is the order of code points: words with a common prefix are neighbours.
    for cut in vocabulary.walk(words.dictionary.take(order).to_pylist()):
        flat.extend(vocabulary.numbers(cut))
        ends.append(len(flat))
    known = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "<i4")))
    place = np.argsort(order.to_numpy())
    at = pa.array(place[words.indices.to_numpy()])
    sizes = np.diff(ends)[at.to_numpy()]
    bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), known.take(at).flatten())


def _shared(spark: SparkSession, model: str):
    """The model file as a broadcast; its size is that of the vocabulary."""
    with open(model, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs (doc_id, text)``; further columns go along.

    A NULL or empty text has no ids. Texts of any length are encoded whole. A
    column ``ids`` that ``docs`` has already is replaced.
    """
    shared = _shared(docs.sparkSession, model)
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            for at, texts in slices(batch["text"], PIECE_BYTES):
                columns = [batch[c].slice(at, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, _ids_of(texts, vocabulary)], [*kept, "ids"])

    schema = docs.drop("text").schema.add("ids", ArrayType(IntegerType()))
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Add the ``text`` of each row's ``ids``; NULL ids give an empty text. A ``text`` there already is replaced."""
    shared = _shared(encoded.sparkSession, model)
    kept = [c for c in encoded.columns if c != "text"]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary(shared.value, decoding=True).texts
        for batch in batches:
            for at in range(0, len(batch), DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                out = []
                for ids in part["ids"]:
                    values = ids.values
                    text = b"".join([table[i] for i in values.to_numpy().tolist()]) if values else b""
                    out.append(text.removeprefix(b" ").decode("utf-8", "replace"))
                columns = [*[part[c] for c in kept], pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "text"])

    return encoded.mapInArrow(run, StructType(list(encoded.schema)).add("text", "string"))
