"""Token ids of texts by a public tokenizer, each distinct word encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE_BYTES = 8 << 20
# Words that are letters of these and up to three closing marks are read as those two parts.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_LOWERED = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
_TAIL, _LONGEST_TAIL = ".,;:!?", 3
_SEPARATOR = "\x00"
_AT_ONCE = 512


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokenizer drops white space, so a text's ids are those of its words."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        # Spark's tasks are the parallel part.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        # Lowered letters are left alone by normalizing and make one pre-token: the same
        # model reads them without those steps. Each word ends with an end-of-word piece.
        steps = [{"type": "WhitespaceSplit"}]
        steps.append({"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False})
        short = parts | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
        self.letters = Tokenizer.from_str(json.dumps(short))
        suffix = parts["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for piece, i in parts["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self.separator = self._joined(self.whole, [_SEPARATOR])[0]

    @staticmethod
    def _joined(tokenizer, texts: list[str]) -> np.ndarray:
        """Ids of ``texts`` in one array."""
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.zeros(0, "<u4"), *[np.array(e.ids, "<u4") for e in found]])

    def _distinct(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of each of ``words``, many of them encoded as one text."""
        lowered = pc.match_substring_regex(words, _LOWERED).to_numpy(zero_copy_only=False)
        given = pc.match_substring(words, _SEPARATOR).to_numpy(zero_copy_only=False)
        kinds = [np.flatnonzero(x) for x in (lowered, ~lowered & ~given, given)]
        letters, others, alone = (words.take(pa.array(k)).to_pylist() for k in kinds)
        texts = [" ".join(letters[i : i + _AT_ONCE]) for i in range(0, len(letters), _AT_ONCE)]
        found = self._joined(self.letters, texts)
        ends = np.flatnonzero(self.ends[found]) + 1
        parts, sizes = [found], [np.diff(ends, prepend=0)]
        blocks = (others[i : i + _AT_ONCE] for i in range(0, len(others), _AT_ONCE))
        found = self._joined(self.whole, [f" {_SEPARATOR} ".join([*b, ""]) for b in blocks])
        ends = np.flatnonzero(found == self.separator)
        parts.append(np.delete(found, ends))
        sizes.append(np.diff(ends, prepend=-1) - 1)
        parts += [self._joined(self.whole, [w]) for w in alone]
        sizes.append(np.array([len(p) for p in parts[2:]], np.int64))
        order = np.argsort(np.concatenate(kinds))
        return _lists(np.concatenate(sizes), np.concatenate(parts)).take(pa.array(order))

    def _words(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of each of ``words``, which are distinct; closing marks apart from the letters before them."""
        core = pc.utf8_rtrim(words, _TAIL)
        tail = pc.subtract(pc.utf8_length(words), pc.utf8_length(core))
        plain = pc.and_(pc.match_substring_regex(core, _LETTERS), pc.less_equal(tail, _LONGEST_TAIL))
        core = pc.if_else(plain, pc.utf8_lower(core), words)
        marks = pa.array([""]).take(pa.array(np.zeros(len(words), np.int64)))
        for n in range(1, _LONGEST_TAIL + 1):
            marks = pc.if_else(pc.and_(plain, pc.equal(tail, n)), pc.utf8_slice_codeunits(words, -n), marks)
        both = pa.concat_arrays([core, marks]).dictionary_encode()
        known = self._distinct(both.dictionary)
        at = both.indices.to_numpy().reshape(2, -1)
        sizes = known.value_lengths().to_numpy().astype(np.int64)
        values = known.take(pa.array(at.T.ravel())).flatten().to_numpy()
        return _lists(sizes[at].sum(axis=0), values)

    def texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, and where each text's begin (and the last ends)."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        known = self._words(words.dictionary)
        sizes = known.value_lengths().to_numpy().astype(np.int64)[words.indices.to_numpy()]
        places = np.concatenate([[0], np.cumsum(sizes)])
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        ids = known.take(words.indices).flatten().to_numpy()
        return ids, places[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=2)
def _worker_encoder(definition: str) -> WordEncoder:
    """A Python worker's encoder, kept from task to task: each one made and dropped leaves some 4 MB behind."""
    return WordEncoder(definition)


def word_encoder(spark: SparkSession, path: str) -> Callable[[], WordEncoder]:
    """A maker of encoders for use inside tasks; the tasks of a worker share one.

    ``path`` is a vocabulary file. It is read on the driver and travels as a
    broadcast: its size is that of the vocabulary.
    """
    with open(path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    return lambda: _worker_encoder(shared.value)


def slices(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Neighbouring texts that together hold about ``size`` bytes, with the index of the first."""
    bytes_of = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(bytes_of)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop
