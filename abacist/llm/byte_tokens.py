"""Token ids of texts by a byte-level tokenizer, each distinct stretch encoded once.

Such a tokenizer first cuts a text into runs of letters, digits, marks and blanks,
where one space may lead a run. Before a space there is a cut unless blanks stand on
both its sides; between a letter and one of ``.,;:!?`` there always is. Texts are cut
at these places, so equal stretches share one encoding, for some time also over batches and tasks.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

# A space between blanks, or between a blank and the end; all that any reading of \s may hold.
_BLANK = "[\t-\r\x1c-\x20\u0085\\p{Z}]"
_LETTERS = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
# Letters after a space are one run, which the model alone reads; its first piece starts with the sign for a space.
_LED, _SPACE = "^ [A-Za-zÀ-ÖØ-öø-ÿ]+$", "Ġ"
_TAIL, _LONGEST_TAIL = ".,;:!?", 3
_AT_ONCE = 512
# Stretches whose ids an encoder keeps from one call to the next.
_KEPT = 1 << 18


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


class ByteEncoder:
    """Ids of texts by a byte-level tokenizer without a normalizer whose only special token is ``mark``."""

    def __init__(self, definition: str, mark: str = "<|endoftext|>"):
        from tokenizers import Tokenizer, pre_tokenizers

        # Spark's tasks are the parallel part.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.mark = Tokenizer.from_str(definition), mark
        self.mark_id = self.tokenizer.token_to_id(mark)
        self.own = self.tokenizer.pre_tokenizer
        led = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
        self.led = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), led])
        self.kept, self.kept_ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(len(vocabulary), bool)
        self.leads[[i for piece, i in vocabulary.items() if piece.startswith(_SPACE)]] = True

    def _joined(self, cut, texts: list[str]) -> np.ndarray:
        """Ids of ``texts`` in one array, cut by the pre-tokenizer ``cut``."""
        self.tokenizer.pre_tokenizer = cut
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.zeros(0, "<u4"), *[np.array(e.ids, "<u4") for e in found]])

    def _distinct(self, stretches: pa.StringArray) -> pa.ListArray:
        """Ids of each stretch; many are encoded at once, where need be with the special token between them."""
        led = pc.match_substring_regex(stretches, _LED).to_numpy(zero_copy_only=False)
        kinds = [np.flatnonzero(led), np.flatnonzero(~led)]
        words, others = (stretches.take(pa.array(k)).to_pylist() for k in kinds)
        words = self._joined(self.led, ["".join(words[i : i + _AT_ONCE]) for i in range(0, len(words), _AT_ONCE)])
        starts = np.flatnonzero(self.leads[words])
        blocks = (others[i : i + _AT_ONCE] for i in range(0, len(others), _AT_ONCE))
        found = self._joined(self.own, [self.mark.join([*b, ""]) for b in blocks])
        ends = np.flatnonzero(found == self.mark_id)
        sizes = np.concatenate([np.diff(starts, append=len(words)), np.diff(ends, prepend=-1) - 1])
        both = _lists(sizes, np.concatenate([words, np.delete(found, ends)]))
        return both.take(pa.array(np.argsort(np.concatenate(kinds))))

    def _remembered(self, stretches: pa.StringArray) -> pa.ListArray:
        """Ids of each of ``stretches``, which are distinct; what earlier calls met is not encoded again."""
        at = pc.index_in(stretches, value_set=self.kept)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        fresh = stretches.filter(pa.array(missing))
        ids = pa.concat_arrays([self.kept_ids, self._distinct(fresh)])
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[missing] = len(self.kept) + np.arange(len(fresh))
        found = ids.take(pa.array(place))
        if len(ids) <= _KEPT:
            self.kept, self.kept_ids = pa.concat_arrays([self.kept, fresh]), ids
        else:
            self.kept, self.kept_ids = stretches, found
        return found

    def _stretches(self, stretches: pa.StringArray) -> pa.ListArray:
        """Ids of each of ``stretches``, which are distinct; closing marks apart from the letters before them."""
        core = pc.utf8_rtrim(stretches, _TAIL)
        tail = pc.subtract(pc.utf8_length(stretches), pc.utf8_length(core))
        plain = pc.and_(pc.match_substring_regex(core, _LETTERS), pc.less_equal(tail, _LONGEST_TAIL))
        marks = pa.array([""]).take(pa.array(np.zeros(len(stretches), np.int64)))
        for n in range(1, _LONGEST_TAIL + 1):
            marks = pc.if_else(pc.and_(plain, pc.equal(tail, n)), pc.utf8_slice_codeunits(stretches, -n), marks)
        both = pa.concat_arrays([pc.if_else(plain, core, stretches), marks]).dictionary_encode()
        known = self._remembered(both.dictionary)
        at = both.indices.to_numpy().reshape(2, -1)
        sizes = known.value_lengths().to_numpy().astype(np.int64)
        return _lists(sizes[at].sum(axis=0), known.take(pa.array(at.T.ravel())).flatten().to_numpy())

    def texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, and where each text's begin (and the last ends)."""
        texts = texts.fill_null("")
        odd = pc.or_(pc.match_substring(texts, self.mark), pc.match_substring_regex(texts, f"{_BLANK} (?:{_BLANK}|$)"))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd):
            alone = {i: self._joined(self.own, [texts[i].as_py()]) for i in odd.tolist()}
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts)
        lists = pc.split_pattern(texts, " ")
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        first = np.zeros(bounds[-1], bool)
        first[bounds[:-1]] = True
        words = lists.flatten()
        spaced = pc.if_else(pa.array(first), words, pc.binary_join_element_wise(" ", words, ""))
        spaced = spaced.dictionary_encode()
        known = self._stretches(spaced.dictionary)
        sizes = known.value_lengths().to_numpy().astype(np.int64)[spaced.indices.to_numpy()]
        ids = known.take(spaced.indices).flatten().to_numpy()
        places = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        if not len(odd):
            return ids, places
        parts = [alone.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(places, places[1:]))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def _worker_encoder(definition: str) -> ByteEncoder:
    """A Python worker's encoder, kept from task to task: each one made and dropped leaves some 4 MB behind."""
    return ByteEncoder(definition)


def byte_encoder(spark: SparkSession, path: str) -> Callable[[], ByteEncoder]:
    """A maker of encoders, one for the tasks of a worker; the vocabulary file ``path`` travels as a broadcast of its own size."""
    with open(path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    return lambda: _worker_encoder(shared.value)
