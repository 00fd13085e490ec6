"""Maximal runs of words that repeat with a period, found by seeds and diagonals.

A run of period q and at least ``least`` words holds a stretch of at least
max(least - q, q) words that equal the word q places on: a stretch of diagonal q.
Lags are taken in classes, each twice as wide as the one before. For a class of
which every run guarantees g equal words, the (g+1)/2-grams of a document are
indexed; any stretch covers one that starts at a multiple of its length, and such a
seed is paired with its occurrences at the lags of the class, in the same document.
Of a lag's pairs, one whose seed begins where the lag is covered so far only moves that
border on; the stretch is extended once to either side, by fewer words than a seed has.

A seed inside a known run of period up to half its length is paired beyond that
run only: inside, it occurs at multiples of the period, which give the same
run again. That keeps the pairs of a class below three a word, whatever repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm import batches as B

LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


def _classes(least: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, lag after the last, words of a seed) while a run of ``longest`` words may have such a period."""
    low, high, equal = 1, least // 2 + 1, (least + 1) // 2
    while 2 * low <= longest:
        yield low, high, (equal + 1) // 2
        low, high, equal = high, 2 * high, high


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``starts`` on, as many as its size says."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def _border(sums: B.Sums, at: np.ndarray, lag: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
    """By how many words, up to ``most``, the diagonals ``lag`` stay equal from ``at`` on to the right, or left."""
    low, high = np.zeros_like(at), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        a = at[open_] if sign > 0 else at[open_] - middle
        d = lag[open_]
        equal = sums.of(a, a + middle) == sums.of(a + d, a + d + middle)
        low[open_] = np.where(equal, middle, low[open_])
        high[open_] = np.where(equal, high[open_], middle - 1)
    return low


def _pairs(sums, ends, places, seed, low, high, known):
    """(seed's place, lag) of the pairs of one class; ``places`` start a gram inside a document of use."""
    n = len(ends) + 1
    grams = sums.of(places, places + seed)
    order = np.argsort(grams, kind="stable")
    changes = np.concatenate([[False], grams[order][1:] != grams[order][:-1]])
    rank = np.cumsum(changes)
    index = rank * n + places[order]  # sorted: by gram, then by place
    often = np.bincount(rank, minlength=1)[rank] > 1
    chosen = np.flatnonzero((places[order] % seed == 0) & often)
    at, key = places[order][chosen], rank[chosen] * n
    first, last = at + low, np.minimum(at + high, ends[at] - seed + 1)
    inside = (known[2] <= seed // 2) & (known[1] >= seed)
    starts, sizes = known[0][inside], known[1][inside]
    covered = np.zeros(n, np.int64)
    covered[_spread(starts, sizes - seed + 1)] = np.repeat(starts + sizes, sizes - seed + 1)
    first = np.maximum(first, covered[at] - seed + 1)
    left = np.searchsorted(index, key + first)
    sizes = np.maximum(np.searchsorted(index, key + np.maximum(last, first)) - left, 0)
    found = places[order][_spread(left, sizes)]
    at = np.repeat(at, sizes)
    return at, found - at


def runs_of(hashes: np.ndarray, bounds: np.ndarray, powers: B.Powers, least: int = LEAST) -> np.ndarray:
    """``start, length, period`` (rows) of the runs of the documents between ``bounds``, by start and period."""
    sizes = np.diff(bounds)
    begins, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    own = np.repeat(sizes, sizes)
    sums, everywhere = B.Sums(hashes, powers), np.arange(len(hashes))
    known = np.zeros((3, 0), np.int64)
    for low, high, seed in _classes(least, int(sizes.max(initial=0))):
        useful = (own >= max(least, 2 * low)) & (everywhere + seed <= ends)
        at, lag = _pairs(sums, ends, everywhere[useful], seed, low, high, known)
        if not len(at):
            continue
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        goes_on = (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + seed) & (ends[at[1:]] == ends[at[:-1]])
        heads = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        left, right = at[heads], at[np.concatenate([heads[1:], [len(at)]]) - 1] + seed
        lag, begin, end = lag[heads], begins[left], ends[left]
        most = np.full(len(left), seed - 1)
        left = left - _border(sums, left, lag, np.minimum(most, left - begin), -1)
        right = right + _border(sums, right, lag, np.minimum(most, end - lag - right), 1)
        enough = right - left >= np.maximum(least - lag, lag)
        found = np.stack([left, right - left + lag, lag])[:, enough]
        # The same words with a multiple of their period are no further run.
        both = np.concatenate([known, found], axis=1)
        both = both[:, np.lexsort(both[::-1])]
        fresh = np.concatenate([[True], (both[:2, 1:] != both[:2, :-1]).any(axis=0)])[: both.shape[1]]
        known = both[:, fresh]
    return known[:, np.lexsort((known[2], known[0]))]


def _collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words of ``text`` that no run holds after its first period, joined by one space."""
    words = text.split()
    if runs.shape[1]:
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[0] + runs[2], 1)
        np.add.at(change, runs[0] + runs[1], -1)
        words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, runs, text`` for every row of ``docs (doc_id, text)``.

    ``runs`` are all stretches of consecutive words with a smallest period q and at
    least max(``least``, 2q) words that no neighbouring word extends: their start (from
    0), length and period, by start, then period. Words are what ASCII blanks
    part. ``text`` holds the words outside of runs and the first period of each,
    joined by one space. A NULL text is an empty one, which has no run; rows without
    ``doc_id`` and repeated rows have a row each; other columns are ignored.

    One narrow pass: no shuffle, and a task holds a quarter of a megabyte of texts,
    or one text if that is longer. Words are compared by hashes of 64 bits.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    names = ["doc_id", "runs", "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank, hasher = B.table(B.BLANKS), B.Hasher()
        for batch in parts:
            for at, texts in B.pieces(batch["text"]):
                words = B.find_words(texts, blank)
                found = runs_of(hasher.words(words), words.bounds, hasher.word_powers, least)
                cuts = np.searchsorted(found[0], words.bounds)
                kept = []
                for i, text in enumerate(texts):
                    own = found[:, cuts[i] : cuts[i + 1]]
                    own[0] -= words.bounds[i]
                    kept.append(_collapsed(text, own))
                rows = pa.StructArray.from_arrays([pa.array(x) for x in found], ["start", "length", "period"])
                columns = [
                    batch["doc_id"].slice(at, len(texts)),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, runs {RUNS}, text string")
