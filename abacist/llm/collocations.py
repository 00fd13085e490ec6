"""Phrases whose words stand together more often than chance, from counts of the longest windows only.

Each word of a text opens one window of up to five words, made of columns that lead
by one to four places and padded with NULL where a phrase cannot go on. Only these
windows are counted, and dealt by their first word, so that whoever gets them can sum them
over ever shorter prefixes, which gives the count of every phrase and word and of all words
of a language. What a task counted travels as one row of columns for each language and
group of first words.

A window goes on only while what it holds can be frequent. For this a first pass counts the
words and pairs of all texts, a second one the triples made of frequent pairs, and a third
the fours made of frequent triples, by a hash of ``bits`` bits; what goes back to the
tasks is one bit for each value, 16 MB a pass at any size of the input. What is
below the least count may share its value with others and stay, which costs time
and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.llm import batches as B
from abacist.session import settle

LEAST, LONGEST, TOP, COVERED = 100, 5, 2000, 100
BITS = 27
# The low bits of a pair's value; the others name the range whose bits one row holds.
_LOW = 16
# Values, and words, that a task combines before it sends them on, and windows that it gathers before it sums them.
_VALUES_HELD, _WORDS_HELD, _WINDOWS_HELD = 1 << 20, 1 << 22, 1 << 19
# Groups of first words.
_GROUPS = 256
# Longest phrases that are counted by their hash beforehand.
_COUNTED = 4
# Parts of a language, so that none gathers in one task.
_SALTS = 32

_CUTS, _BLANKS = b".,;:!?\n\v\f\r", b" \t"


class _Reader:
    """Words of texts, lower-cased, with the values of the phrases of up to four words that start at each."""

    def __init__(self, bits: int):
        self.blank, self.cut, self.fold = B.table(_CUTS + _BLANKS), B.table(_CUTS), B.ascii_lower()
        self.hasher, self.bits = B.Hasher(), bits

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(words, a key of each in its language, text of each, whether the next follows in the same piece, values of phrases of each size)."""
        langs = batch["lang_hash"].to_numpy().view(np.uint64)
        for at, texts in B.pieces(batch["text"]):
            words = B.find_words(texts, self.blank, self.fold)
            hashes, text_of = self.hasher.words(words), words.text_of()
            cuts = np.zeros(len(words.buffer) + 1, np.int32)
            np.cumsum(self.cut[words.buffer], out=cuts[1:])
            follows = (text_of[1:] == text_of[:-1]) & (cuts[words.starts[1:]] == cuts[words.ends[:-1]])
            follows = np.concatenate([follows, [False]])[: len(hashes)]
            keys = mixed = B.mix(hashes + langs[at + text_of])
            values = []
            for k in range(_COUNTED):
                values.append((mixed >> np.uint64(64 - self.bits)).astype(np.int64))
                mixed = B.mix(mixed * np.uint64(B._ODD) + _ahead(hashes, k + 1))
            yield words, keys, at + text_of, follows, values


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """``x`` moved ``k`` places to the left, with zeros at the end."""
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


class _Bits:
    """Which values are frequent."""

    def __init__(self, *bitmaps: bytes):
        self.maps = [np.frombuffer(m, np.uint8) for m in bitmaps]

    def of(self, number: int, values: np.ndarray) -> np.ndarray:
        return (self.maps[number][values >> 3] >> (values & 7).astype(np.uint8)) & 1 > 0

    def spans(self, follows: np.ndarray, values: list[np.ndarray], longest: int) -> Iterator[np.ndarray]:
        """For each size from 1 to ``longest``, where a phrase starts that can be frequent as far as is known."""
        here = self.of(0, values[0])
        yield here
        here = follows & here & _ahead(here, 1) & self.of(0, values[1])
        yield here
        for k in range(3, longest + 1):
            here = here & _ahead(here, 1)
            if k - 2 < len(self.maps):
                here &= self.of(k - 2, values[k - 1])
            yield here


def _packed(values: np.ndarray) -> pa.RecordBatch:
    """Distinct ``values`` with their counts, a row for each range."""
    found, counts = np.unique(values, return_counts=True)
    part = (found >> _LOW).astype(np.int32)
    at, starts = np.unique(part, return_index=True)
    low = (found & ((1 << _LOW) - 1)).astype("<u2")
    ends = [*starts[1:], len(found)]
    rows = [low[a:b].tobytes() + counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows, pa.binary())], ["part", "data"])


def _frequent(docs: DataFrame, least: int, bits: int, known: list[Broadcast]) -> Broadcast:
    """A bit for each value: whether phrases with it number ``least`` together.

    Without ``known`` these are words and pairs, else phrases of one word more than
    what is known, made of such that can be frequent.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, n = _Reader(bits), [], 0
        frequent, size = _Bits(*[x.value for x in known]), len(known) + 2
        for batch in parts:
            for _, _, _, follows, values in reader.read(batch):
                if size == 2:
                    held += [values[0], values[1][follows]]
                else:
                    *_, there = frequent.spans(follows, values, size)
                    held.append(values[size - 1][there])
                n += len(follows)
                if n >= _VALUES_HELD:
                    yield _packed(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield _packed(np.concatenate(held))

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            for part, data in zip(batch["part"].to_pylist(), batch["data"]):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                n = len(raw) // 6
                counts = np.ascontiguousarray(raw[2 * n :].reshape(4, n).T).view("<u4").ravel()
                held = sums.setdefault(part, np.zeros(1 << _LOW, np.uint32))
                at = raw[: 2 * n].view("<u2")
                held[at] = np.minimum(held[at] + counts, least)  # enough is enough, so no sum overflows
        for part, held in sums.items():
            bits_of = np.packbits(held >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits_of], pa.binary())], ["part", "data"])

    schema = "part int, data binary"
    found = docs.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    size = 1 << (_LOW - 3)
    bitmap = bytearray(max(size, 1 << (bits - 3)))
    for row in found.toLocalIterator():
        bitmap[row.part * size : (row.part + 1) * size] = row.data
    return docs.sparkSession.sparkContext.broadcast(bytes(bitmap))


class _Held:
    """Words of neighbouring texts as numbers, one for each language and word, and how far a window goes from each."""

    def __init__(self, longest: int):
        self.longest, self.numbers, self.spelled, self.lang_of = longest, {}, [], []
        self.words, self.reach, self.n, self.rare = [], [], 0, {}

    def add(self, words: B.Words, keys: np.ndarray, langs: np.ndarray, reach: np.ndarray) -> None:
        """``keys`` tell languages and words apart; ``reach`` is the number of words of each word's window, 0 for rare words."""
        use = np.flatnonzero(reach)
        known, first, at = np.unique(keys[use], return_index=True, return_inverse=True)
        numbers, before = self.numbers, len(self.numbers)
        own = np.fromiter((numbers.setdefault(h, len(numbers)) for h in known.tolist()), np.int32, len(known))
        fresh = use[first[own >= before]]
        buffer = words.buffer.tobytes()
        self.spelled += [buffer[a:b] for a, b in zip(words.starts[fresh].tolist(), words.ends[fresh].tolist())]
        self.lang_of += langs[fresh].tolist()
        for lang, n in zip(*(x.tolist() for x in np.unique(langs[reach == 0], return_counts=True))):
            self.rare[lang] = self.rare.get(lang, 0) + n
        number = np.zeros(len(keys), np.int32)
        number[use] = own[at]
        self.words.append(number)
        self.reach.append(reach)
        self.n += len(keys)

    def windows(self, names: pa.Array) -> pa.RecordBatch:
        """Distinct windows with their numbers of times, in a row for each language and group; ``names`` are the languages."""
        words, reach = np.concatenate(self.words), np.concatenate(self.reach)
        spelled, lang_of = pa.array(self.spelled, pa.binary()).cast(pa.string()), np.array(self.lang_of, np.int64)
        group_of = np.fromiter(self.numbers, np.uint64, len(self.numbers)).astype(np.int64) & (_GROUPS - 1)
        rows = []  # language, group, words (-1 where there is none), times

        def add(lang: np.ndarray, group: np.ndarray, said: list[np.ndarray], n: np.ndarray) -> None:
            none = [np.full(len(n), -1, np.int32)] * (self.longest - len(said))
            rows.append([lang, group, *said, *none, n])

        rare = np.array([*self.rare], np.int64)
        add(rare, np.zeros(len(rare), np.int64), [], np.array([*self.rare.values()], np.int64))
        single = np.bincount(words[reach == 1], minlength=len(spelled))
        alone = np.flatnonzero(single)
        add(lang_of[alone], group_of[alone], [alone.astype(np.int32)], single[alone])
        at = np.flatnonzero(reach > 1)
        key = words[at].astype(np.int64)
        for k in range(2, self.longest + 1):
            # Windows that reach k words, by the number of what they say so far.
            key = np.unique(key * len(spelled) + words[at + k - 1], return_inverse=True)[1]
            ends = reach[at] == k
            _, first, n = np.unique(key[ends], return_index=True, return_counts=True)
            start = at[ends][first]
            add(lang_of[words[start]], group_of[words[start]], [words[start + j] for j in range(k)], n)
            key, at = key[~ends], at[~ends]
        lang, group, *said, n = map(np.concatenate, zip(*rows))
        order = np.argsort(lang * _GROUPS + group, kind="stable")
        place = (lang * _GROUPS + group)[order]
        found, starts = np.unique(place, return_index=True)
        offsets = pa.array(np.append(starts, len(place)), pa.int32())
        columns = [spelled.take(pa.array(w[order], mask=w[order] < 0)) for w in said] + [pa.array(n[order].astype(np.int64))]
        columns = [pa.ListArray.from_arrays(offsets, c) for c in columns]
        at = [names.take(pa.array(found // _GROUPS)), pa.array((found % _GROUPS).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*at, *columns], ["lang", "part", *_columns(self.longest), "n"])


def _columns(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def _windows(docs: DataFrame, known: list[Broadcast], longest: int, bits: int) -> DataFrame:
    """``lang, part, w1 ... , n``: distinct longest windows of what a task held at once, in arrays of equal length."""
    schema = "lang string, part int, " + ", ".join(f"{c} array<string>" for c in _columns(longest)) + ", n array<long>"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, frequent = _Reader(bits), _Bits(*[x.value for x in known])
        held, langs = _Held(longest), {}
        for batch in parts:
            own = batch["lang"].dictionary_encode()
            number = np.array([langs.setdefault(x, len(langs)) for x in own.dictionary.to_pylist()], np.int64)
            lang_of = number[own.indices.to_numpy()]
            for words, keys, text_of, follows, values in reader.read(batch):
                reach = np.zeros(len(follows), np.int8)
                for there in frequent.spans(follows, values, longest):
                    reach += there
                held.add(words, keys, lang_of[text_of], reach)
                if held.n >= _WORDS_HELD:
                    yield held.windows(pa.array(list(langs), pa.string()))
                    held = _Held(longest)
        if held.n:
            yield held.windows(pa.array(list(langs), pa.string()))

    return docs.mapInArrow(run, schema)


def _summed(tables: list[pa.Table], by: list[str]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(by, use_threads=False).aggregate([("n", "sum")])
    return sums.rename_columns([*by, "n"])


def _prefixes(windows: DataFrame, least: int, longest: int) -> DataFrame:
    """``lang, phrase, f``: of ``windows`` dealt by ``part`` every prefix that is there ``least`` times, and how often the empty one is in each task."""
    columns = _columns(longest)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, _WINDOWS_HELD
        for batch in parts:
            # Columns in the order in which sums have them.
            lang = batch["lang"].take(batch["n"].value_parent_indices())
            held.append(pa.table({"lang": lang} | {c: batch[c].flatten() for c in [*columns, "n"]}))
            n += len(lang)
            if n >= most:
                held = [_summed(held, ["lang", *columns])]
                n = len(held[0])
                most = max(_WINDOWS_HELD, 2 * n)
        for size in range(longest, -1, -1) if held else ():
            by = columns[:size]
            held = [_summed(held, ["lang", *by])]
            there = pc.greater_equal(held[0]["n"], least) if size else pc.is_valid(held[0]["n"])
            if size:
                there = pc.and_(there, pc.is_valid(held[0][by[-1]]))
            found = held[0].filter(there)
            for rows in found.to_batches():
                phrase = pc.binary_join_element_wise(*[rows[c] for c in by], " ") if size else pa.array([""] * len(rows))
                yield pa.RecordBatch.from_arrays([rows["lang"], phrase, rows["n"]], ["lang", "phrase", "f"])

    return windows.repartition("part").mapInArrow(run, "lang string, phrase string, f long")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """``lang, words, phrase, f``: every phrase of up to ``longest`` words found ``least`` times, and a row of no words with the count of all.

    ``docs`` has ``text`` and ``lang``; a NULL language is ``und``, a NULL text empty.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    docs = docs.withColumn("lang_hash", F.xxhash64("lang"))
    columns = _columns(longest)
    known = []
    for _ in range(2, min(longest, _COUNTED) + 1):
        known.append(_frequent(docs, least, bits, known))
    found = _prefixes(_windows(docs, known, longest, bits), least, longest)
    # A phrase comes from one task, the number of all words from each.
    sums = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " ")).alias("words")
    return sums.select("lang", words, "phrase", "f")


def mine(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, bits: int = BITS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score.

    A phrase of 2 to ``longest`` words that stands ``a`` >= ``least`` times in the pieces
    of texts scores floor(1000 a n / (l r)), where ``n`` counts all words of its
    language, ``l`` and ``r`` its two parts at the cut that scores lowest (of equal ones the
    first). One whose words stand inside a longer phrase with at least ``covered`` per cent
    of its count goes. Texts are lower-cased in A-Z, cut into pieces at
    ``.,;:!?`` and line ends, and into words at spaces and tabs. NULL and empty texts
    have no words, repeated rows count each time, a NULL language is ``und``; ``doc_id``
    and other columns are ignored. Languages without such a phrase have no row.

    Words are compared by 64-bit hashes inside a task and by their letters elsewhere. Products
    are decimals of 38 digits: exact while ``a`` and ``n`` have 17 digits.
    """
    known = settle(phrases(docs, least, longest, bits), "phrases")
    totals = known.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    found = known.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    parts = known.filter(F.size("words") > 0)

    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")
    cuts = found.select("lang", "words", "phrase", "a", cut)
    left = F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ")
    right = F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ")
    cuts = cuts.withColumns({"left": left, "right": right}).drop("words")
    for side, count in (("left", "l"), ("right", "r")):
        counts = parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cuts = cuts.join(counts, ["lang", side]).drop(side)
    digits = lambda c, n=17: F.col(c).cast(f"decimal({n},0)")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int").alias("salt")
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    cuts = cuts.select("*", salt).join(totals, ["lang", "salt"]).withColumns(
        {"upper": F.lit(1000).cast("decimal(4,0)") * digits("a") * digits("n"), "lower": digits("l", 19) * digits("r", 19)}
    )
    cuts = cuts.withColumn("score", F.expr("upper div lower"))
    lowest = F.min(F.struct("score", "cut", "l", "r", "n")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)

    spans = [(i, k) for k in range(2, longest) for i in range(1, longest - k + 2)]
    inside = F.array(
        *[F.when(F.size("words") >= F.lit(max(i + k - 1, k + 1)), F.array_join(F.slice("words", i, k), " ")) for i, k in spans]
    ) if spans else F.array().cast("array<string>")
    longer = found.filter(F.size("words") > 2).select("lang", F.explode(F.array_compact(inside)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    )
    order = [F.desc("best.score"), F.desc("a"), "phrase"]
    # The first of each part of a language, then of these, so no task gets more than the parts' reports.
    ranked = free.select("*", salt)
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = ranked.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", *[f"best.{c}" for c in ("l", "r", "n", "score")])
