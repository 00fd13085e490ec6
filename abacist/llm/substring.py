"""Substring deduplication: seeds on winnowed anchors, grown to maximal repeated stretches.

A window is ``length`` consecutive words. Each window has one anchor, the
smallest hash among its short word sequences, so equal windows have equal
anchors at equal places. Neighbouring windows with one anchor form a span.
Documents meet on anchors, never on all windows:

1. a row for each span: anchor, hash of all words of the span, place;
2. of equal spans all but the first are repeats as a whole;
3. where one anchor stands in different spans (at the ends of a repeat), the
   windows of one span of each sort are compared one by one;
4. repeated windows that overlap or touch join into maximal stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abacist.llm import batches as B
from abacist.session import settle

ANCHOR_WORDS = 5
# A place is one long: first word (32 bits), a tag of the text (20), number of windows (11).
_TAG_BITS, _COUNT_BITS = 20, 11
_COUNT = (1 << _COUNT_BITS) - 1
_TAG = (1 << _TAG_BITS) - 1
_LAST = (1 << 63) - 1
# Numbers for rows without an id: the last 2**40.
_UNNAMED = (1 << 40) - 1
_ROW = "k1 long, k2 long, id long, place long, sure boolean"
_FOUND = "id long, place long, repeat boolean"


def _tags(sums: B.Sums, words: B.Words) -> np.ndarray:
    """A few bits of each text's content; they tell apart texts that share an id."""
    return sums.of(words.text_starts[:-1], words.text_starts[1:] - 1) & np.uint64(_TAG)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (the first of equal ones) in each stretch of ``width``."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def _owners(hashes: B.Sums, words: B.Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and anchor hash of every window, and the anchor's place."""
    total = len(words.starts)
    ends_at = np.repeat(words.bounds[1:], np.diff(words.bounds))
    starts = np.flatnonzero(np.arange(total) + length <= ends_at)
    if not len(starts):
        return starts, starts.astype(np.uint64), starts
    short = np.arange(total - ANCHOR_WORDS + 1)
    seeds = hashes.of(short, short + ANCHOR_WORDS)
    anchor = _lowest(seeds, length - ANCHOR_WORDS + 1)[starts]
    return starts, seeds[anchor], anchor


def _spans(words: B.Words, hasher: B.Hasher, length: int):
    """Anchor hash, span hash, text, first word in the text, number of windows, and the tags."""
    letters = hasher.bytes_sums(words.buffer)
    hashes = hasher.word_sums(letters.of(words.starts, words.ends))
    starts, seed, anchor = _owners(hashes, words, length)
    text = words.text_of()[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    whole = hashes.of(begin, begin + count + length - 1) if len(first) else begin.astype(np.uint64)
    return seed[first], whole, text[first], begin - words.bounds[text[first]], count, _tags(letters, words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
        [n.split()[0] for n in names.split(", ")],
    )


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch["id"].to_numpy(zero_copy_only=False)


def _same_start(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shift = np.uint64(_TAG_BITS + _COUNT_BITS)
    return a.view(np.uint64) >> shift == b.view(np.uint64) >> shift


def _combined(k1: np.ndarray, k2: np.ndarray, own: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch, before the shuffle: all but the first of a ``(k1, k2)`` are sure repeats.

    Rows that share id and start are one stretch of one id; neither is earlier.
    """
    order = np.lexsort((place, own, k2, k1))
    k1, k2, own, place = k1[order], k2[order], own[order], place[order]
    again = np.zeros(len(k1), bool)
    again[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(k1))))
    sure = again & ~((own == own[first]) & _same_start(place, place[first]))
    k1 = np.where(sure, B.mix(place ^ own.astype(np.uint64)), k1)
    k2 = np.where(sure, np.uint64(0), k2)
    return _record(_ROW, _signed(k1), _signed(k2), own, _signed(place), sure)


def _span_rows(docs: DataFrame, length: int) -> DataFrame:
    """Spans of all texts; within a batch only the first of equal ones, the others are ``sure`` repeats.

    A sure row keeps its place only and is dealt out by it.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank, hasher = B.table(B.BLANKS), B.Hasher()
        for batch in parts:
            ids, rows = _ids(batch), []
            for at, texts in B.pieces(batch["text"]):
                words = B.find_words(texts, blank)
                seed, whole, text, begin, count, tags = _spans(words, hasher, length)
                place = (begin.astype(np.uint64) << np.uint64(_TAG_BITS + _COUNT_BITS)) | (
                    tags[text] << np.uint64(_COUNT_BITS)
                ) | count.astype(np.uint64)
                rows.append((seed, whole, ids[at + text], place))
            if not rows:
                continue
            yield _combined(*map(np.concatenate, zip(*rows)))

    return docs.mapInArrow(run, _ROW)


def _judge(rows: DataFrame) -> DataFrame:
    """``id, place, repeat`` of rows sorted by ``k1, k2, id, place``, in one pass that holds one batch.

    ``repeat``: not the first of its ``(k1, k2)``. The first ones come out too, as
    not repeated, where their ``k1`` has more than one ``k2``; the others are left out.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Carried over: the key at hand, its first place, and a lone first row not yet given out.
        last, lone = None, None
        for batch in parts:
            n = len(batch)
            if not n:
                continue
            k1, k2, own, place = (batch[c].to_numpy() for c in ("k1", "k2", "id", "place"))
            sure = batch["sure"].to_numpy(zero_copy_only=False)
            new1, new2 = np.ones(n, bool), np.ones(n, bool)
            new1[1:] = (k1[1:] != k1[:-1]) | sure[1:] | sure[:-1]
            new2[1:] = new1[1:] | (k2[1:] != k2[:-1])
            goes_on = last is not None and not sure[0] and k1[0] == last[0]
            if goes_on:
                new1[0], new2[0] = False, k2[0] != last[1]
            at = np.maximum.accumulate(np.where(new2, np.arange(n), -1))
            held = at < 0
            first_id = np.where(held, last[2] if last else 0, own[at])
            first_place = np.where(held, last[3] if last else 0, place[at])
            repeat = ~new2 & ~((own == first_id) & _same_start(place, first_place))
            # A first row is of interest when another k2 of its k1 follows or went before.
            later = new2 & ~new1
            group = np.cumsum(new1)
            firsts = np.flatnonzero(new2 & ~sure)
            several = np.zeros(group[-1] + 1, bool)
            several[group[later]] = True
            if goes_on and last[4]:
                several[0] = True
            give = np.zeros(n, bool)
            give[firsts] = several[group[firsts]]
            out_id, out_place, out_flag = [own[give]], [place[give]], [np.zeros(give.sum(), bool)]
            if lone is not None and goes_on and several[0]:
                out_id.append([lone[0]]), out_place.append([lone[1]]), out_flag.append([False])
                lone = None
            elif lone is not None and (not goes_on or group[-1] > 0):
                lone = None
            hit = repeat | sure
            out_id.append(own[hit]), out_place.append(place[hit]), out_flag.append(np.ones(hit.sum(), bool))
            end = n - 1
            if sure[end]:
                last, lone = None, None
            else:
                g = group[end]
                seen = bool(several[g])
                if not seen:
                    mine = firsts[group[firsts] == g]
                    if len(mine):
                        lone = (own[mine[0]], place[mine[0]])
                last = (k1[end], k2[end], first_id[end], first_place[end], seen)
            ids, places, flags = map(np.concatenate, (out_id, out_place, out_flag))
            yield _record(_FOUND, ids.astype(np.int64), places.astype(np.int64), flags)

    return rows.mapInArrow(run, _FOUND)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("k1").sortWithinPartitions("k1", "sure", "k2", "id", "place")


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``docs (id, text, ...)`` with the sorted ``places`` of their id."""
    listed = places.groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return docs.join(listed, "id", "left")


def _unpack(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = places.view(np.uint64)
    shift = np.uint64(_TAG_BITS + _COUNT_BITS)
    return (
        (p >> shift).astype(np.int64),
        (p >> np.uint64(_COUNT_BITS)) & np.uint64(_TAG),
        (p & np.uint64(_COUNT)).astype(np.int64),
    )


def _places_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All places of a batch in one array, and where each row's begin."""
    lists = batch["places"]
    sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def _window_rows(docs: DataFrame, length: int) -> DataFrame:
    """A row for each window of the spans in ``places``; its place is one window long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank, hasher = B.table(B.BLANKS), B.Hasher()
        for batch in parts:
            ids = _ids(batch)
            places, begins = _places_of(batch)
            for at, texts in B.pieces(batch["text"]):
                words = B.find_words(texts, blank)
                letters = hasher.bytes_sums(words.buffer)
                hashes = hasher.word_sums(letters.of(words.starts, words.ends))
                mine = places[begins[at] : begins[at + len(texts)]]
                text = np.repeat(np.arange(len(texts)), np.diff(begins[at : at + len(texts) + 1]))
                begin, tag, count = _unpack(mine)
                fits = tag == _tags(letters, words)[text]
                begin, tag, count, text = begin[fits], tag[fits], count[fits], text[fits]
                start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text, tag = np.repeat(text, count), np.repeat(tag, count)
                where = words.bounds[text] + start
                key = hashes.of(where, where + length)
                place = (start.astype(np.uint64) << np.uint64(_TAG_BITS + _COUNT_BITS)) | (
                    tag << np.uint64(_COUNT_BITS)
                ) | np.uint64(1)
                yield _combined(key, np.zeros_like(key), ids[at + text], place)

    return docs.mapInArrow(run, _ROW)


def repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """``id, place``: stretches of words to remove, from ``docs (id, text)``; ``id`` is not NULL."""
    if not ANCHOR_WORDS <= length < _COUNT:
        raise ValueError(f"a repeat has {ANCHOR_WORDS} to {_COUNT - 1} words")
    spans = settle(_judge(_sorted(_span_rows(docs, length))), "repeat-spans")
    unclear = spans.filter("not repeat")
    asked = _with_places(docs, unclear).filter("places is not null")
    windows = _judge(_sorted(_window_rows(asked, length)))
    return spans.filter("repeat").select("id", "place").union(windows.filter("repeat").select("id", "place"))


def _covered(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, list[bytes], B.Words, np.ndarray]]:
    """Pieces of a batch with a flag for each word: whether a repeated window covers it."""
    blank, hasher = B.table(B.BLANKS), B.Hasher()
    places, begins = _places_of(batch)
    for at, texts in B.pieces(batch["text"]):
        words = B.find_words(texts, blank)
        mine = places[begins[at] : begins[at + len(texts)]]
        text = np.repeat(np.arange(len(texts)), np.diff(begins[at : at + len(texts) + 1]))
        begin, tag, count = _unpack(mine)
        depth = np.zeros(len(words.starts) + 1, np.int64)
        if len(mine):
            fits = tag == _tags(hasher.bytes_sums(words.buffer), words)[text]
            begin, count, text = begin[fits], count[fits], text[fits]
            where = words.bounds[text] + begin
            np.add.at(depth, where, 1)
            np.add.at(depth, where + count + length - 1, -1)
        yield at, texts, words, np.cumsum(depth)[:-1] > 0


def _cut(text: bytes, starts: list[int], ends: list[int], gone: list[bool]) -> bytes:
    """``text`` without its words that are ``gone`` and the blanks before them."""
    kept, at = [], 0
    for i, (s, e, out) in enumerate(zip(starts, ends, gone)):
        if out:
            if i and not gone[i - 1]:
                kept.append(text[at : ends[i - 1]])
            at = e
        elif i and gone[i - 1]:
            at = s if not kept else ends[i - 1]
    if starts and not gone[-1]:
        kept.append(text[at:])
    elif not starts:
        kept.append(text)
    return b"".join(kept)


def document_id(docs: DataFrame) -> Column:
    """``doc_id``; where it is NULL a number of the text among the largest ones, so that such rows share no key."""
    unnamed = F.lit(_LAST) - F.xxhash64("text").bitwiseAND(F.lit(_UNNAMED))
    return F.coalesce(F.col("doc_id").cast("long"), unnamed)


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """``docs`` with ``text`` cut and ``n_words, n_removed`` added: all words that no repeated window covers.

    A window of ``length`` words is repeated when its words also start earlier:
    in a smaller ``doc_id``, or in the same document further up. Windows are
    judged on the texts as given. Blanks before a removed word go with it; a
    text that loses nothing stays as it is, to the byte. A NULL text has no
    words and stays NULL. Rows without ``doc_id`` come after all others, in an order of
    their texts' hashes; equal ones are one document.
    Rows that repeat an id are placed by it alone, so of equal texts with one id
    none is earlier. A text that loses all its words becomes empty; its row stays.
    An ``n_words`` or ``n_removed`` that ``docs`` has already is replaced.
    """
    added = ("n_words", "n_removed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*added, "text")]).alias("row")
    keyed = docs.select(document_id(docs).alias("id"), "text", row)
    found = _with_places(keyed, repeats(keyed.select("id", "text"), length))
    out = StructType().add("row", keyed.schema["row"].dataType).add("text", "string")
    out = out.add("n_words", "long").add("n_removed", "long")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at, texts, words, gone in _covered(batch, length):
                n = np.diff(words.bounds)
                lost = B.per_text(gone, words.bounds)
                for i in np.flatnonzero(lost):
                    mine = slice(words.bounds[i], words.bounds[i + 1])
                    base = words.text_starts[i]
                    spans = ((words.starts[mine] - base).tolist(), (words.ends[mine] - base).tolist())
                    texts[i] = _cut(texts[i], *spans, gone[mine].tolist())
                given = batch["text"][at : at + len(texts)].is_null().to_numpy(zero_copy_only=False)
                text = pa.array(texts, pa.binary(), mask=given).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch["row"][at : at + len(texts)], text, pa.array(n), pa.array(lost)],
                    ["row", "text", "n_words", "n_removed"],
                )

    return found.select("text", "row", "places").mapInArrow(run, out).select("row.*", "text", *added)


def deduplicated(docs: DataFrame, length: int = 20) -> DataFrame:
    """:func:`remove_repeats` with the columns of ``docs``; ``n_chars``, where there is one, follows the text."""
    clean = remove_repeats(docs, length)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", size)
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
