"""Best-two-fit packing of documents into token sequences of one length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abacist.llm.tokens import slices, word_encoder
from abacist.session import settle

# Pieces that one task packs together. Each task leaves at most about one
# sequence partly filled for want of pieces, so a task wastes less than 0.01 %.
GROUP_PIECES = 50_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs (doc_id, text)``, with the ids if ``ids``.

    A document is its text's token ids and ``end_id``; NULL is an empty text. One
    longer than ``length`` is cut into pieces of that length, the last may be
    shorter. Rows without ``doc_id`` and rows that repeat one are documents too.
    """
    make = word_encoder(docs.sparkSession, tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    schema = _PIECE + (", ids binary" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            own = batch["doc_id"]
            for at, texts in slices(batch["text"]):
                found, bounds = encoder.texts(texts)
                raw, bounds = found.tobytes(), (4 * bounds).tolist()
                row, number, size, crc, parts = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    whole = raw[a:b] + end
                    for n, begin in enumerate(range(0, len(whole), step)):
                        part = whole[begin : begin + step]
                        row.append(at + i), number.append(n), size.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if ids:
                            parts.append(part)
                columns = [
                    own.take(pa.array(row)),
                    pa.array(number, pa.int32()),
                    pa.array(np.array(number, np.int64) * length),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.binary())] if ids else []), names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class _Stock:
    """Unpacked pieces by length, and the largest length present up to any size."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        order = np.argsort(lengths, kind="stable")
        self.by_length = np.split(order, np.searchsorted(lengths[order], np.arange(1, capacity + 1)))
        self.left = np.array([len(x) for x in self.by_length])
        self._refresh(0)

    def _refresh(self, length: int) -> None:
        """Recompute the floors of ``length`` and of the sizes above it, up to the next length present."""
        present = self.left > 0
        size = len(self.left)
        if not hasattr(self, "floor"):
            self.floor = np.maximum.accumulate(np.where(present, np.arange(size), 0))
            return
        above = np.flatnonzero(present[length + 1 :])
        stop = length + 1 + above[0] if len(above) else size
        self.floor[length:stop] = length if present[length] else self.floor[length - 1]

    def take(self, length: int) -> int:
        self.left[length] -= 1
        if not self.left[length]:
            self._refresh(length)
        return int(self.by_length[length][self.left[length]])

    def put_back(self, length: int) -> None:
        self.left[length] += 1
        if self.left[length] == 1:
            self._refresh(length)

    def two(self, room: int) -> tuple[int, int]:
        """Two lengths of different pieces with the largest sum up to ``room``; (0, 0) if there are none."""
        first = np.flatnonzero(self.left[: room // 2 + 1])
        if not len(first):
            return 0, 0
        second = self.floor[room - first]
        alone = (second == first) & (self.left[first] < 2)
        second = np.where(second < first, 0, second)
        second[alone] = 0
        sums = np.where(second > 0, first + second, 0)
        best = int(np.argmax(sums))
        return (int(first[best]), int(second[best])) if sums[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each of ``lengths`` (1 to ``capacity``).

    Sequences are filled one after the other, each time with the largest piece
    that fits. When none fits the gap, the sequence's smallest piece is put back
    if two unpacked ones fill the gap and its place better.
    """
    stock = _Stock(lengths, capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while stock.floor[capacity]:
        room, held = capacity, []
        while room and (fit := int(stock.floor[room])):
            held.append((stock.take(fit), fit))
            room -= fit
        while room and held:
            piece, small = held[-1]
            a, b = stock.two(room + small)
            if a + b <= small:
                break
            held.pop()
            held += [(stock.take(b), b), (stock.take(a), a)]
            stock.put_back(small)
            stock.by_length[small][stock.left[small] - 1] = piece
            room += small - a - b
            held.sort(key=lambda x: -x[1])
        at = 0
        for piece, size in held:
            sequence[piece], offset[piece] = number, at
            at += size
        number += 1
    return sequence, offset


def pack(parts: DataFrame, length: int = 4096, group: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (as from :func:`cut`) with ``sequence_id`` and ``offset``.

    Pieces are dealt by their row number in the stored table into groups of about
    ``group``, each packed by one task; no key is involved, so none can be hot.
    """
    stored = settle(parts, "pieces")
    groups = max(1, math.ceil(stored.count() / group))
    dealt = stored.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = StructType(stored.schema.fields).add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").drop(columns="part")
        sequence, offset = best_two_fit(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return dealt.groupBy("part").applyInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, document_lengths``: the sequences themselves, from pieces cut with their ids."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(placed.alias("held"))
    return whole.select(
        "sequence_id",
        F.expr("aggregate(held, X'', (all, x) -> concat(all, x.ids))").alias("ids"),
        F.col("held.length").alias("document_lengths"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 4096) -> DataFrame:
    """Cut and pack ``docs``; one row per piece with its place, no ids."""
    return pack(cut(docs, tokenizer, end_id, length), length)
