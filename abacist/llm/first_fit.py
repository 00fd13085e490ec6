"""First-fit-decreasing packing of token sequences with a tournament tree, group by group.

Documents are dealt at random into groups of a bounded size. In a group the pieces go,
longest first, each into the first sequence with room for it, which a tournament
tree over the sequences' free room finds in logarithmic time. What stays free after that
is closed by cutting the pieces of the emptiest sequences, and the tokens left over
then stand in sequences whose lengths are powers of two, which take no padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.byte_tokens import byte_encoder
from abacist.llm.tokens import slices
from abacist.session import settle

# Pieces in a group, each shorter than a sequence: at most 2 bytes x 2048 x 8192 = 32 MB.
GROUP_PIECES = 8192
# Bytes of text that are encoded at once.
SLICE_BYTES = 2 << 20
_PIECE = "doc_id long, doc_tokens long, start long, length long, ids binary"
_PLACE = "sequence_id long, offset long"


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """``doc_id, doc_tokens, start, length, ids`` of ``docs (doc_id, text)``: pieces of ``length`` and a shorter last one.

    ``ids`` are little-endian, 16 bits each where the vocabulary allows and 32 otherwise.
    A document is its text's ids and ``end_id``; a NULL text is an empty one. Rows
    without ``doc_id`` and rows that repeat one are documents too.
    """
    make, kind = byte_encoder(docs.sparkSession, tokenizer), id_type(tokenizer)
    names = [c.split()[0] for c in _PIECE.split(", ")]
    width = np.dtype(kind).itemsize
    step = length * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for at, texts in slices(batch["text"], SLICE_BYTES):
                found, bounds = encoder.texts(texts)
                raw, bounds = found.astype(kind).tobytes(), (bounds * width).tolist()
                row, whole, start, parts = [], [], [], []
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    document = raw[a:b] + end
                    for begin in range(0, len(document), step):
                        row.append(at + i), whole.append(len(document) // width), start.append(begin // width)
                        parts.append(document[begin : begin + step])
                sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
                held = [whole, start, sizes]
                columns = [batch["doc_id"].take(pa.array(row)), *[pa.array(x, pa.int64()) for x in held]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE)


def id_type(tokenizer: str) -> str:
    """How ids are stored, by the size of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


class Tournament:
    """Free room of sequences as the leaves of a tree whose inner nodes hold the larger of two rooms."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first sequence with room for it; its number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        at //= 2
        while at:
            larger = max(room[2 * at], room[2 * at + 1])
            if room[at] == larger:
                break
            room[at] = larger
            at //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of each of ``sizes`` (1 to ``capacity``); equal sizes keep their order."""
    tree = Tournament(len(sizes), capacity)
    found = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        found[i] = tree.place(int(sizes[i]))
    return found


def powers_of_two(n: int) -> list[int]:
    """The powers of two whose sum is ``n``, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def arrange(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(piece, start, length, sequence, offset)`` of every part of the pieces of ``sizes`` (1 to ``capacity``).

    The fullest sequences of the first fit stay, as many as the tokens can fill. The
    others are poured out: their pieces close the gaps, cut where a gap ends, and
    what remains makes sequences of powers of two. No sequence needs padding if
    ``capacity`` is such a power.
    """
    where = first_fit_decreasing(sizes, capacity)
    filled = np.bincount(where, sizes, minlength=1).astype(np.int64)
    total = int(sizes.sum())
    order = np.argsort(-filled, kind="stable")
    stay = order[: total // capacity]
    number = np.full(len(filled), -1)
    number[stay] = np.arange(len(stay))
    parts, used = [], [0] * len(stay)
    poured = []
    for piece in np.lexsort((-sizes, where)).tolist():
        size, to = int(sizes[piece]), int(number[where[piece]])
        if to < 0:
            poured.append((piece, size))
        else:
            parts.append((piece, 0, size, to, used[to]))
            used[to] += size
    gaps = [(i, u, capacity - u) for i, u in enumerate(used) if u < capacity]
    gaps += [(len(stay) + i, 0, p) for i, p in enumerate(powers_of_two(total % capacity))]
    gaps.reverse()
    for piece, size in poured:
        start = 0
        while start < size:
            to, at, room = gaps.pop()
            n = min(room, size - start)
            parts.append((piece, start, n, to, at))
            start += n
            if n < room:
                gaps.append((to, at + n, room - n))
    return parts


def pack(parts: DataFrame, length: int = 2048, group: int = GROUP_PIECES, width: int = 2) -> DataFrame:
    """Pieces as from :func:`cut` with ``sequence_id`` and ``offset``, cut once more where a gap needs it.

    Pieces of the full ``length`` are sequences as they are. The others are dealt by a
    hash of their row number in the stored table into groups of about ``group``, each
    packed by one task; no key is involved, so none can be hot, and no group grows
    with the input. ``width`` is the number of bytes of an id. Sequence numbers are
    distinct and have no other meaning. Which pieces share a sequence depends on the
    order of the rows as stored, what each piece holds does not.
    """
    stored = settle(parts, "first-fit-pieces")
    short = stored.filter(F.col("length") < length)
    groups = max(1, math.ceil(short.count() / group))
    schema = f"{_PIECE}, {_PLACE}"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["part"]).sort_by([(c, "ascending") for c in ("doc_id", "start", "ids")])
        placed = arrange(rows["length"].to_numpy(), length)
        piece, start, size, sequence, offset = np.array(placed, np.int64).reshape(-1, 5).T
        ids = rows["ids"].combine_chunks()
        pairs = zip(piece.tolist(), (start * width).tolist(), ((start + size) * width).tolist())
        held = [ids[p].as_py()[a:b] for p, a, b in pairs]
        taken = rows.take(pa.array(piece))
        columns = [
            taken["doc_id"], taken["doc_tokens"], pa.array(taken["start"].to_numpy() + start), pa.array(size),
            pa.array(held, pa.binary()), pa.array((key[0].as_py() << 32) + sequence), pa.array(offset),
        ]
        return pa.table(columns, [c.split()[0] for c in schema.split(", ")])

    number = F.monotonically_increasing_id()
    dealt = short.withColumn("part", F.pmod(F.xxhash64(number), F.lit(groups)))
    full = stored.filter(F.col("length") >= length)
    full = full.withColumns({"sequence_id": -1 - number, "offset": F.lit(0).cast("long")})
    return full.unionByName(dealt.groupBy("part").applyInArrow(run, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, part_lengths``: the sequences themselves; each has a bounded number of parts."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(placed.alias("held"))
    return whole.select(
        "sequence_id",
        F.expr("aggregate(held, X'', (all, x) -> concat(all, x.ids))").alias("ids"),
        F.col("held.length").alias("part_lengths"),
    )


def with_crc(packed: DataFrame, width: int = 2) -> DataFrame:
    """``packed`` with ``ids_crc32``, the checksum of the ids as 32-bit integers, instead of the ids."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4").tobytes()) for x in batch["ids"]]
            columns = [batch[c] for c in batch.schema.names if c != "ids"]
            names = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    kept = [f"{c} {t}" for c, t in packed.dtypes if c != "ids"]
    return packed.mapInArrow(run, ", ".join([*kept, "ids_crc32 long"]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Cut and pack ``docs (doc_id, text)``; one row per piece with its ids and its place. An empty table has none."""
    width = np.dtype(id_type(tokenizer)).itemsize
    return pack(cut(docs, tokenizer, end_id, length), length, width=width)
