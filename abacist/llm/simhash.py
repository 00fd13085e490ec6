"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.llm.graph import components
from abacist.session import settle

SEED = 42
BITS, BYTES = 64, 8
# Members of an index bucket that one task compares at once; larger buckets are
# split by further bytes, and then by flipped bits.
BUCKET = 4096
_LAST = (1 << 63) - 1
# Three of the first four bytes or of the last four.
_FIRST = [s for half in (range(4), range(4, 8)) for s in combinations(half, 3)]


def fingerprint(text: bytes | None, shingle: int) -> int:
    """One text's fingerprint; 0 when it has no word."""
    words = (text or b"").lower().split()  # of bytes: only A-Z and the six ASCII blanks count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), ">u8", n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, tag, fp`` for every row; ``tag`` is a hash of the text, ``fp`` the fingerprint as a signed long."""
    names = ["doc_id", "tag", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), shingle) for t in batch["text"].cast(pa.binary())), np.uint64, len(batch)
            )
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(found.view(np.int64))], names)

    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")
    return docs.mapInArrow(run, "doc_id long, tag long, fp long")


def _byte(fp: Column, i: int) -> Column:
    """Byte ``i`` of a fingerprint, counted from the highest."""
    return F.shiftrightunsigned(fp, 8 * (BYTES - 1 - i)).bitwiseAND(F.lit(0xFF))


def _keys(sets: list[tuple[int, ...]]) -> Column:
    """The keys of a value: for each of ``sets`` its number and the bytes at those positions."""
    keys = []
    for n, positions in enumerate(sets):
        key = F.lit(n).cast("long")
        for i in positions:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), i))
        keys.append(key)
    return F.array(*keys)


def _index(values: DataFrame) -> DataFrame:
    """Inverted index of positional bytes: a row for each value and each set of byte positions."""
    return values.select("fp", F.explode(_keys(_FIRST)).alias("key"))


def _finer(large: DataFrame) -> DataFrame:
    """The values of large buckets, by each two bytes that the bucket's key lacks."""
    number = F.shiftright("key", 24)
    keys = F.lit(None).cast("array<long>")
    for n, positions in enumerate(_FIRST):
        others = [i for i in range(BYTES) if i not in positions]
        keys = F.when(number == n, _keys(list(combinations(others, 2)))).otherwise(keys)
    return large.select("key", "fp", F.explode(keys).alias("next"))


def _forest(values: np.ndarray, distance: int, shared: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within ``distance`` bits connect, at most one for each value.

    Tallies the positional bytes that two values share, keeps pairs that reach
    the guaranteed number, and counts the differing bits of those.
    """
    parts = values.view(np.uint8).reshape(-1, BYTES)
    root = np.arange(len(values))
    links = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    step = max(1, (1 << 21) // max(1, len(values)))
    for at in range(0, len(values), step):
        block = slice(at, at + step)
        tally = np.zeros((len(values[block]), len(values)), np.uint8)
        for i in range(BYTES):
            tally += parts[block, i][:, None] == parts[:, i][None, :]
        a, b = np.nonzero(tally >= shared)
        a += at
        a, b = a[a < b], b[a < b]
        near = np.bitwise_count(values[a] ^ values[b]) <= distance
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            x, y = top(i), top(j)
            if x != y:
                root[y] = x
                links.append((int(values[i].view(np.int64)), int(values[j].view(np.int64))))
    return links


def _sizes(index: DataFrame, key: list[str]) -> DataFrame:
    return index.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")


def _within(index: DataFrame, key: list[str], distance: int) -> DataFrame:
    """Links inside buckets of bounded size."""
    buckets = index.groupBy(*key).agg(F.collect_list("fp").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for members in batch["members"]:
                values = np.sort(members.values.to_numpy()).view(np.uint64)
                links += _forest(values, distance, BYTES - distance)
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def _flipped(values: DataFrame, distance: int) -> DataFrame:
    """Links through values in between, for buckets that stay too large: linear in their members.

    Two values at ``distance`` or fewer bits have a value in between that is at
    most ``distance // 2`` bits from one and the rest from the other. Each value
    is sent to all values that near it; those that meet there all link to one
    that is at the shorter reach.
    """
    short, long = distance // 2, distance - distance // 2
    masks = [sum(1 << b for b in bits) for n in range(long + 1) for bits in combinations(range(BITS), n)]
    rows = [(m - (1 << 64) if m >> 63 else m, m.bit_count() <= short) for m in masks]
    steps = values.sparkSession.createDataFrame(rows, "mask long, near boolean")
    sent = values.select("fp").distinct().join(F.broadcast(steps)).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("middle"), "near", "fp"
    )
    hubs = sent.filter("near").groupBy("middle").agg(F.min("fp").alias("hub"))
    return sent.join(hubs, "middle").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def near_links(values: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that connect the distinct ``fp`` values as all pairs within ``distance`` bits do.

    At ``distance`` of three, five of the eight positional bytes of a linked pair
    are equal, so three of the first four or three of the last four are: eight
    index keys of three bytes. Buckets over ``bucket`` values are indexed again
    by two more of their five other bytes, and what is still over it goes
    through :func:`_flipped`. Nothing is dropped on the way.
    """
    if distance != 3:
        raise ValueError("the index keys are laid out for three differing bits")
    index = _index(values)
    index = settle(index.join(_sizes(index, ["key"]), "key"), "simhash-index")
    small = _within(index.filter(F.col("size") <= bucket), ["key"], distance)
    large = index.filter(F.col("size") > bucket).select("key", "fp")
    finer = _finer(large)
    finer = finer.join(_sizes(finer, ["key", "next"]), ["key", "next"])
    middle = _within(finer.filter(F.col("size") <= bucket), ["key", "next"], distance)
    rest = _flipped(finer.filter(F.col("size") > bucket), distance)
    return small.union(middle).union(rest)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs (doc_id, text)``.

    Two documents link when their fingerprints differ in ``distance`` or fewer
    bits; ``component_id`` is the smallest ``doc_id`` reachable. Equal
    fingerprints are one node, whatever their number. A NULL or empty text has
    fingerprint zero and links like any other. A row without ``doc_id`` is
    returned too; it counts as the largest id, and its component is NULL when no
    other row has one. Rows that repeat an id are separate documents.
    """
    known, ids = _grouped(docs, shingle, distance, bucket)
    return known.join(ids, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("least_id") < _LAST, F.col("least_id")).alias("component_id"),
    )


def _grouped(docs: DataFrame, shingle: int, distance: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their fingerprints, and of each fingerprint its group and the smallest id there."""
    known = settle(fingerprints(docs, shingle), "fingerprints")
    values = known.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("first_id"))
    values = settle(values, "fingerprint-values")
    # Components over fingerprints, then the smallest id of each component.
    parts = settle(components(near_links(values, distance, bucket)), "fingerprint-components")
    joined = values.join(parts, values["fp"] == parts["node"]).select("fp", "component", "first_id")
    least = joined.groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = joined.join(least, "component").select("fp", "component", "least_id")
    # Stored, so that the last join is of two plain tables and a hot fingerprint can be split in it.
    group, least_id = F.coalesce("component", "fp").alias("group"), F.coalesce("least_id", "first_id").alias("least_id")
    return known, settle(values.join(linked, "fp", "left").select("fp", group, least_id), "fingerprint-ids")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns as they were.

    The row with the group's smallest id stays; of rows of the group that repeat that
    id, the one with the smallest hash of its text. Rows of other groups with the same
    id are other documents, whose groups keep a row of their own. A row without an id
    cannot be named as a group's member and stays.
    """
    known, ids = _grouped(docs, shingle, distance, BUCKET)
    first = known.join(ids, "fp").filter(F.col("doc_id") == F.col("least_id"))
    kept = first.groupBy("group").agg(F.min("tag").alias("tag"), F.min("doc_id").alias("id")).drop("group")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("tag"))
    order = Window.partitionBy("id", "tag").orderBy(F.xxhash64("row"))
    named = rows.join(kept, ["id", "tag"], "left_semi").withColumn("rank", F.row_number().over(order))
    return named.filter("rank = 1").select("row.*").union(rows.filter("id is null").select("row.*"))
