"""Cross-entropy difference: how much likelier a text is under a target model than under a background one.

Both models are bigram models over all words of the corpus. A pair's share of its context
is smoothed towards the share of the word, and that towards an even spread; the
background's counts are scaled to the target's number of words, so both lean on
their counts alike. A text's own counts are left out of the target model, so a text
of the target is scored as one that the target lacks. They stay in the background,
where every text has its own: without them there, a text of words that
nothing else has would be as unlikely under both models and look neutral.

Neither model is ever in one place. Texts are packed into blocks of some megabytes;
a block sends each of its different words and pairs once to the bucket of its hash,
where counts are summed over all blocks, and gets them back in the order it sent
them. A block and a bucket have a bounded size; their number grows with the input.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm import batches as B
from abacist.session import scratch_path, settle

# Parameters of the models: words of the even spread and what each counts for, and the
# number of words that a context's own counts are weighed against.
VOCABULARY, EVEN = 1 << 20, 0.5
PRIOR = 200.0
BLOCK_BYTES = 1 << 21
# Words of all texts for each bucket, which bounds the rows it gets.
BUCKET = 1 << 20
# Ids of target documents that every task may hold: 8 MB. More are joined by a shuffle.
IDS_HELD = 1 << 20

_EDGE = np.array([0x5DEECE66D], np.uint64)  # stands for what precedes a text's first word
_SENT = "block long, kind int, bucket int, hashes binary, counts binary"
_COUNTED = "block long, kind int, bucket int, counts binary"
_PAIRS, _WORDS = 1, 2
# Bits of a hash that are sent beside its bucket, as steps from the one before.
_HASH_BITS = 48
_HASH = _HASH_BITS // 8


def _planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of 64-bit values, byte by byte, so that what small ones have in common lies together."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _of_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(np.int64).ravel()


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs (doc_id, text, target)``, with their numbers of words and of texts that have any, in all and in the target."""
    names = ["block", "data", "words", "target_words", "texts", "target_texts"]

    def packed(ids: list, target: list, sizes: list, hashes: list) -> pa.RecordBatch:
        known, place = np.unique(np.concatenate(hashes), return_inverse=True)
        target, sizes = np.concatenate(target), np.concatenate(sizes)
        places = zlib.compress(_planes(place.astype(np.int64), 4), 1)
        steps = zlib.compress(_planes(np.diff(known, prepend=np.uint64(0)), 8), 1)
        data = pickle.dumps((ids, target, sizes.astype(np.int32), steps, places))
        some = sizes > 0
        figures = [sizes.sum(), sizes[target].sum(), some.sum(), (some & target).sum()]
        row = [(uuid.uuid4().int >> 65, pa.int64()), (data, pa.binary()), *[(int(x), pa.int64()) for x in figures]]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank, fold, hasher = B.table(B.BLANKS), B.ascii_lower(), B.Hasher()
        held, used = ([], [], [], []), 0
        for batch in parts:
            flags = batch["target"].to_numpy(zero_copy_only=False)
            for at, texts in B.pieces(batch["text"]):
                words = B.find_words(texts, blank, fold)
                held[0].extend(batch["doc_id"][at : at + len(texts)].to_pylist())
                for x, found in zip(held[1:], (flags[at : at + len(texts)], np.diff(words.bounds), hasher.words(words))):
                    x.append(found)
                used += len(words.buffer)
                if used >= BLOCK_BYTES:
                    yield packed(*held)
                    held, used = ([], [], [], []), 0
        if held[0]:
            yield packed(*held)

    schema = "block long, data binary, words long, target_words long, texts long, target_texts long"
    return docs.mapInArrow(run, schema)


def _settled(blocks: DataFrame) -> DataFrame:
    """``blocks`` written once, in buckets by their number, so that what comes back to them is all that moves.

    The table's name is dropped again, its files stay in the scratch folder.
    """
    spark = blocks.sparkSession
    name = f"abacist_blocks_{uuid.uuid4().hex}"
    writer = blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    writer.option("path", scratch_path(spark, "word-blocks")).saveAsTable(name)
    table = spark.table(name)
    assert table.columns == blocks.columns  # resolved, while the name is there
    spark.sql(f"DROP TABLE {name}")
    return table


class _Block:
    """A block's texts as places in its own sorted words, and its different pairs ordered by their hash."""

    def __init__(self, data: bytes):
        self.ids, target, self.sizes, steps, places = pickle.loads(data)
        self.known = np.cumsum(_of_planes(zlib.decompress(steps), 8).view(np.uint64))
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.place = _of_planes(zlib.decompress(places), 4)
        edge, self.firsts = len(self.known), self.bounds[:-1][self.sizes > 0]
        before = np.concatenate([[edge], self.place[:-1]])[: len(self.place)]
        before[self.firsts] = edge
        self.before, self.target = before, np.repeat(target, self.sizes)
        code, which = np.unique(before * (edge + 1) + self.place, return_inverse=True)
        known = np.concatenate([self.known, _EDGE])
        hashes = B.mix(B.mix(known[code // (edge + 1)]) * np.uint64(B._ODD) + self.known[code % (edge + 1)])
        order = np.argsort(hashes, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.hashes, self.which = hashes[order], back[which]

    def counts(self, at: np.ndarray, size: int) -> list[np.ndarray]:
        """How often each of ``size`` numbers is in ``at``, in all texts and in those of the target."""
        return [np.bincount(at, minlength=size), np.bincount(at[self.target], minlength=size)]

    def own(self, at: np.ndarray, size: int) -> np.ndarray:
        """How often each entry of ``at`` is there in its own text."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        _, where, n = np.unique(text * size + at, return_inverse=True, return_counts=True)
        return n[where]


def _rows(block: int, kind: int, hashes: np.ndarray, counts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows for the buckets of ``hashes``, which are sorted."""
    width = -(-(1 << 64) // buckets)
    bucket = hashes // np.uint64(width)
    inside = (hashes - bucket * np.uint64(width)) >> np.uint64(max(0, width.bit_length() - _HASH_BITS))
    to, starts = np.unique(bucket, return_index=True)
    cuts = list(zip(starts, [*starts[1:], len(hashes)]))
    columns = [
        pa.array([block] * len(to), pa.int64()), pa.array([kind] * len(to), pa.int32()), pa.array(to.astype(np.int32)),
        pa.array([_planes(np.diff(inside[a:b], prepend=np.uint64(0)), _HASH) for a, b in cuts], pa.binary()),
        pa.array([_planes(np.concatenate([c[a:b] for c in counts]), 4) for a, b in cuts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "kind", "bucket", "hashes", "counts"])


def _sent(blocks: DataFrame, buckets: int) -> DataFrame:
    """The different pairs and words of each block with their counts there, a row for each bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for block, data in zip(batch["block"].to_pylist(), batch["data"]):
                x = _Block(data.as_py())
                yield _rows(block, _PAIRS, x.hashes, x.counts(x.which, len(x.hashes)), buckets)
                yield _rows(block, _WORDS, x.known, x.counts(x.place, len(x.known)), buckets)

    return blocks.select("block", "data").mapInArrow(run, _SENT)


def _summed(sent: DataFrame) -> DataFrame:
    """Counts of all blocks for each entry that was sent, in that order."""

    def run(rows: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_of_planes(d, _HASH)) for d in rows["hashes"].to_pylist()]
        sizes = [len(h) for h in hashes]
        first, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = [_of_planes(c, 4).reshape(2, -1) for c in rows["counts"].to_pylist()]
        sums = [np.bincount(at, np.concatenate([c[k] for c in counts]), len(first)).astype(np.int64) for k in range(2)]
        ends = np.cumsum(sizes)
        back = [_planes(np.concatenate([s[at[b - n : b]] for s in sums]), 8) for n, b in zip(sizes, ends)]
        columns = [rows["block"], rows["kind"], rows["bucket"], pa.array(back, pa.binary())]
        return pa.table(columns, ["block", "kind", "bucket", "counts"])

    return sent.groupBy("kind", "bucket").applyInArrow(run, _COUNTED)


def _losses(x: _Block, n: np.ndarray, words: np.ndarray, totals: tuple[int, int], mine: np.ndarray, scale: float) -> np.ndarray:
    """Negative log probability of each word of a block after the one before it.

    ``n`` and ``words`` count the model's pairs and words, ``totals`` all its words and its
    texts; ``mine`` says of each word whether its own text's counts are left out.
    """
    of_word = np.concatenate([words, [totals[1]]])
    own_pair, own_word = x.own(x.which, len(x.hashes)), x.own(x.place, len(words))
    own_context = np.concatenate([[1], own_word[:-1]])[: len(own_word)]
    own_context[x.firsts] = 1
    length = np.repeat(x.sizes, x.sizes)
    word = scale * (of_word[x.place] - mine * own_word) + EVEN
    share = word / (scale * (totals[0] - mine * length) + EVEN * VOCABULARY)
    pair = scale * (n[x.which] - mine * own_pair)
    context = scale * (of_word[x.before] - mine * own_context)
    return -np.log((pair + PRIOR * share) / (context + PRIOR))


def _score(blocks: DataFrame, counted: DataFrame, sums: dict[str, int]) -> DataFrame:
    # As much evidence in the background as in the target.
    scale = sums["target_words"] / sums["words"] if sums["target_words"] else 1.0
    models = ((1, sums["target_words"], sums["target_texts"], 1.0), (0, sums["words"], sums["texts"], scale))

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        x = _Block(block["data"][0].as_py())
        rows = rows.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kind, found = rows["kind"].to_numpy(), [_of_planes(c, 8).reshape(2, -1) for c in rows["counts"].to_pylist()]
        nothing = [np.zeros((2, 0), np.int64)]
        pairs, words = (np.concatenate(nothing + [f for f, k in zip(found, kind) if k == of], axis=1) for of in (_PAIRS, _WORDS))
        means, some = [], x.sizes > 0
        for k, total, texts, by in models:
            mine = x.target if k else np.zeros(len(x.place), bool)
            loss = _losses(x, pairs[k], words[k], (total, texts), mine, by)
            # Summed text by text, so equal texts score the same wherever they stand.
            sums = np.zeros(len(x.sizes))
            sums[some] = np.add.reduceat(loss, x.firsts) if len(loss) else 0.0
            means.append(sums / np.maximum(x.sizes, 1))
        return pa.table(
            [pa.array(x.ids, pa.int64()), pa.array(x.sizes.astype(np.int64)), *map(pa.array, means), pa.array(means[0] - means[1])],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    own = blocks.select("block", "data").groupBy("block")
    return own.cogroup(counted.groupBy("block")).applyInArrow(run, schema)


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``doc_id, text, target``. So few ids that every task may hold them meet the texts where these are."""
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("target_id")).dropna().distinct()
    wanted = settle(wanted, "target-ids")
    wanted = F.broadcast(wanted) if wanted.count() <= IDS_HELD else wanted.hint("merge")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marked = docs.join(wanted, F.col("doc_id") == F.col("target_id"), "left")
    return marked.select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` for every row of ``docs (doc_id, text)``.

    The target model counts the documents that ``target_ids (doc_id)`` names, the
    background model counts all of them; a document of the target is scored without
    its own counts there, as all others are. Losses are nats per word, and ``score`` is their difference: the
    lower, the more like the target. An empty or NULL text has no words and scores
    0. With no target document its model is an even spread. Ids that repeat or
    are NULL in ``target_ids`` count once or not at all; rows that repeat an id or a text are
    documents of their own, and a copy elsewhere counts.

    Every word and every pair counts, however rare. What goes through the driver
    are four sums, and the number of target documents.
    """
    blocks = _settled(_blocks(_marked(docs, target_ids)))
    names = ["words", "target_words", "texts", "target_texts"]
    row = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    sums = row.asDict()
    buckets = max(2, sums["words"] // BUCKET)
    return _score(blocks, _summed(_sent(blocks, buckets)), sums)
