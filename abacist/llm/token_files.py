"""Token ids in Arrow files of fixed-size lists, read back without copying.

A folder holds pairs of files: ``<n>.arrow`` with the sequences and
``<n>.index.arrow`` with a row for each document. A sequence file is an Arrow
IPC file (with a footer) whose batches have two columns of fixed-size lists,
``ids`` and ``mask``; all batches but the last have the same number of rows, so
the place of any token follows from its number. Tokens run on from document to
document; the last sequence of a file is filled with zeros that are not masked in.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.llm.tokens import slices, word_encoder
from abacist.session import scratch_path, settle

SEQUENCE = 2048
ROWS = 64
_WRITTEN = "file string, first_id long, last_id long, tokens long, documents long"
_DOCUMENT = "doc_id long, first long, n_tokens long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that ``uri`` names and the path in it; a path without scheme is a local one."""
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


class _Writer:
    """One pair of files; their names are final only once both are whole."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int):
        self.store, self.folder = _open(folder)
        self.store.create_dir(self.folder)
        self.name, self.length = name, length
        self.attempt = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([(c.split()[0], pa.int64()) for c in _DOCUMENT.split(", ")])
        self.sinks = [self.store.open_output_stream(f"{self.attempt}{x}") for x in ("", "-index")]
        self.files = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, self.index_schema))]
        self.dtype, self.tokens, self.documents = kind.to_pandas_dtype(), 0, 0
        self.rest = np.zeros(0, self.dtype)
        self.first_id = self.last_id = None

    def add(self, ids: pa.Array, tokens: np.ndarray, sizes: np.ndarray) -> None:
        """Append documents: their ids, all their tokens, and how many each has."""
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.files[1].write_batch(
            pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(sizes)], schema=self.index_schema)
        )
        if self.documents == 0:
            self.first_id = ids[0].as_py()
        self.last_id = ids[-1].as_py()
        self.documents += len(sizes)
        self.tokens += int(sizes.sum())
        all_ids = np.concatenate([self.rest, tokens.astype(self.dtype)])
        block = self.length * ROWS
        whole = len(all_ids) // block * block
        for at in range(0, whole, block):
            self._batch(all_ids[at : at + block], block)
        self.rest = all_ids[whole:].copy()

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> tuple:
        if len(self.rest):
            full = np.zeros(-(-len(self.rest) // self.length) * self.length, self.dtype)
            full[: len(self.rest)] = self.rest
            self._batch(full, len(self.rest))
        for x in (*self.files, *self.sinks):
            x.close()
        for x, y in (("", ".arrow"), ("-index", ".index.arrow")):
            self.store.move(f"{self.attempt}{x}", f"{self.folder}/{self.name}{y}")
        return self.name, self.first_id, self.last_id, self.tokens, self.documents


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, length: int = SEQUENCE
) -> DataFrame:
    """Write ``docs (doc_id, text)`` in ascending ``doc_id`` order; returns the table of files.

    Each document is the ids of its text (NULL: none) and ``end_id``. Ids are
    stored in 16 bits where ``vocabulary`` (the number of ids) allows, else in 32.
    Rows without ``doc_id`` come first; rows that repeat one stand side by side,
    ordered by a hash of their text.

    A file is a range of ids and is made by one task, so none holds more than its
    share of the text. A task that runs twice makes its files anew under names of
    its own; the table of files, stored once the job is through, names those that count.
    """
    make = word_encoder(docs.sparkSession, tokenizer)
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = make(), None
        for batch in batches:
            for at, texts in slices(batch["text"]):
                if writer is None:
                    writer = _Writer(folder, uuid.uuid4().hex, kind, length)
                found, bounds = encoder.texts(texts)
                writer.add(
                    batch["doc_id"][at : at + len(texts)],
                    np.insert(found, bounds[1:], end_id),
                    np.diff(bounds) + 1,
                )
        columns = [[x] for x in writer.close()] if writer else [()] * 5
        names = [c.split() for c in _WRITTEN.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names]
        )

    wanted = docs.select(F.col("doc_id").cast("long"), "text")
    wanted = wanted.withColumn("tie", F.xxhash64("text"))
    ordered = wanted.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    # A few numbers for each file, in one table file: for each that Spark writes, a JVM may start processes.
    return settle(ordered.mapInArrow(run, _WRITTEN).repartition(1), "token-files")


class TokenFile:
    """Random access to one sequence file through its memory map."""

    def __init__(self, folder: str, name: str):
        store, path = _open(f"{folder}/{name}.arrow")
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        with store.open_input_file(path.removesuffix(".arrow") + ".index.arrow") as index:
            self.index = pa.ipc.open_file(index).read_all()
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _values(self, number: int) -> np.ndarray:
        """Ids of one batch, as a view of the file."""
        if self.held[0] != number:
            ids = self.reader.get_batch(number).column("ids")
            self.held = number, ids.flatten().to_numpy(zero_copy_only=True)
        return self.held[1]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``number``."""
        batch, row = divmod(number, ROWS)
        mask = self.reader.get_batch(batch).column("mask")[row].values
        return self._values(batch)[row * self.length :][: self.length], mask.to_numpy(zero_copy_only=False)

    def tokens(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from number ``first`` on; a view where they stand in one batch."""
        block, parts = self.length * ROWS, []
        while count:
            batch, at = divmod(first, block)
            part = self._values(batch)[at : at + count]
            parts.append(part)
            first, count = first + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([self._values(0)[:0], *parts])


def _starts(files: DataFrame) -> DataFrame:
    """``files`` in order of their ids with ``file_start``, the tokens before each; a row for each file, not each text."""
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "file")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("file_start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_documents(files: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, with its ids if ``ids``."""
    return _read(_starts(files), folder, ids)


def _read(files: DataFrame, folder: str, ids: bool) -> DataFrame:
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["file_start"].to_pylist()):
                file = TokenFile(folder, name)
                for part in file.index.to_batches():
                    first, count = part["first"].to_numpy(), part["n_tokens"].to_numpy()
                    found = [file.tokens(f, n).astype("<u4") for f, n in zip(first.tolist(), count.tolist())]
                    columns = [
                        part["doc_id"],
                        pa.array(first + start),
                        part["n_tokens"],
                        pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([x.view("<i4") for x in found], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    # By number, or adaptive execution would give all of these few small rows to one task.
    spread = files.select("file", "file_start").repartition(max(1, files.count()))
    return spread.mapInArrow(run, schema)


def token_folder(spark: SparkSession, name: str = "tokens") -> str:
    """A fresh folder that driver and executors share."""
    return scratch_path(spark, name)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write ``docs`` to files below the shared folder and read them back."""
    folder = token_folder(docs.sparkSession)
    return read_documents(write_tokens(docs, folder, tokenizer, end_id, vocabulary), folder)
