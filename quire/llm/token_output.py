"""Token-ID output: equal-length sequences and masks in Arrow files that can be mapped and read at random.

A shard is a pair of Arrow IPC files: ``ids`` and ``mask`` as fixed-size lists (a mask bit is set for a real token, unset
for the padding that ends the shard), in batches of the same number of sequences, and an index of the shard's documents
(doc_id, offset, n_tokens). Shards follow each other in ascending doc_id order, so shard starts are running sums.

Nulls: a null text is empty; a null doc_id sorts first. An empty text is its end id alone. Repeated rows are written again.
An empty table gives no shard. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, scratch, slices, texts_of
from .tokens import encoder

SHARD = "part int, ids_path string, index_path string, n_docs long, n_tokens long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sequence_schema(seq_len: int, vocab_size: int) -> pa.Schema:
    """ids are unsigned 16-bit where the vocabulary allows it."""
    kind = pa.uint16() if vocab_size <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class ShardWriter:
    """Packs runs of ids into sequences and writes them batch by batch; memory holds one batch."""

    def __init__(self, folder: str, seq_len: int, batch: int, vocab_size: int):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex  # each attempt of a task has files of its own
        self.ids_path, self.index_path = f"{folder}/{name}.arrow", f"{folder}/{name}.index.arrow"
        self.schema = sequence_schema(seq_len, vocab_size)
        self.out = self.fs.open_output_stream(posixpath.join(base, f"{name}.arrow"))
        self.index_out = self.fs.open_output_stream(posixpath.join(base, f"{name}.index.arrow"))
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.index = pa.ipc.new_file(self.index_out, pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))
        self.seq_len, self.batch, self.kind = seq_len, batch, self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.rest: list[np.ndarray] = []
        self.waiting = self.n_tokens = self.n_docs = 0

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts)
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(self.n_tokens + ends - counts), pa.array(counts)], names=["doc_id", "offset", "n_tokens"]))
        self.n_docs, self.n_tokens = self.n_docs + len(counts), self.n_tokens + len(ids)
        self.rest.append(ids.astype(self.kind))
        self.waiting += len(ids)
        size = self.seq_len * self.batch
        if self.waiting >= size:
            flat = np.concatenate(self.rest)
            for k in range(0, len(flat) - size + 1, size):
                self._write(flat[k : k + size], size)
            self.rest = [flat[len(flat) // size * size :].copy()]
            self.waiting = len(self.rest[0])

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.rest)
            padded = np.zeros(-(-len(flat) // self.seq_len) * self.seq_len, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        for x in (self.file, self.index, self.out, self.index_out):
            x.close()


class SequenceFile:
    """Random access to the sequences of one shard; local files are memory-mapped and nothing is copied."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        rows, at = self.file.get_batch(k // self.batch), k % self.batch
        return rows.column(0)[at].values.to_numpy(), rows.column(1)[at].values.to_numpy(zero_copy_only=False)

    def runs(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from start on, as views, batch by batch."""
        size = self.seq_len * self.batch
        while count > 0:
            values = self.file.get_batch(start // size).column(0).flatten().to_numpy()
            view = values[start % size : start % size + count]
            yield view
            start, count = start + len(view), count - len(view)


def _write_part(batches, folder: str, tokenizer: str, end_id: int, seq_len: int, batch: int):
    bpe = encoder(tokenizer)
    writer = None
    for rows in batches:
        for part in slices(rows, 1):
            ids, counts = bpe.encode(texts_of(part.column(1)))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            if writer is None:
                writer = ShardWriter(folder, seq_len, batch, bpe.vocab_size)
            writer.add(part.column(0), ids, counts + 1)
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids_path": [writer.ids_path], "index_path": [writer.index_path], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, seq_len: int = 1024, batch: int = 256, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write all documents in ascending id order; gives one entry for each shard, with the ids before it.

    Range partitions keep the order across shards. Only the shard list (one row for each task) reaches the driver. A lost
    task writes new files; files of lost attempts are named by no entry.
    """
    rows = id_text(docs, id_col, text_col)
    rows = rows.repartitionByRange(rows.doc_id.asc_nulls_first()).sortWithinPartitions(rows.doc_id.asc_nulls_first())
    shards = rows.mapInArrow(partial(_write_part, folder=folder, tokenizer=tokenizer, end_id=end_id, seq_len=seq_len, batch=batch), SHARD).collect()
    start, out = 0, []
    for s in sorted(shards, key=lambda r: r.part):
        out.append(s.asDict() | {"start": start})
        start += s.n_tokens
    return out


def _read_part(batches, wide: str = "<u4"):
    for rows in batches:
        for shard in rows.to_pylist():
            data = SequenceFile(shard["ids_path"])
            files, path = _open(shard["index_path"])
            index = pa.ipc.open_file(files.open_input_file(path))
            for k in range(index.num_record_batches):
                part = index.get_batch(k)
                sums = []
                for at, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    crc = 0
                    for view in data.runs(at, n):
                        crc = zlib.crc32(view.astype(wide).tobytes(), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(part.column(1).to_numpy() + shard["start"]), part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark, shards: list[dict]) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    table = spark.createDataFrame([(s["ids_path"], s["index_path"], s["start"]) for s in shards], "ids_path string, index_path string, start long")
    return table.repartition(max(1, len(shards))).mapInArrow(_read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the sequences and give the per-document digests of what the files hold."""
    spark = docs.sparkSession
    return read_digests(spark, write_sequences(docs, folder or scratch(spark, "sequences"), tokenizer, **options))
