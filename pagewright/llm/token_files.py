"""Token ids in Arrow files of equal-length sequences with masks, read again by memory map or stream.

A shard is one Arrow IPC file of record batches with two fixed-size-list columns, `ids` and `mask`, of `width`
values a row: row r of the shard begins at byte r * width of one buffer, so sequences and masks are read at
random without a copy. Only a shard's last row is padded; there the mask is false. Beside it, an index file has
doc_id, start (in the shard) and n_tokens of each document, and the shard's name says its place in the order.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, shared_dir
from .word_encoder import encoder, text_slices

#: Rows of a record batch.
BATCH = 256


def schema(width: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), width)), ("mask", pa.list_(pa.bool_(), width))])


INDEX = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens")])


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def _batch(flat: np.ndarray, used: int, width: int) -> pa.RecordBatch:
    mask = np.ones(len(flat), bool)
    mask[used:] = False
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), width), pa.FixedSizeListArray.from_arrays(pa.array(mask), width)], schema=schema(width))


class ShardWriter:
    """Writes documents' ids one after another; a file gets its name only when it is whole, so a task run twice does no harm."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, base = _open(folder)
        self.fs.create_dir(base)
        self.to, self.tmp, self.width = f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}", width
        self.out = self.fs.open_output_stream(f"{self.tmp}.ids")
        self.writer = ipc.new_file(self.out, schema(width))
        self.held, self.total = np.zeros(0, np.uint16), 0
        self.index_out = self.fs.open_output_stream(f"{self.tmp}.index")
        self.index = ipc.new_file(self.index_out, INDEX)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, cut: np.ndarray) -> None:
        """Documents whose ids are ids[cut[i] : cut[i + 1]]; whole record batches are written at once."""
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(self.total + cut[:-1]), pa.array(np.diff(cut))], schema=INDEX))
        self.total += len(ids)
        self._flush(np.concatenate([self.held, ids]), False)

    def _flush(self, flat: np.ndarray, end: bool) -> None:
        step = BATCH * self.width
        whole = len(flat) // step * step
        for at in range(0, whole, step):
            self.writer.write_batch(_batch(flat[at : at + step], step, self.width))
        rest = flat[whole:]
        if end and len(rest):
            self.writer.write_batch(_batch(np.pad(rest, (0, -len(rest) % self.width)), len(rest), self.width))
        self.held = rest.copy()

    def close(self) -> None:
        self._flush(self.held, True)
        for x in (self.writer, self.out, self.index, self.index_out):
            x.close()
        for kind in ("index", "ids"):
            to = f"{self.to}.{kind}.arrow"
            if self.fs.get_file_info(to).type != fs.FileType.NotFound:
                self.fs.delete_file(to)  # by an attempt of this task that was lost later: the same bytes, and some stores do not move onto a file
            self.fs.move(f"{self.tmp}.{kind}", to)


class ShardReader:
    """sequence(r) and mask(r) of one shard without copies, and its documents' ids in order."""

    def __init__(self, folder: str, name: str):
        self.fs, base = _open(folder)
        path = f"{base}/{name}.ids.arrow"
        self.source = pa.memory_map(path) if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.index = f"{base}/{name}.index.arrow"
        self.width = self.file.schema.field("ids").type.list_size

    def _row(self, column: str, r: int):
        return self.file.get_batch(r // BATCH).column(column)[r % BATCH].values

    def sequence(self, r: int) -> np.ndarray:
        return self._row("ids", r).to_numpy()

    def mask(self, r: int) -> np.ndarray:
        return self._row("mask", r).to_numpy(zero_copy_only=False)

    def documents(self):
        """(doc_id, start, ids) of every document, with one batch of the index and of ids and one document in memory."""
        held, first, k = np.zeros(0, np.uint16), 0, 0
        with self.fs.open_input_file(self.index) as f:
            index = ipc.open_file(f)
            for i in range(index.num_record_batches):
                for doc_id, start, n in zip(*(c.to_pylist() for c in index.get_batch(i).columns), strict=True):
                    have = len(held) - (start - first)
                    if have < n:
                        got = [held[start - first :]]
                        while have < n:
                            got.append(self.file.get_batch(k).column("ids").values.to_numpy())
                            have += len(got[-1])
                            k += 1
                        held, first = np.concatenate(got), start
                    yield doc_id, start, held[start - first : start - first + n]


def write(df: DataFrame, folder: str, path: str, end: int = 2, width: int = 2048) -> list[tuple[str, int]]:
    """Write the ids of df's documents in ascending doc_id order (nulls first, ties by the text's hash); (shard name, tokens) in order."""

    def run(batches):
        from pyspark import TaskContext

        enc, name = encoder(path), f"shard-{TaskContext.get().partitionId():06d}"
        out = None
        for b in batches:
            for docs, texts in text_slices(b):
                out = out or ShardWriter(folder, name, width)
                out.add(docs, *enc.encode_all(texts, end))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.total], pa.int64())], ["shard", "n"])

    rows = df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(parts(df.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return sorted((r["shard"], r["n"]) for r in dealt.mapInArrow(run, "shard string, n long").collect())  # one row a shard


def read(spark: SparkSession, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start (all ids before it), n_tokens and ids_crc32 of every document, from the files alone."""
    before = np.concatenate([[0], np.cumsum([n for _, n in shards])])[: len(shards)].tolist()
    table = spark.createDataFrame([(name, at) for (name, _), at in zip(shards, before, strict=True)], "shard string, before long")

    def run(batches):
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, start, ids in ShardReader(folder, name).documents():
                    rows.append((doc_id, at + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return table.repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(df: DataFrame, path: str, end: int = 2, width: int = 2048) -> DataFrame:
    """Write all documents to files in the shared folder and return what reading them gives.

    A null text is empty: the end id alone. Repeated rows are written each. An empty table writes nothing and
    gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(spark, folder, write(df, folder, path, end, width))
