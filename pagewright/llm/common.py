"""Pieces the corpus operators share: checkpoints, text buffers, hashing, connected components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join is broadcast; they are summed before, and a larger side is shuffled.
BROADCAST_BYTES = 32 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, or, on a single machine where that is unset, a new one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagewright-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    A checkpoint keeps the size that Spark estimated for its plan, for a join the product of both sides: in a loop of joins
    that number has twice the digits after each round, until the driver's heap is full of it. Sizes beyond a long are unknown ones.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() < 1 << 63:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False), spark)


def release(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing to come reads again: all that was made of them is a checkpoint itself."""
    for df in frames:
        name = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if name.isDefined():
            remove(df.sparkSession, name.get())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(c, kind: T.DataType):
    """About the bytes of a value."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda acc, x: acc + _bytes(x, kind.elementType)), F.lit(16))
    return F.lit(8)


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df, a checkpoint, for broadcast if its bytes are few; beyond that the join shuffles."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20):
    """(first row, rows, bytes as uint8, offsets) of runs of rows of a string column, about `most` bytes or one row each."""
    col = batch.column(column)
    col = col.cast(pa.large_string()).fill_null("") if col.null_count or col.type != pa.large_string() else col
    if not len(col):
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(col))
        yield at, to - at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


# Fixed values of the public XXH64 specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many slices of one byte buffer at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load8 = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    load4 = np.ndarray((len(data) + 1,), "<u4", padded, 0, (1,))
    n, pos, end = len(start), start.astype(np.int64), (start + length).astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(n, s + P5, np.uint64)
        long = np.flatnonzero(length >= 32)
        if len(long):
            v = [np.full(n, x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            idx = long
            while len(idx):
                for k in range(4):
                    v[k][idx] = _round(v[k][idx], load8[pos[idx] + 8 * k])
                pos[idx] += 32
                idx = idx[end[idx] - pos[idx] >= 32]
            w = [x[long] for x in v]
            m = _rotl(w[0], 1) + _rotl(w[1], 7) + _rotl(w[2], 12) + _rotl(w[3], 18)
            for x in w:
                m = (m ^ _round(np.uint64(0), x)) * P1 + P4
            h[long] = m
        h += length.astype(np.uint64)
        idx = np.flatnonzero(end - pos >= 8)
        while len(idx):
            h[idx] = _rotl(h[idx] ^ _round(np.uint64(0), load8[pos[idx]]), 27) * P1 + P4
            pos[idx] += 8
            idx = idx[end[idx] - pos[idx] >= 8]
        idx = np.flatnonzero(end - pos >= 4)
        if len(idx):
            h[idx] = _rotl(h[idx] ^ (load4[pos[idx]].astype(np.uint64) * P1), 23) * P2 + P3
            pos[idx] += 4
        idx = np.flatnonzero(end > pos)
        while len(idx):
            h[idx] = _rotl(h[idx] ^ (padded[pos[idx]].astype(np.uint64) * P5), 11) * P1
            pos[idx] += 1
            idx = idx[end[idx] > pos[idx]]
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Words whose every bit depends on all bits of h's."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long): (node, root), root the smallest node; a root itself has no row.

    Each round hooks every node to its smallest neighbour, halves the trees by pointer jumping until they are
    stars, and contracts the edges to the roots. Rounds are logarithmic; all steps are joins and minima, so no
    component is gathered in one task.
    """
    e = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not e.isEmpty():
        p = checkpoint(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("above"))
            p = checkpoint(p.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            if p.where("moved").isEmpty():
                break
            p = p.select("node", "root")
        p = p.select("node", "root")
        if label is None:
            label = p
        else:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("above"))
            label = checkpoint(label.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(p))
        a = p.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = p.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        e = checkpoint(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return label if label is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(batches, keys: list[str], most: int):
    """Whole groups, as tables sorted by key, from batches sorted by key. A group has `most` rows at most, so what is carried is bounded."""
    left: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t])
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if cut:
            yield t.slice(0, cut), np.concatenate([[0], np.flatnonzero(change[: cut - 1]) + 1, [cut]])
        left = t.slice(cut).combine_chunks()
    if left is not None and left.num_rows:
        change = np.zeros(left.num_rows - 1, bool)
        for k in keys:
            v = left[k].combine_chunks().to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        yield left, np.concatenate([[0], np.flatnonzero(change) + 1, [left.num_rows]])
