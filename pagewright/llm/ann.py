"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

The forest is fitted on a bounded sample; every row is then put in one leaf of each tree. A query walks all trees
through one queue, nearest margin first, until its leaves are thought to hold enough rows, and the rows of those
leaves are reranked by exact distances on the original vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SEED = 11
#: Sampled rows the trees are fitted on, trees, rows a leaf is meant to have, and leaves a tree at most; the forest is broadcast, and these bound its size.
SAMPLE, TREES, LEAF, LEAVES = 20_000, 8, 512, 1024
#: Rows of a leaf, and queries, that one task compares.
CHUNK = 4096
#: The sum of the shares of all rows that a query's leaves hold; leaves of two trees overlap. For vectors without any structure this much is needed.
SHARE = 1.6


class Tree:
    """Nodes in arrays: a hyperplane, a threshold and two children, or the number of a leaf."""

    def __init__(self, x: np.ndarray, leaves: int, rng: np.random.Generator):
        self.normal, self.threshold, self.left, self.right, self.leaf, self.weight = [], [], [], [], [], []
        self._grow(x, np.arange(len(x)), leaves, rng)
        self.normal, self.threshold = np.array(self.normal), np.array(self.threshold)
        self.left, self.right, self.leaf = np.array(self.left), np.array(self.right), np.array(self.leaf)
        self.weight = np.array(self.weight) / max(1, len(x))

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        at = len(self.left)
        for a, v in ((self.normal, np.zeros(x.shape[1])), (self.threshold, 0.0), (self.left, at), (self.right, at), (self.leaf, -1)):
            a.append(v)
        if leaves > 1 and len(rows) > 3:
            a, b = x[rng.choice(rows, 2, replace=False)]
            normal = a - b
            normal = normal / np.linalg.norm(normal) if normal.any() else rng.normal(size=x.shape[1])
            side = x[rows] @ normal
            threshold = np.median(side)
            below = side <= threshold
            if 0 < below.sum() < len(rows):
                self.normal[at], self.threshold[at] = normal, threshold
                self.left[at] = self._grow(x, rows[below], leaves // 2, rng)
                self.right[at] = self._grow(x, rows[~below], leaves - leaves // 2, rng)
                return at
        self.leaf[at] = len(self.weight)
        self.weight.append(len(rows))
        return at

    def find(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.leaf[at] < 0)):
            n = at[inner]
            below = np.einsum("ij,ij->i", x[inner], self.normal[n]) <= self.threshold[n]
            at[inner] = np.where(below, self.left[n], self.right[n])
        return self.leaf[at]


class Forest:
    def __init__(self, sample: np.ndarray, rows: int):
        """rows: how many the leaves will hold."""
        rng = np.random.default_rng(SEED)
        leaves = int(min(LEAVES, max(1, rows // LEAF), max(1, len(sample) // 8)))
        self.trees = [Tree(sample, leaves, rng) for _ in range(TREES)]

    def search(self, q: np.ndarray) -> list[tuple[int, int]]:
        """(tree, leaf) as the shared queue gives them, the smallest margin crossed so far first."""
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        found, share = [], 0.0
        while queue and share < SHARE:
            margin, t, at = heapq.heappop(queue)
            tree = self.trees[t]
            while tree.leaf[at] < 0:
                d = float(tree.normal[at] @ q - tree.threshold[at])
                near, far = (tree.left[at], tree.right[at]) if d <= 0 else (tree.right[at], tree.left[at])
                heapq.heappush(queue, (max(margin, abs(d)), t, int(far)))
                at = near
            found.append((t, int(tree.leaf[at])))
            share += float(tree.weight[tree.leaf[at]])
        return found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def rerank(q: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """(query, vec_id, distance) of the k nearest to each query; a row of x stands for all of its ids, and a query is not its own neighbour."""
    out = []
    square = (x * x).sum(1)
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        rough = square[None, :] - 2 * part @ x.T
        for r, (v, own) in enumerate(zip(part, query_ids[at : at + 64].tolist(), strict=True)):
            d = rough[r]
            if len(d) > k + 1:  # the query's own row may be among them
                limit = np.partition(d, k)[k]
                near = np.flatnonzero(d <= limit + 1e-9 * (1 + abs(limit) + v @ v))
            else:
                near = np.arange(len(d))
            exact = np.sqrt(((x[near] - v) ** 2).sum(1))
            best = sorted((s, i) for s, n in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[n].tolist() if i != own)[:k]
            out += [(own, i, s) for s, i in best]
    return out


def nearest(df: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose vec_id is divisible by `every`.

    Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
    part, nor do rows with a null id. Equal vectors are one row of the index with their k + 1 smallest ids, which
    is all that ties can need. Rows repeated with id and vector count once. Other columns are not read.
    """
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), "embedding").where(F.coalesce(ok, F.lit(False)))
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return df.sparkSession.createDataFrame([], empty)
    dim = dims[0]["dim"]
    rows = rows.where(F.size("embedding") == dim)
    few = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    base = checkpoint(kept.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    n = base.count()
    share = F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.1 * SAMPLE / n))
    sampled = base.where(share).select("embedding").limit(SAMPLE).toArrow()
    if not sampled.num_rows:
        sampled = base.select("embedding").limit(1).toArrow()
    forest = Forest(_matrix(sampled["embedding"], dim), n)
    held = df.sparkSession.sparkContext.broadcast(forest)

    def place(batches):
        for b in batches:
            x = _matrix(b.column("embedding"), dim)
            for t, tree in enumerate(held.value.trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.find(x).astype(np.int32)), b.column("embedding"), b.column("ids")], ["tree", "leaf", "embedding", "ids"])

    def walk(batches):
        for b in batches:
            x = _matrix(b.column("embedding"), dim)
            found = [(r, *y) for r, q in enumerate(x) for y in held.value.search(q)]
            take = pa.array([f[0] for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), b.column("query_id").take(take), b.column("embedding").take(take)], ["tree", "leaf", "query_id", "embedding"])

    kind = df.schema["embedding"].dataType.simpleString()
    leaves = base.mapInArrow(place, f"tree int, leaf int, embedding {kind}, ids array<long>")
    sizes = {(r["tree"], r["leaf"]): r["count"] for r in leaves.groupBy("tree", "leaf").count().collect()}  # TREES x LEAVES rows at most
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id", "embedding"])
    probes = asked.mapInArrow(walk, f"tree int, leaf int, query_id long, embedding {kind}")
    queries = max(1, -(-asked.count() // CHUNK))
    cut = F.broadcast(df.sparkSession.createDataFrame([(*key, -(-c // CHUNK)) for key, c in sizes.items()], "tree int, leaf int, chunks int"))
    leaves = leaves.join(cut, ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("embedding"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))
    probes = probes.join(cut, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(queries)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["tree", "leaf", "chunk", "block"]

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = rerank(np.stack(left["embedding"]).astype(np.float64), left["query_id"].to_numpy(), np.stack(right["embedding"]).astype(np.float64), list(right["ids"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = probes.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(leaves.select(*keys, "embedding", "ids").groupBy(*keys)).applyInPandas(near, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
