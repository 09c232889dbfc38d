"""Best-fit packing of token sequences: large items matched in pairs, small ones best-fit into the gaps.

The lengths of pieces have `capacity` values at most, so the whole packing is planned on their histogram, whose
size the capacity bounds; pieces then find their places by their rank among pieces of the same length. Neither
texts nor pieces are shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, sized
from .word_encoder import encoder, text_slices


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence's items in order, how many such sequences) for `counts` items of each length.

    Items over a third of the capacity fit at most twice in a sequence: from the largest down, each is matched
    with the largest that still fits beside it. Smaller items, from the largest down, go to the fullest sequence
    with room, and to new ones when none has. Items of equal length and sequences alike are treated together.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a length outside 1..capacity")
    groups: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []

    def put(items: list[int], many: int) -> None:
        gap = capacity - sum(items)
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((items, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect_left(large, capacity - n + 1) - 1
            while k >= 0 and (not left[large[k]] or (large[k] == n and left[n] < 2)):
                k -= 1
            if k < 0:
                put([n], left[n])
                left[n] = 0
            else:
                m = large[k]
                many = left[n] // 2 if m == n else min(left[n], left[m])
                left[n] -= many
                left[m] -= many
                put([n, m], many)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[n]
        while rest:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                put([], -(-rest // (capacity // n)))
                continue
            gap = gaps[at]
            items, many = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            each = gap // n
            full = min(many, rest // each)
            if full:
                put(items + [n] * each, full)
            rest -= full * each
            if full < many:
                if 0 < rest < each:
                    put(items + [n] * rest, 1)
                    many -= 1
                    rest = 0
                if many > full:
                    put(items, many - full)
    return [x for g in groups.values() for x in g if x[0]]


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Rows by (length, first rank): pieces of that length from that rank on lie in consecutive sequences at one offset."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for items, many in patterns:
        at = 0
        for n in items:
            rows.append((n, used.get(n, 0), first, at))
            used[n] = used.get(n, 0) + many
            at += n
        first += many
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def _ranks(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many equal values came before each one, those counted in `seen` included, which is brought up to date."""
    order = np.argsort(values, kind="stable")
    head = np.flatnonzero(np.diff(values[order], prepend=-1))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(head, np.diff(np.append(head, len(values))))
    out += seen[values]
    seen += np.bincount(values, minlength=len(seen))
    return out


def _pieces(capacity: int, path: str, end: int, ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * ids]

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for docs, texts in text_slices(b):
                tokens, cut = enc.encode_all(texts, end)
                many = -(-np.diff(cut) // capacity)
                owner = np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                first = cut[owner] + start
                length = np.minimum(cut[owner + 1] - first, capacity)
                raw = memoryview(tokens.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [docs.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part, np.int32)), pa.array(_ranks(length, seen))]
                if ids:  # the pieces follow each other in `tokens`
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(tokens)).astype(np.int32)), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(df: DataFrame, path: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and `end`; a longer one than `capacity` is cut into pieces of it, the last maybe shorter.
    A null text is empty: one piece of the end id alone. Repeated rows are packed each; a null doc_id stays null.
    An empty table gives an empty result. Other columns are not read.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * ids
    rows = checkpoint(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(capacity, path, end, ids), kinds))
    held = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = checkpoint(held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = df.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    ranked = rows.join(sized(held.select("part", "length", "before")), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def run(batches):
        t = table.value
        key = t["length"] << 48 | t["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, n << 48 | r, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(t["sequence"][k] + r - t["rank"][k]), pa.array(t["offset"][k])], [*keep, "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids + ", sequence_id long, offset long"
    return ranked.select(*keep, "rank").mapInArrow(run, out)
