"""Exact removal of repeated passages by prefix-free parsing of the corpus.

A rolling hash triggers phrases: the trigger of a window of `length` symbols is the least hash of the `gram` symbols
at its first `span` places, so equal windows have their triggers at the same place wherever they stand. A phrase is a
trigger with the windows it is the trigger of. The corpus becomes a table of phrases with two hashes: of the symbols
that all windows of the trigger hold, and of all symbols of the phrase. A phrase that stands at two places as a
whole repeats all its windows; one whose common symbols stand at one place alone repeats none; where different phrases
hold the same common symbols, one of each is cut into finer phrases about the trigger, down to single windows. So the
dictionary is only ever counted, by aggregates that combine before they shuffle, and no phrase, however frequent, is
gathered in a task. Symbols are bytes, or words for passages counted in words.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mixed, sized, slices


class Unit(NamedTuple):
    """What is a symbol, places and symbols of a trigger, windows of finer phrases level by level (the last tells single windows apart), and whether both places must be in different texts."""

    words: bool
    span: int
    gram: int
    widths: tuple[int, ...]
    apart: bool


BYTES = Unit(False, 320, 16, (40, 5, 1), False)
WORDS = Unit(True, 44, 4, (6, 1), True)
#: Bytes of the phrases that are cut finer up to which they are broadcast to the texts; beyond it the texts are shuffled to them.
TODO_BYTES = 64 << 20
#: Words of a passage that is counted if another document has it too.
PASSAGE = 51

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MAP = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _tables(many: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse, at least so many."""
    if not _powers or len(_powers[0]) < many:
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(many, x, np.uint64))) for b in _BASES for x in (b, pow(b, -1, 1 << 64))]
    return _powers


class _Sums:
    """Two hashes of any run of symbols, from sums over all of them. Runs here are under 2^10 symbols, too short for the strings that defeat every base."""

    def __init__(self, symbols: np.ndarray):
        t = _tables(len(symbols) + 1)
        with np.errstate(over="ignore"):
            self.sums = [np.append(np.uint64(0), np.cumsum(symbols * t[2 * k][: len(symbols)], dtype=np.uint64)) for k in (0, 1)]
        self.back = t[1], t[3]

    def hash(self, which: int, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
        s = self.sums[which]
        with np.errstate(over="ignore"):
            h = mixed((s[end] - s[start]) * self.back[which][start])
            return h if salt is None else mixed(h + mixed(salt.astype(np.uint64)))


def phrases(symbols: np.ndarray, cut: np.ndarray, length: int, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, last window) of phrases that together hold every window of the texts symbols[cut[i] : cut[i + 1]] once."""
    m = len(symbols) - length + 1
    if m < 1:
        return (np.zeros(0, np.int64),) * 3
    h, power, n = symbols, np.array([_BASES[0]], np.uint64), 1
    with np.errstate(over="ignore"):
        while n < unit.gram:  # a power of two: each run's hash from two of half the length
            h, power, n = h[:-n] * power + h[n:], power * power, 2 * n
    mask = np.uint64((1 << int(len(symbols)).bit_length()) - 1)
    low, n = (mixed(h) & ~mask) | np.arange(len(h), dtype=np.uint64), 1  # of equal hashes the first
    low = low[: m + unit.span - 1]
    while 2 * n <= unit.span:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    low = np.minimum(low[: len(low) - (unit.span - n)], low[unit.span - n :])
    bounds = np.zeros(m + 1, np.int64)
    long = np.diff(cut) >= length
    np.add.at(bounds, cut[:-1][long], 1)
    np.add.at(bounds, cut[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(bounds[:m]))
    if not len(window):
        return (np.zeros(0, np.int64),) * 3
    at = (low[window] & mask).astype(np.int64)
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[head], window[head], window[np.append(head[1:], len(window)) - 1]


def _finer(at: np.ndarray, first: np.ndarray, last: np.ndarray, width: int):
    """(which, step, first, last) of the parts of phrases: windows by their distance to the trigger, `width` distances a part."""
    low = (at - last) // width
    many = (at - first) // width + 1 - low
    which = np.repeat(np.arange(len(at)), many)
    step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which]
    return which, step, np.maximum(first[which], at[which] - (step + 1) * width + 1), np.minimum(last[which], at[which] - step * width)


_TABLE = "tid binary, at int, first int, last int, k long, f long"


def _symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts and where each text's begin."""
    symbols = _MAP[data]
    if not words:
        return symbols, offsets
    gap = _SPACE[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    first = np.flatnonzero(~gap & (np.append(True, gap[:-1]) | starts[:-1]))
    end = np.flatnonzero(~gap & (np.append(gap[1:], True) | starts[1:])) + 1
    return _Sums(symbols).hash(0, first, end), np.searchsorted(first, offsets)


def _parse(width: int | None, length: int, unit: Unit, whole: bool = True):
    """Rows of the phrases of each text, or of finer parts of those that are named with it; only their k, unless `whole`."""

    def run(batches):
        for b in batches:
            for start, n, data, offsets in slices(b, 1, 1 << 20):
                tid = b.column(0).slice(start, n)
                symbols, cut = _symbols(data, offsets, unit.words)
                if width is None:
                    at, first, last = phrases(symbols, cut, length, unit)
                else:
                    named = b.column(2).slice(start, n)
                    base = np.repeat(cut[:-1], np.diff(named.offsets.to_numpy()))
                    packed = named.flatten().to_numpy()
                    at = (packed >> 20) + base
                    first, last = at - (packed >> 10 & 1023), at - (packed & 1023)
                if not len(at):
                    continue
                sums = _Sums(symbols)
                if width is None:
                    k = sums.hash(0, at, at + length - unit.span + 1)
                else:
                    which, step, first, last = _finer(at, first, last, width)
                    at = at[which]
                    k = sums.hash(0, at - step * width, at - (step + 1) * width + 1 + length, step)
                f = sums.hash(1, first, last + length, (at - first) << 12 | at - last) if whole else k
                owner = np.searchsorted(cut, first, "right") - 1
                base = cut[owner]
                for x in range(0, len(at), 1 << 17):
                    y = slice(x, x + (1 << 17))
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(k[y].view(np.int64))], ["k"])
                        continue
                    places = [pa.array((c[y] - base[y]).astype(np.int32)) for c in (at, first, last)]
                    yield pa.RecordBatch.from_arrays([tid.take(pa.array(owner[y])), *places, pa.array(k[y].view(np.int64)), pa.array(f[y].view(np.int64))], ["tid", "at", "first", "last", "k", "f"])

    return run


def repeated(texts: DataFrame, length: int, unit: Unit) -> DataFrame:
    """(tid, spans): for distinct texts that hold windows of `length` symbols that stand at two places, the symbols these cover.

    The texts are parsed twice: first phrases are counted by their common symbols alone, and only those that occur
    twice are written out.
    """
    twice = checkpoint(texts.mapInArrow(_parse(None, length, unit, False), "k long").groupBy("k").count().where("count > 1").select("k"))
    rows, spans = checkpoint(texts.mapInArrow(_parse(None, length, unit), _TABLE).join(sized(twice), "k", "left_semi").select("tid", "at", "first", "last", "k", "f")), None
    place = F.xxhash64("tid") if unit.apart else F.xxhash64("tid", "at", "first")
    for width in (*unit.widths, None):
        places = rows.select("k", "f", place.alias("o")).groupBy("k", "f").agg(F.min("o").alias("a"), F.max("o").alias("b"))
        whole = checkpoint(places.where("a <> b"))
        span = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR((F.col("last") + length).cast("long"))
        hit = rows.join(sized(whole.select("k", "f")), ["k", "f"], "left_semi").groupBy("tid").agg(F.collect_set(span).alias("s"))
        hit = checkpoint(hit)
        spans = hit if spans is None else spans.unionByName(hit)
        if width is None:
            break
        several = checkpoint(places.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
        todo = rows.join(sized(several), "k", "left_semi").join(sized(whole), ["k", "f"], "left")
        stand = (F.col("a") == place) | (F.col("b") == place) if unit.apart else F.col("a") == place
        todo = todo.where(F.col("a").isNull() | stand)  # one of equal phrases (of two texts, if places must be apart) stands for them
        packed = F.shiftleft(F.col("at").cast("long"), 20).bitwiseOR(F.shiftleft((F.col("at") - F.col("first")).cast("long"), 10)).bitwiseOR((F.col("at") - F.col("last")).cast("long"))
        todo = checkpoint(todo.groupBy("tid").agg(F.collect_set(packed).alias("named")))
        rows = checkpoint(texts.join(sized(todo, TODO_BYTES), "tid").select("tid", "text", "named").mapInArrow(_parse(width, length, unit), _TABLE))
    return spans.groupBy("tid").agg(F.flatten(F.collect_list("s")).alias("s")).mapInArrow(_merged, "tid binary, spans binary")


def _merged(batches):
    """The union of each text's spans, disjoint, not touching and in order, as pairs of 32-bit integers."""
    for b in batches:
        out = []
        for x in b.column(1):
            v = np.sort(x.values.to_numpy())
            start, end = v >> 32, np.maximum.accumulate(v & 0xFFFFFFFF)
            head = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
            tail = np.append(head[1:], len(v)) - 1
            out.append(np.stack([start[head], end[tail]], 1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["tid", "spans"])


def _report(texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", *["kept"] * texts]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * texts]

    pairs = lambda x: np.frombuffer(x or b"", "<i4").reshape(-1, 2).tolist()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows, part = [], b.slice(at, 256)
                for doc, text, several, copies, spans, passages in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                    raw = (text or "").encode()
                    gone = [[0, len(raw)]] if copies else pairs(spans)
                    kept = raw
                    if gone:
                        ends = [0, *(x for s in gone for x in s), len(raw)]
                        kept = b"".join(raw[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True))
                    words = len(raw.split()) if several else 0
                    said = words if words >= PASSAGE else sum(e - s for s, e in pairs(passages))
                    rows.append((doc, len(raw), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept).hexdigest(), said, *[kept] * texts))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def remove_repeats(df: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (and kept, the remaining bytes).

    Removed is each byte that a `length`-byte string covers which also starts elsewhere in the table, the same
    document included. n_passage_words counts the words (what ASCII white space separates) in passages of PASSAGE
    words or more that another document has too; they are reported, not removed. A null text is empty; repeated
    rows are copies of each other; null ids stay; an empty table gives an empty result. Other columns are not read.
    """
    if length < BYTES.span + BYTES.gram:
        raise ValueError(f"length must be {BYTES.span + BYTES.gram} at least")
    docs = df.select(F.col("doc_id").cast("long"), "text")
    keyed = docs.select("doc_id", F.unhex(F.md5("text")).alias("tid"), "text")
    copies = keyed.where("text is not null").groupBy("tid").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first(F.octet_length("text")).alias("size"))
    copies = checkpoint(copies.where("n > 1").select("tid", "least", (F.col("size") >= length).alias("copies"), F.lit(True).alias("several")))
    distinct = keyed.join(sized(copies.select("tid", "least", "several")), "tid", "left").where(F.col("several").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))).select("tid", "text")
    passages = repeated(distinct.where(F.octet_length("text") >= 2 * PASSAGE - 1), PASSAGE, WORDS).withColumnRenamed("spans", "passages")
    spans = repeated(distinct.where(F.octet_length("text") >= length), length, BYTES)
    found = checkpoint(spans.join(passages, "tid", "full").join(copies.drop("least"), "tid", "full"))
    joined = docs.withColumn("tid", F.unhex(F.md5("text"))).join(sized(found), "tid", "left")
    rows = joined.select("doc_id", "text", F.coalesce("several", F.lit(False)).alias("several"), F.coalesce("copies", F.lit(False)).alias("copies"), "spans", "passages")
    return rows.mapInArrow(_report(texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + ", kept binary" * texts)
