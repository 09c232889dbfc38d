"""Line deduplication by an edit join: of lines within some edits of each other one stays, and of equal lines one occurrence.

The edits allowed grow with the shorter line, one for each PER_EDIT characters, up to a threshold; lines that allow
none are matched if equal. A line is cut into threshold + 1 even segments; a line within the threshold of it holds
one of them whole, near its place. So each line gives a key for each of its own segments and one for each substring
of it that could be a segment of an equally long or shorter line. Keys that one line alone has, or that are no line's
own segment, are dropped before any text is moved; lines that share one are verified by a banded bit-parallel edit
distance. Links need not be transitive, so a line goes only if a line that stays is near it: within each component,
lines stay or go in the order of the least doc_id that has them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, components, grouped, mixed, release, sized, slices

THRESHOLD = 2
#: Characters of the shorter line for each edit between two lines.
PER_EDIT = 10
#: Lines of one key verified in a task; of more, each two chunks are verified together.
CHUNK = 512
#: Lines of a component that are decided in one task in a round; later lines are compared with those that stayed.
BLOCK = 1024


def allowed(a, b, threshold: int):
    """Edits allowed between lines of a and b characters."""
    return np.minimum(threshold, np.minimum(a, b) // PER_EDIT)


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment from 0, shift of its place) of the substrings to look up, the line's own segments first.

    The others are those that both the edits left of a segment and those right of it allow.
    """
    found = [
        (d, i, shift)
        for d in range(threshold + 1)
        for i in range(threshold + 1)
        for shift in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1)
    ]
    return sorted(found, key=lambda x: (x[0] != 0 or x[2] != 0, x))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, many: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(many, base)]))


def line_keys(code: np.ndarray, cut: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lines code[cut[i] : cut[i + 1]] (code points), a column for each probe, and whether there is one.

    Hashes of substrings come from sums over the whole batch; equal keys of different substrings only cost a look.
    """
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(code))[: len(code)], dtype=np.uint64)])
        back, size, k = _powers(_INVERSE, len(code)), np.diff(cut), threshold + 1
        keys, there = [], []
        for d, i, shift in probes(threshold):
            target = size - d
            each, longer = target // k, target % k
            start = cut[:-1] + each * i + np.maximum(longer - (k - i), 0) + shift
            end = start + each + (longer > k - 1 - i)
            ok = (target >= PER_EDIT) & (d <= allowed(target, size, threshold)) & (start >= cut[:-1]) & (end <= cut[1:])
            start, end = np.where(ok, start, 0), np.where(ok, end, 0)
            h = (sums[end] - sums[start]) * back[start]
            keys.append(mixed(h + mixed(target.astype(np.uint64) * np.uint64(k) + np.uint64(i))))
            there.append(ok)
    return np.stack(keys, 1), np.stack(there, 1)


def edits_within(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """Whether each pair is within `threshold` edits: a[p, :m[p]] and b[p, :n[p]], with |m - n| <= threshold < m.

    The vertical differences of a band of the distance table lie in one word for each pair, the band's lower end
    in the top bit, and all pairs go from column to column together; pairs that are past the threshold drop out.
    """
    one, top = np.uint64(1), np.uint64(63)
    pad = np.pad(a, ((0, 0), (threshold + 1, 2 * threshold + 2)), constant_values=np.iinfo(a.dtype).max)
    out = np.zeros(len(a), bool)
    live = np.flatnonzero(np.abs(m - n) <= threshold)
    vp = np.full(len(live), np.uint64((1 << 64) - (1 << (64 - threshold - 1))))
    vn, dist = np.zeros(len(live), np.uint64), np.full(len(live), threshold, np.int64)
    col = 0
    with np.errstate(over="ignore"):
        while len(live):
            c, x = b[live, col], np.zeros(len(live), np.uint64)
            for k in range(2 * threshold + 1):  # bit 63 - k: row col + threshold - k
                x |= (pad[live, col + 2 * threshold + 1 - k] == c).astype(np.uint64) << np.uint64(63 - k)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            sunk = col - (m[live] - threshold)  # columns since the band's lower end met the last row
            bit = np.where(sunk < 0, 0, np.uint64(62) - np.maximum(sunk, 0).astype(np.uint64)).astype(np.uint64)
            dist += np.where(sunk < 0, (~(d0 >> top) & one).astype(np.int64), ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
            vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
            col += 1
            ended = col >= n[live]
            out[live[ended & (dist <= threshold)]] = True
            # In the last row the distance can come down by one a column, of which there are 2 * threshold at most.
            stay = ~ended & (dist <= 3 * threshold)
            live, vp, vn, dist = live[stay], vp[stay], vn[stay], dist[stay]
    return out


def _matrix(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lines])
    out = np.zeros((len(lines), int(size.max()) + 1), np.uint32)
    flat = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    out[np.repeat(np.arange(len(lines)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def _counts(lines: list[str]) -> np.ndarray:
    """How often each line has each of 64 classes of characters: an edit changes two of the counts at most."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(row * 64 + (flat & 63), minlength=64 * len(lines)).reshape(-1, 64).astype(np.int32)


class _Group:
    """Lines of a batch, for which pairs of rows are verified many at a time."""

    def __init__(self, lines: list[str], threshold: int):
        self.lines, self.threshold, self.counts = lines, threshold, _counts(lines)
        self.size = np.array([len(x) for x in lines])

    def may_be(self, x, y: np.ndarray) -> np.ndarray:
        """Whether lengths and counts allow the pairs (x, y)."""
        most = allowed(self.size[x], self.size[y], self.threshold)
        ok = np.abs(self.size[x] - self.size[y]) <= most
        ok[ok] = np.abs(self.counts[x if np.isscalar(x) else x[ok]] - self.counts[y[ok]]).sum(1) <= 2 * most[ok]
        return ok

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        most = allowed(self.size[x], self.size[y], self.threshold)
        out[most == 0] = [self.lines[a] == self.lines[b] for a, b in zip(x[most == 0].tolist(), y[most == 0].tolist(), strict=True)]
        for edits in range(1, self.threshold + 1):
            todo = np.flatnonzero(most == edits)
            order = todo[np.argsort(self.size[x[todo]], kind="stable")]  # so that a block's lines are of like length
            for at in range(0, len(order), 2048):
                k = order[at : at + 2048]
                front = "" if min(self.size[x[k]].min(), self.size[y[k]].min()) > edits else " " * edits  # what both have in front costs no edit
                (a, m), (b, n) = _matrix([front + self.lines[r] for r in x[k].tolist()]), _matrix([front + self.lines[r] for r in y[k].tolist()])
                out[k] = edits_within(a, m, b, n, edits)
        return out

    def forest(self, rows: np.ndarray):
        """(x, y) rows that join what is linked within one large group.

        Pairs that lengths and counts allow are verified in rounds, a few of each row at first and ever more; pairs
        within a component that has formed are left out.
        """
        x, y = [], []
        for k, r in enumerate(rows[:-1].tolist()):
            near = rows[k + 1 :][self.may_be(r, rows[k + 1 :])]
            x.append(np.full(len(near), r))
            y.append(near)
        x, y, label, few = np.concatenate(x), np.concatenate(y), np.arange(int(rows[-1]) + 1), 1
        while len(x):
            head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            place = np.arange(len(x)) - np.repeat(head, np.diff(np.append(head, len(x))))
            now = place < few
            ok = self.linked(x[now], y[now])
            for a, b in zip(x[now][ok].tolist(), y[now][ok].tolist(), strict=True):
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    yield a, b
            rest = ~now & (label[x] != label[y])
            x, y, few = x[rest], y[rest], few * 4

    def near(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs (x, y), x before y, within each group of at most FEW rows."""
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, FEW):
            same = np.flatnonzero(group[small[lag:]] == group[small[:-lag]]) if lag < len(small) else []
            if not len(same):
                break
            ok = self.may_be(small[same], small[same + lag])
            x.append(small[same][ok])
            y.append(small[same + lag][ok])
        return np.concatenate(x), np.concatenate(y)

    def stays(self, sizes: np.ndarray) -> np.ndarray:
        """Which rows stay if those of each group are decided in order: a row goes if one before it that stays is near."""
        out = np.ones(len(self.lines), bool)
        x, y = self.near(sizes)
        ok = self.linked(x, y)
        order = np.lexsort((x[ok], y[ok]))
        for a, b in zip(x[ok][order].tolist(), y[ok][order].tolist(), strict=True):
            if out[a]:
                out[b] = False
        for first, n in zip((np.cumsum(sizes) - sizes)[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            kept = np.array([first])
            for r in range(first + 1, first + n):
                close = kept[self.may_be(r, kept)]
                if len(close) and self.linked(np.full(len(close), r), close).any():
                    out[r] = False
                else:
                    kept = np.append(kept, r)
        return out


#: Rows of a group up to which its pairs are formed together with those of other groups.
FEW = 24


def _links(threshold: int):
    def run(batches):
        for t, cut in grouped(batches, ["key", "i", "j"], 2 * CHUNK):
            ids = t["h1"].combine_chunks().to_numpy()
            own, sizes = _Group(t["line"].to_pylist(), threshold), np.diff(cut)
            a, b = own.near(sizes)
            pair = np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1)
            once = np.unique(pair, axis=0, return_index=True)[1]  # a pair may share several keys
            a, b = a[once], b[once]
            ok = own.linked(a, b)
            pairs = np.array([p for k in np.flatnonzero(sizes > FEW) for p in own.forest(np.arange(cut[k], cut[k + 1]))], np.int64).reshape(-1, 2)
            x, y = np.concatenate([a[ok], pairs[:, 0]]), np.concatenate([b[ok], pairs[:, 1]])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    return run


def _lines(df: DataFrame, *keep: str) -> DataFrame:
    """One row a line that is not blank: keep, pos, line and 128 bits that stand for it, h1 and h2."""
    rows = df.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _keyed(lines: DataFrame, threshold: int) -> DataFrame:
    """h1, h2, n (occurrences), doc (the least doc_id) and keys, for each line a batch has; the first threshold + 1 keys are its segments'."""

    def run(batches):
        for b in batches:
            for at, n, data, _ in slices(b, "line", 1 << 20):
                h1, h2, doc = (b.column(c).slice(at, n) for c in ("h1", "h2", "doc_id"))
                x, y = h1.to_numpy(), h2.to_numpy()
                order = np.lexsort((y, x))
                new = np.ones(n, bool)
                new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
                head = np.flatnonzero(new)
                one = order[head]
                least = np.minimum.reduceat(doc.fill_null(_NO_DOC).to_numpy()[order], head)
                code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
                size = pc.utf8_length(b.column("line").slice(at, n)).to_numpy().astype(np.int64)
                keep = np.zeros(n, bool)
                keep[one] = True
                code, first = code[np.repeat(keep, size)], np.flatnonzero(keep)
                keys, there = line_keys(code, np.concatenate([[0], np.cumsum(size[first])]), threshold)
                back = np.searchsorted(first, one)
                keys, there = keys[back], there[back]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)), pa.array(keys[there].view(np.int64)))
                take = pa.array(one)
                yield pa.RecordBatch.from_arrays([h1.take(take), h2.take(take), pa.array(np.diff(np.append(head, n))), pa.array(least), lists], ["h1", "h2", "n", "doc", "keys"])

    return lines.select("line", "h1", "h2", "doc_id").mapInArrow(run, "h1 long, h2 long, n long, doc long, keys array<long>")


_NO_DOC = (1 << 63) - 1


def _decided(texts: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """(h1, h2) of the lines that go because a line that stays is near; texts has h1, h2, doc and line.

    Components are decided in rounds, BLOCK lines of each in one task in the order of doc, h1 and h2; then the
    component's other lines are compared with those that stayed, in chunks. A component of at most BLOCK lines is done in one round.
    """
    order = ["doc", "h1", "h2"]
    open_ = checkpoint(texts.join(roots, texts["h1"] == roots["node"], "left").select(F.coalesce("root", "h1").alias("root"), *order, "line"))
    several = open_.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    open_ = checkpoint(open_.join(several, "root"))
    gone = open_.select("h1", "h2").limit(0)

    def block(batches):
        for t, cut in grouped(batches, ["root"], BLOCK):
            ok = _Group(t["line"].to_pylist(), threshold).stays(np.diff(cut))
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("root", "h1", "h2", "line")), pa.array(ok)], ["root", "h1", "h2", "line", "stays"])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = _Group([*left["line"], *right["line"]], threshold)
        kept = np.arange(len(left), len(own.lines))
        near = np.zeros(len(left), bool)
        for r in range(len(left)):
            close = kept[own.may_be(r, kept)]
            near[r] = len(close) > 0 and own.linked(np.full(len(close), r), close).any()
        return left.assign(near=near)

    while not open_.isEmpty():
        place = F.row_number().over(Window.partitionBy("root").orderBy(*order))
        first = open_.withColumn("place", place).where(F.col("place") <= BLOCK).drop("place", "n")
        first = checkpoint(first.repartition("root").sortWithinPartitions("root", *order).mapInArrow(block, "root long, h1 long, h2 long, line string, stays boolean"))
        gone = gone.unionByName(first.where("not stays").select("h1", "h2"))
        later = open_.where(F.col("n") > BLOCK).join(first.select("h1", "h2"), ["h1", "h2"], "left_anti")
        later = checkpoint(later.withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("h1", "h2"), F.col("chunks")).cast("int")))
        if later.isEmpty():
            break
        sizes = later.select("root", "chunks").distinct()
        kept = first.where("stays").join(sizes, "root").select("root", "line", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in later.schema.fields)
        later = checkpoint(later.groupBy("root", "chunk").cogroup(kept.groupBy("root", "chunk")).applyInPandas(compare, f"{kinds}, near boolean"))
        gone = gone.unionByName(later.where("near").select("h1", "h2"))
        left = later.where("not near").select("root", *order, "line")
        open_ = checkpoint(left.join(left.groupBy("root").agg(F.count("*").alias("n")), "root"))
    return checkpoint(gone)


def decisions(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(h1, h2, doc, goes) of the lines that occur twice or go: all occurrences if `goes`, else all but one in the document doc."""
    lines = _lines(df.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    keyed = checkpoint(_keyed(lines, threshold))
    several = checkpoint(keyed.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("doc").alias("doc")).where("n > 1").select("h1", "h2", F.when(F.col("doc") < _NO_DOC, F.col("doc")).alias("doc")))
    each = keyed.select("h1", "h2", F.posexplode("keys").alias("probe", "key"))
    keys = checkpoint(each.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"))
    shared = each.join(sized(keys), "key", "left_semi").groupBy("key", "h1", "h2").agg((F.min("probe") <= threshold).alias("own"))
    shared = checkpoint(shared)
    release(keyed)
    owned = checkpoint(shared.groupBy("key").agg(F.max("own").alias("own"), F.count("*").alias("n")).where("own and n > 1").select("key", "n"))
    shared = shared.join(sized(owned), "key").select("key", "h1", "h2", "n")
    nodes = checkpoint(shared.select("h1", "h2").distinct())
    texts = lines.join(sized(nodes), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("line").alias("line"))
    texts = checkpoint(texts.withColumn("doc", F.coalesce("doc", F.lit(_NO_DOC))))
    split = shared.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    split = split.withColumn("c", F.pmod("h1", F.col("chunks").cast("long")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    split = split.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "h1", "h2").join(sized(texts.select("h1", "h2", "line")), ["h1", "h2"]).select("key", "i", "j", "h1", "line")
    links = split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links(threshold), "a long, b long")
    gone = _decided(texts, components(links), threshold).withColumn("goes", F.lit(True))
    once = several.join(sized(gone), ["h1", "h2"], "left_anti").withColumn("goes", F.lit(False))
    return checkpoint(once.unionByName(gone.withColumn("doc", F.lit(None).cast("long"))))


def _with_hits(df: DataFrame, threshold: int) -> DataFrame:
    """df's columns and pw__hits, the lines of each document that decisions() names: place, line, document and whether all go."""
    base = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("pw__h"), "text")
    found = decisions(base, threshold)
    hits = _lines(base, "doc_id", "pw__h").drop("line").join(sized(found), ["h1", "h2"])
    hits = checkpoint(hits.groupBy(F.col("doc_id").alias("pw__id"), "pw__h").agg(F.collect_set(F.struct("pos", "h1", "h2", "doc", "goes")).alias("pw__hits")))
    docs = df.withColumn("pw__h2", F.xxhash64("text"))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("pw__id")) & (F.col("pw__h2") == F.col("pw__h"))
    return docs.join(hits, here, "left").select(*[F.col(f"`{c}`") for c in df.columns], "pw__hits")


def _kept(text: str | None, doc, hits) -> tuple[str | None, int, int]:
    """The text without the lines that go, its lines and how many went; a line's first place in the document that keeps it stays."""
    if text is None:
        return None, 0, 0
    if not hits:
        return text, text.count("\n") + 1, 0
    lines, gone, seen = text.split("\n"), set(), set()
    for x in sorted(hits, key=lambda x: x["pos"]):
        if not x["goes"] and x["doc"] == doc and (x["h1"], x["h2"]) not in seen:
            seen.add((x["h1"], x["h2"]))
        else:
            gone.add(x["pos"])
    return "\n".join([x for k, x in enumerate(lines) if k not in gone]), len(lines), len(gone)


def dedup_lines(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text without the lines that go, n_lines and n_removed of every document.

    Blank lines stay. Of equal lines the first in the document with the least doc_id stays; of lines within
    allowed() edits, lines are decided in the order of their least doc_id, and one goes only if one that stays is near.
    A null text stays null with no lines; rows with equal ids count as one document and keep the same; rows with
    a null id come after all others and keep what only they have; an empty table gives an empty result. Other
    columns are not read. Hits of one document are held with it, so memory is bounded by the longest text.
    """
    joined = _with_hits(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                doc, text, hit = (b.column(i).slice(at, 512).to_pylist() for i in range(3))
                out = [_kept(*x) for x in zip(text, doc, hit, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "text", "n_lines", "n_removed"])

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long")


def filter_lines(df: DataFrame, threshold: int = THRESHOLD, least: float | None = None) -> DataFrame:
    """df with the lines that dedup_lines takes out taken out of text, and n_chars, if there, as the new length; all other columns stay.

    Documents stay, whatever is left of them, unless `least` is given: the share of a text's characters that has to
    remain. Null texts stay.
    """
    joined = _with_hits(df, threshold)
    names, kinds = df.columns, df.schema

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                said = part.column(names.index("text")).to_pylist()
                ids = part.column(names.index("doc_id")).cast(pa.int64()).to_pylist()
                text = [_kept(*x)[0] for x in zip(said, ids, part.column(len(names)).to_pylist(), strict=True)]
                new = {"text": pa.array(text, pa.string()), "n_chars": pa.array([None if x is None else len(x) for x in text], pa.int64())}
                columns = [new[c].cast(part.column(k).type) if c in new else part.column(k) for k, c in enumerate(names)]
                out = pa.RecordBatch.from_arrays(columns, names)
                if least is not None:
                    out = out.filter(pa.array([x is None or len(y) >= least * len(x) for x, y in zip(said, text, strict=True)]))
                yield out

    return joined.mapInArrow(run, kinds)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
