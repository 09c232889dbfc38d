"""Near duplicates: SimHash with pigeonhole blocks and exact Hamming distances; wide SimHash fingerprints that propose, with exact shingle similarity."""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, grouped, mixed, sized, slices, xxh64

SEED = 42
#: Rows of a block's bucket compared in one task; a larger bucket is cut into such chunks, which are compared pair by pair.
CHUNK = 2048
#: Words of the fingerprints that propose similar sets.
WORDS = 4
#: Sets that a key of such fingerprints is to hold, about, and the size from which it is cut into chunks.
HELD, HELD_MOST = 4096, 1 << 15
#: Tables within a key, and their bits.
TABLES, TABLE_BITS = 24, 10
#: Sets of a group whose shingles are compared in one task, cut like CHUNK.
SETS = 512
#: Shingles of a set up to which its fingerprint says too little; such sets get keys of single shingles as well.
SHORT = 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bits(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many of the hashes of each run set each of the 64 bits."""
    out = np.zeros((len(cut) - 1, 64), np.int64)
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        for at in range(a, b, 255):  # so many that a byte holds their sum
            out[k] += np.add.reduce(np.unpackbits(h[at : min(b, at + 255)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), 0, np.uint8)
    return out


def identity(fps: np.ndarray) -> np.ndarray:
    """One word for each row of fingerprint words: the word itself if there is one."""
    out = fps[:, 0]
    for k in range(1, fps.shape[1]):
        out = mixed(out) ^ fps[:, k]
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of all shingles of the texts data[offsets[i]:offsets[i + 1]] (UTF-8), and where each text's begin and the last end."""
    docs = len(offsets) - 1
    gap = _SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[head] = ~gap[head]
    last = ~gap
    last[:-1] &= gap[1:]
    tail = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tail] = ~gap[tail]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    length = e - s
    to = np.concatenate([[0], np.cumsum(length + 1)])  # each word and a space, one after another
    joined = np.full(to[-1], 32, np.uint8)
    keep = ~gap
    where = np.arange(len(data), dtype=np.int64)[keep]
    joined[where + np.repeat(to[:-1] - s, length)] = _LOWER[data[keep]]
    before = np.searchsorted(s, offsets)  # the words before each text
    count = np.diff(before)
    many = np.maximum(count - shingle + 1, np.minimum(count, 1))
    cut = np.concatenate([[0], np.cumsum(many)])
    i = np.repeat(before[:-1] - cut[:-1], many) + np.arange(cut[-1])
    j = np.minimum(i + shingle, np.repeat(before[1:], many)) - 1
    return xxh64(joined, to[i], to[j] + length[j] - to[i], SEED), cut


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, words: int = 1) -> np.ndarray:
    """Fingerprints of the texts, a row of `words` 64-bit words each: the first from the shingles' XXH64, the others from that hash mixed again."""
    h, cut = shingles(data, offsets, shingle)
    docs, many = len(offsets) - 1, np.diff(cut)
    out = np.zeros((docs, words), np.uint64)
    for k in range(words):
        x = h if k == 0 else mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        out[:, k] = np.packbits(_bits(x, cut) * 2 > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(df: DataFrame, shingle: int, words: int, *keep: str) -> DataFrame:
    """The columns `keep`, id (the fingerprint's identity) and its words f0, f1, ...; of the column text. Null and wordless texts get zeros."""
    src = df.select(F.col("text").alias("_scanned"), *keep)
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        for b in batches:
            fps = [fingerprints(d, o, shingle, words) for _, _, d, o in slices(b, 0, 1 << 20)]
            if fps:
                fps = np.concatenate(fps)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(identity(fps).view(np.int64)), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(words))], [*keep, "id", *names])

    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, id long, " + ", ".join(f"{x} long" for x in names))


def agreeing(fingerprints: int) -> int:
    """Blocks that a key holds: the more fingerprints, the more bits a key needs so that few share it by chance (21, 27 or 32)."""
    return 2 if fingerprints <= 1 << 22 else 3 if fingerprints <= 1 << 28 else 4


def pigeonhole_keys(fps: DataFrame, distance: int, agree: int = 2) -> DataFrame:
    """(key, f0): with distance + agree blocks, two fingerprints that differ in `distance` bits at most are equal in `agree` of them; a key for each such choice."""
    n = distance + agree
    edges = [64 * k // n for k in range(n + 1)]
    part = [F.shiftrightunsigned("f0", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    wide = max(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))
    keys = []
    for k, blocks in enumerate(combinations(range(n), agree)):
        key = F.lit(k).cast("long")
        for x in blocks:
            key = F.shiftleft(key, wide).bitwiseOR(part[x])
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "f0")


def _forest(fps: np.ndarray, distance: int):
    """Edges that join what is linked within one bucket: a search that leaves each fingerprint once."""
    rest = np.arange(len(fps))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]).sum(1, dtype=np.int64) <= distance
            if near.any():
                found = rest[near]
                yield np.full(len(found), x), found
                frontier += found.tolist()
                rest = rest[~near]


def _links(distance: int, words: int):
    def run(batches):
        for t, cut in grouped(batches, ["key", "i", "j"], 2 * CHUNK):
            fps = np.stack([t[f"f{k}"].combine_chunks().to_numpy().view(np.uint64) for k in range(words)], 1)
            sizes = np.diff(cut)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.flatnonzero(np.repeat(sizes <= 24, sizes))
            g = group[small]
            a, b = [], []
            for lag in range(1, 24):
                same = np.flatnonzero(g[lag:] == g[:-lag]) if lag < len(g) else []
                if not len(same):
                    break
                x, y = small[same], small[same + lag]
                near = np.bitwise_count(fps[x] ^ fps[y]).sum(1, dtype=np.int64) <= distance
                a.append(x[near])
                b.append(y[near])
            for k in np.flatnonzero(sizes > 24):
                for x, y in _forest(fps[cut[k] : cut[k + 1]], distance):
                    a.append(x + cut[k])
                    b.append(y + cut[k])
            if a:
                ids = identity(fps).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(a)]), pa.array(ids[np.concatenate(b)])], ["a", "b"])

    return run


def hamming_links(rows: DataFrame, words: int, distance: int) -> DataFrame:
    """(a, b) identities of fingerprints that span the same components as all pairs within `distance` that share a key.

    A bucket of over CHUNK fingerprints is cut into chunks by hash, and each two chunks are compared in a task
    of their own, so that no task holds more than two chunks whatever the size of the bucket.
    """
    names = [f"f{k}" for k in range(words)]
    return _chunked(rows.select("key", *names), F.xxhash64(*names), CHUNK).mapInArrow(_links(distance, words), "a long, b long")


def _chunked(rows: DataFrame, spread, chunk: int) -> DataFrame:
    """The rows by key and two chunks i <= j, sorted so; a key of over `chunk` rows is cut by `spread`, and each two chunks meet."""
    names = [c for c in rows.columns if c != "key"]
    hot = checkpoint(rows.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    if hot.count():
        rows = rows.join(sized(hot), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("c", F.pmod(spread, F.col("chunks").cast("long")).cast("int"))
        rows = rows.select(*names, "key", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
        rows = rows.select(*names, "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    else:
        rows = rows.select(*names, "key", F.lit(0).alias("i"), F.lit(0).alias("j"))
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _classes(df: DataFrame, shingle: int, words: int, distance: int, keys) -> DataFrame:
    """doc_id, f0 and component_id of every row."""
    base = checkpoint(with_fingerprints(df, shingle, words, "doc_id"))
    names = [f"f{k}" for k in range(words)]
    least = checkpoint(base.groupBy("id", *names).agg(F.min("doc_id").alias("least")))
    roots = components(hamming_links(keys(least), words, distance))
    return base.join(_smallest(least, roots), "id").select("doc_id", "f0", "component_id")


def _smallest(least: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, component_id) from (id, least) and the components' (node, root): only components of several ids are grouped, whose rows stay where they are if these are few."""
    linked = least.join(roots, least["id"] == roots["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    several = checkpoint(roots.select("root").distinct())
    smallest = checkpoint(linked.join(sized(several), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id")))
    return linked.join(sized(smallest), "root", "left").select("id", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(df: DataFrame, shingle: int = 5, distance: int = 4, id_column: str = "doc_id") -> DataFrame:
    """Each row's id, fingerprint (16 hex digits) and component_id, the smallest id its fingerprint reaches over links.

    Texts are lower-cased in A-Z and cut at ASCII white space; a shingle is that many words. A null or wordless
    text has fingerprint zero and links like any other; repeated rows each come back; a null id stays null and is
    never a component's id unless it has no other. An empty table gives an empty result. Other columns are not read.
    """
    out = _classes(df.select(F.col(id_column).alias("doc_id"), "text"), shingle, 1, distance, lambda fps: pigeonhole_keys(fps, distance, agreeing(fps.count())))
    return out.select(F.col("doc_id").alias(id_column), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _sets(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in order, and where each text's begin."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(cut)))


def _set_ids(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return xxh64(np.ascontiguousarray(h).view(np.uint8), 8 * cut[:-1], 8 * np.diff(cut), SEED).view(np.int64)


def _signatures(df: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, id (of the set of shingles), n (shingles of it), its fingerprint f0, f1, ..., and prefix (the least shingles of short sets).

    Two sets of a similarity of s or more share one of the n - ceil(s n) + 1 least shingles of each.
    """
    names = [f"f{k}" for k in range(WORDS)]

    def run(batches):
        for b in batches:
            for at, many, data, offsets in slices(b, 0, 1 << 20):
                h, cut = _sets(*shingles(data, offsets, shingle))
                n = np.diff(cut)
                fps = [np.packbits(_bits(h if k == 0 else mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))), cut) * 2 > n[:, None], axis=1, bitorder="little").view(np.int64).ravel() for k in range(WORDS)]
                least = np.where(n <= SHORT / similarity, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + (n > 0), 0)
                to = np.concatenate([[0], np.cumsum(least)])
                prefix = h[np.repeat(cut[:-1] - to[:-1], least) + np.arange(to[-1])]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, many), pa.array(_set_ids(h, cut)), pa.array(n.astype(np.int64)), *map(pa.array, fps), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(prefix.view(np.int64)))], ["doc_id", "id", "n", *names, "prefix"])

    kinds = ", ".join(f"{x} long" for x in names)
    return df.select("text", "doc_id").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, id long, n long, {kinds}, prefix array<long>")


def _grams(df: DataFrame, shingle: int) -> DataFrame:
    """id and grams, the set's hashes."""

    def run(batches):
        for b in batches:
            for _, _, data, offsets in slices(b, 0, 1 << 20):
                h, cut = _sets(*shingles(data, offsets, shingle))
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(h, cut)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "grams"])

    return df.select("text").mapInArrow(run, "id long, grams array<long>")


def differing(similarity: float) -> float:
    """The share of bits in which the fingerprints of two sets of that similarity differ: the angle of the sets, in half turns."""
    return acos(2 * similarity / (1 + similarity)) / pi


def key_bits(sets: int) -> int:
    """The bits of a key, so that it holds HELD of so many sets."""
    return max(0, ceil(log2(max(1, sets) / HELD)))


def key_groups(bits: int, similarity: float, missed: float = 1e-6) -> int:
    """Keys a set gets so that two sets of that similarity share a table of none with a probability of `missed`."""
    same = 1 - differing(similarity)
    found = same**bits * (1 - (1 - same**TABLE_BITS) ** TABLES)
    return ceil(log(missed) / log(1 - found))


def _sampled(bits: int, groups: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bits of each group's key and those of each of its tables."""
    rng = np.random.default_rng(SEED)
    picks = [rng.permutation(64 * WORDS) for _ in range(groups)]
    return [(p[:bits], np.stack([rng.permutation(p[bits:])[:TABLE_BITS] for _ in range(TABLES)])) for p in picks]


def _value(fps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits `at` of each fingerprint, as a number."""
    out = np.zeros(len(fps), np.int64)
    for x in at.tolist():
        out = out << 1 | (fps[:, x >> 6] >> np.uint64(x & 63) & np.uint64(1)).astype(np.int64)
    return out


def similarity_keys(sets: DataFrame, bits: int, groups: int) -> DataFrame:
    """key, id, n, f0, f1, ...: a row for each group's key (not negative) and for each shingle of the prefix (negative)."""
    names = [f"f{k}" for k in range(WORDS)]
    picks = [at for at, _ in _sampled(bits, groups)]

    def run(batches):
        for b in batches:
            full = np.flatnonzero(b.column("n").to_numpy() > 0)
            b = b.take(pa.array(full))
            fps = np.stack([b.column(x).to_numpy().view(np.uint64) for x in names], 1)
            prefix = b.column("prefix")
            own = np.repeat(np.arange(len(full)), prefix.value_lengths().to_numpy())
            single = prefix.flatten().to_numpy() | np.int64(-(1 << 63))
            rest = b.select(["id", "n", *names])
            for g, at in enumerate(picks):
                yield pa.RecordBatch.from_arrays([pa.array(_value(fps, at) | g << 40), *rest.columns], ["key", "id", "n", *names])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(single), *rest.take(pa.array(own)).columns], ["key", "id", "n", *names])

    return sets.select("id", "n", *names, "prefix").mapInArrow(run, "key long, id long, n long, " + ", ".join(f"{x} long" for x in names))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least row of its class) after the classes of a[i] and b[i] are made one."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _stars(ids: np.ndarray, label: np.ndarray):
    several = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[label[several]]), pa.array(ids[several])], ["a", "b"])


def _proposed(similarity: float, bits: int, groups: int):
    """(a, b) that span the components of the sets near one another by fingerprint that share a table of a key."""
    picks = [tables for _, tables in _sampled(bits, groups)]
    share = differing(similarity)
    # 4.5 standard deviations; sets of few shingles differ more (four of five have 0.1875).
    most = [ceil(64 * WORDS * x + 4.5 * sqrt(64 * WORDS * x * (1 - x))) for x in (share, max(share, 0.1875))]

    def run(batches):
        for t, cut in grouped(batches, ["key", "i", "j"], 2 * HELD_MOST):
            keys, ids_, n_ = (t[x].combine_chunks().to_numpy() for x in ("key", "id", "n"))
            all_ = np.stack([t[f"f{k}"].combine_chunks().to_numpy().view(np.uint64) for k in range(WORDS)], 1)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                fps, n, key = all_[lo:hi], n_[lo:hi], int(keys[lo])
                near = lambda x, y, fps=fps, n=n, d=most[key < 0]: (np.bitwise_count(fps[x] ^ fps[y]).sum(-1, dtype=np.int64) <= d) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
                label = np.arange(hi - lo)
                for at in [np.zeros(0, np.int64)] if key < 0 else picks[key >> 40]:
                    label = _near_in_table(_value(fps, at), label, near)
                yield _stars(ids_[lo:hi], label)

    return run


def _near_in_table(value: np.ndarray, label: np.ndarray, near) -> np.ndarray:
    """Labels after all rows of equal value that are near are joined; rows of one class already are not compared."""
    order = np.argsort(value, kind="stable")
    sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(value[order])) + 1, [len(value)]]))
    start = np.cumsum(sizes) - sizes
    large = np.repeat(sizes > 24, sizes)
    small, v = order[~large], value[order[~large]]
    for lag in range(1, 24):
        same = np.flatnonzero(v[lag:] == v[:-lag]) if lag < len(v) else []
        if not len(same):
            break
        x, y = small[same], small[same + lag]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
        found = near(x, y)
        label = _join(label, x[found], y[found])
    for k in np.flatnonzero(sizes > 24).tolist():
        rest = order[start[k] : start[k] + sizes[k]]
        while len(rest) > 1:  # a search that leaves each row once
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                x = frontier.pop()
                found = near(x, rest)
                if found.any():
                    label = _join(label, np.full(found.sum(), x), rest[found])
                    frontier += rest[found].tolist()
                    rest = rest[~found]
    return label


def _verified(similarity: float):
    """(a, b) that span the components of the sets of a group whose exact similarity is enough: shingles in common are counted by posting lists."""

    def run(batches):
        for t, cut in grouped(batches, ["key", "i", "j"], 2 * SETS):
            ids, grams = t["id"].combine_chunks().to_numpy(), t["grams"].combine_chunks()
            offsets, values = grams.offsets.to_numpy().astype(np.int64), grams.values.to_numpy()
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                to = offsets[lo : hi + 1] - offsets[lo]
                h, n = values[offsets[lo] : offsets[hi]], np.diff(to)
                order = np.argsort(h, kind="stable")
                by, owner = h[order], np.repeat(np.arange(hi - lo), n)[order]
                first = np.searchsorted(by, h)
                place = np.empty(len(h), np.int64)
                place[order] = np.arange(len(h))
                before = place - first  # sets earlier in the group that have the shingle
                label = np.arange(hi - lo)
                for x in range(1, hi - lo):
                    many = before[to[x] : to[x + 1]]
                    at = np.repeat(first[to[x] : to[x + 1]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    both = np.bincount(owner[at], minlength=x)
                    found = np.flatnonzero((both >= similarity * (n[x] + n[:x] - both) - 1e-9) & (label[:x] != label[x]))
                    if len(found):
                        label = _join(label, np.full(len(found), x), found)
                yield _stars(ids[lo:hi], label)

    return run


def similar(df: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id over links of that similarity (Jaccard, of sets of shingles) or more.

    SimHash proposes: sets whose fingerprints of 64 * WORDS bits agree in the sampled bits of a key and of a table within it, and differ
    in no more bits than sets of that similarity do, are joined to loose groups. Two sets of that similarity share no table with
    a probability of about 1e-6; sets of few shingles get exact keys besides. Within a loose group all sets are compared by
    their shingles, and only links of that similarity count. Edges that span a group are all that a task returns, so no
    row is made for a pair, and a large group of near copies is cut into chunks of SETS that are compared two by two.
    Texts without a word are equal; rows are treated as in near_duplicates.
    """
    names = [f"f{k}" for k in range(WORDS)]
    base = checkpoint(_signatures(df, shingle, similarity))
    sets = checkpoint(base.groupBy("id", "n", *names).agg(F.min("doc_id").alias("least"), F.first("prefix").alias("prefix")))
    bits = key_bits(sets.count())
    groups = key_groups(bits, similarity)
    keys = _chunked(similarity_keys(sets, bits, groups), F.xxhash64("id"), HELD_MOST)
    loose = components(keys.mapInArrow(_proposed(similarity, bits, groups), "a long, b long"))
    members = checkpoint(loose.select(F.col("node").alias("id"), F.col("root").alias("key")).unionByName(loose.select(F.col("root").alias("id"), F.col("root").alias("key")).distinct()))
    grams = checkpoint(_grams(df, shingle).join(sized(members), "id").dropDuplicates(["id"]))
    links = _chunked(grams, F.xxhash64("id"), SETS).mapInArrow(_verified(similarity), "a long, b long")
    return base.join(_smallest(sets, components(links)), "id").select("doc_id", "component_id")
