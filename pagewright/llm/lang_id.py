"""Language identification by a byte convolutional network, trained in numpy on a bounded sample of labelled text.

Filters of widths 2, 3 and 4 over bytes, a rectifier, max pooling over a window and a softmax. A text is cut into
windows of WINDOW bytes, all of them scored; its probabilities are the mean of its windows', weighted by length.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The sample that is learned from: documents a language, characters of each from a place that its id says, and languages (those with most documents in the sample).
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 400, 1024, 100
STEPS, BATCH, SEED = 500, 64, 7
UNDETERMINED = "und"
#: First and last letters of the alphabets that texts to reject are drawn from, and the signs.
ALPHABETS = ((0x61, 0x7A), (0x61, 0x7A), (0x100, 0x17F), (0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x3041, 0x30F6), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
SIGNS = "0123456789!\"#$%&'()*+,-./:;<=>?@[]^_{|}~"


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows of all texts, the text and the bytes of each."""
    length = np.diff(offsets)
    many = -(-length // WINDOW)
    owner = np.repeat(np.arange(len(length)), many)
    first = np.cumsum(many) - many
    flat = np.zeros(int(many.sum()) * WINDOW, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], length)] = data
    used = np.minimum(length[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW, WINDOW)
    return flat.reshape(-1, WINDOW), owner, used


class ByteNetwork:
    """Parameters: for each width w a table [w, 256, FILTERS] and bias, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.table = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _params(self) -> list[np.ndarray]:
        return [*self.table, *self.bias, self.out, self.out_bias]

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = SEED) -> ByteNetwork:
        """Adam on the cross entropy; only the pooled position of each filter has a gradient."""
        rng = np.random.default_rng(seed)
        params = self._params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(windows), BATCH)
            x, y = windows[pick], labels[pick]
            pooled, where = [], []
            for table, bias, w in zip(self.table, self.bias, WIDTHS, strict=True):
                conv = sum(table[k][x[:, k : WINDOW - w + 1 + k]] for k in range(w))
                at = conv.argmax(1)
                where.append(at)
                pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0] + bias)
            z = np.concatenate(pooled, 1)
            h = np.maximum(z, 0)
            p = _softmax(h @ self.out + self.out_bias)
            p[np.arange(BATCH), y] -= 1
            p /= BATCH
            back = (p @ self.out.T) * (z > 0)
            grads = []
            for i, (table, w) in enumerate(zip(self.table, WIDTHS, strict=True)):
                g, b = np.zeros_like(table), back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (x[np.arange(BATCH)[:, None], where[i] + k], np.arange(FILTERS)[None, :]), b)
                grads.append(g)
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))] + [h.T @ p, p.sum(0)]
            for a, g, m1, v1 in zip(params, grads, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                a -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
        return self

    def compiled(self):
        """Tables for pairs of bytes, which take the place of the filters: [65536, 3 * FILTERS], [65536, FILTERS] and [256, FILTERS]."""
        t2, t3, t4 = self.table
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return np.ascontiguousarray(np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1])], 1)), pair(t4[2], t4[3]), t3[2]

    def probabilities(self, windows: np.ndarray, compiled=None, block: int = 256) -> np.ndarray:
        first, second, third = compiled or self.compiled()
        bias, out = np.concatenate(self.bias), []
        for at in range(0, len(windows), block):
            x = windows[at : at + block]
            pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
            a = first[pairs]
            z = [a[:, :, :FILTERS].max(1), (a[:, :-1, FILTERS : 2 * FILTERS] + third[x[:, 2:]]).max(1), (a[:, :-2, 2 * FILTERS :] + second[pairs[:, 2:]]).max(1)]
            out.append(_softmax(np.maximum(np.concatenate(z, 1) + bias, 0) @ self.out + self.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is held out of nothing but never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(df: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of SAMPLE_DOCS documents a language at most, those with the smallest hashes of their ids, of LANGUAGES languages at most.

    Only rows that can be learned from count: neither held-out documents' labels nor texts without a letter are looked at.
    """
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    start = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    rows = rows.select("lang", "doc_id", F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS)
    rows = checkpoint(rows)
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    return [(r["lang"], r["text"]) for r in sorted(rows.where(F.col("lang").isin(known)).collect(), key=lambda r: (r["lang"], r["r"]))] if known else []


def train(rows: list[tuple[str, str]]) -> ByteNetwork | None:
    languages = sorted({x for x, _ in rows})
    if not languages:
        return None
    raw = [t.encode() for _, t in rows]
    x, owner, used = _windows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    y = np.array([languages.index(k) for k, _ in rows])[owner]
    full = used >= 32
    if not full.any():
        full[:] = True
    return ByteNetwork(languages).fit(x[full], y[full])


def rejects(many: int) -> list[tuple[str, str]]:
    """Texts in no language, labelled UNDETERMINED: a third of signs and digits, the others of evenly drawn letters of one alphabet.

    An alphabet of which a learned language makes use is drawn from as well: there, what is learned is that its letters come in no order.
    """
    rng, out = random.Random(SEED), []
    for k in range(many):
        a, b = ALPHABETS[k % len(ALPHABETS)]
        draw = (lambda: rng.choice(SIGNS)) if k % 3 == 0 else lambda a=a, b=b: chr(rng.randint(a, b))
        out.append((UNDETERMINED, " ".join("".join(draw() for _ in range(rng.randint(1, 10))) for _ in range(80))))
    return out


def predict(df: DataFrame, network: ByteNetwork | None, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, the language and its score (0 to 1) under `names`; `und` and 0 where the text is null or has no letter, or nothing was learned."""
    src = df.select(F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("pw__scanned"), *keep)
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    if network is None:
        return src.select(*keep, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]))
    held = df.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = held.value
        tables = net.compiled()
        said = np.array([*net.languages, UNDETERMINED], object)
        for b in batches:
            for at, n, data, offsets in slices(b, 0, 1 << 20):
                x, owner, used = _windows(data, offsets)
                p = net.probabilities(x, tables) * used[:, None]
                total = np.stack([np.bincount(owner, p[:, k], n) for k in range(p.shape[1])], 1) / np.maximum(np.diff(offsets), 1)[:, None]
                best = np.where(np.diff(offsets) > 0, total.argmax(1), len(net.languages))
                score = np.clip(total.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[1:]), pa.array(said[best].tolist(), pa.string()), pa.array(score)], [*keep, *names])

    return src.mapInArrow(run, f"{kinds}, {names[0]} string, {names[1]} double")


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Only documents that are not held out, and have text, an id and a language, are learned from. Repeated rows
    each come back; an empty table gives an empty result. Other columns are not read.
    """
    return predict(df.withColumn("held_out", held_out()), train(sample(df)), "doc_id", "held_out")
