"""Exact encoding of whole columns of texts with a public word-level BPE tokenizer of the tokenizers library."""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Entries of the cache of words that go through the library one by one, of which there are two generations: they bound a worker's memory.
WORDS = 150_000
#: Characters of a word up to which its merges are made in arrays; a longer one goes through the library.
LONGEST = 64
#: Distinct words whose merges are made together: few enough for the processor's cache.
CHUNK = 8192
#: Places of the table of merges, a power of two; a vocabulary of 16 bits has fewer merges than a quarter of it.
_PLACES = 1 << 18
_NONE = np.int64(1) << 40

# The byte alphabet of byte-level BPE.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}
#: Characters that lower-casing and NFC treat one by one, that are no white space and begin neither a contraction nor a special token.
_PLAIN = regex.compile(r"[\x21-\x7e¡-¬®-įĲ-ſ--['<]]", regex.V1).match

_LIMIT = 0x800  # code points of one or two bytes
_OK = np.array([c < 0x180 and bool(_PLAIN(chr(c))) for c in range(_LIMIT)])
_LOW = np.array([ord(chr(c).lower()) if _OK[c] else 0 for c in range(_LIMIT)])
_KIND = np.array([1 if regex.match(r"\p{L}", chr(c)) else 2 if regex.match(r"\p{N}", chr(c)) else 3 for c in range(_LIMIT)], np.int8)


class _Library(dict):
    """Ids of words by the library itself, in two generations: a full one becomes the old one, from which entries still in use come back."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}

    def __missing__(self, word: str) -> np.ndarray:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint16)
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """encode_all(texts, end): the ids that tokenizer.encode(text, add_special_tokens=False) gives, as uint16, and `end` after each text's.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words, cut at
    spaces and line feeds; each distinct word of a slice is encoded once. Words of plain Latin letters, digits and
    signs have the merges of the library's own table made in arrays, all words together; others go through the library.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of over 16 bits")
        if sys.byteorder != "little":
            raise ValueError("ids are kept in the machine's order, which must be little-endian")
        self.library = _Library(tokenizer)
        model = json.loads(tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab.get(_BYTE[b], -1) for b in range(256)])
        self.final = np.array([vocab.get(_BYTE[b] + suffix, -1) for b in range(256)])
        pairs = [(vocab[a] << 16 | vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.merged = np.array([x for _, x in pairs])
        self.keys, self.ranks = np.full(_PLACES, -1), np.full(_PLACES, _NONE)
        for rank, (key, _) in enumerate(pairs):
            at = int(self._place(np.array([key]))[0])
            while self.keys[at] not in (-1, key):
                at = (at + 1) % _PLACES
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = key, rank

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; _NONE for those that never merge."""
        key = a << 16 | b
        at = self._place(key)
        found = self.keys[at]
        while len(other := np.flatnonzero((found != key) & (found != -1))):
            at[other] = (at[other] + 1) % _PLACES
            found[other] = self.keys[at[other]]
        return np.where(found == key, self.ranks[at], _NONE)

    def _merge(self, s: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merge the symbols s of pieces, in place: of each piece the pair of least rank, the first of equals, as long as there is one. Which symbols stay."""
        alive = np.ones(len(s), bool)
        q = np.arange(len(s))
        r = np.full(len(s), _NONE)
        r[:-1] = np.where(piece[1:] == piece[:-1], self._rank(s[:-1], s[1:]), _NONE)
        while len(q):
            p = piece[q]
            head = np.flatnonzero(np.diff(p, prepend=-1))
            best = np.minimum.reduceat(r << 22 | np.arange(len(q)), head)
            live = best < _NONE << 22
            i = best[live] & ((1 << 22) - 1)
            rank = r[i]
            s[q[i]] = self.merged[rank]
            alive[q[i + 1]] = False
            stay = np.repeat(live, np.diff(np.append(head, len(q))))
            stay[i + 1] = False
            r[i] = -1  # to be found again, like the pair before
            before = i[i > 0] - 1
            r[before[p[before] == p[before + 1]]] = -1
            q, r = q[stay], r[stay]
            again = np.flatnonzero(r == -1)
            after = np.minimum(again + 1, len(q) - 1)
            joined = (after > again) & (piece[q[again]] == piece[q[after]])
            r[again] = np.where(joined, self._rank(s[q[again]], s[q[after]]), _NONE)
        return alive

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has)."""
        _, off, data = words.buffers()
        off = np.frombuffer(off, np.int32, len(words) + 1 + words.offset)[words.offset :].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        off = off - off[0]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[lead].astype(np.int64)
        second = np.append(data, np.uint8(0))[lead + 1].astype(np.int64)
        code = np.where(first < 0x80, first, np.where(first < 0xE0, (first & 0x1F) << 6 | second & 0x3F, 0))
        begin = np.searchsorted(lead, off)
        count = np.diff(begin)
        owner = np.repeat(np.arange(len(words)), count)
        slow = (np.bincount(owner, ~_OK[code], minlength=len(words)) > 0) | (count > LONGEST)
        plain = ~slow[owner]
        code, owner = _LOW[code[plain]], owner[plain]
        kind = _KIND[code]
        cut = np.ones(len(code), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        wide = 1 + (code >= 0x80)
        at = np.cumsum(wide) - wide
        raw = np.zeros(int(wide.sum()), np.int64)
        raw[at] = np.where(code < 0x80, code, 0xC0 | code >> 6)
        raw[(at + 1)[wide == 2]] = 0x80 | code[wide == 2] & 0x3F
        piece, word = np.repeat(np.cumsum(cut), wide), np.repeat(owner, wide)
        last = np.ones(len(raw), bool)
        last[:-1] = piece[1:] != piece[:-1]
        s = np.where(last, self.final[raw], self.inner[raw])
        if (s < 0).any():
            raise ValueError("a byte without a symbol of its own")
        alive = self._merge(s, piece)
        many = np.bincount(word[alive], minlength=len(words))
        start = np.cumsum(many) - many
        ids = [s[alive].astype(np.uint16)]
        at = len(ids[0])
        for k in np.flatnonzero(slow).tolist():
            got = self.library[words[k].as_py()]
            ids.append(got)
            start[k], many[k] = at, len(got)
            at += len(got)
        return np.concatenate(ids), start, many

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, `end` after each, and where each text's begin and the last end. A null text is empty."""
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = parts.values.dictionary_encode()
        some = [self._words(coded.dictionary.slice(k, CHUNK)) for k in range(0, len(coded.dictionary), CHUNK)]
        said = np.concatenate([x[0] for x in some])
        start = np.concatenate([x[1] + n for x, n in zip(some, np.cumsum([0] + [len(x[0]) for x in some]).tolist(), strict=False)])
        many = np.concatenate([x[2] for x in some])
        start, many = start.astype(np.int32), many.astype(np.int32)
        at = coded.indices.to_numpy()
        size = many[at]
        after = np.cumsum(size, dtype=np.int32)
        shift = start[at] - after + size
        ids = said[np.repeat(shift, size) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)]
        cut = np.concatenate([np.zeros(1, np.int32), after])[parts.offsets.to_numpy()].astype(np.int64)
        return np.insert(ids, cut[1:], np.uint16(end)), cut + np.arange(len(cut))


def text_slices(batch: pa.RecordBatch, most: int = 8 << 20):
    """(doc_id, text) columns of runs of rows with about `most` bytes of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at)
        at = to


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so that its table outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
