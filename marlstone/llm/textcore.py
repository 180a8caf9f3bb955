"""Vectorised text primitives used inside Arrow tasks: word boundaries, word
hashes and n-gram hashes for a whole batch of documents at once.

Everything works on the UTF-8 bytes of an Arrow string column, so no Python
object is made per word.  Null texts have no words.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: What a Python worker, which outlives a stage, keeps for tasks of another kind: called and forgotten when words are next looked at.
idle: list[Callable[[], None]] = []
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_NGRAM = 0xD6E8FEB86659FD93

#: Bytes that end a word: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters: every ASCII byte but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE_POW, _WORD_POW = _Powers(_BASE), _Powers(_NGRAM)


@dataclass
class Words:
    """Words of some documents. first[d] .. first[d+1] are the words of document d."""

    data: np.ndarray  # bytes
    start: np.ndarray  # byte offsets
    end: np.ndarray
    first: np.ndarray  # per document, one more than documents
    hash: np.ndarray  # uint64 per word
    sums: np.ndarray  # of the bytes' hash, for parts of words

    def part_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _BYTE_POW.get(len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def ngrams(self) -> NGrams:
        return NGrams(self.hash)


class NGrams:
    """Hashes of any run of words, each from two prefix sums."""

    def __init__(self, words: np.ndarray):
        up, self.down = _WORD_POW.get(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text starts."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = False, ends: np.ndarray = SPACE) -> Words:
    """texts: a string array without nulls; ends: the bytes that end a word."""
    if idle:
        while idle:
            idle.pop()()
        gc.collect()
    data, offsets = bytes_of(texts)
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = ~ends[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (cut[:-1] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
    up, down = _BYTE_POW.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, np.searchsorted(start, offsets), hashed, sums)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of text each (one document at least)."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def text_column(batch: pa.RecordBatch, column: str) -> pa.Array:
    x = batch.column(column)
    return x.fill_null("") if x.null_count else x
