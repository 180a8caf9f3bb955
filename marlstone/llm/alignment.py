"""Alignment of two tokenizers' tokens, with corpus-wide counts of the pairs that end together.

A is a byte-level BPE (its declaration as JSON), B a piece model with byte fallback.
Both encode space and text, so both cut the same bytes; the offsets where a token of A
and one of B end together cut the tokens into groups, and the two tokens that end
there are a link.

First pass.   Tasks encode the texts, keep both encodings (two bytes a token) in a
              table, align them, and add up the links of each pair of ids they met.
Pairs.        A pair's tokens end together over the same bytes, so the shorter is the
              end of the longer: there are at most as many pairs as the tokens have
              ends, some hundred thousand for vocabularies of this size, whatever the
              corpus (``most_pairs`` counts them).  The distinct ones get a minimal
              perfect hash: levels of bits, a key is at home in the first level where
              no other key shares its slot, and its number is the bits before it.
Counts.       Each task turns the sums it reads into one dense vector by hash, each key
              verified, and vectors are added by a tree of FAN at a time, in segments,
              so no task holds more than FAN segments.
Second pass.  Tasks align the kept encodings again and look the links' counts up; keys
              are verified, so a pair that wasn't counted can't take another's place.

Texts over CUT characters are encoded in parts, cut at single spaces between letters or
digits: neither tokenizer has a token over such a place, so the parts' tokens are the
text's.

Defined results: texts that are null, empty, or that a tokenizer doesn't give back byte
for byte (some characters that stand for others) have no tokens, zeros and an empty
digest; strings of special tokens are plain text; rows that repeat an id or a text get
a row each and count each; null ids stay null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import documents, ship, stash
from marlstone.llm.textcore import bytes_of, chunks, mix

CUT, SEGMENT, FAN = 1 << 16, 8192, 32
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")
_KEY = np.uint64(1 << 16)


def _of_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Pieces:
    """The bytes of each id."""

    tokens: list[bytes]

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        place = np.cumsum(size) - size
        return self.data[np.repeat(self.start[ids] - place, size) + np.arange(int(size.sum()))]


class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, a: bytes, b: bytes, pattern: str):
        declared = json.loads(a)["model"]
        of = _of_bytes()
        raw = {bytes(of[c] for c in t): i for t, i in declared["vocab"].items() if all(c in of for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in declared["merges"]]
        if any(declared["vocab"]["".join(m)] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("the ids of the byte-level tokenizer must follow its merges")
        ranks = {t: i for t, i in raw.items() if i < 256 + len(merges)}
        self._a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b)
        named = {i: t for t, i in ranks.items()}
        self.a = Pieces([named[i] for i in range(len(named))])
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.b = Pieces([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])

    def parts(self, text: str, cut: int = CUT) -> list[str]:
        out, at = [], 0
        while self.cuts and len(text) - at > cut and (m := _SAFE.search(text, at + cut)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A, which is given a space before it, and by B, which adds one."""
        parts = [self.parts(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        a = [np.array(self._a.encode_ordinary(" " + t), np.uint16) for t in flat]
        b = [np.array(x, np.uint16) for x in self._b.encode(flat, num_threads=1)]
        if len(flat) == len(texts):
            return a, b
        begin = np.cumsum([0, *map(len, parts)])
        whole = lambda x: [np.concatenate(x[i:j]) for i, j in zip(begin, begin[1:], strict=False)]
        return whole(a), whole(b)


_loaded: dict[str, Tokenizers] = {}


def _tokenizers(files) -> Tokenizers:
    """Those of this worker. files: broadcast (a, b, pattern, digest)."""
    a, b, pattern, digest = files.value
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = Tokenizers(a, b, pattern)
    return _loaded[digest]


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each text's begin."""
    return np.concatenate([*parts, np.zeros(0, np.uint16)]).astype(np.int64), np.cumsum([0, *map(len, parts)])


def encoded_exactly(tools: Tokenizers, texts: pa.Array) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
    """Both encodings of each text, None where one of them doesn't give the text back. texts: without nulls."""
    a, b = tools.encode(texts.to_pylist())
    data, offsets = bytes_of(texts)
    good = np.diff(offsets) > 0
    for ids, pieces in ((a, tools.a), (b, tools.b)):
        flat, first = _flat(ids)
        upto = np.concatenate([[0], np.cumsum(pieces.size[flat])])
        good &= np.diff(upto[first]) == np.diff(offsets) + 1
    some = np.flatnonzero(good)
    begin = np.cumsum([0, *(np.diff(offsets)[some] + 1)])
    want = np.full(int(begin[-1]), 32, np.uint8)
    inside = np.ones(len(want), bool)
    inside[begin[:-1]] = False
    size = np.diff(offsets)
    want[inside] = data[np.repeat(good, size)]
    for ids, pieces in ((a, tools.a), (b, tools.b)):
        wrong = pieces.joined(_flat([ids[i] for i in some])[0]) != want
        bad = np.diff(np.concatenate([[0], np.cumsum(wrong)])[begin]) > 0
        good[some[bad]] = False
    return [x if g else None for x, g in zip(a, good, strict=True)], [x if g else None for x, g in zip(b, good, strict=True)]


@dataclass
class Links:
    """Alignment of some texts at once; place_a and place_b: the tokens that end together, group_a and group_b: each token's group."""

    place_a: np.ndarray
    place_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def aligned(size_a: np.ndarray, size_b: np.ndarray) -> Links:
    """size_a, size_b: bytes of the tokens, of the same texts in the same order."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    at = np.searchsorted(end_b, end_a)
    same = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_b) else np.zeros(0, np.int64)
    cuts = end_a[same]
    return Links(same, at[same], np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b))


def written(a: np.ndarray, b: np.ndarray, links: Links, first_a: np.ndarray, first_b: np.ndarray) -> list[bytes]:
    """The groups of each text, as ``a1,a2|b1;a3|b2,b3``."""
    names = _names()
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[links.place_a] = last_b[links.place_b] = True
    closes = np.zeros(len(b), bool)
    closes[first_b[1:][np.diff(first_b) > 0] - 1] = True
    in_a, in_b = np.bincount(links.group_a, minlength=len(links.place_a)), np.bincount(links.group_b, minlength=len(links.place_b))
    before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
    out = np.empty(len(a) + len(b), names.dtype)
    out[np.arange(len(a)) + before_b[links.group_a]] = names[np.where(last_a, 1, 0), a]
    out[np.arange(len(b)) + before_a[links.group_b]] = names[np.where(closes, 3, np.where(last_b, 2, 0)), b]
    edges = first_a + first_b
    return [out[i:j].tobytes().replace(b"\0", b"") for i, j in zip(edges, edges[1:], strict=False)]


_written_names: list[np.ndarray] = []


def _names() -> np.ndarray:
    """Each id with what follows it: a comma, a bar, a semicolon or nothing."""
    if not _written_names:
        _written_names.append(np.array([[f"{i}{s}".encode() for i in range(1 << 16)] for s in (",", "|", ";", "")], "S6"))
    return _written_names[0]


class MinimalHash:
    """Numbers distinct keys from 0 without gaps. keys: by number, to verify what is looked up."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, held = np.unique(keys.astype(np.uint64)), 0
        self.keys = np.zeros(len(left), np.uint64)
        while len(left):
            slots = max(int(len(left) * spread), 16)
            at = self._slot(left, len(self.levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            before = held + np.cumsum(alone) - alone
            self.levels.append((alone, before.astype(np.int32)))
            home = alone[at]
            self.keys[before[at[home]]] = left[home]
            held, left = held + int(home.sum()), left[~home]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(slots)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys it wasn't made of."""
        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, before) in enumerate(self.levels):
            at = self._slot(keys[todo], level, len(alone))
            home = alone[at]
            out[todo[home]] = before[at[home]]
            todo = todo[~home]
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def most_pairs(tools: Tokenizers) -> int:
    """How many pairs of ids can end together: those of which one is the end of the other."""
    ids: dict[bytes, list[int]] = {}
    for t in tools.a.tokens:
        ids[t] = [ids.get(t, [0, 0])[0] + 1, 0]
    for t in tools.b.tokens:
        ids[t] = [ids.get(t, [0, 0])[0], ids.get(t, [0, 0])[1] + 1]
    total = 0
    for t, (n_a, n_b) in ids.items():
        total += n_a * n_b
        for k in range(1, len(t)):
            a, b = ids.get(t[k:], (0, 0))
            total += n_a * b + n_b * a
    return total


def _pairs(a: np.ndarray, b: np.ndarray, links: Links) -> np.ndarray:
    return a[links.place_a].astype(np.uint64) * _KEY + b[links.place_b].astype(np.uint64)


_ENCODED = "doc_id long, a binary, b binary, keys binary, sums binary"


def encode(df: DataFrame, files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a and b (ids of two bytes each; null without tokens) of each document; and of each task a row with keys and sums, the links of the pairs it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, keys, sums = _tokenizers(files), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for chunk in chunks(batch, "text"):
                a, b = encoded_exactly(tools, chunk.column("text").fill_null(""))
                ids_a, ids_b = (_flat([x for x in ids if x is not None])[0] for ids in (a, b))
                met, n = np.unique(_pairs(ids_a, ids_b, aligned(tools.a.size[ids_a], tools.b.size[ids_b])), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, met]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, n]), len(keys)).astype(np.int64)
                raw = [pa.array([None if x is None else x.astype("<u2").tobytes() for x in ids], pa.binary()) for ids in (a, b)]
                none = pa.nulls(len(chunk), pa.binary())
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *raw, none, none], names=["doc_id", "a", "b", "keys", "sums"])
        own = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 2, *(pa.array([x.tobytes()], pa.binary()) for x in (keys, sums))]
        yield pa.RecordBatch.from_arrays(own, names=["doc_id", "a", "b", "keys", "sums"])

    return documents(df, id_col, text_col).mapInArrow(run, _ENCODED)


def _distinct(parts: DataFrame) -> np.ndarray:
    """All keys that tasks met. parts: keys and sums of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(0, np.uint64)
        for batch in batches:
            for raw in batch.column("keys"):
                met = np.union1d(met, np.frombuffer(raw.as_py(), np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int64))], names=["key"])

    return parts.select("keys").mapInArrow(run, "key long").distinct().toPandas()["key"].to_numpy(np.uint64)  # most_pairs rows at most


def counted(parts: DataFrame, numbers) -> np.ndarray:
    """The sum of each key by its number. parts: keys and sums of each task; numbers: a broadcast MinimalHash."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed: MinimalHash = numbers.value
        total = np.zeros(len(hashed.keys), np.int64)
        for batch in batches:
            for keys, sums in zip(batch.column("keys"), batch.column("sums"), strict=True):
                at = hashed.find(np.frombuffer(keys.as_py(), np.uint64))
                if (at < 0).any():
                    raise ValueError("a pair was counted that isn't hashed")
                total[at] += np.frombuffer(sums.as_py(), np.int64)
        cut = [total[i : i + SEGMENT].tobytes() for i in range(0, len(total), SEGMENT)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array(cut, pa.binary())], names=["segment", "part", "vector"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("vector"))
        return pa.table([group.column("segment")[:1], group.column("part")[:1], pa.array([total.tobytes()], pa.binary())], names=["segment", "part", "vector"])

    shape = "segment int, part int, vector binary"
    vectors = stash(parts.mapInArrow(dense, shape), "vectors")
    top = vectors.agg(F.max("part")).first()[0] or 0
    while top:
        up = vectors.withColumn("part", F.expr(f"part DIV {FAN}").cast("int"))
        vectors, top = stash(up.groupBy("segment", "part").applyInArrow(add, shape), "vectors"), top // FAN
    held = sorted((r["segment"], r["vector"]) for r in vectors.collect())  # one vector
    return np.frombuffer(b"".join(bytes(v) for _, v in held), np.int64)


def align(df: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document, and the groups themselves if asked for.

    a_path, b_path: files on the driver; tasks get their contents.  n_best: links whose pair is the most frequent of its B id, corpus-wide.
    """
    spark = df.sparkSession
    ship(spark)
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        raw = a.read(), b.read(), pattern
    files = spark.sparkContext.broadcast((*raw, hashlib.sha256(repr(raw).encode()).hexdigest()))
    encoded = stash(encode(df, files, id_col, text_col), "encoded")
    parts = encoded.filter("keys IS NOT NULL").select("keys", "sums")
    hashed = MinimalHash(_distinct(parts))
    numbers = spark.sparkContext.broadcast(hashed)
    counts = counted(parts, numbers)
    of_b = (hashed.keys % _KEY).astype(np.int64)
    most = np.zeros(1 << 16, np.int64)
    np.maximum.at(most, of_b, counts)
    looked_up = spark.sparkContext.broadcast((counts, counts == most[of_b]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, (count, best) = _tokenizers(files), looked_up.value
        for batch in batches:
            for chunk in chunks(batch, "a"):
                ids = [[np.frombuffer(x.as_py() or b"", "<u2") for x in chunk.column(c)] for c in ("a", "b")]
                (ids_a, first_a), (ids_b, first_b) = map(_flat, ids)
                links = aligned(tools.a.size[ids_a], tools.b.size[ids_b])
                at = numbers.value.find(_pairs(ids_a, ids_b, links))
                if (at < 0).any():
                    raise ValueError("a pair is linked that wasn't counted")
                cut = np.searchsorted(links.place_a, first_a)
                upto = lambda x, cut=cut: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[cut])
                n = np.diff(cut)
                texts = written(ids_a, ids_b, links, first_a, first_b)
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                columns = [np.diff(first_a), np.diff(first_b), n, n, upto(best[at]), upto(count[at])]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests), *([pa.array([t.decode() for t in texts])] if groups else [])], names=names)

    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if groups else "")
    return encoded.filter("keys IS NULL").select("doc_id", "a", "b").mapInArrow(run, shape)
