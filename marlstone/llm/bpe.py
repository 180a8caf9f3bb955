"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

Encoder.  The merges compile into a trie of the tokens and the way each token was
last merged.  Reading a piece byte by byte, the encoding of what was read so far
is known, and so is every place where a later token may still begin: the places
from which the bytes lead to an inner node of the trie.  A state of the
transducer is the set of these places, each with its node and the tokens before
it that are not final yet.  What all places agree on no continuation can change:
it is emitted on the edge, so at most the length of the longest token is held
back.  States and edges are made when a text first needs them and kept in bounded
tables; full tables are dropped and filled anew, which changes no result.  Every
piece that isn't itself a token is read through the states to its last byte.

Decoder.  An automaton reads bytes one at a time: its states are how many bytes a
character still needs and which range the next one is in, made from the rules of
UTF-8.  What a token does to a state (text that comes out, the state after) is
put together from its bytes when first needed and kept in a bounded table.

Correctness of the encoder rests on two facts about merges by rank: the encoding
of a prefix that ends at a token boundary is a prefix of the encoding, and a
sequence of tokens is an encoding exactly if each neighbouring pair is.

Defined results: a null text encodes as an empty one; texts of any length stream
through in pieces; repeated rows and null ids give a row each; bytes that are no
UTF-8 decode to a replacement character for each maximal invalid part; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marlstone.llm.runtime import documents, ship
from marlstone.llm.textcore import chunks, idle

#: Bounds of the tables of a worker: pieces met before, edges, pairs of tokens, what tokens do to a state of the decoder.
MEMO_ENTRIES, EDGE_ENTRIES, PAIR_ENTRIES, JOIN_ENTRIES = 300_000, 600_000, 500_000, 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merge(raw: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Merges by rank, with merges of a rank under ``below`` alone."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


#: What a state keeps: the last final token, where it still matters, and the open places: (node, tokens before it that are not final).
_Key = tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]
_NO_TOKEN, _ANY_TOKEN = -1, -2
_START: _Key = (_NO_TOKEN, ((0, ()),))


class Transducer:
    """Encodes one piece of text at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.code = {i: int(i).to_bytes(4, "little") for i in ranks.values()}
        self.split: dict[int, tuple[int, int]] = {}
        self.child: dict[int, int] = {}  # node and byte in one number, to a node
        self.token, self.inner = [-1], [True]  # of each node
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = _merge(token, ranks, i)
                if len(parts) != 2:  # no merge makes it
                    continue
                self.split[i] = (ranks[parts[0]], ranks[parts[1]])
            self.token[self._node(token)] = i
        self.pairs = {v: k for k, v in self.split.items()}
        self.fits: dict[int, bool] = {}
        self._clear()

    def _node(self, token: bytes) -> int:
        at = 0
        for byte in token:
            to = self.child.get(at << 8 | byte)
            if to is None:
                to = self.child[at << 8 | byte] = len(self.token)
                self.token.append(-1)
                self.inner.append(False)
                self.inner[at] = True
            at = to
        return at

    def _clear(self) -> None:
        self.edges: dict[int, tuple[int, bytes]] = {}  # state and byte in one number, to a state and what is emitted
        self.ids: dict[_Key, int] = {}
        self.states: list[_Key] = []
        self.rest: list[bytes] = []  # what each state emits at the end of a piece
        self._state(_START)

    def _state(self, key: _Key) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.states)
            self.states.append(key)
            self.rest.append(self._written(key[1][-1][1]))
        return i

    def _written(self, tokens: tuple[int, ...]) -> bytes:
        return b"".join(map(self.code.__getitem__, tokens))

    def follows(self, left: int, right: int) -> bool:
        """Whether [left, right] is an encoding: no merge across the border comes before the merges beside it."""
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= PAIR_ENTRIES:
                self.fits.clear()
            known = self.fits[pair] = self._follows(left, right)
        return known

    def _follows(self, left: int, right: int) -> bool:
        # Undo merges from the latest on; a pair across the border that merges earlier than the one undone would have been taken.
        # Equal ranks: the leftmost goes first, so a merge on the left side of the border beats an equal one across it, and that one beats the right side's.
        end = 1 << 62
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < end:
                return False
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                end, left = left, a[1]
            else:
                end, right = right + 1, b[0]

    def _edge(self, state: int, byte: int) -> tuple[int, bytes]:
        """Where a byte leads to from a state, and what it emits."""
        prev, places = self.states[state]
        made, still = None, []
        for node, held in places:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if made is None and (token := self.token[to]) >= 0:  # just one token ends here in an encoding
                left = held[-1] if held else prev
                if left < 0 or self.follows(left, token):
                    made = (*held, token)
            if self.inner[to]:
                still.append((to, held))
        if made is None:
            raise ValueError("the ranks have no token for a byte")
        still.append((0, made))
        first = still[0][1]  # the earliest place holds the fewest tokens
        final = len(first)
        for _, held in still:
            while held[:final] != first[:final]:
                final -= 1
        emitted = b""
        if final:
            prev, emitted = first[final - 1], self._written(first[:final])
            still = [(node, held[final:]) for node, held in still]
        key = (prev if not still[0][1] else _ANY_TOKEN, tuple(still))  # behind a held token the final one no longer matters
        if len(self.edges) >= EDGE_ENTRIES:
            self._clear()
            return self._state(key), emitted
        edge = self.edges[state << 8 | byte] = self._state(key), emitted
        return edge

    def encode(self, raw: bytes) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return self.code[whole]
        state, out, known = 0, [], self.edges.get
        for byte in raw:
            edge = known(state << 8 | byte)
            if edge is None:
                edge = self._edge(state, byte)
                known = self.edges.get
            state, emitted = edge
            if emitted:
                out.append(emitted)
        out.append(self.rest[state])
        return b"".join(out)


class _Memo(dict):
    """Piece to ids; filled by the transducer. Of the pieces met before the last change of generation those come back that are met again."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(self) >= MEMO_ENTRIES // 2:
            self.before = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = ids
        return ids


def _utf8_steps() -> list[list[int]]:
    """steps[state][byte]: the next state, or -1. State 0 is between characters, 1 to 3 need so many more bytes.

    The others follow a lead byte whose next byte is in a smaller range: no overlong form, surrogate or number over 10FFFF.
    """
    ranges = [
        [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
        [(0x80, 0xBF, 0)], [(0x80, 0xBF, 1)], [(0x80, 0xBF, 2)],
        [(0xA0, 0xBF, 1)], [(0x80, 0x9F, 1)], [(0x90, 0xBF, 2)], [(0x80, 0x8F, 2)],
    ]
    steps = [[-1] * 256 for _ in ranges]
    for state, parts in enumerate(ranges):
        for a, z, to in parts:
            steps[state][a : z + 1] = [to] * (z - a + 1)
    return steps


class Utf8Stream:
    """Turns bytes into text as they come; a character that is cut off waits for its rest."""

    STEPS, REPLACEMENT = _utf8_steps(), "�"

    def __init__(self, state: int = 0, held: bytes = b""):
        self.state, self.held = state, held

    def feed(self, raw: bytes) -> str:
        state, held, out = self.state, bytearray(self.held), []
        for byte in raw:
            to = self.STEPS[state][byte]
            if to < 0 and state:  # the character breaks off, and the byte begins anew
                out.append(self.REPLACEMENT)
                held.clear()
                to = self.STEPS[0][byte]
            if to < 0:
                out.append(self.REPLACEMENT)
                to = 0
            else:
                held.append(byte)
                if to == 0:
                    out.append(held.decode())
                    held.clear()
            state = to
        self.state, self.held = state, bytes(held)
        return "".join(out)

    def end(self) -> str:
        rest = self.REPLACEMENT if self.held else ""
        self.state, self.held = 0, b""
        return rest


class Decoder:
    """Ids to text; needs the tokens alone."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        self.raw = [b""] * n
        for token, i in ranks.items():
            self.raw[i] = token
        self.text, self.whole = np.empty(n, object), np.zeros(n, bool)  # tokens that lead from between characters to there
        for i, token in enumerate(self.raw):
            stream = Utf8Stream()
            self.text[i] = stream.feed(token)
            self.whole[i] = not stream.held
        self.joins: dict[tuple[bytes, int], tuple[str, int, bytes]] = {}

    def _join(self, state: int, held: bytes, token: int) -> tuple[str, int, bytes]:
        """What a token does in the middle of a character; the bytes held fix the state."""
        known = self.joins.get((held, token))
        if known is None:
            if len(self.joins) >= JOIN_ENTRIES:
                self.joins.clear()
            stream = Utf8Stream(state, held)
            known = self.joins[held, token] = stream.feed(self.raw[token]), stream.state, stream.held
        return known

    def decode(self, ids: bytes, step: int = 1 << 14) -> str:
        every, out, state, held = np.frombuffer(ids, "<u4"), [], 0, b""
        for a in range(0, len(every), step):
            part = every[a : a + step]
            cut = np.flatnonzero(~self.whole[part]).tolist()  # only these may leave a character open
            at = 0
            for c in [*cut, len(part)]:
                while held and at < min(c + 1, len(part)):
                    text, state, held = self._join(state, held, int(part[at]))
                    out.append(text)
                    at += 1
                if at < c:
                    out.extend(self.text[part[at:c]].tolist())
                    at = c
                if at == c and c < len(part) and not held:
                    text, state, held = self._join(0, b"", int(part[c]))
                    out.append(text)
                    at += 1
        return "".join(out) + Utf8Stream(state, held).end()


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern).findall
        self.memo = _Memo(Transducer(ranks))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, until another operator's tasks run there."""
    idle.append(encoder.cache_clear)
    return Encoder(load_ranks(path), pattern)


@cache
def decoder(path: str) -> Decoder:
    """One per Python worker."""
    return Decoder(load_ranks(path))


def _mapped(columns: list[str], kinds: list[pa.DataType], rows) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, batch.schema.names[1]):
                made = list(zip(*(rows(x.as_py()) for x in chunk.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=["doc_id", *columns])

    return run


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids, a binary of little-endian unsigned 32-bit integers."""
    ship(df.sparkSession)

    def rows(text: str | None) -> tuple[int, bytes]:
        ids = encoder(path, pattern).encode(text or "")
        return len(ids) // 4, ids

    return documents(df, id_col, text_col).mapInArrow(_mapped(["n_tokens", "ids"], [pa.int64(), pa.binary()], rows), "doc_id long, n_tokens long, ids binary")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, n_tokens, ids and text."""
    ship(df.sparkSession)

    def rows(ids: bytes | None) -> tuple[int, bytes, str]:
        ids = ids or b""
        return len(ids) // 4, ids, decoder(path).decode(ids)

    named = df.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{ids_col}` AS ids")
    return named.mapInArrow(_mapped(["n_tokens", "ids", "text"], [pa.int64(), pa.binary(), pa.string()], rows), "doc_id long, n_tokens long, ids binary, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and the text that these ids decode to: encode and decode in one pass, so in one Python worker a task."""
    ship(df.sparkSession)

    def rows(text: str | None) -> tuple[int, bytes, str]:
        ids = encoder(path, pattern).encode(text or "")
        return len(ids) // 4, ids, decoder(path).decode(ids)

    return documents(df, id_col, text_col).mapInArrow(_mapped(["n_tokens", "ids", "text"], [pa.int64(), pa.binary(), pa.string()], rows), "doc_id long, n_tokens long, ids binary, text string")
