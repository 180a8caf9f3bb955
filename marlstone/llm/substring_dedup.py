"""Substring deduplication by seed and extend.

Seeds.   Every window of ``length`` words holds exactly one winnowed anchor: the
         smallest of its ``anchor``-word hashes.  Neighbouring windows with the
         same anchor form a run, the anchor extended both ways as far as windows
         that chose it reach.  Equal windows choose the same anchor, so a window
         whose anchor is in one document only can't repeat: it goes no further.
Extend.  Rows that share an anchor meet once.  Where they also share the run,
         both sides extend to the whole run and the later document's run is a
         repeat.  Where runs differ, the first document of each run is extended
         to each window that holds the anchor, so many words to its left and the
         rest to its right, and windows meet by a 128-bit hash.
Maximal  Repeated windows of a document overlap into maximal spans.
repeats.

Tasks resolve what they can before anything is shuffled.  Of the rows of one run
in a block, only those of the smallest document go on, so a passage that a third
of the corpus shares costs a row per task in the shuffle and not one per copy.  An
anchor that has many runs in a block is known there to be shared: its rows go
straight to the extension, dealt evenly, and four of them tell the other tasks.

Defined results: a null or blank text has no words and keeps nothing (kept_text
is empty); texts shorter than ``length`` lose nothing; a repeat within one
document alone is kept; rows that repeat a doc_id don't remove each other, and
each loses what its own text repeats of other documents; rows with a null doc_id
neither lose words nor make others lose them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.runtime import documents, ship, stash
from marlstone.llm.textcore import NGrams, chunks, mix, text_column, words_of

LENGTH, ANCHOR = 13, 5
#: Rows that a task resolves at once, and rows of an anchor in them that still meet under it; they bound memory and hot keys, not what is found.
BLOCK_ROWS, ANCHOR_ROWS = 1_000_000, 16
#: at: first window of a run and how many windows it has, in one number.
_WIDTH = 1 << 8
#: What is known of a row: nothing yet, that it is a repeat, that it is to be extended. Known rows have no run and are dealt by their place.
MEETS, REPEAT, OPEN = 0, 1, 2
_SEED = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int32()), ("at", pa.int64()), ("state", pa.int8())])
_SHAPE = "anchor long, run long, doc_id long, print int, at long, state byte"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _resolve(a: np.ndarray, b: np.ndarray, doc: np.ndarray, text: np.ndarray, at: np.ndarray, extend: bool) -> pa.RecordBatch:
    """Rows of equal (a, b) with a larger doc than another are repeats. With extend, if a has many rows besides in different runs and documents, those are open."""
    order = np.lexsort((doc, b, a))
    a, b, doc, text, at = a[order], b[order], doc[order], text[order], at[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
    state = np.where(doc > least, REPEAT, MEETS).astype(np.int8)
    left = np.flatnonzero(state == MEETS) if extend else np.zeros(0, int)
    first = np.flatnonzero(np.concatenate([[True], a[left][1:] != a[left][:-1]])) if len(left) else left
    size = np.diff(np.append(first, len(left)))
    for f, n in zip(first[size > ANCHOR_ROWS].tolist(), size[size > ANCHOR_ROWS].tolist(), strict=True):
        rows = left[f : f + n]  # by run, then by document
        if b[rows[0]] != b[rows[-1]] and doc[rows].min() != doc[rows].max():
            tell = {0, n - 1, int(doc[rows].argmin()), int(doc[rows].argmax())}
            state[np.delete(rows, list(tell))] = OPEN
    known = state != MEETS
    spread = mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.view(np.uint64))
    return pa.RecordBatch.from_arrays(
        [pa.array(_signed(np.where(known, spread, a))), pa.array(_signed(b), mask=known), pa.array(doc), pa.array(text), pa.array(at), pa.array(state)], schema=_SEED
    )


def _blocks(parts: Iterator[tuple[np.ndarray, ...]], extend: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= BLOCK_ROWS:
            yield _resolve(*(np.concatenate(x) for x in zip(*held, strict=True)), extend)
            held, n = [], 0
    if n:
        yield _resolve(*(np.concatenate(x) for x in zip(*held, strict=True)), extend)


def _seeds(length: int, anchor: int):
    """Runs of windows that chose the same anchor."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                w = words_of(text_column(chunk, "text"))
                n = len(w.hash)
                if n < length:
                    continue
                ids, prints = np.asarray(chunk.column("doc_id")), np.asarray(chunk.column("print"))
                doc, grams = w.doc_of_word(), w.ngrams()
                begin = np.arange(n - anchor + 1)
                hashed = grams.hash(begin, begin + anchor)
                near = np.lib.stride_tricks.sliding_window_view(hashed, length - anchor + 1)
                first = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
                if not len(first):
                    continue
                chosen, d = first + near[first].argmin(axis=1), doc[first]
                new = np.ones(len(first), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (d[1:] != d[:-1])
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(first)) - 1
                run = grams.hash(first[a], first[z] + length) + (chosen[a] - first[a]).astype(np.uint64)
                yield hashed[chosen[a]], run, ids[d[a]], prints[d[a]], (first[a] - w.first[d[a]]) * _WIDTH + (z - a + 1)

    return lambda batches: _blocks(parts(batches), True)


def _windows(length: int):
    """Each window of the given runs, under two hashes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                w = words_of(text_column(chunk, "text"))
                if not len(w.hash):
                    continue
                runs = chunk.column("runs")
                sizes = np.asarray(pc.list_value_length(runs))
                at, d = np.asarray(runs.flatten()), np.repeat(np.arange(len(chunk)), sizes)
                count = at % _WIDTH
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begin, d = np.repeat(at // _WIDTH, count) + step, np.repeat(d, count)
                place = np.unique(np.stack([d, begin]), axis=1)  # a run may be listed twice
                d, begin = place[0], place[1]
                there = w.first[d] + begin
                fits = there + length <= w.first[d + 1]
                d, begin, there = d[fits], begin[fits], there[fits]
                one, two = w.ngrams(), NGrams(mix(w.hash + np.uint64(0xA5A5A5A5A5A5A5A5)))
                ids, prints = np.asarray(chunk.column("doc_id")), np.asarray(chunk.column("print"))
                yield one.hash(there, there + length), two.hash(there, there + length), ids[d], prints[d], begin * _WIDTH + 1

    return lambda batches: _blocks(parts(batches), False)


_CUT = "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept_text string"


def _cut(length: int):
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text", 1 << 23):
                n_words, n_removed, spans, kept = [], [], [], []
                for text, runs in zip(chunk.column("text"), chunk.column("runs"), strict=True):
                    raw = text.as_buffer()
                    words = raw.to_pybytes().split() if raw is not None else []
                    cut: list[tuple[int, int]] = []
                    if runs.is_valid:
                        for x in np.sort(np.asarray(runs.values)).tolist():
                            a = x // _WIDTH
                            z = min(a + x % _WIDTH + length - 1, len(words))
                            if cut and a <= cut[-1][1]:
                                cut[-1] = (cut[-1][0], max(z, cut[-1][1]))
                            elif a < z:
                                cut.append((a, z))
                    n_words.append(len(words))
                    n_removed.append(sum(z - a for a, z in cut))
                    spans.append([{"begin": a, "end": z} for a, z in cut])
                    for a, z in reversed(cut):
                        del words[a:z]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
                )

    return run


_ROW = ["doc_id", "print"]


def repeated_runs(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, print and at: runs of windows of a row (an id and the print of its text) that also start in a document with a smaller doc_id."""
    known = docs.filter("doc_id IS NOT NULL")
    by_anchor = Window.partitionBy("anchor").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_run = Window.partitionBy("anchor", "run")
    met = (
        known.mapInArrow(_seeds(length, anchor), _SHAPE)
        .withColumn("many", (F.min("run").over(by_anchor) != F.max("run").over(by_anchor)) & (F.min("doc_id").over(by_anchor) != F.max("doc_id").over(by_anchor)))
        .withColumn("least", F.min("doc_id").over(by_run))
        .withColumn("again", (F.col("state") == REPEAT) | ((F.col("state") == MEETS) & (F.col("doc_id") > F.col("least"))))
        .filter(F.col("again") | F.col("many") | (F.col("state") == OPEN))
        .select(*_ROW, "at", "again")
    )
    # One row a text: runs already known to repeat, and runs to be extended window by window.
    listed = stash(
        met.groupBy(*_ROW).agg(F.collect_list(F.when(F.col("again"), F.col("at"))).alias("done"), F.collect_list(F.when(~F.col("again"), F.col("at"))).alias("runs")),
        "runs",
    )
    open_runs = listed.filter(F.size("runs") > 0).select(*_ROW, "runs")
    # A left join keeps the documents' side the same plan as in remove_repeats, so its exchange is made once.
    opened = known.join(open_runs, _ROW, "left").filter(F.size(F.coalesce("runs", F.array())) > 0)
    window = (
        opened.mapInArrow(_windows(length), _SHAPE)
        .withColumn("least", F.min("doc_id").over(by_run))
        .filter((F.col("state") == REPEAT) | ((F.col("state") == MEETS) & (F.col("doc_id") > F.col("least"))))
        .select(*_ROW, "at")
    )
    return listed.select(*_ROW, F.explode("done").alias("at")).unionByName(window)


def remove_repeats(df: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (of removed words, end exclusive) and kept_text of each document."""
    if not 0 < anchor <= length or length - anchor + 1 >= _WIDTH:
        raise ValueError(f"anchor of {anchor} words doesn't fit windows of {length}")
    ship(df.sparkSession)
    docs = documents(df, id_col, text_col).withColumn("print", F.hash("text"))
    runs = repeated_runs(docs, length, anchor).groupBy(*_ROW).agg(F.collect_list("at").alias("runs"))
    joined = docs.filter("doc_id IS NOT NULL").join(runs, _ROW, "left")
    rest = docs.filter("doc_id IS NULL").withColumn("runs", F.lit(None).cast("array<bigint>"))
    return joined.select("doc_id", "text", "runs").unionByName(rest.select("doc_id", "text", "runs")).mapInArrow(_cut(length), _CUT)
