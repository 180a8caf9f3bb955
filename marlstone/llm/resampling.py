"""Importance resampling towards a target distribution, with counts from distinct lines.

Features are runs of up to ``highest`` words, hashed into buckets.  What a bucket
gains is how much likelier it is in the target than in the corpus; a document's
weight is the mean gain of its features, and the documents drawn are those whose
weight plus seeded Gumbel noise is highest: a sample without replacement.

Corpus counts.  Line feeds separate words, so texts fall into lines.  Lines that repeat are
                counted first (with partial aggregation: a line that a third of all
                documents share is one row of each task), each distinct line's features
                are counted once and multiplied by its occurrences, and runs of words
                that go over a line's end are counted in the documents and added.
Scores.         The gains, a number for each bucket, go to the tasks, which read each
                document once.
Draw.           Documents are sorted by ranges of scores, not in one window; the copies
                of a document that repeats are told apart by a hash of their places.

Defined results: null, empty and blank texts have no features and weight 0; they and
all documents with fewer than ``least`` words are scored and never drawn; rows that
repeat an id are drawn like others, with equal noise; null ids have the noise of an
empty id and come last among ties; an empty table gives an empty result, an empty
target equal counts in all buckets; other columns are ignored but for those to be kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.ranking import placed
from marlstone.llm.runtime import ship, stash
from marlstone.llm.textcore import NOT_ALNUM, chunks, text_column, words_of

HIGHEST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: Longer slices are read one by one.
_LONG = 64


def _table() -> np.ndarray:
    """What a byte does to the remainder, by the generator polynomial, lowest bit first."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _table()


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of many slices of some bytes: a byte of all of them at a time, the longest first."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, _LONG + 1).astype(np.int8), kind="stable")
    begin, left = start[order], np.minimum(size[order], _LONG + 1)
    far = int(np.searchsorted(-left, -_LONG, side="left"))  # slices longer than that
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-left, -np.arange(_LONG + 1), side="left")
    for i in range(_LONG):
        n = int(live[i])  # slices of more than i bytes
        if n <= far:
            break
        s = state[far:n]
        state[far:n] = _STEP[(s ^ data[begin[far:n] + i]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out[order] = ~state
    for k in order[:far]:
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
    return out


@dataclass
class Features:
    """Buckets of all runs of words of some texts, and each run's text; across: whether a line ends within it."""

    bucket: np.ndarray
    doc: np.ndarray
    across: np.ndarray
    words: np.ndarray  # of each text


def features(texts: pa.Array, highest: int, buckets: int) -> Features:
    w = words_of(texts, lower=True, ends=NOT_ALNUM)
    doc, data, start, end = w.doc_of_word(), w.data, w.start, w.end
    line = np.cumsum(data == 10)[start] if len(start) else np.zeros(0, np.int64)
    if highest > 1:  # words joined by single spaces, so that a run of them is a slice
        size = end - start
        place = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(place, size) + inner] = data[np.repeat(start, size) + inner]
        data, start, end = joined, place, place + size
    got = []
    for n in range(1, highest + 1):
        first = np.arange(max(len(doc) - n + 1, 0))
        first = first[doc[first] == doc[first + n - 1]]
        last = first + n - 1
        got.append((crc32s(data, start[first], end[last]) % np.uint32(buckets), doc[first], line[first] != line[last]))
    return Features(*(np.concatenate(x) for x in zip(*got, strict=True)), np.diff(w.first))


def _bucket_sums(rows: DataFrame, column: str, times: str | None, highest: int, buckets: int, across: bool) -> DataFrame:
    """bucket and n, added up within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in chunks(batch, column):
                f = features(text_column(chunk, column), highest, buckets)
                each = np.asarray(chunk.column(times), np.int64)[f.doc] if times else np.ones(len(f.doc), np.int64)
                np.add.at(total, f.bucket[f.across] if across else f.bucket, each[f.across] if across else each)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return rows.mapInArrow(run, "bucket int, n long")


def bucket_counts(df: DataFrame, text_col: str = "text", highest: int = HIGHEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket; the result's size is the number of buckets."""
    ship(df.sparkSession)
    texts = df.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    parts = _bucket_sums(lines, "line", "times", highest, buckets, False)
    if highest > 1:
        parts = parts.unionByName(_bucket_sums(texts, "text", None, highest, buckets, True))
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, with one more of each counted."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(seed: str, id_col: str = "doc_id") -> Column:
    """Thousandths of a Gumbel variable, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weighed(df: DataFrame, gain: np.ndarray, highest: int = HIGHEST, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight (the mean gain of a document's features, rounded down) and the columns to keep."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    held = ["kept"] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                f = features(text_column(chunk, "text"), highest, len(gain))
                n = np.bincount(f.doc, minlength=len(f.words))
                total = np.zeros(len(n), np.int64)
                np.add.at(total, f.doc, gain[f.bucket])
                columns = [f.words.astype(np.int64), n.astype(np.int64), total // np.maximum(n, 1)]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *map(pa.array, columns), *[chunk.column(c) for c in held]], names=["doc_id", "n_words", "n_features", "weight", *held])

    kept = f", kept {rows.schema['kept'].dataType.simpleString()}" if keep else ""
    return rows.mapInArrow(run, f"doc_id long, n_words long, n_features long, weight long{kept}")


def resample(
    df: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, highest: int = HIGHEST, buckets: int = BUCKETS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1 among the drawn, else null), and ``kept``, a struct of the columns to keep.

    Drawn are ``percent`` in a hundred of the documents with at least ``least`` words, rounded down.
    """
    gain = gains(bucket_counts(df, text_col, highest, buckets), bucket_counts(target, "text", highest, buckets))
    scored = weighed(df, gain, highest, id_col, text_col, keep).withColumn("score", F.col("weight") + noise(seed)).withColumn("copy", F.xxhash64(F.monotonically_increasing_id()))
    scored = stash(scored.withColumn("able", F.col("n_words") >= least), "scored")
    drawn = percent * scored.filter("able").count() // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("copy")]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return placed(scored, order, "ranked").select("doc_id", "n_features", "weight", "score", rank.alias("rank"), *(["kept"] if keep else []))
