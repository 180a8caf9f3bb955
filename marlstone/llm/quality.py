"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are its own shape (letters, capitals,
symbols, repeats and so on) and that of the lines before and after; neighbouring
labels are tied by transition weights.  The field is fitted by gradient ascent
on labelled documents whose lines all carry the document's label.  Forward and
backward passes give each line's probability of being good; the mean of these,
weighted by length, is the document's raw quality, and a logistic curve fitted
on the same labels maps it to a probability.

The fit takes whole labelled documents, at most about FIT_DOCS of them and only as
many as have FIT_LINES lines together, chosen by a hash of the id (documented
bounds, both parameters of ``fit``); scoring reads every line of every text.

Defined results: null, empty and blank texts have no lines and get the share of
good documents among the labels; repeated rows and null ids give a row each;
without labelled rows every score is 0.5; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.fitting import labelled_sample, linear, logistic
from marlstone.llm.runtime import documents, ship, stash
from marlstone.llm.textcore import SPACE, bytes_of, chunks, text_column, words_of

FIT_DOCS, FIT_LINES, ROUNDS = 4000, 150_000, 150
_SETS = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)], "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
    "stop": b".,;:?", "mark": b"!", "symbol": b"#$%&*@^~<>{}[]=_\\/+`", "bar": b"|", "space": np.flatnonzero(SPACE),
}


def _mask(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.array(list(members))] = True
    return out


_MASKS = {k: _mask(v) for k, v in _SETS.items()}


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    curve: np.ndarray
    base: float


def _lines(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of each non-blank line, its length, and where each document's lines start."""
    texts = text_column(chunk, "text")
    data, offsets = bytes_of(texts)
    w = words_of(texts)
    # A line ends at a line feed or with its document.
    ends = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, ends + 1]))
    begin, end = edges[:-1], edges[1:]
    first = np.searchsorted(w.start, edges)
    full = np.diff(first) > 0
    begin, end, first, last = begin[full], end[full], first[:-1][full], first[1:][full]
    words = (last - first).astype(float)
    size = np.maximum((end - begin).astype(float), 1)
    total = {k: np.concatenate([[0], np.cumsum(m[data], dtype=np.int64)]) for k, m in _MASKS.items()}
    n = {k: (t[end] - t[begin]).astype(float) for k, t in total.items()}
    line = np.repeat(np.arange(len(first)), last - first)
    order = np.lexsort((w.hash, line))
    h = w.hash[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    next_to = np.zeros(len(h), bool)
    next_to[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    tail = data[w.end[last - 1] - 1] if len(last) else np.zeros(0, np.uint8)
    own = np.stack([
        np.log1p(size), np.log1p(words), np.minimum(size / words, 20), n["letter"] / size, n["upper"] / np.maximum(n["upper"] + n["lower"], 1), n["digit"] / size,
        np.sqrt(n["stop"] / words), np.sqrt(n["mark"] / words), np.sqrt(n["symbol"] / words), np.sqrt(n["bar"] / words),
        np.bincount(line, again, len(first)) / words, np.bincount(line, next_to, len(first)) / words, (tail == 46).astype(float), (n["stop"] > 0).astype(float),
    ], axis=1)
    return own, size, np.searchsorted(begin, offsets)


def _with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Adds the features of the lines before and after within a document, and whether there are such."""
    n = len(own)
    inner = np.ones(n + 1)
    inner[starts[starts <= n]] = 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * inner[1:n, None]
    after[:-1] = own[1:] * inner[1:n, None]
    return np.concatenate([own, before, after, 1 - inner[:n, None], 1 - inner[1:, None]], axis=1)


def marginals(emit: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of each transition. emit: score of good over bad; starts: one more than documents."""
    n, lengths = len(emit), np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, sizes = starts[:-1][order], lengths[order]
    score = np.stack([np.zeros(n), emit], axis=1)
    fwd, bwd = score.copy(), np.zeros((n, 2))
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes.max(initial=0)))]  # documents with over t lines
    for t in range(1, len(live)):
        at = begin[: live[t]] + t
        x = fwd[at - 1, :, None] + transitions[None]
        fwd[at] += np.logaddexp(x[:, 0], x[:, 1])
    for t in range(len(live) - 1, 0, -1):
        at = begin[: live[t]] + t
        x = transitions[None] + (score[at] + bwd[at])[:, None, :]
        bwd[at - 1] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    both = fwd + bwd
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
    inner = np.ones(n, bool)
    inner[starts[:-1][lengths > 0]] = False
    at = np.flatnonzero(inner)
    pair = fwd[at - 1, :, None] + transitions[None] + (score[at] + bwd[at])[:, None, :]
    pair = np.exp(pair - np.logaddexp(both[at, 0], both[at, 1])[:, None, None])
    return good, pair.sum(0)


def _fit_field(x: np.ndarray, y: np.ndarray, starts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the penalised log-likelihood."""
    inner = np.ones(len(y), bool)
    inner[starts[:-1][np.diff(starts) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        good, pairs = marginals(x @ theta[:-4], starts, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(y) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _raw(good: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean over lines, weighted by length; NaN without lines."""
    doc, n = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), len(starts) - 1
    with np.errstate(invalid="ignore"):  # each document's lines are added up by themselves, in their order
        return np.bincount(doc, good * size, n) / np.bincount(doc, size, n)


def _curve(raw: np.ndarray) -> np.ndarray:
    p = np.clip(raw, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(p)), np.log(p / (1 - p)) / 4, p], axis=1)


def _within(sample: DataFrame, lines: int) -> DataFrame:
    """Documents of a bounded sample that have so many lines together, taken in the order of a hash of the id. One that doesn't fit any more is passed over."""
    breaks = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")) + 1
    left, fitting = lines, []
    for r in sample.select("doc_id", breaks.alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # a row for each document of the sample
        if r["n"] <= left:
            left -= r["n"]
            fitting.append((r["doc_id"],))
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(fitting, "doc_id long")), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = FIT_DOCS, label: str = "quality", lines: int = FIT_LINES) -> QualityModel:
    """Fits from documents (doc_id, text) and labels (doc_id, label); only labels for which ``allowed`` holds are read."""
    ship(docs.sparkSession)
    sample = _within(stash(labelled_sample(documents(docs), labels, label, allowed, bound), "labelled"), lines)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                own, size, starts = _lines(chunk)
                rows = np.concatenate([_with_neighbours(own, starts), size[:, None]], axis=1)
                parts = [rows[a:z].ravel() for a, z in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("label"), pa.array(parts, pa.list_(pa.float64()))], names=["doc_id", "label", "rows"])

    got = sample.mapInArrow(gather, "doc_id long, label int, rows array<double>").toPandas().sort_values("doc_id")
    own, _, starts = _lines(pa.RecordBatch.from_arrays([pa.array(["x"])], names=["text"]))
    width = _with_neighbours(own, starts).shape[1]
    lengths = got["rows"].map(len).to_numpy() // (width + 1) if len(got) else np.zeros(0, int)
    if not lengths.sum():
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)), np.zeros(3), 0.5)
    rows = np.concatenate(got["rows"].to_numpy()).reshape(-1, width + 1)
    label_of = got["label"].to_numpy(float)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    mean, scale = rows[:, :-1].mean(0), rows[:, :-1].std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    x = np.concatenate([np.ones((len(rows), 1)), (rows[:, :-1] - mean) / scale], axis=1)
    weights, transitions = _fit_field(x, np.repeat(label_of, lengths), starts, ROUNDS)
    good, _ = marginals(x @ weights, starts, transitions)
    raw = _raw(good, rows[:, -1], starts)
    has = lengths > 0
    return QualityModel(mean, scale, weights, transitions, logistic(_curve(raw[has]), label_of[has], 0.1), float(label_of.mean()))


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and raw (the length-weighted share of good lines) of every document."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text", 1 << 22):
                own, size, starts = _lines(chunk)
                x = (_with_neighbours(own, starts) - model.mean) / model.scale
                good, _ = marginals(linear(x, model.weights[1:]) + model.weights[0], starts, model.transitions)
                raw = _raw(good, size, starts)
                p = 1 / (1 + np.exp(-np.clip(linear(_curve(np.nan_to_num(raw, nan=0.5)), model.curve), -30, 30)))
                p = np.where(np.isnan(raw), model.base, p)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(p), pa.array(raw, mask=np.isnan(raw))], names=["doc_id", "score", "raw"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, raw double")
