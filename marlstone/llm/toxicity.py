"""Toxicity by weak supervision.

Voters.       Nothing toxic is listed here: words, beginnings of words and pairs of
              neighbouring words vote if the labelled sample shows, by a significance
              test against the share of toxic texts, that texts with so many of them
              are toxic.  Pattern voters look at capitals, exclamation, repetition,
              symbols, word length and how densely the lexicon hits, each above a cut
              that the sample sets.  A voter fires (1) or not (0); which class a
              firing speaks for is learned.
Label model.  A generative model of the votes: each voter has its own rate of
              firing in either class, and the label of a sample row is one more,
              noisy vote.  Expectation maximisation estimates rates and posteriors;
              in each round the correlation left between voters given the class is
              estimated anew and shrinks their weight, so that near copies don't count
              as independent.  It is cross-fitted: the sample is halved by a hash of
              the text, and voters that one half chose (entries, times, cuts) are
              judged on the other, whose labels had no part in choosing them.
Classifier.   A logistic regression on the evidence of voters chosen from the whole
              sample, trained on the posterior labels, scores every document.

The fit takes at most FIT_ROWS labelled rows (a documented bound).  Equal texts among
them count once, as toxic if any copy is, and so do near copies, by MinHash
signatures of the sample: a text that was copied often would else vouch for each of
its words.  Everything is scored.

Defined results: null, empty and blank texts have no evidence and get the score
of a text without hits; repeated rows and null ids give a row each; without any
labelled row nothing is known and every score is the prior PRIOR; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.llm.fitting import labelled_sample, linear, logistic
from marlstone.llm.near_dedup import profiles
from marlstone.llm.runtime import documents, ship, stash
from marlstone.llm.textcore import NOT_ALNUM, SPACE, NGrams, bytes_of, chunks, text_column, words_of

FIT_ROWS, PRIOR = 10_000, 0.05
#: A lexicon entry: so many toxic texts at least, so much of its texts toxic, and a G statistic that chance reaches about once among all candidates, and this at least.
SUPPORT, PURITY, SURE = 4, 0.5, 12.0
#: Beginnings of words that are tried, in characters, and how many occurrences an entry may need.
STEMS, TIMES = (3, 4, 5, 6, 7, 8), (1, 2, 3)
PATTERNS = ("capitals", "exclaiming", "repeating", "symbols", "long words", "kinds", "dense")
#: Words of a shingle, and values of 64 that signatures of near copies differ in at most (a similarity of about 0.7).
SHINGLE, NEAR = 5, 20
#: How sure a label of the sample is as a vote.
LABEL_ODDS = float(np.log(0.98 / 0.02))


@dataclass
class Lexicon:
    """Entries: a word, a beginning that ends in *, or two neighbouring words; times: how often a text must have each for it to fire.

    Hashes are sorted by kind: the length in bytes of a beginning, 0 for whole words, -1 for pairs.
    """

    entries: list[str]
    times: list[int]

    def __post_init__(self) -> None:
        self.by_kind: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        plain = [e.removesuffix("*") for e in self.entries]
        w = words_of(pa.array(plain, pa.string()), lower=True, ends=NOT_ALNUM)
        pair = NGrams(w.hash)
        hashes = np.array([pair.hash(np.array([a]), np.array([z]))[0] if z - a > 1 else w.hash[a] for a, z in zip(w.first, w.first[1:], strict=False)], np.uint64)
        kinds = np.array([-1 if " " in e else len(p.encode()) if e.endswith("*") else 0 for e, p in zip(self.entries, plain, strict=True)])
        for kind in sorted(set(kinds.tolist())):
            column = np.flatnonzero(kinds == kind)
            column = column[np.argsort(hashes[column])]
            self.by_kind[kind] = hashes[column], column

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How often each entry occurs in each text, and the number of words."""
        n, width = len(texts), len(self.entries)
        w = words_of(texts, lower=True, ends=NOT_ALNUM)
        total = np.zeros(n * width)
        for kind, (hashes, column) in self.by_kind.items():
            if kind > 0:
                place = np.flatnonzero(w.end - w.start >= kind)
                h = w.part_hash(w.start[place], w.start[place] + kind)
            elif kind == 0:
                place, h = np.arange(len(w.hash)), w.hash
            else:
                place = np.flatnonzero(np.diff(w.doc_of_word()) == 0)
                h = w.ngrams().hash(place, place + 2)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            doc = np.searchsorted(w.first, place[hit], side="right") - 1
            total += np.bincount(doc * width + column[at[hit]], minlength=n * width)
        return total.reshape(n, width), np.diff(w.first)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Rate of firing in toxic and in clean texts, of each voter, on the half of the sample that didn't choose it.
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlated: list[tuple[str, str]] = field(default_factory=list)
    prior: float = PRIOR
    #: Rows of the sample whose posterior contradicts their label.
    moved: int = 0


def _evidence(chunk: pa.RecordBatch, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Hits of each entry, and the value of each pattern."""
    texts = text_column(chunk, "text")
    hits, words = lexicon.hits(texts)
    data, offsets = bytes_of(texts)
    some = np.maximum(words, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)

    upper, lower, space = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122)), count(SPACE[data])
    other = count(NOT_ALNUM[data]) - space
    w = words_of(texts, lower=True, ends=NOT_ALNUM)
    doc = w.doc_of_word()
    again = np.zeros(len(doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    total = hits.sum(axis=1)
    values = [
        upper / np.maximum(upper + lower, 1), count(data == 33) / some, np.bincount(doc, again, len(words)) / some, other / some, (upper + lower) / some,
        (hits > 0).sum(axis=1).astype(float), total / (some + 20.0),
    ]
    return hits, np.stack(values, axis=1)


def _features(hits: np.ndarray, patterns: np.ndarray, times: np.ndarray) -> np.ndarray:
    total = hits.sum(axis=1, keepdims=True)
    fired = hits >= times
    return np.concatenate([
        np.ones((len(hits), 1)), fired, np.minimum(np.log1p(total), 3), np.minimum(fired.sum(axis=1, keepdims=True), 6) / 2, (total == 0).astype(float),
        np.log(np.minimum(patterns[:, -1:], 0.2) + 1e-3), np.minimum(patterns[:, :-2], 3), np.minimum(patterns[:, -2:-1], 6) / 2,
    ], axis=1)


def g_statistic(bad: np.ndarray, n: np.ndarray, all_bad: float, total: float) -> np.ndarray:
    """Twice the log-likelihood ratio of the table (toxic or not, with the voter or without) against independence."""
    cells = [(bad, n * (all_bad / total)), (n - bad, n * (1 - all_bad / total)), (all_bad - bad, (total - n) * (all_bad / total)), (total - n - all_bad + bad, (total - n) * (1 - all_bad / total))]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(np.where(seen > 0, seen * np.log(seen / want), 0.0) for seen, want in cells)


def cuts(values: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of each column the cut among its quantiles above which labels differ most from those below."""
    out = np.zeros(values.shape[1])
    for k in range(values.shape[1]):
        tried = np.unique(np.quantile(values[:, k], np.linspace(0.02, 0.99, 40), method="higher"))
        above = values[:, k, None] >= tried
        out[k] = tried[int(np.argmax(g_statistic((above * labels[:, None]).sum(0), above.sum(0).astype(float), labels.sum(), len(labels))))]
    return out


def label_model(votes: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Posterior of each row, rates[class, voter] of firing, the weight of each voter, and pairs of voters correlated given the class."""
    fires = votes.astype(float)
    anchor = np.log(prior / (1 - prior)) + np.where(labels > 0.5, LABEL_ODDS, -LABEL_ODDS)
    q, pairs = np.where(labels > 0.5, 0.98, 0.02), []
    for _ in range(rounds):
        rates = np.stack([(w @ fires + 0.5) / (w.sum() + 1) for w in (1 - q, q)])
        left = fires - np.stack([1 - q, q], axis=1) @ rates  # what the class doesn't explain
        sd = left.std(axis=0)
        live = sd > 1e-6
        c = np.abs(left.T @ left) / len(votes) / np.maximum(np.outer(sd, sd), 1e-12)
        c = np.where((c > 0.3) & live[:, None] & live[None, :], c, 0)
        np.fill_diagonal(c, 1)
        share = 1 / c.sum(axis=1)
        pairs = [(int(i), int(j)) for i, j in np.argwhere(np.triu(c, 1) > 0)]
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        odds = anchor + fires @ (share * on) + (1 - fires) @ (share * off)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, rates, share, pairs


def mine(sample: DataFrame) -> tuple[list[str], list[int]]:
    """Entries and the times they need. sample: distinct texts with a label, a bounded table.

    Each candidate is tested against the share of toxic texts, so the words of a rare language count as those of a frequent one.
    Of entries that contain one another the more significant one stays.
    """
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = sample.select("label", F.monotonically_increasing_id().alias("id"), F.filter(F.split(plain, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", -1), lambda w: w != "").alias("words"))
    total = words.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    if not total["bad"]:
        return [], []
    beginnings = [F.expr(f"transform(filter(words, w -> char_length(w) >= {k}), w -> concat(left(w, {k}), '*'))") for k in STEMS]
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    entries = words.select("label", F.array_sort(F.concat(F.filter("words", lambda w: F.length(w) >= 3), pairs, *beginnings)).alias("entries"))
    # In order, the k-th occurrence in a text is one whose k-1 predecessors are equal and the one before differs; from the last one counted on nothing is said.
    back = lambda i, k: F.coalesce(F.get("entries", i - k), F.lit(""))
    nth = lambda x, i: F.when(back(i, 1) != x, 1).when(back(i, 2) != x, 2).when(back(i, 3) != x, 3)
    texts = entries.select("label", F.explode(F.filter(F.transform("entries", lambda x, i: F.struct(x.alias("entry"), nth(x, i).alias("times"))), lambda x: x["times"].isNotNull())).alias("x")).select("label", "x.*")
    counts = texts.groupBy("entry").agg(*[f for k in TIMES for f in (F.sum(F.when(F.col("times") == k, F.col("label")).otherwise(0)).alias(f"bad{k}"), F.count_if(F.col("times") == k).alias(f"n{k}"))])
    # One row for each times; the significance of these few is computed on the driver.
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("times"), F.col(f"bad{k}").alias("bad"), F.col(f"n{k}").alias("n")) for k in TIMES]))
    tried = Observation()
    counts = counts.observe(tried, F.count_if(F.col("n1") >= SUPPORT).alias("n"))
    likely = counts.select("entry", level.alias("x")).select("entry", "x.*").filter((F.col("bad") >= SUPPORT) & (F.col("bad") >= PURITY * F.col("n")))
    rows = likely.toPandas()
    rows["g"] = g_statistic(rows["bad"].to_numpy(float), rows["n"].to_numpy(float), float(total["bad"]), float(total["n"])) if len(rows) else 0.0
    rows = rows[rows["g"] >= max(SURE, 2 * np.log(max(tried.get["n"], 1)))].assign(g=rows["g"].round(6), size=rows["entry"].str.len())
    rows = rows.sort_values(["g", "size", "entry", "times"], ascending=[False, False, True, True])  # of equally good ones the longest, which says most
    found: dict[str, int] = {}
    for name, times in zip(rows["entry"], rows["times"], strict=True):
        if not any(_same(name, other) for other in found):
            found[name] = int(times)
    return list(found), list(found.values())


def first_of_copies(signatures: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Which rows differ from every kept row before them in more than ``near`` values."""
    keep, kept, n = np.zeros(len(signatures), bool), np.empty_like(signatures), 0
    for i, s in enumerate(signatures):
        if not n or (kept[:n] != s).sum(axis=1).min() > near:
            kept[n], keep[i] = s, True
            n += 1
    return keep


def _same(a: str, b: str) -> bool:
    """Whether one entry's words are among the other's."""
    if " " in a or " " in b:
        return any(_same(x, y) for x in a.split() for y in b.split()) if a != b else True
    x, y = a.rstrip("*"), b.rstrip("*")
    return x == y or (a.endswith("*") and y.startswith(x)) or (b.endswith("*") and x.startswith(y))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = FIT_ROWS, label: str = "toxic") -> ToxicityModel:
    """Fits from documents (doc_id, text) and labels (doc_id, label); only labels for which ``allowed`` holds are read."""
    ship(docs.sparkSession)
    sample = labelled_sample(documents(docs), labels, label, allowed, bound).filter("text IS NOT NULL")
    sample = stash(sample.groupBy("text").agg(F.max("label").alias("label")).withColumn("doc_id", F.xxhash64("text")), "labelled")
    known = profiles(sample.select("doc_id", "text"), SHINGLE).select("doc_id", "signature").orderBy("doc_id").toPandas()  # of the bounded sample
    if len(known):
        only = known["doc_id"][first_of_copies(np.stack([np.frombuffer(x, np.uint16) for x in known["signature"]]))]
        sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame(only.to_frame())), "doc_id", "left_semi")
    lexicon = Lexicon(*mine(sample))
    sample = sample.withColumn("half", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int"))
    lexicons = [lexicon, *(Lexicon(*mine(sample.filter(F.col("half") != h))) for h in (0, 1))]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                rows = np.concatenate([x for one in lexicons for x in _evidence(chunk, one)], axis=1)
                yield pa.RecordBatch.from_arrays([chunk.column("label"), chunk.column("half"), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "half", "rows"])

    rows = sample.mapInArrow(gather, "label int, half int, rows array<double>").toPandas()  # a row for each text of the bounded sample
    times = np.array(lexicon.times, float)
    if not len(rows):
        weights = np.zeros(_features(np.zeros((1, len(times))), np.zeros((1, len(PATTERNS))), times).shape[1])
        weights[0] = np.log(PRIOR / (1 - PRIOR))
        return ToxicityModel(lexicon, weights)
    y, half, values = rows["label"].to_numpy(float), rows["half"].to_numpy(), np.stack(rows["rows"].to_numpy())
    order = np.lexsort([*values.T, half, y])  # the order rows came in doesn't count
    y, half, values = y[order], half[order], values[order]
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    ends = np.cumsum([len(one.times) + len(PATTERNS) for one in lexicons])
    evidence = [(v[:, : len(one.times)], v[:, len(one.times) :]) for v, one in zip(np.split(values, ends[:-1], axis=1), lexicons, strict=True)]
    posterior, rates, pairs = crossed(evidence[1:], lexicons[1:], half, y, prior)
    weights = logistic(_features(*evidence[0], times), posterior)
    return ToxicityModel(lexicon, weights, rates, pairs, prior, int(((posterior >= 0.5) != (y > 0.5)).sum()))


def crossed(
    evidence: list[tuple[np.ndarray, np.ndarray]], lexicons: list[Lexicon], half: np.ndarray, labels: np.ndarray, prior: float
) -> tuple[np.ndarray, dict[str, tuple[float, float]], list[tuple[str, str]]]:
    """Posterior of each row, rates of firing and correlated pairs of voters, by name. lexicons[h] is what the half other than h chose.

    A half is judged by the other's voters; if either is empty, there is nothing to judge by and a label stands as far as a label is believed.
    """
    posterior = np.where(labels > 0.5, 1, -1) * LABEL_ODDS
    posterior = 1 / (1 + np.exp(-posterior))
    seen: dict[str, list[tuple[float, float]]] = {}
    correlated: set[tuple[str, str]] = set()
    for h, (hits, patterns) in enumerate(evidence):
        own = half == h
        if own.all() or not own.any():
            continue
        names = [*lexicons[h].entries, *PATTERNS]
        fired = np.concatenate([hits >= np.array(lexicons[h].times, float), patterns >= cuts(patterns[~own], labels[~own])], axis=1)
        posterior[own], rates, _, pairs = label_model(fired[own], labels[own], prior)
        for i, name in enumerate(names):
            seen.setdefault(name, []).append((float(rates[1, i]), float(rates[0, i])))
        correlated.update((names[i], names[j]) for i, j in pairs)
    return posterior, {name: tuple(np.mean(found, axis=0).tolist()) for name, found in seen.items()}, sorted(correlated)


def _scores(model: ToxicityModel):
    times = np.array(model.lexicon.times, float)
    return lambda chunk: linear(_features(*_evidence(chunk, model.lexicon), times), model.weights)


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    ship(df.sparkSession)
    scores = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(scores(chunk), -30, 30))))], names=["doc_id", "score"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(df: DataFrame, model: ToxicityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of df whose text scores under the threshold, as they are."""
    ship(df.sparkSession)
    scores, limit = _scores(model), float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, text_col):
                only = pa.RecordBatch.from_arrays([chunk.column(text_col)], names=["text"])
                yield chunk.filter(pa.array(scores(only) < limit))

    return df.mapInArrow(run, df.schema)
