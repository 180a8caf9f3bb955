"""Scores of toxicity and quality: alike in every batch, and equal to what their features say when computed text by text."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import near_dedup, quality, toxicity
from marlstone.llm.textcore import chunks

ALNUM, WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    word = ["haus", "été", "Gut", "zurgel", "zurgelt", "bad idea", "HALT!", "12.5", "|", "&", "fine.", "ok,"] + [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        lines = [" ".join(r.choice(word) for _ in range(r.randint(0, 15))) for _ in range(r.randint(1, 8))]
        toxic = i % 6 == 0
        if toxic:
            lines.append("quabble flonk " + r.choice(word))
        good = r.random() < 0.7
        rows.append((i, "\n".join(lines if good else [x.upper() + " !!! ### 99" for x in lines]), int(toxic), int(good)))
    rows += [(400, None, 0, 1), (401, "", 0, 0), (402, " \n\n ", 0, 0), (403, "é" * 3000, 0, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows], "doc_id long, toxic int, quality int")
    return docs, labels, {i: t for i, t, *_ in rows}


def toxic_score(text, model):
    words, b = ALNUM.findall(text.translate(SMALL)), text.encode()
    hits = []
    for e in model.lexicon.entries:
        if " " in e:
            hits.append(sum(f"{x} {y}" == e for x, y in zip(words, words[1:], strict=False)))
        else:
            hits.append(sum(w.startswith(e[:-1]) if e.endswith("*") else w == e for w in words))
    upper, lower, space = (sum(lo <= c <= hi for c in b) for lo, hi in ((65, 90), (97, 122), (9, 13)))
    space += b.count(32)
    other = sum(not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in b) - space
    some, total = max(len(words), 1), sum(hits)
    fired = [h >= t for h, t in zip(hits, model.lexicon.times, strict=True)]
    shape = [upper / max(upper + lower, 1), b.count(33) / some, sum(x == y for x, y in zip(words, words[1:], strict=False)) / some, other / some, (upper + lower) / some]
    x = [1, *fired, min(math.log1p(total), 3), min(sum(fired), 6) / 2, total == 0, math.log(min(total / (some + 20), 0.2) + 1e-3), *(min(v, 3) for v in shape), min(sum(h > 0 for h in hits), 6) / 2]
    return 1 / (1 + math.exp(-sum(a * w for a, w in zip(x, model.weights, strict=True))))


def quality_score(text, model):
    lines = [x + "\n" * (k < text.count("\n")) for k, x in enumerate(text.split("\n"))]
    own, sizes = [], []
    for line in (x for x in lines if WORD.search(x)):
        w, b = WORD.findall(line), line.encode()
        n = lambda chars, b=b: sum(b.count(c) for c in chars)
        upper, lower = n(range(65, 91)), n(range(97, 123))
        stop, size, k = n(b".,;:?"), len(b), len(w)
        own.append([
            math.log1p(size), math.log1p(k), min(size / k, 20), (upper + lower + n(range(128, 256))) / size, upper / max(upper + lower, 1), n(range(48, 58)) / size,
            math.sqrt(stop / k), math.sqrt(n(b"!") / k), math.sqrt(n(b"#$%&*@^~<>{}[]=_\\/+`") / k), math.sqrt(n(b"|") / k),
            (k - len(set(w))) / k, sum(x == y for x, y in zip(w, w[1:], strict=False)) / k, w[-1].endswith("."), stop > 0,
        ])
        sizes.append(size)
    if not own:
        return model.base
    none, last = [0.0] * len(own[0]), len(own) - 1
    emit = []
    for i, x in enumerate(own):
        full = [*x, *(own[i - 1] if i else none), *(own[i + 1] if i < last else none), i == 0, i == last]
        emit.append(model.weights[0] + sum((v - m) / s * w for v, m, s, w in zip(full, model.mean, model.scale, model.weights[1:], strict=True)))
    both = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    t = model.transitions
    fwd, bwd = [(0.0, emit[0])], [(0.0, 0.0)]
    for e in emit[1:]:
        p = fwd[-1]
        fwd.append((both(p[0] + t[0, 0], p[1] + t[1, 0]), e + both(p[0] + t[0, 1], p[1] + t[1, 1])))
    for e in emit[:0:-1]:
        p = bwd[0]
        bwd.insert(0, tuple(both(t[y, 0] + p[0], t[y, 1] + e + p[1]) for y in (0, 1)))
    good = [1 / (1 + math.exp(a + c - b - d)) for (a, b), (c, d) in zip(fwd, bwd, strict=True)]
    raw = sum(g * s for g, s in zip(good, sizes, strict=True)) / sum(sizes)
    p = min(max(raw, 1e-4), 1 - 1e-4)
    z = model.curve[0] + model.curve[1] * math.log(p / (1 - p)) / 4 + model.curve[2] * p
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("op, label, by_hand", [(toxicity, "toxic", toxic_score), (quality, "quality", quality_score)])
def test_scores_are_those_computed_text_by_text(labelled, op, label, by_hand):
    docs, labels, texts = labelled
    model = op.fit(docs, labels, F.lit(True), label=label)
    got = {r.doc_id: r.score for r in op.score(docs, model).collect()}
    assert len(got) == len(texts) and len({round(x, 9) for x in got.values()}) > 20
    for i, t in texts.items():
        assert math.isclose(got[i], by_hand(t or "", model), rel_tol=1e-6, abs_tol=1e-9), i


@pytest.mark.parametrize("op, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_do_not_depend_on_the_batch(labelled, op, label):
    docs, labels, texts = labelled
    model = op.fit(docs, labels, F.lit(True), label=label)
    spark = docs.sparkSession
    probe = "Some Gut words w3 zurgel, HALT! été\nand a second line. quabble flonk"
    many = spark.createDataFrame([(i, t) for k in range(40) for i, t in [(1000 + k, probe), *list(texts.items())[k * 9 : k * 9 + 9 - k % 3]]], "doc_id long, text string")
    first = None
    for df in (many.repartition(1), many.repartition(7), many.orderBy(F.desc("text")), many.orderBy(F.xxhash64("doc_id")), many.repartition(40, "doc_id")):
        scores = {(r.doc_id, r.score) for r in op.score(df, model).collect()}
        first = first or scores
        assert scores == first
    assert len({s for i, s in first if i >= 1000}) == 1


def test_what_is_kept_does_not_depend_on_the_batch(labelled):
    docs, labels, texts = labelled
    model = toxicity.fit(docs, labels, F.lit(True))
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts.values()])], names=["text"])
    scores = toxicity._scores(model)
    whole = scores(batch).tolist()
    alone = [float(scores(batch.slice(i, 1))[0]) for i in range(len(batch))]
    parts = [x for c in chunks(batch, "text", 500) for x in scores(c).tolist()]
    assert whole == alone == parts
    cut = 1 / (1 + math.exp(-sorted(whole)[len(whole) // 2]))  # a threshold that is one of the scores
    kept = lambda d: sorted(r.doc_id for r in toxicity.keep_clean(d, model, cut).collect())
    assert kept(docs.repartition(1)) == kept(docs.repartition(9)) == kept(docs.orderBy(F.desc("text")))


def test_documents_too_long_for_the_sample_are_passed_over(spark):
    order = [r.id for r in spark.range(20).orderBy(F.xxhash64("id"), "id").collect()]
    long = {order[0], order[4]}
    docs = spark.createDataFrame([(i, "x\n" * (500 if i in long else 9) + "end") for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in quality._within(docs, 100).collect()} == {i for i in order if i not in long}.intersection(order[:12])
    assert quality._within(docs, 5).count() == 0


def test_a_set_longer_than_a_tile_is_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 50)
    r = random.Random(2)
    long = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-3] + ["x"])), (3, " ".join(long[200:])), (4, "short text here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_voters_are_judged_where_they_were_not_chosen():
    r = np.random.default_rng(4)
    n = 1200
    half, labels = np.arange(n) % 2, (r.random(n) < 0.3).astype(float)
    real = (r.random(n) < np.where(labels == 1, 0.8, 0.05)).astype(float)
    luck = np.where(half == 0, labels, r.random(n) < 0.2).astype(float)  # says in one half what the label says, and nothing in the other
    patterns = r.random((n, len(toxicity.PATTERNS)))
    words = toxicity.Lexicon(["real", "luck"], [1, 1])
    hits = np.stack([real, luck], axis=1)
    posterior, rates, pairs = toxicity.crossed([(hits, patterns)] * 2, [words, words], half, labels, 0.3)
    for h in (0, 1):
        own = half == h
        cut = toxicity.cuts(patterns[~own], labels[~own])
        votes = np.concatenate([hits >= 1, patterns >= cut], axis=1)[own]
        q, got, _, _ = toxicity.label_model(votes, labels[own], 0.3)
        assert np.allclose(posterior[own], q)
        if h == 1:
            assert abs(got[1, 1] - got[0, 1]) < 0.15 and got[1, 0] - got[0, 0] > 0.6
    chosen_in_0 = [toxicity.Lexicon(["real"], [1]), words]  # "luck" was chosen by half 0 only, so half 1 alone judges it
    _, rates, _ = toxicity.crossed([(hits[:, :1], patterns), (hits, patterns)], chosen_in_0, half, labels, 0.3)
    assert abs(rates["luck"][0] - rates["luck"][1]) < 0.15 and rates["real"][0] - rates["real"][1] > 0.6
    # With one half empty there is nobody to judge, and a label stands as far as it is believed.
    posterior, rates, pairs = toxicity.crossed([(hits, patterns)] * 2, [words, words], np.zeros(n, int), labels, 0.3)
    assert np.allclose(posterior, np.where(labels == 1, 0.98, 0.02)) and rates == {} and pairs == []
