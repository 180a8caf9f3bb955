"""Mixing, alignment and resampling against brute force, on rows with nulls, blanks, copies, ties, long texts and clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from marlstone.llm import alignment, mixing, ranking, resampling
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = ["the", "Spark", "été", "naïve", "日本語", "x1", "don't", "I'm", "42", "ﬁ", "🙂"] + [f"w{i}" for i in range(50)]
    out = [(None, None, "a"), (1, "", "b"), (2, " \n\t ", None), (3, "one", None), (None, "no id", "c"), (3, "one", None), (3, "one", None)]
    out += [(i, "shared line here\n" + " ".join(r.choice(word) for _ in range(r.randint(1, 60))) + r.choice(["\n", "", "\r\nlast line", "  two  spaces"]), r.choice(["a", "b", "Z", "é", None])) for i in range(10, 70)]
    return out + [(100, "long word " * 30_000, "b"), (101, "x" * 90_000, "c"), (7, "same same", "a"), (7, "same same", "a"), (8, "▁ odd", "a"), (9, "<s> <|endoftext|> </s>", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3.0) for i, t, s in rows], "doc_id long, text string, source string, size int, taken string, rank int, score double")


# Places and edges


def test_places_are_those_of_a_sort(spark):
    r = random.Random(1)
    values = [(r.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(values, "a int, b int").repartition(5)
    got = {(x.a, x.b): x.place for x in ranking.placed(df, [F.col("a").desc_nulls_last(), F.col("b")]).collect()}
    want = sorted(values, key=lambda v: (v[0] is None, -(v[0] or 0), v[1]))
    assert [got[v] for v in want] == list(range(500))
    assert ranking.placed(df.limit(0), [F.col("a")]).collect() == []


def filled(sizes, weights, share, epochs):
    """Water-filling by its rule: clamp whoever is above, share what is left among the others, until none is above."""
    budget, full = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full and weights[i] > 0]
        level = (budget - sum(epochs * sizes[i] for i in full)) / sum(weights[i] for i in free) if free else 0
        above = {i for i in free if weights[i] * level > epochs * sizes[i]}
        if not above:
            return [epochs * s if i in full else max(weights[i], 0) * level for i, s in enumerate(sizes)]
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_fill_to_their_caps(spark, seed):
    r = random.Random(seed)
    n = r.randint(1, 30)
    sizes, weights = [r.choice([0, 5, 100, r.randint(1, 10_000)]) for _ in range(n)], [r.choice([0, 1, 2, 5, 100]) for _ in range(n)]
    df = spark.createDataFrame([(str(i), s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight int")
    got = {x.source: x.target for x in mixing.targets(df, 1.5, 2).collect()}
    assert all(math.isclose(got[str(i)], t, rel_tol=1e-12, abs_tol=1e-9) for i, t in enumerate(filled(sizes, weights, 1.5, 2)))


def mixed_by_hand(rows, weights=(5, 2, 1)):
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    sums = [sum(n for _, s, n in sized if s == x) for x in sources]
    target = dict(zip(sources, filled(sums, [weights[k % len(weights)] for k in range(len(sources))], 1.5, 2), strict=True))
    out = []
    for x, total in zip(sources, sums, strict=True):
        whole, left = divmod(math.floor(target[x]), total) if total else (0, 0)
        own = [(int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16), n, i) for i, s, n in sized if s == x]
        for _, n, i in sorted(own, key=lambda v: v[:2]):
            part = min(n, left)
            left -= part
            out.append((str(i), n, total, round(target[x], 6), whole * n + part))
    return sorted(out)


def test_mix_is_what_the_rule_says(spark, rows):
    for r in (rows, [(1, None, "a")], [(5, "w " * 40, "hot")] * 300 + [(6, "w " * 7, "other")]):
        got = mixing.mix(frame(spark, r), (5, 2, 1)).collect()
        assert sorted((str(x.doc_id), x["size"], x.source_size, round(x.target, 6), x.taken) for x in got) == mixed_by_hand(r)
        assert all(x.taken <= 2 * x["size"] for x in got)
    assert mixing.mix(frame(spark, []), (5, 2, 1)).collect() == []


def test_an_edge_among_equal_rows_is_found_by_row(spark, rows):
    many = [(1, "a b c", "hot")] * 5000 + [(2, "d", "small")]
    got = mixing.mix(frame(spark, many).repartition(7), (1, 1)).filter("source = 'hot'")
    r = got.agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("part").alias("part")).first()
    assert r.taken == math.floor(r.target) and r.part <= 3


def test_texts_of_a_mix_hold_the_words_taken(spark, rows):
    mixed = mixing.mix(frame(spark, rows), (5, 2, 1), keep=("text", "size"))
    again = mixing.texts(mixed).collect()
    assert sum(len(WORD.findall(x.text)) for x in again) == mixed.agg(F.sum("taken")).first()[0]
    whole = {t for _, t, _ in rows}
    assert sum(x.text not in whole for x in again) <= 6  # one edge a source


def test_mix_agrees_however_rows_are_dealt(spark, rows):
    df = frame(spark, rows)
    digest = lambda d: sorted(map(str, mixing.mix(d, (5, 2, 1)).drop("source").collect()))
    assert digest(df.repartition(1)) == digest(df.repartition(9)) == digest(df.orderBy(F.desc("text")))


def test_mix_takes_weights_by_source(spark, rows):
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 0.0)], "source string, weight double")
    got = mixing.mix(frame(spark, rows), weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert all((x.n > 0) == (x.source in ("a", "b")) for x in got)


# Alignment


@pytest.fixture(scope="module")
def paths():
    return [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def aligned_by_hand(rows, paths):
    """By the libraries' own encoders, in dictionaries."""
    t = tokenizers.Tokenizer.from_file(paths[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    of = alignment._of_bytes()
    vocabulary = {i: bytes(of[c] for c in s) for s, i in json.load(open(paths[0]))["model"]["vocab"].items() if all(c in of for c in s)}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    every, counts = [], Counter()
    for i, text, _ in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            want = (" " + text).encode()
            if b"".join(vocabulary[x] for x in a) != want or b"".join(map(piece, b)) != want:
                a, b = [], []
        at_a = at_b = 0
        ga, gb, k = [], [], 0
        for x in a:
            ga.append(x)
            at_a += len(vocabulary[x])
            while k < len(b) and at_b < at_a:
                gb.append(b[k])
                at_b += len(piece(b[k]))
                k += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        counts.update(links)
        every.append((i, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (str(i), n_a, n_b, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, x in every
    )


def test_alignment_equals_the_libraries_encodings(spark, rows, paths):
    got = alignment.align(frame(spark, rows).repartition(3), *paths, public_tokenizers.PATTERN, groups=True).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == aligned_by_hand(rows, paths)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert any(r.n_a > 10_000 for r in got) and {r.n_a for r in got if r.doc_id in (1, 8)} == {0}
    assert alignment.align(frame(spark, []), *paths, public_tokenizers.PATTERN).collect() == []
    none = alignment.align(frame(spark, [(1, None, "a")]), *paths, public_tokenizers.PATTERN).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_parts_of_long_texts_encode_as_the_whole(paths):
    with open(paths[0], "rb") as a, open(paths[1], "rb") as b:
        tools = alignment.Tokenizers(a.read(), b.read(), public_tokenizers.PATTERN)
    r = random.Random(5)
    for _ in range(20):
        text = "".join(r.choice(["ab ", "c  d", " e, f", "\n", "I'm it's ", "日本 x", "9 8", "🙂 "]) for _ in range(300))
        parts = tools.parts(text, 40)
        assert len(parts) > 3 and " ".join(parts) == text
        whole_a, whole_b = tools._a.encode_ordinary(" " + text), tools._b.encode(text)
        assert [i for p in parts for i in tools._a.encode_ordinary(" " + p)] == whole_a and [i for p in parts for i in tools._b.encode(p)] == whole_b
    assert 50_000 < alignment.most_pairs(tools) < 2_000_000


def test_minimal_hash_numbers_every_key_once_and_knows_no_other():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 40, n).astype(np.uint64))
        hashed = alignment.MinimalHash(keys)
        assert sorted(hashed.find(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(r.integers(0, 1 << 40, 1000).astype(np.uint64), keys)
        assert (hashed.find(others) == -1).all()


def test_vectors_are_added_over_several_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "SEGMENT", 16)
    r = np.random.default_rng(4)
    parts = [(r.choice(np.arange(1, 101, dtype=np.uint64), 60, replace=False), r.integers(1, 9, 60)) for _ in range(11)]
    df = spark.createDataFrame([(bytearray(k.tobytes()), bytearray(s.astype(np.int64).tobytes())) for k, s in parts], "keys binary, sums binary").repartition(11)
    hashed = alignment.MinimalHash(np.arange(1, 101, dtype=np.uint64))
    from marlstone.llm.runtime import ship

    ship(spark)
    # FAN and SEGMENT are read on the driver and in tasks: tasks keep their own.
    got = alignment.counted(df, spark.sparkContext.broadcast(hashed))
    want = Counter()
    for k, s in parts:
        want.update(dict(zip(k.tolist(), s.tolist(), strict=True)))
    assert {int(k): int(n) for k, n in zip(hashed.keys, got, strict=True) if n} == dict(want)


# Resampling


def test_crc32_of_slices():
    r = random.Random(6)
    words = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 3, 7, 63, 64, 65, 200]))) for _ in range(500)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    assert resampling.crc32s(data, start, end).tolist() == [zlib.crc32(w) for w in words]
    assert len(resampling.crc32s(data, start[:0], end[:0])) == 0


def runs(text, highest):
    w = ALNUM.findall((text or "").translate(SMALL))
    return [" ".join(w[i : i + n]) for n in range(1, highest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("highest", [1, 2, 3])
def test_counts_of_lines_are_those_of_whole_texts(spark, rows, highest):
    want = np.zeros(97, np.int64)
    for _, t, _ in rows:
        for x in runs(t, highest):
            want[zlib.crc32(x.encode()) % 97] += 1
    assert resampling.bucket_counts(frame(spark, rows).repartition(3), "text", highest, 97).tolist() == want.tolist()


@pytest.mark.parametrize("highest, percent", [(1, 10), (2, 50)])
def test_resampling_equals_the_rule(spark, rows, highest, percent):
    target = [("the Spark w1 w2 w3",), (None,), ("été 日本語 été",)]
    count = lambda texts: Counter(zlib.crc32(x.encode()) % 1000 for t in texts for x in runs(t, highest))
    s, t = count(x[1] for x in rows), count(x[0] for x in target)
    n_s, n_t = sum(s.values()), sum(t.values())
    want = []
    for i, text, _ in rows:
        g = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 1000) / ((s[b] + 1) * (n_t + 1000)))) for b in (zlib.crc32(x.encode()) % 1000 for x in runs(text, highest))]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ALNUM.findall(text or ""))])
    able = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    df = spark.createDataFrame(target, "text string")
    got = resampling.resample(frame(spark, rows).repartition(4), df, percent=percent, highest=highest, buckets=1000, keep=("text",))
    key = lambda v: (str(v[0]), *map(str, v[1:]))
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=key) == sorted(((*x[:4], drawn.get(id(x))) for x in want), key=key)
    assert drawn and got.filter("kept.text = 'one'").count() == 3
    assert resampling.resample(frame(spark, []), df.limit(0)).collect() == []
