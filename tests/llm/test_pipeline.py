"""The corpus pipeline, stage by stage and whole, against brute force on a small table."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, toxicity
from marlstone.llm.fitting import remainder
from tests.llm.test_corpus import SMALL, contaminated, linked_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, doc string, row string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(31)
    word = [f"wort{i}" for i in range(500)]
    prose = lambda n: [r.choice(word) for _ in range(n)]
    item = prose(40)
    rows, toxic = [], set()
    for i in range(500):
        w = prose(60)
        if i % 9 == 0:
            w[20], w[40], toxic = "zurgel" + r.choice("abc"), "zurgelx", toxic | {i}
        elif i % 17 == 1:
            w[10:50] = item
        elif i % 13 == 2:
            w[30] = "password: hunter2secret" + str(i)
        rows.append((i, " ".join(w)))
    for i in range(500, 540):  # near copies: a word in sixty differs, and exact ones
        base = rows[3 * (i - 500) + 2][1].split()
        if i % 2:
            base[30] = "changed"
        rows.append((i, " ".join(base)))
    rows += [(600, None), (601, ""), (602, " \n "), (None, "no id of its own"), (None, "no id of its own"), (603, "x " * 40_000), (3, rows[3][1])]
    top = tmp_path_factory.mktemp("tables")
    full = [(i, t, "xx", "s", len(t or ""), "d", "r") for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows[:500]], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top), rows, toxic, [(1, " ".join(item)), (2, None), (3, "")]


def listed(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def without_copies(rows):
    """Of documents linked by five-word shingles at four fifths the one with the smallest id stays."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in rows:
        w = word.findall((t or "").translate(SMALL))
        if i is not None and w:
            sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and (n := len(sets[i] & sets[j])) and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    for _ in sets:
        before = dict(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    kept = [(i, t) for i, t in rows if least.get(i, i) == i]
    smallest = {i: min(t or "" for j, t in kept if j == i) for i, _ in kept if i is not None}
    return [x for x in kept if x[0] is None] + [(i, next(t for j, t in kept if j == i and (t or "") == smallest[i])) for i in smallest]


def redacted(text):
    spans = sorted((int(a), int(z)) for _, a, z in (x.split(":") for x in linked_spans(text).split(",") if x))
    out, at = [], 0
    for a, z in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return text if not spans else "".join(out) + text[at:]


def test_stages_and_run(spark, tables):
    top, rows, toxic, items = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    labels = spark.read.parquet(f"{top}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "secrets", "tokens"]

    clean = stages["toxicity"](spark, docs, top)
    model = toxicity.fit(docs, labels, remainder(3) != 1)
    scores = {(r.doc_id): r.score for r in toxicity.score(docs.filter("doc_id IS NOT NULL"), model).collect()}
    want = sorted(((i, t) for i, t in rows if i is None or scores[i] < corpus_pipeline.TOXIC_FROM), key=str)
    assert listed(clean) == want and clean.columns == docs.columns
    assert {i for i, _ in rows} - {i for i, _ in want} == toxic | {i for i in range(500, 540) if 3 * (i - 500) + 2 in toxic}

    one = stages["near_dedup"](spark, clean, top)
    want = sorted(without_copies(want), key=str)
    assert listed(one) == want and one.columns == docs.columns and len(want) < 460

    apart = stages["decontamination"](spark, one, top)
    bad = {i for i, *_, b in contaminated(want, items) if b}
    want = [(i, t) for i, t in want if str(i) not in bad]
    assert listed(apart) == want and apart.columns == docs.columns and len(bad) > 20

    hidden = stages["secrets"](spark, apart, top)
    want = sorted(((i, redacted(t)) for i, t in want), key=str)
    assert listed(hidden) == want and hidden.columns == docs.columns and any("[SECRET]" in (t or "") for _, t in want)
    assert all(r.n_chars == len(r.text or "") for r in hidden.filter("text IS NOT NULL").collect())

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(corpus_pipeline.TOKENIZER)), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    tokens = []
    for i, t in want:
        ids = known.encode_ordinary(t or "")
        tokens.append((str(i), len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())))
    result = lambda df: sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert result(stages["tokens"](spark, hidden, top)) == sorted(tokens)
    assert result(corpus_pipeline.run(spark, top)) == sorted(tokens)


def test_one_row_of_each_document_stays(spark):
    rows = [(1, "b b"), (1, "a a"), (1, "a a"), (None, "a a"), (None, "a a"), (2, None), (2, None), (3, "x y z")]
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, n int, row string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert listed(got) == sorted([(1, "a a"), (None, "a a"), (None, "a a"), (2, None), (3, "x y z")], key=str) and got.columns == docs.columns


def test_stages_without_labels_or_benchmark(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{tables[0]}/{name}.parquet")
        (df if name == "documents" else df.filter(F.lit(False))).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    assert corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_of_an_empty_table(spark, tables):
    top = tables[0]
    none = spark.read.parquet(f"{top}/documents.parquet").filter(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, top).count() == 0, name
