"""Operators against brute force on small tables with nulls, blanks, copies, clashing columns and long texts."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marlstone.llm import bpe, decontamination, near_dedup, neighbours, quality, queries, secrets, sharding, substring_dedup, toxicity, warc
from marlstone.llm.fitting import labelled_sample, remainder
from pyspark.sql import functions as F

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, spans string, anchor int, runs string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    word = [f"w{i}" for i in range(400)] + ["É", "été", "Über"]
    passage = [r.choice(word) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, " ".join(passage)), (5, " ".join(passage)), (6, "a " * 3000)]
    for i in range(7, 60):
        w = [r.choice(word) for _ in range(r.randint(5, 90))]
        if i % 3 == 0:
            w[3:3] = passage[r.randint(0, 20) : r.randint(35, 60)]
        if i % 7 == 0:
            w = [x if r.random() > 0.03 else "edit" for x in rows[-1][1].split()]
        rows.append((i, " ".join(w).upper() if i % 11 == 0 else "  ".join(w)))
    return rows


def repeats(rows):
    """For each row (id, text): words, and which of them a window of 13 words covers that starts in a document with a smaller id."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [(i, word.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in tokens:
        for a in range(len(w) - 12) if i is not None else ():
            first[tuple(w[a : a + 13])] = min(i, first.get(tuple(w[a : a + 13]), i))
    out = []
    for i, w in tokens:
        gone = {p for a in range(len(w) - 12) if i is not None and first[tuple(w[a : a + 13])] < i for p in range(a, a + 13)}
        out.append((str(i), len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def removed(spark, rows):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())


def test_substring_dedup(spark, texts):
    got = removed(spark, texts)
    assert got == repeats(texts) and dict((i, n) for i, _, n, _ in got)["5"] == 60


def test_repeats_of_repeated_and_missing_ids(spark):
    r = random.Random(8)
    make = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    p, own = make(40), make(40)
    rows = [(1, p), (5, p), (5, own), (5, own), (None, p), (None, p), (7, p + " " + own)]
    got = removed(spark, rows)
    assert got == repeats(rows)
    assert [x[2] for x in got if x[0] == "5"] == [0, 0, 40] and [x[2] for x in got if x[0] == "None"] == [0, 0]


def test_a_phrase_in_many_contexts(spark):
    # Five words that many documents hold between different ones: their rows can't all meet under the phrase.
    r = random.Random(12)
    make = lambda n: [f"c{r.randrange(10**6)}" for _ in range(n)]
    phrases = [make(6) for _ in range(8)]
    rows = [(i, " ".join([*make(12), *phrases[i % 8], *make(12), *phrases[(i + 1) % 8], *make(9)])) for i in range(600)]
    rows += [(1000 + i, " ".join([*rows[i][1].split()[4:33], *make(5)])) for i in range(0, 600, 7)]
    assert removed(spark, rows) == repeats(rows)


def test_rows_of_a_hot_anchor_are_dealt_out():
    n = 500
    a, b = np.full(n, 7, np.uint64), np.arange(n, dtype=np.uint64) // np.uint64(2)
    doc, place = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64) * 256 + 1
    out = substring_dedup._resolve(a, b, doc, np.zeros(n, np.int32), place, True).to_pydict()
    meets = [k for k in range(n) if out["state"][k] == substring_dedup.MEETS]
    assert len(meets) <= 4 and {out["anchor"][k] for k in meets} == {7} and len({out["run"][k] for k in meets}) > 1
    assert out["state"].count(substring_dedup.REPEAT) == n // 2 and len(set(out["anchor"])) > n - 5
    # One run, or one document, is never opened by its number alone.
    alone = substring_dedup._resolve(a, np.zeros(n, np.uint64), doc, np.zeros(n, np.int32), place, True).to_pydict()
    own = substring_dedup._resolve(a, b, np.zeros(n, np.int64), np.zeros(n, np.int32), place, True).to_pydict()
    assert substring_dedup.OPEN not in alone["state"] + own["state"]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, texts, words):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in texts:
        w = word.findall((t or "").translate(SMALL))
        sets[i] = {tuple(w[a : a + words]) for a in range(max(1, len(w) - words + 1))} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    least[i] = least[j] = min(least[i], least[j])
        if all(least[least[i]] == least[i] for i in least):
            break
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts), words).collect()}
    assert got == {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def test_groups_that_are_dealt_out_lose_nothing(spark, texts, monkeypatch):
    r = random.Random(21)
    base = [f"b{r.randrange(10**6)}" for _ in range(60)]
    copies = [(200 + i, " ".join(w if r.random() > 0.03 else f"e{r.randrange(99)}" for w in base)) for i in range(90)]
    chain = [(400 + i, " ".join(f"k{i * 4 + k}" for k in range(80))) for i in range(30)]  # each is like its neighbours alone
    rows = [*texts, *copies, *chain, (200, copies[0][1]), (None, copies[1][1])]
    whole = near_dedup.near_duplicates(frame(spark, rows)).collect()
    for shingles, classes, pivots in ((40, 2, 8), (300, 4, 1)):
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", classes)
        monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
        assert sorted(near_dedup.near_duplicates(frame(spark, rows)).collect(), key=str) == sorted(whole, key=str)
    assert len({x.component_id for x in whole if x.doc_id and x.doc_id >= 400}) == 1


def test_links_of_signatures_and_sets_connect_what_is_connected():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 16, (6, near_dedup.VALUES), dtype=np.uint16)
    rows = np.stack([np.where(r.random(near_dedup.VALUES) < r.choice([0.1, 0.3, 0.45]), r.integers(0, 1 << 16, near_dedup.VALUES, dtype=np.uint16), base[i % 6]) for i in range(80)])

    def classes(n, links):
        of = list(range(n))
        for a, b in links:
            of = [of[b] if x == of[a] else x for x in of]
        return [[of.index(x) for x in of], len(links)]

    every = [(a, b) for a in range(80) for b in range(a) if (rows[a] != rows[b]).sum() <= near_dedup.DISTANCE]
    got = near_dedup.near_of(np.arange(80), rows)
    assert classes(80, got)[0] == classes(80, every)[0] and len(got) < 80 and set(map(frozenset, got)) <= set(map(frozenset, every))


def contaminated(rows, items, window=13):
    """For each row (id, text): n_words, n_hit, the items whose windows occur, and whether it counts as contaminated."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(SMALL))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + window]), set()).add(i)
    out = []
    for i, t in rows:
        w = word.findall((t or "").translate(SMALL))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        out.append((str(i), len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [100_000, 3])
def test_decontamination(spark, texts, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST", broadcast)
    items = [(1, texts[4][1][:200]), (2, "One"), (3, None), (4, "..."), (5, texts[4][1][:200]), (6, "w1 w2"), (7, "W3 w4 w5")]
    rows = [*texts, (4, texts[4][1]), (4, texts[4][1]), (4, "one"), (None, "a one b"), (None, "a one b"), (None, None)]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    df = frame(spark, rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) for r in decontamination.contamination(df, table).collect())
    want = contaminated(rows, items)
    assert got == want
    clean = sorted(str(i) for i, *_, bad in want if not bad)
    odd = df.withColumnsRenamed({"anchor": "_doc", "runs": "_print", "kind": "row"})
    kept = decontamination.decontaminate(odd, table)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == clean


def linked_spans(text):
    """The spans of one text, by looking at every pair of matches."""
    found = []
    for kind, pattern, group, least, partners in [(k.name, k.pattern, k.group, k.least, k.completed_by) for k in secrets.KINDS]:
        found += [(m.start(), kind, m.end(), partners) for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(group)) >= least]
    base = [x for x in found if not x[3]]
    out = list(base)
    for a, kind, z, partners in found:
        near = any(k in partners and 0 <= max(a - end, start - z) <= secrets.SCOPE for start, k, end, _ in found)
        if partners and near and not any(start < z and a < end for start, _, end, _ in base):
            out.append((a, kind, z, partners))
    order = [k.name for k in secrets.KINDS]
    return ",".join(f"{k}:{a}:{z}" for a, k, z, _ in sorted(out, key=lambda x: (x[0], order.index(x[1]), x[2])))


def test_linked_secrets_against_every_pair(spark):
    r = random.Random(17)
    part = [
        "client_id=abc{n}", "login: user{n}", "Zm9vYmFyYmF6cXV4MTIz{n}", "AKIA" + "Q7" * 8, "password = hunter2secret{n}", "https://db{n}.example.com/x", "redis://cache{n}:6379", "0f" * 16 + "{n}",
        "token=short", "é😀", "user_id: \"{n}abc\"", "plain words here", "postgresql://h{n}/db", "x" * 25,
    ]
    rows = []
    for i in range(400):
        glue = [" " * r.choice([1, 2, 30]), " " + "lorem " * r.choice([1, 20, 34, 40]), "\n"]
        rows.append((i, "".join(r.choice(part).format(n=r.randint(1, 99)) + r.choice(glue) for _ in range(r.randint(0, 9)))))
    edge = [f"client_id=abc{' ' * gap}Zm9vYmFyYmF6cXV4MTIzNDU2" for gap in range(196, 205)]
    rows += [(1000 + i, t) for i, t in enumerate(edge)] + [(2000, "client_id=abc Zm9vYmFyYmF6cXV4MTIzNDU2 " * 4000), (7, rows[7][1]), (7, "AKIA" + "Z" * 16), (None, edge[0]), (None, edge[0]), (2001, None)]
    got = sorted((str(x.doc_id), x.spans) for x in secrets.scan(frame(spark, rows)).withColumn("spans", secrets.written(F.col("spans"))).collect())
    assert got == sorted((str(i), linked_spans(t)) for i, t in rows)
    assert any("blob" in s for _, s in got) and any("endpoint" in s for _, s in got) and any("id:" in s for _, s in got)


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "password: hunter2secret x", "d", "p", "s", "r"), (1, "password: hunter2secret x", "e", "p", "s", "r"), (2, None, "d", "p", "s", "r"), (None, "AKIA" + "Q" * 16, "d", "p", "s", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _print string, _spans string, row string")
    out = secrets.redact(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text), r._doc) for r in out.collect()) == [("1", "[SECRET] x", "d"), ("1", "[SECRET] x", "e"), ("2", "None", "d"), ("None", "[SECRET]", "d")]


def test_secrets(spark):
    key, far = "AKIA" + "Q7" * 8, "x " * 300
    rows = [(0, None), (1, f"é password: hunter2secret and {key} 😀 " + "0f" * 16), (2, "token=short"), (3, f"client_id=abc123 {far} Zm9vYmFyYmF6cXV4MTIzNDU2"), (4, "client_id=abc123 Zm9vYmFyYmF6cXV4MTIzNDU2"), (4, "client_id=abc123 Zm9vYmFyYmF6cXV4MTIzNDU2"), (None, key)]
    df = frame(spark, rows)
    assert secrets.scan(df).count() == len(rows)
    got = {(r.doc_id, r.spans): r for r in secrets.scan(df).withColumn("spans", secrets.written(F.col("spans"))).collect()}
    assert {k for k in got} == {
        (0, ""), (1, "assign:2:25,access:30:50,hex:53:85"), (2, ""), (3, ""), (4, "id:0:16,blob:17:41"), (None, "access:0:20")
    }
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[4] == "[SECRET] [SECRET]" and clean[2] == "token=short" and clean[None] == "[SECRET]" and clean[0] is None
    assert clean[1] == "é [SECRET] and [SECRET] 😀 [SECRET]"


def test_sharding(spark, texts):
    df = frame(spark, [*texts, (5, "again"), (5, "again")]).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    rows = sharding.assign(df, "doc_id", ["size"], 7).collect()
    assert len(rows) == len(texts) + 2
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.assign(df.limit(0), "doc_id", ["size"], 7).count() == 0


def test_sharding_query_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.choice(["é", "a b", "x" * 50, None, ""]) if i % 3 else "hot", "en") for i in range(700)] + [(9, "hot", "en")] * 300 + [(None, "n", "en")] * 40
    spark.createDataFrame(rows, "doc_id long, text string, rank string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_sharding(spark, str(tmp_path)).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == want
    slots = [sorted(x.slot for x in got if x.shard == s) for s in range(40)]
    assert all(v == list(range(len(v))) for v in slots) and {len(v) for v in slots} <= {len(rows) // 40, len(rows) // 40 + 1}
    assert {(x.law, x.grown_shard) for x in got} == {("rows", None)}


def test_sharding_follows_the_ring_and_moves_little(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"))
    ring = sharding._ring(spark, 10, 64)
    place = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit("key"), F.col("doc_id").cast("string")).alias("h")).collect()}
    arc = {i: next((k for k, (at, _) in enumerate(ring) if h < at), 0) for i, h in place.items()}
    home = {i: ring[k][1] for i, k in arc.items()}
    got = {r.doc_id: r.shard for r in sharding.assign(df, "doc_id", [], 10).collect()}
    over = {s: max(0, sum(h == s for h in home.values()) - 600) for s in range(10)}
    # Only what overflows a shard leaves home, and what has its home in a shard with room never does.
    assert all(got[i] == h for i, h in home.items() if not over[h]) and sum(over.values()) > 0
    assert sum(got[i] != h for i, h in home.items()) == sum(over.values())
    # One more shard takes its share from all and little else moves; by remainder ten in eleven rows would.
    more = {r.doc_id: r.shard for r in sharding.assign(df, "doc_id", [], 11).collect()}
    assert sum(more[i] != s for i, s in got.items()) < 0.4 * len(got)


def test_a_hot_key_fills_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    names = ["rank", "place", "cell", "salt", "hit", "lo", "hi", "arc", "ranges", "last", "own", "row", "part", "k0", "shard", "slot"]
    rows = [(7 if i % 2 else i, *[f"{n}{i}" for n in names]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} string" for n in names))
    out = sharding.assign(df, "doc_id", ["rank"], 7)
    assert out.columns == ["doc_id", *names[:-2], "shard", "slot"]
    got = out.collect()
    assert sorted((x.doc_id, x.rank, x.last, x.row) for x in got) == sorted((x[0], x[1], x[1 + names.index("last")], x[1 + names.index("row")]) for x in rows)
    slots = [sorted(x.slot for x in got if x.shard == s) for s in range(7)]
    assert all(v == list(range(len(v))) for v in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_bpe(spark, texts):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [*texts, (90, "aaaa" * 400 + " 漢字😀é\x1c\x85 \n\n  it's 1234"), (91, " " * 500)]
    again = bpe.encode(frame(spark, [(5, "twice"), (5, "twice"), (None, "no id"), (None, None)]), path, pattern).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in again) == [("5", len(known.encode_ordinary("twice")))] * 2 + [("None", 0), ("None", len(known.encode_ordinary("no id")))]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, rows), path, pattern), path).collect()}
    assert got == {r.doc_id: r for r in bpe.round_trip(frame(spark, rows), path, pattern).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == known.encode_ordinary(t or "")
        assert got[i].text == (t or "")


def test_every_piece_is_read_through_the_states():
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.load_ranks(path)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    part = ["le", "aux", "çan", "è", "straße", "ing", "str", "zu", "漢", "😀", "1", "ñ"]
    pieces = [" " + "".join(r.choice(part) for _ in range(r.randint(1, 9))) for _ in range(3000)] + ["a" * 3000, "xyz" * 900]

    class Counted(dict):
        reads = 0

        def get(self, key):
            self.reads += 1
            return super().get(key)

    own = bpe.Transducer(ranks)
    own.edges = Counted(own.edges)
    for piece in pieces:
        raw, before = piece.encode(), own.edges.reads
        assert np.frombuffer(own.encode(raw), "<u4").tolist() == known._encode_single_piece(raw)
        assert own.edges.reads - before == (0 if raw in ranks else len(raw))
    longest = max(map(len, ranks))
    assert all(len(held) <= longest for _, places in own.states for _, held in places)


def test_full_tables_change_no_result(monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.load_ranks(path)
    text = " ".join(f"wörd{i}tail{i * 7}" for i in range(400)) + "q" * 700
    want = bpe.Encoder(ranks, pattern).encode(text)
    for name, n in (("EDGE_ENTRIES", 40), ("PAIR_ENTRIES", 30), ("MEMO_ENTRIES", 6), ("JOIN_ENTRIES", 2)):
        monkeypatch.setattr(bpe, name, n)
    small = bpe.Encoder(ranks, pattern)
    assert small.encode(text) == want and len(small.memo.transducer.edges) <= 40 and len(small.memo) <= 6
    assert bpe.Decoder(ranks).decode(want) == text


def test_utf8_states_against_the_library():
    r = random.Random(1)
    some = [0x41, 0xC3, 0xA9, 0xE6, 0xBC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xE0, 0xF4, 0x90, 0xFF, 0xC0]
    for raw in ["aé漢😀".encode(), *(bytes(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(5000))]:
        s = bpe.Utf8Stream()
        assert "".join(s.feed(raw[i : i + 1]) for i in range(len(raw))) + s.end() == raw.decode("utf-8", "replace")


def test_decoder_joins_characters_across_tokens():
    ranks, r = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), random.Random(4)
    decoder = bpe.Decoder(ranks)
    for _ in range(1500):
        ids = np.array([r.randrange(256 if r.random() < 0.7 else 50256) for _ in range(r.randint(0, 30))], "<u4")
        raw = b"".join(decoder.raw[i] for i in ids)
        assert decoder.decode(ids.tobytes(), step=r.choice([1, 3, 100])) == raw.decode("utf-8", "replace")


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 12)).round(1)
    x[7] = x[8] = x[50]
    rows = [(i, [float(v) for v in row], "s") for i, row in enumerate(x)] + [(900, None, "s"), (901, [0.0] * 12, "s"), (902, [float("nan")] * 12, "s"), (903, [None] * 12, "s"), (904, [1.0], "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(df.filter("vec_id % 50 = 0"), df, 5).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(300), -s.round(12)))[:5]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want.tolist()
    assert set(got.query_id) == set(range(0, 300, 50))


def test_neighbours_of_extreme_repeated_and_missing_vectors(spark):
    big, small = [1e200, 2e200, 0.0], [1e-200, 2e-200, 1e-210]
    rows = [(0, big), (50, [1.0, 2.0, 0.0]), (1, small), (2, [-1e300, 5e-324, 0.0]), (3, [3.0, 0.0, 1.0]), (3, [3.0, 0.0, 1.0]), (3, [9.0, 9.0, 9.0]), (None, [1.0, 2.0, 0.0]), (4, [float("inf"), 0.0, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df.filter("vec_id % 50 = 0"), df, 5).orderBy("query_id", "rank").collect()
    order = {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 50)}
    assert sorted(order[0][:2]) == [1, 50] and sorted(order[50][:2]) == [0, 1]  # parallel but for the last bit
    assert order[0][2:] == order[50][2:] == [3, 2] and [r.rank for r in got] == [1, 2, 3, 4] * 2
    assert all(np.isfinite(r.score) for r in got)
    assert abs(next(r.score for r in got if (r.query_id, r.vec_id) == (0, 2)) + 1 / np.sqrt(5)) < 1e-12
    assert neighbours.nearest(df.limit(0), df.limit(0), 5).count() == 0 and neighbours.nearest(df.limit(0), df, 5).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    word = [f"wort{i}" for i in range(200)]
    docs, labels = [(990, None), (991, "")], []
    for i in range(600):
        w = [r.choice(word) for _ in range(60)]
        toxic, good = i % 6 == 0, i % 5 != 0
        if toxic:
            w[10], w[30] = "zurgel" + r.choice("abc"), "idiot"
        lines = [" ".join(w[k : k + 10]) + "." for k in range(0, 60, 10)]
        docs.append((i, "\n".join(lines if good else [x.upper().replace(" ", "!! ") for x in lines])))
        labels.append((i, int(good), int(toxic)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op, label, threshold", [(toxicity, "toxic", 0.7), (quality, "quality", 0.3)])
def test_held_out_accuracy(labelled, op, label, threshold):
    docs, labels = labelled
    model = op.fit(docs, labels, remainder(3) != 1)
    rows = op.score(docs, model).filter(remainder(3) == 1).join(labels, "doc_id").collect()
    assert len(rows) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum((r.score >= threshold) == bool(r[label]) for r in rows) >= 0.97 * len(rows)
    assert op.score(docs, model).count() == 602
    assert op.score(docs.limit(0), model).count() == 0
    assert all(0 <= r.score <= 1 for r in op.score(docs.filter("doc_id >= 990"), model).collect())


def test_a_repeated_id_pools_the_links_of_its_texts(spark):
    r = random.Random(11)
    one, two, apart = ([f"{c}{r.randrange(10**6)}" for _ in range(200)] for c in "xyz")
    edit = lambda w: " ".join([*w[:100], "edit", *w[101:]])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (5, ""), (7, edit(one)), (8, edit(two)), (9, " ".join(apart)), (None, edit(one))]
    found = {(x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert found == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (None, None, True)}
    # The set that a link goes through belongs to an id which is not the smallest.
    rows = [(6, " ".join(one)), (6, " ".join(two)), (2, edit(two)), (3, " ".join(one))]
    assert {(x.doc_id, x.component_id) for x in near_dedup.near_duplicates(frame(spark, rows)).collect()} == {(2, 2), (3, 2), (6, 2)}


def test_toxic_words_of_a_rare_language(spark):
    # Entries are tested against the share of toxic texts, so the clean ones are most of the table, as in any corpus.
    r = random.Random(5)
    fill = lambda lang: [f"{lang}{r.randrange(300)}" for _ in range(40)]
    rows = [(["common"] if i % 3 == 0 else []) + fill("mot") for i in range(240)] + [(["raro"] if i % 3 == 0 else []) + fill("voz") for i in range(18)]
    rows += [[f"{chr(97 + i // 26)}{chr(97 + i % 26)}tail", *fill("mot")] for i in range(80) for _ in range(4)]  # many words of little support
    rows += [fill(lang) for lang in ("mot", "voz") for _ in range(1400)]
    rows += [["common", "copied", "mot1"]] * 200
    data = [(i, " ".join(w), int(w[0] in ("common", "raro") or w[0].endswith("tail"))) for i, w in enumerate(rows)]
    docs, labels = frame(spark, [x[:2] for x in data]), spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    found = set(model.lexicon.entries)
    assert {"raro", "common"} <= {e.rstrip("*") for e in found}
    assert not any(e.startswith("copi") for e in found) and sum("tai" in e for e in found) >= 76
    unseen = [(1, "raro voz1 voz2 voz3"), (2, "voz1 voz2 voz3 voz4"), (3, "aatail mot1 mot2 mot3")]
    assert [x.score >= 0.7 for x in toxicity.score(frame(spark, unseen), model).orderBy("doc_id").collect()] == [True, False, True]


def test_an_entry_may_need_several_occurrences(spark):
    r = random.Random(6)
    fill = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    rows = [(" ".join([*fill(60), *r.sample(["scharflich", "scharfung", "scharfkeit", "scharfer"], 3), *fill(20)]), 1) for _ in range(60)]
    rows += [(" ".join([*fill(60), *(["scharfum"] if i % 4 == 0 else []), *fill(20)]), 0) for i in range(800)]
    docs = frame(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"), F.lit(True))
    assert dict(zip(model.lexicon.entries, model.lexicon.times, strict=True)).get("scharf*", 0) > 1
    got = {x.doc_id: x.score >= 0.7 for x in toxicity.score(docs, model).collect()}
    assert sum(got[i] == bool(y) for i, (_, y) in enumerate(rows)) >= 0.99 * len(rows)


def test_label_model_by_enumeration():
    r = np.random.default_rng(9)
    truth = r.random(900) < 0.3
    rates = [(0.9, 0.1), (0.7, 0.2), (0.3, 0.5), (0.5, 0.5)]  # the third speaks for clean, the last for nothing
    votes = np.stack([r.random(900) < np.where(truth, a, b) for a, b in rates], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a copy of the first
    labels = np.where(r.random(900) < 0.05, ~truth, truth).astype(float)
    q, got, share, pairs = toxicity.label_model(votes, labels, 0.3, rounds=40)
    assert pairs == [(0, 4)] and np.allclose(share[[0, 4]], 0.5, atol=0.02) and np.allclose(share[1:4], 1)
    for row in range(0, 900, 37):  # Bayes' rule, class by class and voter by voter
        joint = [1 - 0.3, 0.3]
        for c in (0, 1):
            joint[c] *= 0.98 if labels[row] == c else 0.02
            for v in range(5):
                joint[c] *= (got[c, v] if votes[row, v] else 1 - got[c, v]) ** share[v]
        assert abs(q[row] - joint[1] / sum(joint)) < 1e-6
    for c, weight in ((0, 1 - q), (1, q)):  # rates are the posterior-weighted shares of firing
        for v in range(5):
            assert abs(got[c, v] - (sum(weight[votes[:, v]]) + 0.5) / (sum(weight) + 1)) < 1e-4
    assert got[1, 0] > got[0, 0] and got[1, 2] < got[0, 2]


def test_marginals_by_enumeration():
    r = np.random.default_rng(3)
    lengths = [1, 4, 0, 3, 6]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    emit, trans = r.normal(size=starts[-1]) * 2, r.normal(size=(2, 2))
    good, pairs = quality.marginals(emit, starts, trans)
    seen = np.zeros((2, 2))
    for a, z in zip(starts, starts[1:], strict=False):
        if a == z:
            continue
        total, own, two = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(z - a)):
            w = np.exp(sum(emit[a + i] * y for i, y in enumerate(labels)) + sum(trans[x, y] for x, y in itertools.pairwise(labels)))
            total += w
            own += w * np.array(labels)
            for x, y in itertools.pairwise(labels):
                two[x, y] += w
        assert np.allclose(good[a:z], own / total)
        seen += two / total
    assert np.allclose(pairs, seen)


def test_fitting_samples_are_bounded_by_documents(spark):
    docs = frame(spark, [(1, "b"), (1, "a"), *[(2, "x")] * 3000, (3, None), (None, "n")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, str(r.text), r.label) for r in got) == [(1, "a", 1), (2, "x", 0), (3, "None", 1)]
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    few = labelled_sample(frame(spark, [(i, "t") for i in range(4000)]), many, "toxic", F.lit(True), 200).count()
    assert 120 < few < 280
    whole = frame(spark, [(i, "line\n" * 99 + "end") for i in range(50)])
    assert quality._within(whole, 1000).count() == 10 and quality._within(whole, 50).count() == 0


@pytest.mark.parametrize("op, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_of_odd_rows(labelled, op, label):
    docs, labels = labelled
    model = op.fit(docs, labels, F.lit(True))
    spark = docs.sparkSession
    long = "idiot wort1 zurgela. " * 60_000
    rows = [(5, "twice same"), (5, "twice same"), (None, "no id"), (6, None), (7, ""), (8, " \n "), (9, long)]
    odd = spark.createDataFrame([(i, t, 9.0, "y", [1]) for i, t in rows], "doc_id long, text string, score double, label string, rows array<int>")
    got = op.score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id == 5}
    blank = {round(r.score, 12) for r in got if r.doc_id in (6, 7, 8)}
    assert len(same) == 1 and len(blank) == 1
    none = op.fit(docs, labels.filter("doc_id < 0"), F.lit(True))
    assert len({r.score for r in op.score(odd, none).collect()}) == 1


def test_empty_tables(spark):
    none, items = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert secrets.scan(none).count() == 0
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(frame(spark, [(1, "a b")]), items).first().contaminated is False
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_digest_of_kept_text_is_of_utf8(spark):
    out = substring_dedup.remove_repeats(frame(spark, [(1, "é  b")])).select(F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).first()
    assert out.h == hashlib.sha256("é b".encode()).hexdigest()


def test_warc_derivatives(spark):
    html = "<p>a &amp;lt; b</p><!-- x --><script>no()</script>\n<b>é</b>"
    pages = spark.createDataFrame([(1, "u", html, 0), (2, None, None, 0)], "page_id long, url string, html string, content int")
    rows = {(r.page_id, r.warc_type): r for r in warc.derivatives(pages).collect()}
    assert len(rows) == 4
    text, facts = rows[1, "conversion"], rows[1, "metadata"]
    assert text.content == "a &lt; b é" and text.refers_to == facts.refers_to and text.record_id != facts.record_id
    assert text.payload == "sha1:" + hashlib.sha1(html.encode()).hexdigest()
    assert f"Content-Length: {len(text.content.encode())}\r\n" in text.header and f"WARC-Refers-To: {text.refers_to}\r\n" in text.header
    assert f"WARC-Payload-Digest: {text.payload}\r\n" in text.header and "WARC-Date: 1970-01-01T00:00:00Z\r\n" in text.header
    assert rows[2, "conversion"].content == "" and "WARC-Target-URI" not in rows[2, "conversion"].header
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_warc_derivatives_preserve_what_the_source_has(spark):
    rows = [(1, "http://x/\r\nWARC-Type: evil", "b", "<urn:uuid:1>", "2024-05-01T10:00:00Z", {"Server": "s\r\nx", "Content-Type": "text/html"}), (1, "u", "b", "<urn:uuid:2>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rid string, at string, headers map<string,string>")
    got = {(r.refers_to, r.warc_type): r for r in warc.derivatives(pages, record_id_col="rid", date_col="at", headers_col="headers").collect()}
    one = got["<urn:uuid:1>", "metadata"]
    assert "source-header: Content-Type: text/html\r\nsource-header: Server: sx\r\n" in one.content
    assert "WARC-Date: 2024-05-01T10:00:00Z\r\n" in one.header and "\r\nWARC-Type: evil" not in one.header and one.target_uri == rows[0][1]
    assert len({r.record_id for r in got.values()}) == 4
    lines = pages.select("page_id", "url", "html", F.lit("HTTP/1.1 200 OK\r\nServer: s\r\n\r\n").alias("h"), F.lit("2024-05-01 10:00:00").cast("timestamp").alias("at"))
    text = warc.derivatives(lines, headers_col="h", date_col="at").filter("warc_type = 'metadata'").first()
    assert text.content.endswith("source-header: Server: s\r\n") and "WARC-Date: 2024-05-01T10:00:00Z" in text.header


def test_character_references_are_resolved_once(spark):
    cases = ["&#65;&#x42;&#X43;", "&amp;#65;", "&eacute;&Eacute;&nbsp;x", "&unknown; &amp &", "&#0;&#xD800;&#x110000;", "&#128512;", "&apos;&lt;b&gt;", "plain", "a&euro;b&frac12;"]
    want = ["ABC", "&#65;", "éÉ x", "&unknown; &amp &", "\ufffd" * 3, "😀", "'<b>", "plain", "a€b½"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", warc.resolved(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == want


def test_repeated_and_very_long_pages(spark):
    long = "<p>" + "word &amp; " * 200_000 + "</p>"
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "y"), (3, "v", long)], "page_id long, url string, html string")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    assert next(r.content for r in rows if r.page_id == 3 and r.warc_type == "conversion") == ("word & " * 200_000).strip()
