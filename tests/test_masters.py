"""Suggestions against every pair, and rows that earlier versions lost."""

import hashlib
import random

from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.functions import exprs
from marlstone.operators import history, ingest, masters
from marlstone.sources import landing


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def expected(raw, known):
    """Contained names, and near ones of the same first letter; the three best."""
    out = []
    for i, name in known:
        if name in raw or raw in name:
            out.append((-0.75, i))
        elif name[0] == raw[0] and (ratio := 1 - distance(raw, name) / max(len(raw), len(name))) >= 0.6 - 1e-12:
            out.append((-round(ratio * 0.7, 6), i))
    return [(i, -s) for s, i in sorted(out)[:3]]


def test_candidates_against_every_pair(spark):
    r = random.Random(3)
    letters = "abcxyz"
    known = [(f"k{i:03d}", "".join(r.choice(letters) for _ in range(r.randint(1, 9)))) for i in range(120)] + [("k900", "xay"), ("k901", "axcye")]
    known = list({n: (i, n) for i, n in known}.values())
    raws = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(60)} | {"a", "abcde"} - {n for _, n in known})
    raws = [x for x in raws if x not in {n for _, n in known}]
    rows = masters.candidates(spark.createDataFrame([(x,) for x in raws], "raw string"), spark.createDataFrame(known, "id string, name string")).collect()
    got = {x: [(y.id, y.score) for y in sorted(rows, key=lambda z: z["rank"]) if y.raw == x] for x in raws}
    assert got == {x: expected(x, known) for x in raws}


def test_alike_names_meet_their_neighbours_only(spark, monkeypatch):
    pairs, scored = [], masters._scored
    monkeypatch.setattr(masters, "_scored", lambda df: (pairs.append(df.count()), scored(df))[1])

    def ask(n):
        known = [(f"k{i:05d}", f"supplier number {i:05d}") for i in range(n)]
        raws = [f"supplier number {i:05d}s" if i % 2 else f"suppliar number {i:05d}" for i in range(0, n, 5)]
        pairs.clear()
        rows = masters.candidates(spark.createDataFrame([(x,) for x in raws], "raw string"), spark.createDataFrame(known, "id string, name string")).collect()
        return raws, known, rows, sum(pairs)

    raws, known, rows, few = ask(100)
    plain = [(i, n.replace(" ", "")) for i, n in known]
    assert {x: [(y.id, y.score) for y in sorted(rows, key=lambda z: z["rank"]) if y.raw == x] for x in raws} == {x: expected(x.replace(" ", ""), plain) for x in raws}
    assert ask(1000)[3] < 20 * few  # ten times the names; all pairs would be a hundred times as many


def test_equal_spellings_are_compared_once(spark):
    known = [(f"k{i:04d}", "same  name" if i % 2 else "SAME_NAME") for i in range(3000)] + [("a", "same nome"), ("b", "sane name")]
    rows = masters.candidates(spark.createDataFrame([("same namee",), ("Same Namee",)], "raw string"), spark.createDataFrame(known, "id string, name string")).collect()
    assert sorted((r.raw, r.id, r.score, r["rank"]) for r in rows) == [(x, f"k{i:04d}", 0.75, i + 1) for x in ("Same Namee", "same namee") for i in range(3)]


def test_a_shared_stem_is_enough(spark):
    known = spark.createDataFrame([("1", "华东有限公司"), ("2", "华南子公司")], "id string, name string")
    got = masters.candidates(spark.createDataFrame([("华东分公司",)], "raw string"), known).collect()
    assert [(x.id, x.score) for x in got] == [("1", 0.9)]


def test_spaces_of_all_kinds_are_noise(spark):
    names = ["a b", "a b", "a b", "a﻿b", "a\tb", "a b"]
    assert {r.n for r in spark.createDataFrame([(x,) for x in names], "t string").select(exprs.normalize_name(F.col("t")).alias("n")).collect()} == {"ab"}


def test_rows_without_a_label_are_not_dropped(spark):
    rows = spark.createDataFrame([("total",), (None,), ("sum of",), ("a",)], "company string")
    assert {r.company for r in ingest.drop_rows(rows, "company", ["total"], "sum").collect()} == {None, "a"}


def test_a_change_to_null_is_a_change(spark):
    past = spark.createDataFrame([("a", "x", "y")], "id string, g string, h string")
    start = history.first_versions(past, spark.createDataFrame([], "id string"), "2020-01-01", ["g", "h"])
    after = history.apply_changes(start, spark.createDataFrame([("a", None, "y")], "id string, g string, h string"), ["g", "h"], "2021-01-01").collect()
    assert sorted((str(r.valid_from), r.is_current, r.g) for r in after) == [("2020-01-01", False, "x"), ("2021-01-01", True, None)]
    same = history.apply_changes(start, past, ["g", "h"], "2021-01-01")
    assert same.count() == 1


def test_masked_sheets_tell_what_is_left_out(spark):
    cells = spark.createDataFrame([("f", "s", r, 1, "text", "x") for r in range(1, 45)] + [("g", "s", 1, 1, "number", "5")], "file_hash string, sheet string, row_no int, col_no int, value_kind string, raw_value string")
    got = ingest.masked(cells, 40, 4).groupBy("file_hash").agg(F.count("*").alias("n"), F.bool_or("truncated").alias("t")).collect()
    assert {(r.file_hash, r.n, r.t) for r in got} == {("f", 40, True), ("g", 1, False)}


def test_sheets_of_equal_content_land_once(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 2, "y"), ("b", 1, "x"), ("c", 1, "x")]
    cells = landing.landed_sheets(spark.createDataFrame(rows, "file string, row int, v string"), "file", "row", "s").collect()
    assert len({c.file_hash for c in cells}) == 2 and len(cells) == 3


def test_drift_counts_values_that_do_not_fit(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.5, "b"), (None, None)], "v double, w string")
    want = spark.createDataFrame([], "v int, x string").schema
    got = {r.column: (r.state, r.n_lost) for r in landing.schema_drift(df, want).collect()}
    assert got == {"v": ("type changed", 1), "w": ("extra", 2), "x": ("missing", 0)}


def test_search_reads_aliases(spark):
    catalog = spark.createDataFrame([("m", "1", "Revenue", ["Sales", None]), ("m", "2", None, None), ("m", "3", "Cost", [])], "kind string, id string, name string, aliases array<string>")
    assert [r.id for r in masters.search(catalog, "SALE").collect()] == ["1"]


def test_files_land_by_their_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"a, ""b""",\n,12.5,=A1+1\n', encoding="utf8")
    (tmp_path / "copy.csv").write_bytes((tmp_path / "a.csv").read_bytes())
    (tmp_path / "empty.csv").write_text("")
    cells = landing.land_files(spark, str(tmp_path)).collect()
    assert {(c.row_no, c.col_no, c.value_kind, c.raw_value, c.formula) for c in cells} == {
        (1, 1, "text", "x", None), (1, 2, "text", 'a, "b"', None), (2, 2, "number", "12.5", None), (2, 3, "text", "=A1+1", "=A1+1")
    }
    assert {c.file_hash for c in cells} == {hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()} and len(cells) == 4


def largest_broadcast(spark, run):
    """The most rows that a broadcast holds while run works."""
    store = spark._jsparkSession.sharedState().statusStore()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = max((e.executionId() for e in each(store.executionsList())), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for e in [e.executionId() for e in each(store.executionsList()) if e.executionId() > last]:
        values = store.executionMetrics(e)
        for node in each(store.planGraph(e).allNodes()):
            for m in each(node.metrics()):
                if node.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return most


def test_strings_made_of_names_are_not_broadcast(spark):
    known = spark.createDataFrame([(f"k{i:04d}", f"supplier number {i:05d}") for i in range(300)], "id string, name string")
    raws = spark.createDataFrame([(f"supplier number {i:05d}s",) for i in range(300)], "raw string")
    assert largest_broadcast(spark, lambda: masters.candidates(raws, known).collect()) <= 300


def test_open_names_meet_all_tiles(spark, monkeypatch):
    monkeypatch.setattr(masters, "TILE", 7)
    monkeypatch.setattr(masters, "SHARE", 5)
    tiled, met = masters._compared, []
    monkeypatch.setattr(masters, "_compared", lambda open_, owners, top: (met.append(open_.count()), tiled(open_, owners, top))[1])
    r = random.Random(5)
    known = [(f"k{i:03d}", "a" + "".join(r.choice("abcdefgh") for _ in range(r.randint(6, 12)))) for i in range(200)]
    known += [(i, n + "bb") for i, n in known[::10]]  # ids of two names
    raws = sorted({"a" + "".join(r.choice("abcdefgh") for _ in range(r.randint(6, 12))) for _ in range(40)})
    rows = masters.candidates(spark.createDataFrame([(x,) for x in raws], "raw string"), spark.createDataFrame(known, "id string, name string"), 5).collect()
    ranked = lambda x: sorted({(-s, i) for k in known for i, s in expected(x, [k])})[:5]
    assert {x: [(-y.score, y.id) for y in sorted(rows, key=lambda z: z["rank"]) if y.raw == x] for x in raws} == {x: ranked(x) for x in raws}
    assert met[0] > 20


def test_as_many_letters_are_dropped_as_lengths_call_for(spark):
    names = spark.createDataFrame([("abcdef",)], "n string")
    count = lambda *sizes: masters._dropped(names, "n", 2, list(sizes)).count()
    assert [count(6), count(5), count(4), count(7), count(8), count(9), count(5, 7)] == [1 + 6 + 15, 6 + 15, 15, 1 + 6, 1, 0, 1 + 6 + 15]


def test_best_candidates_pass_no_strings_made_of_names_through_the_driver(spark):
    rows, d = [], "/root/testdata/sf0.01"
    assert largest_broadcast(spark, lambda: rows.extend(catalog.QUERIES["top3_candidates"](spark, d).collect())) <= 100
    keys = range(spark.read.parquet(f"{d}/supplier.parquet").count())
    assert {(r.raw, r.n, r.best) for r in rows} == {(f"Supplier#{i:09d}" + (" (X)" if i % 4 == 1 else "S"), 3, f"s_{i}") for i in keys if i % 2}


def test_the_unresolved_report_passes_no_strings_made_of_names_through_the_driver(spark):
    rows, d = [], "/root/testdata/sf0.01"
    assert largest_broadcast(spark, lambda: rows.extend(catalog.QUERIES["unresolved_report"](spark, d).collect())) <= 100
    keys = [i for i in range(spark.read.parquet(f"{d}/supplier.parquet").count()) if i % 2]
    want = sorted((-(i % 25 + 1), f"Supplier#{i:09d}" + (" (X)" if i % 4 == 1 else "S"), f"s_{i}") for i in keys)
    assert [(-r.n_rows, r.raw, r.candidates.split(",")[0]) for r in rows] == want and {r.candidates.count(",") for r in rows} == {2}
