"""Known answers of the worksheet and registry operators."""

import pytest
from pyspark.sql import functions as F

from marlstone.model import Refused
from marlstone.operators import ingest, registry, sheets

CELL = "file_hash string, sheet string, row_no int, col_no int, value_kind string, raw_value string, formula string"


def cells(spark, *rows):
    return spark.createDataFrame([("f", "s", r, c, k, v, x) for r, c, k, v, x in rows], CELL)


def test_skipped_value_columns_win_and_repeat_once():
    assert sheets.value_columns([(4, 6), (5, 7)], [6]) == [4, 5, 7]


def test_position_wins_over_header(spark):
    got = sheets.column_calibers(cells(spark, (1, 4, "text", "ytd", None), (1, 5, "text", "ytd", None), (1, 6, "text", "?", None)), {4: "month"}, {"ytd": "ytd"})
    assert [r.caliber for r in got.orderBy("col_no").collect()] == ["month", "ytd", None]


def test_first_rows_are_capped_in_the_report_not_in_the_count(spark):
    rows = spark.range(1, 21).selectExpr("'f' AS file_hash", "CAST(id AS int) AS row_no")
    got = sheets.first_rows(rows, ["file_hash"]).collect()[0]
    assert (got.n, got.first_rows) == (20, "1,2,3,4,5,6,7,8")


def test_a_region_goes_on_while_anything_is_there(spark):
    df = cells(
        spark, (1, 4, "text", "a", None), (1, 5, "text", "b", None), (1, 7, "text", "beyond a gap", None), (2, 1, "text", "no label of an anchor in D", None), (2, 3, "text", " x ", None),
        (3, 3, "text", " ", None), (3, 4, "number", "5", "=SUM(A1:A2)"), (4, 5, "number", "7", None), (5, 3, "text", "y", None), (5, 4, "text", "n/a", None), (5, 7, "number", "9", None),
        (6, 1, "text", "nor this", None), (6, 7, "number", "1", None), (7, 3, "text", "after the end", None),
    )
    got = [(r.axis, r.position, r.label, r.computed) for r in sheets.region_labels(df, 2, 4).orderBy("axis", "position").collect()]
    assert got == [("column", 4, "a", False), ("column", 5, "b", False), ("row", 2, "x", False), ("row", 3, None, True), ("row", 4, None, False), ("row", 5, "y", False)]
    assert [(r.row_no, r.col_no, r.n_strays) for r in sheets.stray_cells(df, 2, 4).orderBy("row_no").collect()] == [(3, 4, 2), (4, 5, 2)]
    assert [(r.row_no, r.n_strays) for r in sheets.stray_cells(df, 2, 4, most=1).collect()] == [(3, 2)]


def test_a_region_without_headers_is_one_column_wide(spark):
    df = cells(spark, (2, 1, "text", "x", None), (3, 2, "date", "2026-01-01", None), (4, 3, "number", "1", None))
    assert [(r.row_no, r.label, r.strays) for r in sheets.region(df, 2, 2).orderBy("row_no").collect()] == [(2, "x", []), (3, None, [2])]


def hinted(spark, *rows):
    """Of a sheet whose labels are in column 4 and data in column 5, with rows 2 and 3."""
    df = cells(spark, (2, 4, "text", "x", None), (3, 4, "text", "y", None), *[(*r, None) for r in rows])
    return [(r.col_no, r.month_col, str(r.fin_month)) for r in sheets.period_hint(df, 2, 5).collect()]


def test_a_period_is_told_by_its_header(spark):
    assert hinted(spark, (1, 2, "text", "期间"), (2, 2, "text", "2026-06"), (3, 2, "text", "2026-06"), (9, 2, "text", "2026-07")) == [(2, None, "2026-06-01")]  # row 9 is beyond
    assert hinted(spark, (1, 2, "text", "name"), (2, 2, "text", "2026-06")) == []
    assert hinted(spark, (1, 2, "text", "期间"), (2, 2, "text", "2026-06"), (3, 2, "text", "2026-07")) == []
    assert hinted(spark, (1, 4, "text", "期间"), (2, 3, "text", "2026-06")) == []  # the labels' own column doesn't count


def test_a_year_and_a_month_make_a_period(spark):
    year, month = [(1, 1, "text", "年份"), (2, 1, "text", "2026"), (3, 1, "text", "2026")], [(1, 3, "text", "月份"), (2, 3, "text", "06")]
    assert hinted(spark, *year, *month) == [(1, 3, "2026-06-01")]
    assert hinted(spark, *year, (1, 3, "text", "月"), (2, 3, "text", "2025-11")) == [(1, 3, "2026-11-01")]
    assert hinted(spark, *year, *month, (1, 2, "text", "年月"), (2, 2, "text", "2024/1")) == [(2, None, "2024-01-01")]  # one column goes first
    assert hinted(spark, *year, *month, (1, 2, "text", "年月"), (2, 2, "text", "soon")) == [(1, 3, "2026-06-01")]
    assert hinted(spark, *year) == [] and hinted(spark, *year, (1, 3, "text", "月"), (2, 3, "text", "13")) == []


def located(spark, *rows, axis=()):
    known = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("metric",)], "label string")
    df = cells(spark, *[(r, c, "text", t, None) for r, c, t in rows])
    return [(r.row_no, r.first_col, r.width) for r in ingest.header_runs(df, known, axis).collect()]


def test_a_header_has_nothing_but_an_axis_name_to_its_left(spark):
    prose = [(1, 1, "total of"), (1, 2, "k1"), (1, 3, "k2"), (1, 4, "k3")]
    assert located(spark, *prose, (3, 2, "k1"), (3, 3, "k2")) == [(3, 2, 2)]
    assert located(spark, *prose, axis=("total of",)) == [(1, 2, 3)]
    assert located(spark, *prose) == []
    assert located(spark, (2, 1, "k1"), (3, 1, "k2")) == [(2, 1, 1)]
    assert located(spark, (2, 1, "metric"), (2, 2, "k1"), axis=("metric",)) == [(2, 1, 2)]
    assert located(spark, (2, 1, "name"), (2, 2, "metric"), (2, 3, "k1"), axis=("metric",)) == [(2, 3, 1)]


def test_amounts_are_found_and_dates_are_not(spark):
    texts = ["7", "12.5%", "(1,234.00)", "￥ 3", "- 8 万元", "in all 12,345 of them", "20260630", "on 2026-06-30", "as of 20260630", "2026年", "第18期", "9999 units", "", None, "a 10000", "1\u00a0元"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in ingest.leak_scan(df, F.col("t")).collect()]
    assert got == ["7", "12.5%", "(1,234.00)", "￥ 3", "- 8 万元", "in all 12,345 of them", "20260630", "a 10000", "1\u00a0元"]


def test_a_label_set_belongs_to_a_registry_only_as_a_whole(spark):
    ids = lambda *n: spark.createDataFrame([(x,) for x in n], "id string")
    labels = spark.createDataFrame([(1, "ytd"), (1, "month"), (2, "ytd"), (2, "c"), (3, None)], "k int, label string")
    got = sheets.axis_match(labels, ["k"], [("caliber", ids("ytd", "month")), ("company", ids("c"))]).orderBy("k").collect()
    assert [r.dimension for r in got] == ["caliber", None, None]


def test_several_owners_conflict(spark):
    declared = spark.createDataFrame([("A", ["A", "B"]), ("C", ["C"]), ("D", ["D", "A"])], "name string, labels array<string>")
    owners = spark.createDataFrame([("A", "m1"), ("B", "m2")], "label string, id string")
    got = {r.name: (r.id, r.state) for r in registry.metric_claims(declared, owners).collect()}
    assert got == {"A": (None, "conflict"), "C": ("new_c", "new"), "D": ("m1", "kept")}


def test_an_id_that_two_names_claim_is_a_conflict(spark):
    declared = spark.createDataFrame([("A", ["Sales "]), ("B", ["s_a_l_e_s"]), ("C", None), ("D", ["d"])], "name string, labels array<string>")
    owners = spark.createDataFrame([("SALES", "m1"), ("D", "m2")], "label string, id string")
    got = {r.name: (r.id, r.state) for r in registry.metric_claims(declared, owners).collect()}
    assert got == {"A": (None, "conflict"), "B": (None, "conflict"), "C": ("new_c", "new"), "D": ("m2", "kept")}


def test_an_unknown_name_refuses_the_whole_sync(spark):
    members, bridge = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a", 1), ("b", 2)], "member string, w int")
    with pytest.raises(Refused) as e:
        registry.synced(members, bridge, "x_")
    assert e.value.reason == "UNKNOWN_NAME"
    assert registry.synced(members, bridge.filter("member = 'a'"), "x_").select("w").collect()[0].w == 1


def test_undeclared_metrics_are_refused(spark):
    rows = spark.createDataFrame([("m",), ("n",), (None,)], "metric_id string")
    definitions = spark.createDataFrame([("m", "f", False)], "metric_id string, fact string, derived boolean")
    assert {r.metric_id: r.reason for r in registry.refused_inputs(rows, definitions, "f").collect()} == {"n": "METRIC_NOT_DECLARED", None: "METRIC_NOT_DECLARED"}


def test_search_is_case_free(spark):
    log = spark.createDataFrame([("b1", "in", "X.xlsx"), ("b2", "out", "x.xlsx")], "batch_id string, direction string, origin string")
    assert [r.batch_id for r in registry.search(log, "in", "x.XL").collect()] == ["b1"]
    assert registry.search(log, None, "x").agg(F.count("*")).collect()[0][0] == 2
