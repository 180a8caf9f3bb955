"""Landing of files: quoted fields, encodings, limits; and the drift of files from a declaration."""

import csv
import hashlib
import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.model import Refused
from marlstone.sources import landing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab ,"\n\r=1é中', max_size=6), min_size=1, max_size=4), max_size=5))
def test_records_are_those_of_the_csv_module(rows):
    out = io.StringIO(newline="")
    csv.writer(out, quoting=csv.QUOTE_ALL).writerows(rows)
    text = out.getvalue()
    assert [[f for f, _ in r] for r in landing._records(text)] == list(csv.reader(io.StringIO(text, newline=""))) == rows


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab,\n\r1", max_size=30))
def test_plain_records_are_those_of_the_csv_module(text):
    ours = [[f for f, _ in r] for r in landing._records(text)]
    theirs = [r or [""] for r in csv.reader(io.StringIO(text, newline=""))]  # a blank line is a record without cells, whose number counts
    assert ours == theirs


def test_odd_files_land_or_are_refused_by_name(spark, tmp_path):
    wide, long = ",".join("x" * 513), "x\n" * 20_001
    files = {
        "plain.csv": b'"line1\nline2",5\r\nb,"5"', "bom.csv": "﻿é,1\n".encode(), "gbk.csv": "公司,收入\n".encode("gbk"), "wide.csv": wide.encode(),
        "long.csv": long.encode(), "limit.csv": ("x\n" * 20_000).encode(), "open.csv": b'a,"b\n', "bytes.csv": b"\xff\xff\x81", "empty.csv": b"", "u16.csv": "中,1".encode("utf-16"),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "open.csv").write_bytes(files["open.csv"])
    key = {hashlib.sha256(c).hexdigest(): n for n, c in files.items()}
    cells = landing.land_files(spark, str(tmp_path)).collect()
    got = {(key[c.file_hash], c.row_no, c.col_no): (c.value_kind, c.raw_value) for c in cells if key[c.file_hash] != "limit.csv"}
    assert got == {
        ("plain.csv", 1, 1): ("text", "line1\nline2"), ("plain.csv", 1, 2): ("number", "5"), ("plain.csv", 2, 1): ("text", "b"), ("plain.csv", 2, 2): ("text", "5"),
        ("bom.csv", 1, 1): ("text", "é"), ("bom.csv", 1, 2): ("number", "1"), ("gbk.csv", 1, 1): ("text", "公司"), ("gbk.csv", 1, 2): ("text", "收入"),
        ("u16.csv", 1, 1): ("text", "中"), ("u16.csv", 1, 2): ("number", "1"),
    }
    assert sum(key[c.file_hash] == "limit.csv" for c in cells) == 20_000
    refused = sorted((r.path.rpartition("/")[2], r.refused) for r in landing.refused_files(spark, str(tmp_path)).collect())
    assert refused == [("bytes.csv", "ENCODING_UNKNOWN"), ("long.csv", "SHEET_TOO_LARGE"), ("open.csv", "FILE_MALFORMED"), ("open.csv", "FILE_MALFORMED"), ("wide.csv", "SHEET_TOO_LARGE")]


def test_a_declared_encoding_is_kept_to(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("é".encode("latin-1"))
    assert [c.raw_value for c in landing.land_files(spark, str(tmp_path), encoding="latin-1").collect()] == ["é"]
    assert [r.refused for r in landing.refused_files(spark, str(tmp_path), encoding="utf-8").collect()] == ["ENCODING_UNKNOWN"]
    with pytest.raises(LookupError):
        landing.land_files(spark, str(tmp_path), encoding="no such")


def test_large_files_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("abcdef")
    (tmp_path / "b.csv").write_text("x")
    monkeypatch.setattr(landing, "MAX_BYTES", 3)
    assert [c.raw_value for c in landing.land_files(spark, str(tmp_path)).collect()] == ["x"]
    assert [(r.path.rpartition("/")[2], r.file_hash, r.refused) for r in landing.refused_files(spark, str(tmp_path)).collect()] == [("a.csv", None, "FILE_TOO_LARGE")]


def test_files_drift_each_in_its_way(spark, tmp_path):
    declared = spark.createDataFrame([], "id long NOT NULL, at date, v decimal(18,2)").schema
    assert not declared["id"].nullable
    kinds = {
        "good": "id, DATE '2026-01-01' AS at, CAST(1 AS decimal(18,2)) AS v", "no_v": "id, DATE '2026-01-01' AS at", "no_id": "DATE '2026-01-01' AS at, CAST(1 AS decimal(18,2)) AS v",
        "more": "id, DATE '2026-01-01' AS at, CAST(1 AS decimal(18,2)) AS v, 'x' AS w", "typed": "id, '2026' AS at, CAST(1 AS decimal(18,2)) AS v",
        "nulls": "nullif(id, 0) AS id, DATE '2026-01-01' AS at, CAST(1 AS decimal(18,2)) AS v",
    }
    for name, columns in kinds.items():
        spark.range(3).selectExpr(*re.split(r", (?![^(]*\))", columns)).coalesce(1).write.parquet(str(tmp_path / f"k=a b%{name}"))
    (tmp_path / "k=broken").mkdir()
    (tmp_path / "k=broken" / "x.parquet").write_bytes(b"PAR1 no")
    drift = landing.file_drift(landing.file_schemas(spark, str(tmp_path)), declared).collect()
    folder = lambda f: f.rpartition("/")[0].rpartition("k=")[2].rpartition("%25")[2]
    assert {(folder(r.file), r.column, r.state, r.n_rows, r.n_null, r.blocking) for r in drift} == {
        ("no_v", "v", "missing", 3, None, False), ("no_id", "id", "missing, not null", 3, None, True), ("more", "w", "extra", 3, 0, True),
        ("typed", "at", "type changed", 3, 0, True), ("nulls", "id", "null values", 3, 1, True), ("broken", None, "unreadable", None, None, True),
    }
    with pytest.raises(Refused) as e:
        landing.accepted_files(spark, str(tmp_path), declared)
    assert e.value.reason == "SCHEMA_DRIFT"
    for name in ("good", "no_v"):
        landing.accepted_files(spark, str(tmp_path / f"k=a b%{name}"), declared)


def customers(spark, path, n, tasks):
    rows = spark.range(0, n, 1, tasks).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment")
    rows.write.parquet(f"{path}/customer.parquet")


def test_broken_lines_of_more_rows_than_a_sheet_holds_land_whole(spark, tmp_path):
    customers(spark, tmp_path, landing.MAX_ROWS + 5, 1)
    cells = catalog.QUERIES["land_broken_lines"](spark, str(tmp_path))
    want = spark.range(landing.MAX_ROWS + 5).selectExpr("id AS row_no", "inline(array(struct(1 AS col_no, concat('Customer#', id, '\n\"BUILDING\", ') AS raw_value), struct(2 AS col_no, CAST(id AS STRING) AS raw_value)))")
    assert cells.count() == 2 * (landing.MAX_ROWS + 5)
    assert cells.exceptAll(want).isEmpty() and want.exceptAll(cells).isEmpty()


def test_more_rows_than_eight_sheets_hold_land_whole(spark, tmp_path):
    n = 8 * landing.MAX_ROWS + 5
    customers(spark, tmp_path, n, 4)
    got = catalog.QUERIES["land_files"](spark, str(tmp_path)).groupBy("col_no", "value_kind").agg(F.count("*").alias("n"), F.countDistinct("raw_value").alias("texts")).collect()
    assert {tuple(r) for r in got} == {(1, "number", n, n), (2, "text", n, n), (3, "text", n, 25)}
