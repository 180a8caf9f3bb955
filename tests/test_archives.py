"""Archives: what compaction moves, what it leaves, and what failures leave behind."""

import pytest

from marlstone.model import Refused
from marlstone.operators import archives

SHAPE = "batch_id string, v long"


@pytest.fixture
def mixed(spark, tmp_path):
    """Batches a, b and c in small files (two of c), one large file of d, and a file of e without rows."""
    path = str(tmp_path / "archive")
    for name, n in (("a", 3), ("b", 2), ("c:1", 4)):
        archives.archive(spark.range(n).selectExpr(f"'{name}' AS batch_id", "id AS v").repartition(2 if n == 4 else 1), path)
    archives.archive(spark.range(0, 20_000, 1, 1).selectExpr("'d' AS batch_id", "xxhash64(id) AS v"), path)
    spark.createDataFrame([], SHAPE).coalesce(1).write.parquet(f"{path}/batch=e")
    return path


def listed(path):
    from pathlib import Path

    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*.parquet"))


def counts(spark, path):
    return {r.batch_id: r["count"] for r in archives.read_archive(spark, path).groupBy("batch_id").count().collect()}


ALL = {"a": 3, "b": 2, "c:1": 4, "d": 20_000}


def test_only_small_files_with_rows_move(spark, mixed):
    before = listed(mixed)
    plan = archives.compact(spark, mixed, max_bytes=50_000).collect()
    assert sorted((r.action, r.n_rows) for r in plan) == [("empty", 0), ("large", None), ("merge", 2), ("merge", 2), ("merge", 2), ("merge", 3)]
    after = listed(mixed)
    assert [p for p in after if p in before] == [p for p in before if p.startswith(("batch=d", "batch=e"))]
    assert len(after) == 3 and counts(spark, mixed) == ALL
    assert sorted(r.v for r in archives.read_archive(spark, mixed, "c:1").collect()) == [0, 1, 2, 3]
    assert archives.read_archive(spark, mixed, "d").count() == 20_000
    again = archives.compact(spark, mixed, max_bytes=50_000).collect()  # a single small file isn't rewritten for ever
    assert sorted(r.action for r in again) == ["empty", "few", "large"] and listed(mixed) == after


def test_a_dry_run_and_too_few_files_move_nothing(spark, mixed):
    before = listed(mixed)
    assert [r.action for r in archives.compact(spark, mixed, max_bytes=50_000, dry_run=True).collect()].count("merge") == 4
    assert {r.action for r in archives.compact(spark, mixed, max_bytes=50_000, min_files=5).collect()} == {"few", "empty", "large"}
    assert listed(mixed) == before


def test_files_are_packed_up_to_the_target(spark, mixed):
    archives.compact(spark, mixed, max_bytes=50_000, target_bytes=1)
    assert sum("compacted-" in p for p in listed(mixed)) >= 4 and counts(spark, mixed) == ALL


def test_a_mismatch_leaves_all_as_it_was(spark, mixed, monkeypatch):
    before, packed = listed(mixed), archives._packed
    monkeypatch.setattr(archives, "_packed", lambda *a: packed(*a).filter("NOT (batch_id = 'a' AND v = 0)"))
    with pytest.raises(Refused) as e:
        archives.compact(spark, mixed, max_bytes=50_000)
    assert e.value.reason == "ARCHIVE_INCOMPLETE" and listed(mixed) == before and counts(spark, mixed) == ALL


def test_an_interrupted_compaction_is_completed(spark, mixed, monkeypatch):
    finish, calls = archives.finish, []

    def fails(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        finish(*a)

    monkeypatch.setattr(archives, "finish", fails)
    with pytest.raises(RuntimeError):
        archives.compact(spark, mixed, max_bytes=50_000)
    with pytest.raises(Refused) as e:
        archives.read_archive(spark, mixed)
    assert e.value.reason == "ARCHIVE_BUSY"
    finish(spark, mixed)
    assert counts(spark, mixed) == ALL and len(listed(mixed)) == 3


def test_a_merged_batch_is_sealed(spark, mixed):
    archives.compact(spark, mixed, max_bytes=50_000)
    with pytest.raises(Refused) as e:
        archives.archive(spark.createDataFrame([("a", 9)], SHAPE), mixed)
    assert e.value.reason == "ARCHIVE_SEALED" and counts(spark, mixed) == ALL
