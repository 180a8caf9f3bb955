"""Loads that publish a batch whole or not at all, and replay of what they read."""

import shutil
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.functions.exprs import unit_checked
from marlstone.model import Refused
from marlstone.operators import admission, loading, store
from marlstone.operators.store import STEPS, Store

CELL = "file_hash string, sheet string, row_no int, col_no int, value_kind string, raw_value string, formula string"
SPEC = admission.SheetSpec({"company": 1, "period": 2, "metric": 3}, (5, 6), {5: "month", 6: "ytd"}, {}, degenerate={"ccy": 4}, constants={"scenario": "actual"})
GRAIN = {"by_month": ("fin_month", "period_from", "scenario", "ccy")}
METRICS = [("m_1", "fact_finance", False)]


def refused(f):
    with pytest.raises(Refused) as e:
        f()
    return e.value.reason


def sheet(spark, rows, file="f"):
    """rows: (company, period, metric, ccy, month, ytd) from row 2 on."""
    out = [(file, "s", 1, c, "text", t, None) for c, t in enumerate(("unit", "period", "metric", "ccy", "month", "ytd"), 1)]
    out += [(file, "s", n, c, "number" if c > 4 else "text", str(v), None) for n, row in enumerate(rows, 2) for c, v in enumerate(row, 1) if v is not None]
    return spark.createDataFrame(out, CELL)


FIRST = [("Alpha", "2026-01", "Sales", "CNY", "1.50", "1.50"), ("Alpha", "2026-02", "Sales", "CNY", "2", "3.50"), ("Beta", "2026-02", "Sales", None, "4", "9")]
SECOND = [("alpha", "2026-02", "Sales", "CNY", "5", "6.50"), ("Gamma", "2026-03", "Sales", "USD", "7", None), ("Beta", "2026-02", "Sales", None, "8", "9")]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("company", "alpha", "c_a"), ("company", "beta", "c_b"), ("metric", "sales", "m_1")], store.NAMES)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory, names):
    s = Store(spark, str(tmp_path_factory.mktemp("base") / "store"))
    store.load(s, sheet(spark, FIRST), [SPEC], names, spec_id="x", metrics=METRICS, aggregates=GRAIN, batch_id="b1", imported_at="2026-03-01")
    return s


@pytest.fixture(scope="module")
def loaded(spark, base, tmp_path_factory, names):
    s = copied(base, tmp_path_factory.mktemp("loaded"))
    return s, second(spark, s, names)


def copied(s, where):
    return Store(s.spark, shutil.copytree(s.root, str(where / "store")))


@pytest.fixture
def filled(base, tmp_path):
    return copied(base, tmp_path)


def second(spark, s, names, **options):
    decisions = spark.createDataFrame([("company", "Gamma", "create", None)], "kind string, raw string, action string, target string")
    return store.load(s, sheet(spark, SECOND, "g"), [SPEC], names, **{"spec_id": "x", "decisions": decisions, "metrics": METRICS, "aggregates": GRAIN, "on_conflict": "replace", "batch_id": "b2", "imported_at": "2026-04-01"} | options)


def seen(s):
    """Everything that readers can ask for."""
    parts = [s.facts(), s.aggregate("by_month"), s.log().drop("live"), store.reconciled(s), *map(s.appended, store.APPENDED)]
    return [sorted(map(str, p.collect())) for p in parts]


def amounts(df):
    return sorted((str(r.fin_month), str(r.period_from), r.company_id, str(r.ccy), float(r.amount), r.batch_id) for r in df.collect())


def test_a_batch_is_in_every_table(spark, base, loaded, names):
    filled, done = loaded
    jan, feb = "2026-01-01", "2026-02-01"
    assert amounts(base.facts()) == [(jan, jan, "c_a", "CNY", 1.5, "b1"), (feb, jan, "c_a", "CNY", 3.5, "b1"), (feb, jan, "c_b", "None", 9.0, "b1"), (feb, feb, "c_a", "CNY", 2.0, "b1"), (feb, feb, "c_b", "None", 4.0, "b1")]
    assert (done.version, done.n_staged, done.n_facts, done.replaced, done.archived) == (2, 5, 5, 4, True)
    gamma = next(r.id for r in filled.appended("versions").collect())
    assert amounts(filled.facts()) == sorted([
        (jan, jan, "c_a", "CNY", 1.5, "b1"), (feb, jan, "c_a", "CNY", 6.5, "b2"), (feb, jan, "c_b", "None", 9.0, "b2"), (feb, feb, "c_a", "CNY", 5.0, "b2"), (feb, feb, "c_b", "None", 8.0, "b2"),
        ("2026-03-01", "2026-03-01", gamma, "USD", 7.0, "b2"),
    ])
    log = {r.batch_id: r for r in filled.log().collect()}
    assert log["b2"].replaced_batches == ["b1"] and log["b1"].n_facts == 5 and log["b1"].n_staged == 6
    assert {(r.batch_id, r.fact_rows, r.state) for r in store.reconciled(filled).collect()} == {("b1", 1, "replaced in part"), ("b2", 5, "whole")}
    assert [(r.kind, r.name, r.valid_from, r.is_current, r.batch_id) for r in filled.appended("versions").collect()] == [("company", "Gamma", date(2026, 2, 1), True, "b2")]
    assert {(r.fin_month, r.batch_id) for r in filled.appended("periods").collect()} == {(date(2026, 1, 1), "b1"), (date(2026, 2, 1), "b1"), (date(2026, 3, 1), "b2")}
    assert {(str(r.fin_month), str(r.period_from), str(r.ccy), float(r.amount)) for r in filled.aggregate("by_month").collect()} == {
        (jan, jan, "CNY", 1.5), (feb, jan, "CNY", 6.5), (feb, jan, "None", 9.0), (feb, feb, "CNY", 5.0), (feb, feb, "None", 8.0), ("2026-03-01", "2026-03-01", "USD", 7.0)
    }
    staged = {(r.row_no, r.col_no): r for r in filled.appended("staged", "b2").collect()}
    assert set(staged) == {(2, 5), (2, 6), (3, 5), (4, 5), (4, 6)} and (staged[2, 5].company, staged[2, 5].company_id, staged[2, 5].degenerate) == ("alpha", "c_a", '{"ccy":"CNY","scenario":"actual"}')
    assert {(r.norm, r.id) for r in filled.appended("catalog", "b2").filter("kind = 'company'").collect()} == {("alpha", "c_a"), ("beta", "c_b"), ("gamma", gamma)}
    assert spark.read.parquet(f"{filled.root}/archive").groupBy("batch_id").count().count() == 2 and filled.orphans() == []


def test_names_of_earlier_batches_are_known(spark, loaded, names, tmp_path):
    s = copied(loaded[0], tmp_path)
    assert store.load(s, sheet(spark, [("GAMMA", "2026-04", "Sales", "USD", "1", None)], "h"), [SPEC], names, spec_id="x", batch_id="b3").n_facts == 1


def test_a_failure_at_any_step_changes_nothing_for_readers(spark, filled, names):
    was = seen(filled)
    for step in STEPS[:-1]:

        def fail(at, step=step):
            if at == step:
                raise OSError(step)

        with pytest.raises(OSError, match=step):
            second(spark, filled, names, before=fail)
        assert seen(filled) == was and (filled.orphans() != []) == (step != "stage")
    assert second(spark, filled, names).version == 2  # the same batch is tried again
    assert amounts(filled.facts())[-1][-1] == "b2" and filled.orphans() == []


def test_a_failed_archive_does_not_undo_a_load(spark, filled, names):
    def fail(at):
        if at == "archive":
            raise OSError

    assert second(spark, filled, names, before=fail).archived is False
    assert filled.log().count() == 2


def test_of_two_loads_at_a_time_one_is_published(spark, filled, names):
    def other(at):
        if at == "commit":
            store.load(filled, sheet(spark, [("Beta", "2026-05", "Sales", None, "1", None)], "h"), [SPEC], names, spec_id="y", batch_id="b9")

    assert refused(lambda: second(spark, filled, names, before=other)) == "STORE_CHANGED"
    assert {r.batch_id for r in filled.log().collect()} == {"b1", "b9"} and {r.batch_id for r in filled.facts().select("batch_id").distinct().collect()} == {"b1", "b9"}
    assert second(spark, filled, names).version == 3


@pytest.mark.parametrize(
    "reason, options",
    [
        ("CONFLICT_WITH_EXISTING", {"on_conflict": "reject"}), ("DECISION_NEEDED", {"decisions": None}), ("BATCH_ALREADY_LOADED", {"batch_id": "b1"}),
        ("METRIC_INPUT_INVALID", {"metrics": [("Sales", "fact_finance", True)]}), ("MODEL_AGG_NONADDABLE", {"aggregates": {"x": ("fin_month",)}}),
    ],
)
def test_refusals_publish_nothing(spark, filled, names, reason, options):
    was = seen(filled)
    assert refused(lambda: second(spark, filled, names, **options)) == reason
    assert seen(filled) == was


def test_decisions_have_targets(spark, filled, names):
    shape = "kind string, raw string, action string, target string"
    gone = spark.createDataFrame([("company", "Gamma", "merge", "c_zzz")], shape)
    assert refused(lambda: second(spark, filled, names, decisions=gone)) == "DECISION_TARGET_UNKNOWN"
    second(spark, filled, names, decisions=spark.createDataFrame([("company", "Gamma", "merge", "c_b")], shape))
    assert {r.id for r in filled.appended("names").collect()} == {"c_b"} and filled.appended("versions").count() == 0
    assert filled.facts().filter("company_id = 'c_b'").count() == 3


def test_lost_rows_refuse_the_load(spark, filled, names, monkeypatch):
    write = Store.write

    def lossy(self, df, table, batch_id):
        return write(self, df.filter("row_no > 2") if table == "staged" and batch_id == "b2" else df, table, batch_id)

    monkeypatch.setattr(Store, "write", lossy)
    was = seen(filled)
    assert refused(lambda: second(spark, filled, names)) == "LOAD_INCOMPLETE" and seen(filled) == was


def differences(df):
    return sorted((r.row_no, r.col_no, r.what) for r in df.collect())


def test_replay_finds_each_change_by_its_cell(spark, loaded):
    filled, cells = loaded[0], sheet(spark, SECOND, "g")
    assert differences(store.replay(filled, cells, "x")) == [] and differences(store.replay(filled, sheet(spark, FIRST), batch_id="b1")) == []
    edited = cells.withColumn("raw_value", F.when(F.expr("row_no = 2 AND col_no = 5"), "5.01").when(F.expr("row_no = 3 AND col_no = 1"), "Beta").otherwise(F.col("raw_value")))
    changed = edited.filter("row_no <> 4").unionByName(spark.createDataFrame([("g", "s", 3, 6, "number", "1", None)], CELL))
    assert differences(store.replay(filled, changed, "x")) == [(2, 5, "amount"), (3, 5, "company"), (3, 5, "company_id"), (3, 6, "missing"), (4, 5, "extra"), (4, 6, "extra")]
    rule = admission.SheetSpec(**vars(SPEC) | {"calibers": {5: "month", 6: "since"}})
    assert differences(store.replay(filled, cells, "x", blocks=[rule])) == [(2, 6, "caliber"), (4, 6, "caliber")]
    assert refused(lambda: store.replay(filled, cells, "never")) == "SPEC_NOT_INGESTED"
    assert admission.SheetSpec.from_json(rule.to_json()) == rule


def test_an_empty_store_reads_as_empty(spark, tmp_path):
    s = Store(spark, str(tmp_path / "none"))
    assert s.facts().count() == s.log().count() == s.appended("staged").count() == s.aggregate("by_month").count() == 0 and s.orphans() == []


def test_null_coordinates_collide_and_are_replaced(spark):
    shape = "fin_month date, period_from date, company_id string, metric_id string, scenario string, ccy string, amount decimal(18,2)"
    row = lambda v: spark.createDataFrame([(date(2026, 1, 1), date(2026, 1, 1), "c", "m", None, None, Decimal(v))], shape)
    assert loading.collisions(row(1), row(2)).count() == 1
    assert [r.amount for r in loading.upserted(row(1), row(2)).collect()] == [2]
    assert loading.replay_diff(row(1), row(2), loading.COORDINATE, ["amount"]).collect()[0].what == "amount"


def test_amounts_that_units_refuse_are_told_by_cell(spark):
    values = ["1", "1.005", "x", str(10**17), "1e3", None, "-2.5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")

    def told(*unit):
        amount, why = unit_checked(F.col("v"), *unit)
        return [(None if r.a is None else float(r.a), r.w) for r in df.select("i", amount.alias("a"), why.alias("w")).orderBy("i").collect()]

    assert told("万元", "元") == [(10000, None), (10050, None), (None, "not a number"), (None, "does not fit"), (10_000_000, None), (None, None), (-25000, None)]
    assert told("元", "元", "reject")[:2] == [(1, None), (None, "would be rounded")] and told("元", "元")[1] == (1.01, None)
    spec = admission.SheetSpec(**vars(SPEC) | {"units": {5: ("万元", "元")}})
    bad = sheet(spark, [*FIRST, ("Beta", "2026-03", "Sales", "CNY", str(10**15), "1"), ("Beta", "2026-04", "Sales", "CNY", "1", str(10**17))])
    assert {(r.row_no, r.col_no, r.code, r.reason) for r in admission.refused_cells(bad, spec).collect()} == {(5, 5, "TRANSFORM_VALUE_INVALID", "does not fit"), (6, 6, "TRANSFORM_VALUE_INVALID", "does not fit")}
    assert {(r.code, r.n, r.first_row) for r in admission.findings(bad, spec).collect()} == {("TRANSFORM_VALUE_INVALID", 2, 5)}
    assert refused(lambda: admission.admitted(bad, spec)) == "TRANSFORM_VALUE_INVALID"
    good = admission.expanded(sheet(spark, FIRST), spec).filter("row_no = 2").collect()
    assert {(r.col_no, float(r.amount)) for r in good} == {(5, 15000.0), (6, 1.5)}
