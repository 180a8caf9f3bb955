"""One test for each coded refusal, and what a refused batch leaves behind."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.model import FACTS, Fact, Metric, Refused
from marlstone.operators import admission, archives, loading, measures, registry, reports
from marlstone.operators.measures import Measure, measure_query

FACT = "fin_month date, period_from date, company_id string, metric_id string, scenario string, ccy string, amount decimal(18,2)"
CELL = "file_hash string, sheet string, row_no int, col_no int, value_kind string, raw_value string, formula string"
SPEC = admission.SheetSpec({"company": 1, "period": 2, "metric": 3}, (4,), {4: "month"}, {})
CONTRACT = Fact("fact_contract", ("company_id", "metric_id", "month", "year"))
ODD = Fact("fact_odd", ("company_id", "metric_id", "month"), ("month",))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(date(2026, m, 1), date(2026, m, 1), c, "m", "actual", "CNY", Decimal(m)) for m in (1, 2) for c in ("a", "b")], FACT)


def refused(call) -> str:
    with pytest.raises(Refused) as e:
        call()
    return e.value.reason


@pytest.mark.parametrize(
    "reason, measure, options",
    [
        ("EMPTY_MEASURES", None, {}),
        ("BAD_MEASURE", Measure(""), {}),
        ("BAD_MEASURE", Measure("m", None), {}),
        ("BAD_AGG", Measure("m", agg="median"), {}),
        ("UNKNOWN_PERIOD_TYPE", Measure("m", "week"), {}),
        ("CALIBER_IS_CALCULATOR", Measure("m", "yoy"), {}),
        ("FACT_UNKNOWN", Measure("m"), {"fact": "nowhere"}),
        ("FACT_NOT_DECLARED", Measure("m"), {"declared": {}}),
        ("UNKNOWN_DIMENSION", Measure("m"), {"group_by": ("moon",)}),
        ("PERIOD_TYPE_NOT_GROUPABLE", Measure("m"), {"group_by": ("period_type",)}),
        ("UNKNOWN_FILTER", Measure("m"), {"filters": {"moon": "x"}}),
        ("EMPTY_FILTER", Measure("m"), {"filters": {"company_id": []}}),
        ("DIM_NOT_ON_FACT", Measure("m", None), {"fact": "fact_contract", "group_by": ("scenario",)}),
        ("PERIOD_TYPE_NOT_ON_FACT", Measure("m", "month"), {"fact": "fact_contract"}),
        ("CCY_NOT_ON_FACT", Measure("m", None), {"fact": "fact_contract", "to_ccy": "USD"}),
        ("CALIBER_UNRESOLVABLE", Measure("m", "month"), {"fact": "fact_odd"}),
        ("CUMULATIVE_TIME_UNPINNED", Measure("m", "ytd"), {"filters": {"ccy": "CNY"}}),
        ("DIM_MIXED_AGGREGATION", Measure("m"), {}),
        ("DERIVED_METRIC_FILTER", Measure("x"), {"group_by": ("metric_id",), "metrics": {"x": Metric("x", ("m",), lambda m: m)}}),
        ("TOO_FINE_GRAINED", Measure("m"), {"group_by": ("company_id",), "filters": {"ccy": "CNY"}, "audience": "agent"}),
    ],
)
def test_queries(rows, reason, measure, options):
    declared = FACTS | {f.name: f for f in (CONTRACT, ODD)}
    assert refused(lambda: measure_query(rows, [measure] if measure else [], **{"declared": declared, **options})) == reason


def test_shifts_do_not_mix(rows):
    assert refused(lambda: measure_query(rows, [Measure("m", "ytd", name="x"), Measure("m", "prior_ytd", name="y")], ("month",), {"ccy": "CNY"})) == "CALIBER_SHIFT_CONFLICT"


def test_a_fact_without_calibers_sums_all_its_rows(rows):
    declared = FACTS | {CONTRACT.name: CONTRACT}
    got = measure_query(rows.drop("scenario", "ccy", "period_from"), [Measure("m", None)], ("company_id",), fact="fact_contract", declared=declared).collect()
    assert {(r.company_id, r.value) for r in got} == {("a", 3), ("b", 3)}


def test_a_limit_tells_what_it_leaves_out(rows):
    ask = lambda n: measure_query(rows, [Measure("m")], ("company_id", "month"), {"ccy": "CNY"}, limit=n).collect()
    assert [(len(r), r[0].truncated) for r in (ask(3), ask(4), ask(9))] == [(3, True), (4, False), (4, False)]


@pytest.mark.parametrize(
    "reason, block",
    [
        ("VALUE_BINDING_BAD", reports.Block("metric_id", "caliber", metric="m")),
        ("VALUE_BINDING_BAD", reports.Block("company_id", "caliber", metric=" ")),
        ("CALIBER_AXIS_COLS_ONLY", reports.Block("caliber", "metric_id")),
        ("UNCONSTRAINED_DIM", reports.Block("company_id", "caliber")),
        ("UNCONSTRAINED_DIM", reports.Block("company_id", "metric_id")),
        ("EXPR_REFS", reports.Block("metric_id", "caliber", ("ytd",), expr_refs=("ytd", "prior_ytd"))),
    ],
)
def test_blocks(reason, block):
    assert refused(lambda: reports.accepted(block)) == reason


def test_sound_blocks_are_accepted(spark):
    for block in (reports.Block("company_id", "caliber", ("ytd",), metric="m", expr_refs=("ytd",)), reports.Block("company_id", "metric_id", caliber="ytd"), reports.Block("company_id", "caliber", filters={"metric_id": "m"})):
        assert reports.accepted(block) is block
    assert refused(lambda: reports.ordered(spark.range(1).selectExpr("'a' AS k"), "k", ["a", "a"])) == "ORDER_DUPLICATE"


def test_aggregates_keep_what_can_not_be_summed(rows):
    grain = ("fin_month", "period_from", "scenario", "ccy")
    assert measures.aggregated(rows, grain).count() == 2
    for lost in grain:
        assert refused(lambda lost=lost: measures.aggregated(rows, tuple(g for g in grain if g != lost))) == "MODEL_AGG_NONADDABLE"


def sheet(spark, *rows):
    """rows: (company, period, metric, amount) from row 2 on, each a text or a pair of kind and text, and a formula on the amount."""
    out = [("f", "s", 1, c, "text", t, None) for c, t in enumerate(("unit", "period", "metric", "value"), 1)]
    for n, values in enumerate(rows, 2):
        for c, v in enumerate(values[:4], 1):
            kind, text = v if isinstance(v, tuple) else ("number" if c == 4 else "text", v)
            if text is not None:
                out.append(("f", "s", n, c, kind, text, values[4] if c == 4 and len(values) > 4 else None))
    return spark.createDataFrame(out, CELL)


GOOD = [("a", "2026-01", "m", "1"), ("b", "2026-01", "m", "2")]


@pytest.mark.parametrize(
    "reason, bad",
    [
        ("ROWKEY_DUPLICATE_IN_FILE", ("a", "2026-01", "m", "3")),
        ("MEASURE_NON_NUMERIC", ("c", "2026-01", "m", ("text", "n/a"))),
        ("PERIOD_UNPARSEABLE", ("c", "spring", "m", "3")),
        ("PERIOD_CELL_NOT_TEXT", ("c", ("number", "46174"), "m", "3")),
        ("COMPUTED_ROW_NOT_DROPPED", ("total", "2026-01", "m", "3", "=SUM(D2:D3)")),
        ("ROWKEY_EMPTY_IN_FILE", (" ", "2026-01", "m", "3")),
    ],
)
def test_batches(spark, reason, bad):
    df = sheet(spark, *GOOD, bad)
    assert {r.code for r in admission.findings(df, SPEC).collect()} == {reason}
    assert refused(lambda: admission.admitted(df, SPEC)) == reason


def test_other_batches(spark):
    good = sheet(spark, *GOOD)
    assert refused(lambda: admission.admitted(good, admission.SheetSpec(SPEC.labels, (4,), {}, {}))) == "HEADER_UNMAPPED"
    empty = sheet(spark, ("a", "2026-01", "m", None))
    assert refused(lambda: admission.admitted(empty, SPEC)) == "NO_WRITABLE_ROWS"
    derived = spark.createDataFrame([("m", "fact_finance", True)], "metric_id string, fact string, derived boolean")
    assert refused(lambda: admission.admitted(good, SPEC, derived)) == "METRIC_INPUT_INVALID"
    dropped = admission.SheetSpec(SPEC.labels, (4,), {4: "month"}, {}, drop=("total",))
    assert {(r.company, r.fin_month, r.caliber, r.amount) for r in admission.admitted(sheet(spark, *GOOD, ("total", "2026-01", "m", "3", "=D2+D3")), dropped).collect()} == {
        ("a", date(2026, 1, 1), "month", 1), ("b", date(2026, 1, 1), "month", 2)
    }
    dated = admission.SheetSpec(SPEC.labels, (4,), {4: "month"}, {}, period_is_date=True)
    assert [r.fin_month for r in admission.admitted(sheet(spark, ("a", ("number", "46174"), "m", "1")), dated).collect()] == [date(2026, 6, 1)]


def test_a_load_is_all_or_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "fact")
    rows.write.partitionBy("fin_month").parquet(path)
    stored = lambda: sorted((r.company_id, str(r.fin_month), r.amount) for r in spark.read.parquet(path).collect())
    before = stored()
    batch = admission.admitted(sheet(spark, ("a", "2026-02", "m", "9"), ("c", "2026-03", "m", "7")), SPEC)
    coordinates = batch.select("fin_month", F.col("company").alias("company_id"), F.col("metric").alias("metric_id"), F.lit("actual").alias("scenario"), F.lit("CNY").alias("ccy"), "caliber", "amount")
    assert refused(lambda: admission.load(path, coordinates)) == "CONFLICT_WITH_EXISTING" and stored() == before
    assert refused(lambda: admission.load(path, coordinates.withColumn("caliber", F.lit("yoy")))) == "CALIBER_NOT_INGESTIBLE" and stored() == before
    assert refused(lambda: admission.load(path, coordinates.withColumn("caliber", F.lit("week")))) == "CALIBER_NOT_DECLARED" and stored() == before
    twice = coordinates.unionByName(coordinates.withColumn("amount", F.col("amount") + 1))
    assert refused(lambda: admission.load(path, twice, "replace")) == "COORDINATE_CONFLICT" and stored() == before
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "fact" / "fin_month=2026-01-01").iterdir()}
    admission.load(path, coordinates, "replace")
    assert stored() == [("a", "2026-01-01", 1), ("a", "2026-02-01", 9), ("b", "2026-01-01", 1), ("b", "2026-02-01", 2), ("c", "2026-03-01", 7)]
    assert kept == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "fact" / "fin_month=2026-01-01").iterdir()}  # other months aren't rewritten


def test_reports_refuse_what_the_lint_finds(spark):
    facts = spark.createDataFrame([], "fin_month date, period_from date, company_id string, metric_id string, scenario string, ccy string, amount decimal(18,2)")
    assert refused(lambda: reports.by_caliber(facts, "company_id", ["c"], ["ytd"], "2026-06")) == "UNCONSTRAINED_DIM"
    assert refused(lambda: reports.pivot(facts, "company_id", "scenario", ["actual"], "ytd", "2026-06")) == "UNCONSTRAINED_DIM"
    assert refused(lambda: reports.pivot(facts, "company_id", "metric_id", ["m"], "", "2026-06")) == "UNCONSTRAINED_DIM"
    assert refused(lambda: reports.by_metric(facts, "caliber", ["ytd"], ["m"], "ytd", "2026-06")) == "CALIBER_AXIS_COLS_ONLY"


def test_what_is_shown_to_a_human_is_capped_and_says_so(spark):
    rows = spark.range(6000).selectExpr("DATE '2026-01-01' AS fin_month", "DATE '2026-01-01' AS period_from", "format_string('c%04d', id) AS company_id", "'m' AS metric_id", "'actual' AS scenario", "'CNY' AS ccy", "CAST(1 AS decimal(18,2)) AS amount")
    ask = lambda **more: measures.measure_query(rows, [measures.Measure("m")], ("company_id",), {"ccy": "CNY"}, **more)
    shown = ask(audience="human").collect()
    assert len(shown) == 5000 and all(r.truncated for r in shown) and {r.company_id for r in shown} == {f"c{n:04d}" for n in range(5000)}
    assert ask().count() == 6000  # a step of a larger plan is whole


def test_archiving_twice_replaces(spark, tmp_path):
    batch = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 3)], "batch_id string, v int")
    for _ in range(2):
        assert archives.archive(batch, str(tmp_path / "a")) == 3
    archives.archive(batch.filter("batch_id = 'b2'"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_ids_that_are_shared_are_refused(spark):
    # "Aa" and "BB" hash alike: 65 * 31 + 97 = 66 * 31 + 66.
    assert refused(lambda: registry.declared_rows(spark.createDataFrame([("Aa",), ("BB",)], "name string"), "x_")) == "ENTITY_ID_SHARED"
    assert registry.declared_rows(spark.createDataFrame([("Aa",), ("Aa",), ("b",)], "name string"), "x_").count() == 2
