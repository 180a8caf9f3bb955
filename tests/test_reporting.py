"""Known answers and invariants of the reporting operators."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.functions import exprs
from marlstone.model import Metric, Refused
from marlstone.operators import history, ingest, loading, measures
from marlstone.operators.measures import Measure, measure_query
from marlstone.plans import fixtures
from marlstone.sources import landing
from marlstone.streaming.incremental import incremental_landing

FACT = "fin_month date, period_from date, company_id string, metric_id string, scenario string, ccy string, amount decimal(18,2)"


def facts(spark, *rows):
    return spark.createDataFrame([(date(*m), date(*p), c, k, s, y, Decimal(a)) for m, p, c, k, s, y, a in rows], FACT)


@pytest.fixture(scope="module")
def micro(spark):
    rows = [((2026, 2, 1), (2026, 1, 1), "c", "m", "actual", "CNY", "100"), ((2026, 2, 1), (2026, 1, 1), "c", "m", "actual", "USD", "20"), ((2026, 2, 1), (2026, 1, 1), "c", "m", "budget", "CNY", "999"), ((2026, 2, 1), (2026, 2, 1), "c", "m", "actual", "CNY", "60")]
    return facts(spark, *rows)


def rates(spark, *rows):
    return spark.createDataFrame([(date(*m), c, Decimal(r)) for m, c, r in rows], "rate_month date, ccy string, rate decimal(12,6)")


def test_ytd_of_default_members(micro):
    assert measure_query(micro, [Measure("m", "ytd")], filters={"month": "2026-02", "ccy": "CNY"}).collect()[0].value == 100


def test_conversion_before_aggregation(spark, micro):
    r = rates(spark, ((2026, 2, 1), "CNY", "1"), ((2026, 2, 1), "USD", "7"))
    assert measure_query(micro, [Measure("m", "ytd")], filters={"month": "2026-02"}, rates=r, to_ccy="CNY").collect()[0].value == 240


@pytest.mark.parametrize("change, reason", [({"filters": {"year": "2026", "ccy": "CNY"}}, "CUMULATIVE_TIME_UNPINNED"), ({"group_by": ("moon",)}, "UNKNOWN_DIMENSION"), ({"filters": {"month": "2026-02"}}, "DIM_MIXED_AGGREGATION"), ({"filters": {"company_id": []}}, "EMPTY_FILTER")])
def test_refusals(micro, change, reason):
    with pytest.raises(Refused) as e:
        measure_query(micro, [Measure("m", "ytd")], **change)
    assert e.value.reason == reason


@pytest.mark.parametrize("bad", [[], [((2026, 2, 1), "CNY", "1")], [((2026, 2, 1), "CNY", "1"), ((2026, 2, 1), "USD", "7"), ((2026, 2, 1), "USD", "8")]])
def test_missing_or_doubtful_rate_refuses(spark, micro, bad):
    with pytest.raises(Refused) as e:
        measure_query(micro, [Measure("m", "ytd")], ("month",), rates=rates(spark, *bad), to_ccy="CNY", limit=1)
    assert e.value.reason == "FX_RATE_MISSING"


def test_thin_cells_are_refused_for_agents(micro):
    with pytest.raises(Refused) as e:
        measure_query(micro, [Measure("m", "ytd")], ("month",), {"ccy": "CNY"}, audience="agent")
    assert e.value.reason == "TOO_FINE_GRAINED"


def test_ratio_after_aggregation(spark):
    month = (2026, 1, 1)
    df = facts(spark, *[(month, month, c, m, "actual", "CNY", a) for c, m, a in (("a", "r", "100"), ("a", "k", "50"), ("b", "r", "300"), ("b", "k", "300"))])
    margin = {"x": Metric("x", ("r", "k"), lambda r, k: F.try_divide(r - k, F.nullif(r, F.lit(0.0))))}
    assert measure_query(df, [Measure("x")], filters={"month": "2026-01", "ccy": "CNY"}, metrics=margin).collect()[0].value == 0.125


def test_prior_ytd_is_last_years_ytd(spark):
    df = facts(spark, ((2025, 6, 1), (2025, 1, 1), "c", "m", "actual", "CNY", "7"))
    new = measure_query(df, [Measure("m", "prior_ytd")], ("month",), {"month": "2026-06", "ccy": "CNY"}).collect()
    assert [(r.month, r.value) for r in new] == [("2026-06", 7)]


def test_expressions(spark):
    texts = ["2026-06", "2026/6", "2026.6", "2026年6月", "202606", "2026-06-01", "2026-06-01T08:00:00Z", "2026年6月30日"]
    good = spark.createDataFrame([(t,) for t in texts], "t string").select(exprs.parse_period(F.col("t")).alias("d")).collect()
    assert {r.d for r in good} == {date(2026, 6, 1)}
    bad = spark.createDataFrame([(t,) for t in ("46173", "2026-13", "1899-01", "x", "", None)], "t string").select(exprs.parse_period(F.col("t")).alias("d")).collect()
    assert {r.d for r in bad} == {None}
    one = spark.range(1)
    assert one.select(exprs.excel_serial_date(F.lit(46174.5)).alias("d")).first().d == date(2026, 6, 1)
    assert one.select(exprs.excel_serial_date(F.lit(60.0)).alias("d")).first().d is None
    assert one.select(exprs.unit_convert(F.lit(Decimal("-0.0000015")), "万元", "元", 2, True)[0].alias("v")).first().v == Decimal("0.02")
    assert one.select(exprs.entity_id(F.lit("工业"), "").alias("v")).first().v == "gedx"
    assert one.select(exprs.company_stem(F.lit("华东 子公司")).alias("v")).first().v == "华东"
    assert one.select(exprs.company_stem(F.lit("集团有限公司")).alias("v")).first().v == "集团有限公司"
    assert one.select(exprs.normalize_name(F.lit("ＡＢ（c）")).alias("v")).first().v == "abc"
    assert [one.select(exprs.band(F.lit(x)).alias("v")).first().v for x in (-2.5e8, 12345.0, 1500.0, 7.0)] == ["-2.5亿", "1.2万", "1.5千", "7"]


def test_january_windows_collapse_or_conflict(spark):
    rows = spark.createDataFrame([("a", Decimal("1")), ("a", Decimal("1")), ("b", Decimal("1")), ("b", Decimal("2"))], "k string, amount decimal(18,2)")
    assert {r.k: r.conflict for r in loading.merged(rows, ["k"]).collect()} == {"a": False, "b": True}


def test_reload_is_refused(micro):
    with pytest.raises(Refused) as e:
        loading.upserted(micro, micro, "reject")
    assert e.value.reason == "CONFLICT_WITH_EXISTING"
    assert loading.upserted(micro, micro).count() == 4


def test_replay_of_the_same_batch_is_empty(micro):
    assert loading.replay_diff(micro, micro, loading.COORDINATE, ["amount"]).isEmpty()


def test_versions_stay_sound(spark):
    current = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, g string")
    start = history.first_versions(current, spark.createDataFrame([], "id string"), "2020-01-01", ["g"])
    moved = current.withColumn("g", F.when(F.col("id") == "a", "z").otherwise(F.col("g")))
    after = history.apply_changes(start, moved, ["g"], "2021-01-01")
    assert after.count() == 3
    assert history.problems(moved, after, ["g"]).isEmpty()
    with pytest.raises(Refused):
        history.apply_changes(after, current, ["g"], "2020-06-01")


def test_blank_rows_end_the_grid(spark):
    cells = spark.createDataFrame([("f", "s", r, 1, "text", "x") for r in (1, 2, 3, 5)] + [("f", "s", 4, 2, "number", "1")], "file_hash string, sheet string, row_no int, col_no int, value_kind string, raw_value string")
    assert sorted(r.row_no for r in ingest.extent(cells, 2, [1]).collect()) == [2, 3]


def test_drift_of_a_table(spark):
    batch = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 3)], "batch_id string, v int")
    drift = landing.schema_drift(batch, spark.createDataFrame([], "batch_id string, v long, w int").schema)
    assert {(r.column, r.state) for r in drift.collect()} == {("v", "type changed"), ("w", "missing")}


def test_a_file_lands_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    df.write.parquet(source)
    assert incremental_landing(spark, source, df.schema, target, mark).count() == 2
    df.write.mode("append").parquet(source)
    assert incremental_landing(spark, source, df.schema, target, mark).count() == 2


def test_an_empty_folder_lands_nothing(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "i int, t string").schema
    landed = incremental_landing(spark, source, schema, target, mark)
    assert landed.columns == ["i", "t", "file_hash"] and landed.isEmpty()


def test_a_batch_reads_its_buckets_of_the_ledger_only(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a")], "i int, t string").coalesce(1)
    df.write.parquet(source)
    digest = incremental_landing(spark, source, df.schema, target, str(tmp_path / "m1")).collect()[0].file_hash
    other = tmp_path / "out" / "_ledger" / f"prefix={'00' if digest[:2] != '00' else '01'}"
    other.mkdir()
    (other / "x.parquet").write_bytes(b"not a ledger")  # reading it would fail
    for part in (tmp_path / "out").glob("_marlstone_batch=*/*.parquet"):
        part.write_bytes(b"not rows")  # neither are the rows read, to know what has landed
    again = incremental_landing(spark, source, df.schema, target, str(tmp_path / "m2"))  # another stream over the same file
    assert again.columns == ["i", "t", "file_hash"] and len(list((tmp_path / "out").glob("_marlstone_batch=*"))) == 1


def test_a_target_without_a_ledger_gets_one(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a")], "i int, t string").coalesce(1)
    df.write.parquet(source)
    incremental_landing(spark, source, df.schema, target, str(tmp_path / "m1"))
    (tmp_path / "out" / "_ledger").rename(tmp_path / "old")
    assert incremental_landing(spark, source, df.schema, target, str(tmp_path / "m2")).count() == 1


def test_equal_rows_of_new_files_all_land(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "i int, t string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    landed = lambda: sorted(((r.i, r.t) for r in incremental_landing(spark, source, spark.createDataFrame([], schema).schema, target, mark).collect()), key=str)
    arrive((1, "a"), (1, "a"), (2, None))
    arrive((1, "a"), (3, "c"))
    arrive((1, "a"), (3, "c"))  # the same file in the same batch
    first = [(1, "a")] * 3 + [(3, "c")]
    assert [x for x in landed() if x[0] != 2] == first
    arrive((1, "a"), (1, "a"), (2, None))  # and in a later one
    arrive((1, "a"))
    arrive((1, "a"), (2, None))
    rows = landed()
    assert rows.count((1, "a")) == 5 and rows.count((2, None)) == 2 and len(rows) == 8


def test_derived_metrics_can_not_be_filtered_by_metric(micro):
    with pytest.raises(Refused):
        measure_query(micro, [Measure("m_margin")], ("metric_id",), {"ccy": "CNY"}, measures.GROSS)


def test_small_rates_keep_their_digits(spark):
    facts = spark.createDataFrame([(date(2026, 1, 1), "IRR", Decimal(10**12))], "fin_month date, ccy string, amount decimal(18,2)")
    rates = spark.createDataFrame([(date(2026, 1, 1), "IRR", Decimal("0.00029")), (date(2026, 1, 1), "USD", Decimal("7.1234"))], "rate_month date, ccy string, rate decimal(12,6)")
    got = measures.converted(facts, rates, "USD").first().converted
    assert round(got, 2) == round(Decimal(10**12) * Decimal("0.00029") / Decimal("7.1234"), 2)


def test_a_missing_earlier_leg_refuses(spark):
    shape = "fin_month date, period_from date, company_id string, metric_id string, scenario string, ccy string, amount decimal(18,2)"
    rows = spark.createDataFrame([(d, d, c, "m", "actual", "CNY", Decimal(v)) for d, c, v in ((date(2025, 1, 1), "a", 2), (date(2026, 1, 1), "a", 3), (date(2026, 1, 1), "b", 1))], shape)
    with pytest.raises(Refused) as e:
        measures.year_over_year(rows, "m", since="2026-01", over=("ccy",))
    assert e.value.reason == "CALIBER_OPERAND_MISSING"
    assert [(r.company_id, r.month) for r in measures.missing_legs(rows, "m", since="2026-01", over=("ccy",)).collect()] == [("b", "2026-01")]
    whole = measures.year_over_year(rows.filter("company_id = 'a'"), "m", since="2026-01", over=("ccy",)).collect()
    assert [(r.company_id, r.month, r.prev, r.cur, r.yoy) for r in whole] == [("a", "2026-01", 2, 3, 0.5)]


def test_year_over_year_lists_every_company_and_month(spark):
    d = "/root/testdata/sf0.001"
    rows = fixtures.view(spark, d, "fact_finance").filter("scenario = 'actual' AND metric_id = 'm_revenue' AND period_from = fin_month").collect()
    sums = {}
    for r in rows:
        key = r.company_id, r.fin_month.year, r.fin_month.month
        sums[key] = sums.get(key, 0) + r.amount
    want = {}
    for (c, y, m), cur in sums.items():
        prev = sums.get((c, y - 1, m))
        want[c, f"{y}-{m:02}"] = cur, prev, None if not prev else float(cur - prev) / float(prev)
    got = {(r.company_id, r.month): (r.cur, r.prev, r.yoy) for r in catalog.QUERIES["yoy_ratio"](spark, d).collect()}
    assert got.keys() == want.keys() and len({m for _, m in got}) < len(got)
    for key, (cur, prev, ratio) in want.items():
        assert got[key][:2] == (cur, prev)
        assert got[key][2] is None if ratio is None else abs(got[key][2] - ratio) < 1e-6
    lost = {(r.company_id, r.month) for r in catalog.QUERIES["leg_join"](spark, d).collect()}
    assert lost == {k for k, v in got.items() if v[1] is None} and 0 < len(lost) < len(got)


def test_a_leg_of_null_amounts_is_a_leg(spark):
    old, new = date(2025, 1, 1), date(2026, 1, 1)
    legs = [(old, old, "a", None), (new, new, "a", Decimal(3)), (old, old, "b", Decimal(0)), (new, new, "b", None), (new, old, "c", Decimal(5))]
    rows = spark.createDataFrame([(m, p, c, "m", "actual", "CNY", a) for m, p, c, a in legs], FACT)
    assert sorted((r.company_id, r.month) for r in measures.missing_legs(rows, "m", over=("ccy",)).collect()) == [("a", "2025-01"), ("b", "2025-01")]
    got = measures.year_over_year(rows, "m", over=("ccy",), strict=False).collect()
    assert sorted((r.company_id, r.month, r.cur, r.prev, r.yoy) for r in got) == [
        ("a", "2025-01", None, None, None), ("a", "2026-01", 3, None, None), ("b", "2025-01", 0, None, None), ("b", "2026-01", None, 0, None),
    ]
    assert len(measures.year_over_year(rows, "m", since="2026-01", over=("ccy",)).collect()) == 2


def test_several_changes_of_a_member_are_refused(spark):
    past = spark.createDataFrame([("a", "x")], "id string, g string")
    start = history.first_versions(past, spark.createDataFrame([], "id string"), "2020-01-01", ["g"])
    with pytest.raises(Refused) as e:
        history.apply_changes(start, spark.createDataFrame([("a", "y"), ("a", "z")], "id string, g string"), ["g"], "2021-01-01")
    assert e.value.reason == "SEVERAL_CHANGES"


def test_sheets_of_different_cells_are_different_files(spark):
    rows = [("1", 1, "a\tb", "c"), ("2", 1, "a", "b\tc"), ("3", 1, None, "x"), ("4", 1, "", "x"), ("5", 1, "x\ny", None), ("6", 1, "x", None), ("6", 2, "y", None)]
    cells = landing.landed_sheets(spark.createDataFrame(rows, "file string, row int, v string, w string"), "file", "row", "s")
    assert cells.select("file_hash").distinct().count() == 6


def test_formulas_are_masked(spark):
    cells = spark.createDataFrame([("f", "s", 1, 1, "text", "secret 99", "=A2"), ("f", "s", 1, 2, "text", "open", None)], "file_hash string, sheet string, row_no int, col_no int, value_kind string, raw_value string, formula string")
    assert {r.shown for r in ingest.masked(cells, 9, 9).collect()} == {"<formula>", "open"}


def test_views_follow_their_files(spark, tmp_path):
    for t in fixtures.BASE:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    count = lambda: fixtures.view(spark, str(tmp_path), "master").count()
    before = count()
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").withColumn("s_suppkey", F.col("s_suppkey") + 1000).write.mode("append").parquet(str(tmp_path / "supplier.parquet"))
    assert count() == 2 * before


@pytest.mark.parametrize("block", ["month", "year"])
def test_the_as_of_merge_is_the_range_join(spark, block):
    rng = random.Random(5)
    day = lambda n: date(2020, 1, 1) + timedelta(days=n)
    versions = []
    for i in range(20):
        cuts = sorted(rng.sample(range(1500), rng.randint(1, 12)))
        for a, b in zip(cuts, [*cuts[1:], None], strict=True):  # some end before the next begins, so that there are gaps
            end = None if b is None else rng.choice([b, (a + b) // 2 if (a + b) // 2 > a else b])
            versions.append((str(i), day(a), None if end is None else day(end), f"g{a}", None if a % 5 == 0 else a))
    hot = [("0", day(rng.randrange(1600)), n) for n in range(1500)]
    rows = hot + [(str(rng.randrange(25)), day(rng.randrange(1600)), n) for n in range(600)] + [(None, day(9), -1), ("1", None, -2)]
    facts = spark.createDataFrame(rows, "id string, day date, version int")
    known = spark.createDataFrame(versions, "id string, valid_from date, valid_to date, g string, v int")
    got = history.as_of_join(facts, known, "id", "day", ["g", "v"], block)
    assert got.columns == ["id", "day", "version", "g", "v"]
    k = known.withColumnRenamed("id", "k")
    want = facts.join(k, (facts.id == k.k) & (facts.day >= k.valid_from) & (k.valid_to.isNull() | (facts.day < k.valid_to))).select("id", "day", "version", "g", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 1000
