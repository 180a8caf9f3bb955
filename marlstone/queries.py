"""Registered queries of the reporting operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import exprs
from marlstone.model import CALIBERS, Metric
from marlstone.operators import history, ingest, loading, masters, measures, reports
from marlstone.operators.measures import GROSS, Measure, measure_query
from marlstone.plans.fixtures import view, with_views
from marlstone.sources import landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MONTH, YEAR = "1998-06", "1998"
ACTUAL = "scenario = 'actual'"
IS = {"month": "period_from = fin_month", "ytd": "period_from = CAST(date_trunc('year', fin_month) AS DATE)", "since": "period_from = DATE '1995-01-01'"}
M = "DECIMAL(18,2)"
YM = "strftime(fin_month, '%Y-%m')"


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return f

    return keep


def facts(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fact_finance")


def base(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Aggregates: one key a function, over companies in one month.
for _agg, _sql, _type in (("sum", "SUM", M), ("max", "MAX", M), ("min", "MIN", M), ("count", "COUNT", "BIGINT")):
    query(
        (
            f"SELECT company_id, CAST({_sql}(CASE WHEN metric_id='m_revenue' AND {IS['month']} THEN amount END) AS {_type}) AS value "
            f"FROM fact_finance WHERE {ACTUAL} AND year(fin_month)=1998 AND metric_id='m_revenue' GROUP BY 1"
        ),
        f"measure_{_agg}",
    )(lambda s, d, a=_agg: measure_query(facts(s, d), [Measure("m_revenue", "month", a)], ("company_id",), {"year": YEAR}, over=("ccy",)))


@query(
    f"SELECT company_id, CAST(round(CAST(SUM(CASE WHEN {IS['month']} THEN amount END) AS DOUBLE) / COUNT(CASE WHEN {IS['month']} "
    f"THEN 1 END), 2) AS {M}) AS value FROM fact_finance WHERE {ACTUAL} AND year(fin_month)=1998 AND metric_id='m_revenue' "
    f"GROUP BY 1"
)
def measure_avg(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue", "month", "avg")], ("company_id",), {"year": YEAR}, over=("ccy",))


@query(
    f"SELECT company_id, CAST(SUM(CASE WHEN metric_id='m_revenue' AND {IS['month']} THEN amount END) AS {M}) AS rev, CAST(SUM(CASE "
    f"WHEN metric_id='m_cost' AND {IS['ytd']} THEN amount END) AS {M}) AS cost_ytd, CAST(COUNT(CASE WHEN metric_id='m_revenue' "
    f"AND {IS['month']} THEN amount END) AS BIGINT) AS rev_support, CAST(COUNT(CASE WHEN metric_id='m_cost' AND {IS['ytd']} "
    f"THEN amount END) AS BIGINT) AS cost_ytd_support FROM fact_finance WHERE {ACTUAL} AND {YM}='{MONTH}' GROUP BY 1"
)
def multi_measure(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue", name="rev"), Measure("m_cost", "ytd", name="cost_ytd")], ("company_id",), {"month": MONTH}, over=("ccy",), support=True)


@query(f"SELECT CAST(SUM(CASE WHEN {IS['month']} THEN amount END) AS {M}) AS value FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue'")
def global_measure(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue")], over=("ccy",))


for _dim, _expr in (("month", YM), ("year", "strftime(fin_month, '%Y')"), ("company_id", "company_id"), ("ccy", "ccy"), ("scenario", "scenario"), ("metric_id", "metric_id")):
    query(
        (
            f"SELECT {_expr} AS {_dim}, CAST(SUM(CASE WHEN metric_id='m_revenue' AND {IS['month']} THEN amount END) AS {M}) AS value "
            f"FROM fact_finance WHERE metric_id='m_revenue'"
        ) + ("" if _dim == "scenario" else f" AND {ACTUAL}") + " GROUP BY 1",
        f"group_by_{_dim.removesuffix('_id')}",
    )(lambda s, d, g=_dim: measure_query(facts(s, d), [Measure("m_revenue")], (g,), over=("ccy",)))

for _cal, _key in (("month", "caliber_same"), ("ytd", "caliber_year_start"), ("since", "caliber_since")):
    query((
        f"SELECT company_id, {YM} AS month, CAST(SUM(CASE WHEN {IS[_cal]} THEN amount END) AS {M}) AS value FROM fact_finance "
        f"WHERE {ACTUAL} AND metric_id='m_revenue' GROUP BY 1, 2"
    ), _key)(
        lambda s, d, c=_cal: measure_query(facts(s, d), [Measure("m_revenue", c)], ("company_id", "month"), over=("ccy",))
    )


@query(
    f"SELECT company_id, strftime(fin_month + INTERVAL 1 YEAR, '%Y-%m') AS month, CAST(SUM(CASE WHEN {IS['ytd']} THEN amount "
    f"END) AS {M}) AS value FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' AND {YM} = '1997-06' GROUP BY 1, 2"
)
def caliber_shift(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue", "prior_ytd")], ("company_id", "month"), {"month": MONTH}, over=("ccy",))


@query(
    f"SELECT {YM} AS month, CAST(SUM(CASE WHEN {IS['month']} THEN amount END) AS {M}) AS value FROM fact_finance WHERE {ACTUAL} "
    f"AND metric_id='m_cost' AND company_id IN ('c_1','c_7') AND ccy='USD' AND year(fin_month) IN (1997, 1998) GROUP BY 1"
)
def dim_filter(s, d):
    return measure_query(facts(s, d), [Measure("m_cost")], ("month",), {"company_id": ["c_1", "c_7"], "ccy": "USD", "year": ["1997", "1998"]})


@query(
    f"SELECT c.group_name, CAST(SUM(f.amount) AS {M}) AS value FROM fact_finance f JOIN dim_company c ON f.company_id=c.id "
    f"WHERE f.scenario='actual' AND f.metric_id='m_revenue' AND f.period_from=f.fin_month AND c.level=2 GROUP BY 1"
)
def star_join(s, d):
    dim = view(s, d, "dim_company").filter("level = 2").select(F.col("id").alias("company_id"), "group_name")
    own = facts(s, d).filter(F.col("metric_id") == "m_revenue").filter(ACTUAL).filter(exprs.in_window(CALIBERS["month"]))
    return own.join(dim, "company_id").groupBy("group_name").agg(F.sum("amount").cast(measures.MONEY).alias("value"))


@query(
    f"SELECT f.company_id, CAST(SUM(f.amount) AS {M}) AS value FROM fact_finance f JOIN dim_company c ON f.company_id=c.id "
    f"WHERE f.scenario='actual' AND f.metric_id='m_revenue' AND f.period_from=f.fin_month AND c.group_name IN ('ASIA','EUROPE') "
    f"GROUP BY 1"
)
def attr_filter(s, d):
    chosen = view(s, d, "dim_company").filter(F.col("group_name").isin("ASIA", "EUROPE")).select(F.col("id").alias("company_id"))
    return measure_query(facts(s, d).join(chosen, "company_id", "left_semi"), [Measure("m_revenue")], ("company_id",), over=("ccy",))


@query(
    f"SELECT company_id, CAST(SUM(CASE WHEN {IS['month']} THEN amount END) AS {M}) AS value FROM fact_finance WHERE scenario='budget' "
    f"AND metric_id='m_revenue' GROUP BY 1"
)
def scenario_selector(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue")], ("company_id",), {"scenario": "budget"}, over=("ccy",))


@query("SELECT company_id, month, value, count(*) OVER () > 50 AS truncated FROM (" + (
    f"SELECT company_id, {YM} AS month, CAST(SUM(CASE WHEN {IS['month']} THEN amount END) AS {M}) AS value FROM fact_finance "
    f"WHERE {ACTUAL} AND metric_id='m_revenue' GROUP BY 1, 2) ORDER BY company_id, month LIMIT 50"
))
def result_limit(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue")], ("company_id", "month"), over=("ccy",), limit=50)


_LEAF = (
    f"CAST(SUM(CASE WHEN metric_id='m_revenue' AND {IS['ytd']} THEN amount END) AS DOUBLE) AS r, CAST(SUM(CASE WHEN metric_id='m_cost' "
    f"AND {IS['ytd']} THEN amount END) AS DOUBLE) AS c"
)


@query(
    f"SELECT company_id, CAST(round(CAST((r - c) / nullif(r, 0) AS DECIMAL(28,10)), 6) AS DOUBLE) AS margin FROM (SELECT "
    f"company_id, {_LEAF} FROM fact_finance WHERE {ACTUAL} AND {YM}='{MONTH}' GROUP BY 1)"
)
def derived_metric(s, d):
    return measure_query(facts(s, d), [Measure("m_margin", "ytd", name="margin")], ("company_id",), {"month": MONTH}, GROSS, over=("ccy",))


@query(
    f"SELECT company_id, CAST(least(COUNT(CASE WHEN metric_id='m_revenue' AND {IS['month']} THEN amount END), COUNT(CASE "
    f"WHEN metric_id='m_cost' AND {IS['month']} THEN amount END)) AS BIGINT) AS profit_support FROM fact_finance WHERE {ACTUAL} "
    f"AND year(fin_month)=1998 GROUP BY 1"
)
def derived_support(s, d):
    return measure_query(facts(s, d), [Measure("m_profit", name="profit")], ("company_id",), {"year": YEAR}, GROSS, over=("ccy",), support=True).select("company_id", "profit_support")


@query(
    f"SELECT company_id, CAST(COUNT(CASE WHEN {IS['month']} THEN amount END) AS BIGINT) AS value_support FROM fact_finance "
    f"WHERE {ACTUAL} AND metric_id='m_revenue' GROUP BY 1"
)
def support_count(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue")], ("company_id",), over=("ccy",), support=True).select("company_id", "value_support")


_FX = (
    f"SELECT f.company_id, CAST(round(CAST(SUM(CAST(round(CAST(CAST(f.amount AS DOUBLE) * CAST(s.rate AS DOUBLE) / CAST(t.rate "
    f"AS DOUBLE) AS DECIMAL(32,10)), 6) AS DECIMAL(28,6))) AS DECIMAL(28,6)), 2) AS {M}) AS value FROM "
    f"fact_finance f LEFT JOIN dim_fx_rate s ON s.rate_month=f.fin_month AND s.ccy=f.ccy LEFT JOIN dim_fx_rate t ON t.rate_month=f.fin_month "
    f"AND t.ccy='USD' WHERE f.scenario='actual' AND f.metric_id='m_revenue' AND f.period_from=f.fin_month GROUP BY 1"
)


@query(_FX)
def fx_convert(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue")], ("company_id",), rates=view(s, d, "dim_fx_rate"), to_ccy="USD")


@query("SELECT rate_month, ccy, rate, CAST(count(*) AS BIGINT) AS n, count(*)=1 AND rate>0 AS sound FROM dim_fx_rate GROUP BY 1,2,3")
def fx_rate_quality(s, d):
    return measures.rate_quality(view(s, d, "dim_fx_rate"))


@query(
    "SELECT CAST(count(*) AS BIGINT) AS bad FROM fact_finance f LEFT JOIN dim_fx_rate r ON r.rate_month=f.fin_month AND "
    "r.ccy=f.ccy AND month(r.rate_month)<>5 WHERE r.rate IS NULL"
)
def bad_fx_total(s, d):
    rates = measures.rate_quality(view(s, d, "dim_fx_rate").filter("month(rate_month) <> 5")).select(F.col("rate_month").alias("fin_month"), "ccy", "sound")
    return facts(s, d).join(rates, ["fin_month", "ccy"], "left").agg(F.count_if(~F.coalesce("sound", F.lit(False))).alias("bad"))


@query(
    f"SELECT a.company_id, strftime(a.fin_month,'%Y-%m') AS month, CAST(a.v AS {M}) AS cur, CAST(b.v AS {M}) AS prev, CAST(round(CAST((CAST(a.v "
    f"AS DOUBLE)-CAST(b.v AS DOUBLE))/nullif(CAST(b.v AS DOUBLE),0) AS DECIMAL(28,10)),6) AS DOUBLE) AS yoy FROM (SELECT "
    f"company_id, fin_month, SUM(amount) AS v FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' AND {IS['month']} "
    f"GROUP BY 1,2) a LEFT JOIN (SELECT company_id, fin_month, SUM(amount) AS v FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' "
    f"AND {IS['month']} GROUP BY 1,2) b ON a.company_id=b.company_id AND b.fin_month = a.fin_month - INTERVAL 1 YEAR"
)
def yoy_ratio(s, d):
    return measures.year_over_year(facts(s, d), "m_revenue", over=("ccy",), strict=False)


@query(
    f"SELECT a.company_id, strftime(a.fin_month,'%Y-%m') AS month FROM (SELECT DISTINCT company_id, fin_month FROM fact_finance "
    f"WHERE {ACTUAL} AND metric_id='m_revenue' AND {IS['month']}) a WHERE NOT EXISTS (SELECT 1 FROM fact_finance b WHERE "
    f"b.scenario='actual' AND b.metric_id='m_revenue' AND b.period_from=b.fin_month AND b.company_id=a.company_id AND b.fin_month=a.fin_month "
    f"- INTERVAL 1 YEAR)"
)
def leg_join(s, d):
    return measures.missing_legs(facts(s, d), "m_revenue", over=("ccy",))


@query(
    "SELECT bl_id, b.company_id, strftime(fin_month,'%Y-%m') AS month, CAST(SUM(amount*weight) AS DECIMAL(28,6)) AS value "
    "FROM fact_finance f JOIN map_org_bl b ON f.company_id=b.company_id WHERE scenario='actual' AND metric_id='m_revenue' "
    "AND period_from=fin_month GROUP BY 1,2,3"
)
def bridge_allocate(s, d):
    own = facts(s, d).filter(ACTUAL).filter("metric_id = 'm_revenue'").filter(exprs.in_window(CALIBERS["month"]))
    joined = own.join(view(s, d, "map_org_bl"), "company_id")
    return joined.groupBy("bl_id", "company_id", F.date_format("fin_month", "yyyy-MM").alias("month")).agg(F.sum(F.col("amount") * F.col("weight")).cast("decimal(28,6)").alias("value"))


_CENTS = "CAST(floor(l_quantity * 100 / CAST(t.total AS DOUBLE)) / 100 AS DECIMAL(5,4))"
_SHARES = "(SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM lineitem GROUP BY 1)"


@query(
    f"SELECT l_orderkey AS member, CAST(SUM({_CENTS}) AS DECIMAL(10,4)) AS total FROM lineitem JOIN {_SHARES} t USING (l_orderkey) "
    f"GROUP BY 1 HAVING SUM({_CENTS}) <> 1"
)
def allocation_conserved(s, d):
    # Shares of an order's lines, cut to cents: many don't add up.
    lines = base(s, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("q"))
    total = lines.groupBy("l_orderkey").agg(F.sum(F.col("q").cast("decimal(12,2)")).cast("decimal(18,2)").alias("total"))
    weight = (F.floor(F.col("q") * 100 / F.col("total").cast("double")).cast("double") / 100).cast("decimal(5,4)")
    return measures.not_conserved(lines.join(total, "l_orderkey").select(F.col("l_orderkey").alias("member"), weight.alias("weight")), "member")


@query(f"SELECT fin_month, period_from, metric_id, scenario, ccy, CAST(SUM(amount) AS {M}) AS amount FROM fact_finance GROUP BY 1,2,3,4,5")
def agg_rebuild(s, d):
    return measures.aggregated(facts(s, d), ("fin_month", "period_from", "metric_id", "scenario", "ccy"))


@query("SELECT count(*) = count(DISTINCT (fin_month, period_from, company_id, metric_id, scenario, ccy)) AS noop FROM fact_finance")
def agg_noop_check(s, d):
    keys = facts(s, d).groupBy(*loading.COORDINATE).agg(F.count("*").alias("n"))
    return keys.agg((F.sum("n") == F.count("*")).alias("noop"))


@query(f"SELECT DISTINCT {YM} AS month FROM fact_finance")
def distinct_months(s, d):
    return facts(s, d).select(F.date_format("fin_month", "yyyy-MM").alias("month")).distinct().orderBy("month")


@query("SELECT id, name, parent_id, CAST(level AS INTEGER) AS level, group_name FROM dim_company")
def member_catalog(s, d):
    return view(s, d, "dim_company").orderBy(F.asc_nulls_last("level"), "name")


_ORDER = ["c_3", "c_1", "c_99", "c_2", "c_7"]
_ROWS = "(VALUES (0,'c_3'),(1,'c_1'),(2,'c_99'),(3,'c_2'),(4,'c_7')) o(row_ord, company_id)"
_PIN = {"month": f"{IS['month']} AND {YM}='{MONTH}'", "ytd": f"{IS['ytd']} AND {YM}='{MONTH}'", "prior_ytd": f"{IS['ytd']} AND {YM}='1997-06'"}
_SUMS = ", ".join(f"CAST(SUM(CASE WHEN {p} THEN amount END) AS {M}) AS {c}" for c, p in _PIN.items())


@query(
    f"SELECT CAST(o.row_ord AS INTEGER) AS row_ord, o.company_id, t.month, t.ytd, t.prior_ytd FROM {_ROWS} LEFT JOIN (SELECT "
    f"company_id, {_SUMS} FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' GROUP BY 1) t ON t.company_id=o.company_id"
)
def report_company_by_caliber(s, d):
    return reports.by_caliber(facts(s, d), "company_id", _ORDER, list(_PIN), MONTH, metric_id="m_revenue", scenario="actual")


@query(
    f"SELECT CAST(o.row_ord AS INTEGER) AS row_ord, o.metric_id, t.month, t.ytd, t.prior_ytd FROM (VALUES (0,'m_revenue'),(1,'m_cost')) "
    f"o(row_ord, metric_id) LEFT JOIN (SELECT metric_id, {_SUMS} FROM fact_finance WHERE {ACTUAL} GROUP BY 1) t ON t.metric_id=o.metric_id"
)
def report_metric_by_caliber(s, d):
    return reports.by_caliber(facts(s, d), "metric_id", ["m_revenue", "m_cost"], list(_PIN), MONTH, scenario="actual")


_BM = (
    f"(SELECT company_id, CAST(SUM(CASE WHEN metric_id='m_revenue' THEN amount END) AS {M}) AS m_revenue, CAST(SUM(CASE WHEN "
    f"metric_id='m_cost' THEN amount END) AS {M}) AS m_cost FROM fact_finance WHERE {ACTUAL} AND {_PIN['ytd']} GROUP BY 1) "
    f"t"
)
MARGIN = Metric("margin", ("m_revenue", "m_cost"), lambda r, c: F.try_divide(r - c, F.nullif(r, F.lit(0.0))))


@query(
    f"SELECT CAST(o.row_ord AS INTEGER) AS row_ord, o.company_id, t.m_revenue, t.m_cost, CAST(round(CAST((CAST(m_revenue "
    f"AS DOUBLE)-CAST(m_cost AS DOUBLE))/nullif(CAST(m_revenue AS DOUBLE),0) AS DECIMAL(28,10)),6) AS DOUBLE) AS margin FROM "
    f"{_ROWS} LEFT JOIN {_BM} ON t.company_id=o.company_id"
)
def report_company_by_metric(s, d):
    return reports.by_metric(facts(s, d), "company_id", _ORDER, ["m_revenue", "m_cost", MARGIN], "ytd", MONTH, scenario="actual")


@query(
    f"SELECT company_id, CAST(SUM(CASE WHEN scenario='actual' THEN amount END) AS {M}) AS actual, CAST(SUM(CASE WHEN scenario='budget' "
    f"THEN amount END) AS {M}) AS budget, CAST(SUM(CASE WHEN scenario='forecast' THEN amount END) AS {M}) AS forecast FROM "
    f"fact_finance WHERE metric_id='m_revenue' AND {_PIN['ytd']} GROUP BY 1"
)
def report_generic_pivot(s, d):
    return reports.pivot(facts(s, d), "company_id", "scenario", ["actual", "budget", "forecast"], "ytd", MONTH, metric_id="m_revenue")


@query(
    f"SELECT 'report' AS sheet, CAST(5+o.row_ord AS INTEGER) AS row_no, CAST(2 + u.k AS INTEGER) AS col_no, CASE u.k WHEN "
    f"0 THEN o.company_id WHEN 1 THEN CAST(t.month AS VARCHAR) WHEN 2 THEN CAST(t.ytd AS VARCHAR) ELSE CAST(t.prior_ytd AS "
    f"VARCHAR) END AS value FROM {_ROWS} LEFT JOIN (SELECT company_id, {_SUMS} FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' "
    f"GROUP BY 1) t ON t.company_id=o.company_id CROSS JOIN (VALUES (0),(1),(2),(3)) u(k) WHERE CASE u.k WHEN 0 THEN o.company_id "
    f"WHEN 1 THEN CAST(t.month AS VARCHAR) WHEN 2 THEN CAST(t.ytd AS VARCHAR) ELSE CAST(t.prior_ytd AS VARCHAR) END IS NOT "
    f"NULL"
)
def report_cells(s, d):
    return reports.cells(report_company_by_caliber(s, d), list(_PIN), "company_id", "report", 5, 2)


@query(
    f"SELECT o.company_id AS series, u.k AS category, CASE u.k WHEN 'month' THEN t.month WHEN 'ytd' THEN t.ytd ELSE t.prior_ytd "
    f"END AS value FROM {_ROWS} LEFT JOIN (SELECT company_id, {_SUMS} FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' "
    f"GROUP BY 1) t ON t.company_id=o.company_id CROSS JOIN (VALUES ('month'),('ytd'),('prior_ytd')) u(k)"
)
def chart_series(s, d):
    return reports.series(report_company_by_caliber(s, d), "company_id", list(_PIN))


_MONTHLY = f"(SELECT company_id, fin_month, CAST(SUM(amount) AS {M}) AS amount FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' AND {IS['month']} GROUP BY 1,2)"


def _monthly(s, d):
    own = facts(s, d).filter(ACTUAL).filter("metric_id = 'm_revenue'").filter(exprs.in_window(CALIBERS["month"]))
    return own.groupBy("company_id", "fin_month").agg(F.sum("amount").cast(measures.MONEY).alias("amount"))


@query(
    f"SELECT a.company_id, a.fin_month, a.amount, b.amount AS prev, CAST(round(CAST((CAST(a.amount AS DOUBLE)-CAST(b.amount "
    f"AS DOUBLE))/nullif(CAST(b.amount AS DOUBLE),0) AS DECIMAL(28,10)),6) AS DOUBLE) AS mom FROM {_MONTHLY} a LEFT JOIN "
    f"{_MONTHLY} b ON a.company_id=b.company_id AND b.fin_month=a.fin_month - INTERVAL 1 MONTH"
)
def month_over_month(s, d):
    return reports.month_over_month(_monthly(s, d), ["company_id"])


@query(
    f"SELECT c.id AS company_id, p.fin_month, m.amount FROM dim_company c CROSS JOIN (SELECT DISTINCT fin_month FROM {_MONTHLY} "
    f"WHERE fin_month <= DATE '1998-06-01' ORDER BY 1 DESC LIMIT 12) p LEFT JOIN {_MONTHLY} m ON m.company_id=c.id AND m.fin_month=p.fin_month "
    f"WHERE c.level=2"
)
def trend_12(s, d):
    members = view(s, d, "dim_company").filter("level = 2").select(F.col("id").alias("company_id"))
    return reports.trend(_monthly(s, d), ["company_id"], members, MONTH)


@query(
    f"SELECT company_id, fin_month, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*)=1 THEN max(amount) END AS value, string_agg(DISTINCT "
    f"scenario, ',' ORDER BY scenario) AS sources, CASE WHEN count(*)>1 THEN 'conflict' ELSE 'value' END AS status FROM fx_month "
    f"WHERE metric_id='m_revenue' GROUP BY 1,2"
)
def coordinate_lookup(s, d):
    return reports.lookup(view(s, d, "fx_month").filter("metric_id = 'm_revenue'"), ["company_id", "fin_month"], F.col("scenario"))


@query(
    f"SELECT company_id, amount, CAST(round(CAST(abs(CAST(amount AS DOUBLE))/(SELECT max(abs(CAST(amount AS DOUBLE))) FROM "
    f"{_MONTHLY} WHERE fin_month=DATE '1998-06-01') AS DECIMAL(28,10)),6) AS DOUBLE) AS scaled FROM {_MONTHLY} WHERE fin_month=DATE "
    f"'1998-06-01'"
)
def company_comparison(s, d):
    one = _monthly(s, d).filter("fin_month = DATE '1998-06-01'").select("company_id", "amount")
    top = one.agg(F.max(F.abs(F.col("amount").cast("double"))).alias("top"))
    return one.crossJoin(F.broadcast(top)).select("company_id", "amount", F.round((F.abs(F.col("amount").cast("double")) / F.col("top")).cast("decimal(28,10)"), 6).cast("double").alias("scaled"))


@query(
    "SELECT CAST(count(DISTINCT company_id) AS BIGINT) AS companies, CAST(count(*) FILTER (n=1) AS BIGINT) AS cells_with_value, "
    "CAST(count(*) FILTER (n>1) AS BIGINT) AS conflicts FROM (SELECT company_id, fin_month, count(*) AS n FROM fx_month "
    "WHERE metric_id='m_revenue' GROUP BY 1,2)"
)
def dashboard_cards(s, d):
    return coordinate_lookup(s, d).agg(F.countDistinct("company_id").alias("companies"), F.count_if(F.col("status") == "value").alias("cells_with_value"), F.count_if(F.col("status") == "conflict").alias("conflicts"))


@query("SELECT company_id, fin_month, CAST(count(*) AS BIGINT) AS n FROM fx_month WHERE metric_id='m_revenue' GROUP BY 1,2 HAVING count(*)>1")
def overlap_groups(s, d):
    return coordinate_lookup(s, d).filter("n > 1").select("company_id", "fin_month", "n")


@query(
    f"SELECT CAST(o.row_ord AS INTEGER) AS row_ord, o.company_id, t.amount FROM {_ROWS} LEFT JOIN (SELECT company_id, amount "
    f"FROM {_MONTHLY} WHERE fin_month=DATE '1998-06-01') t ON t.company_id=o.company_id"
)
def export_lookup(s, d):
    return reports.ordered(_monthly(s, d).filter("fin_month = DATE '1998-06-01'").select("company_id", "amount"), "company_id", _ORDER)


@query((
    f"SELECT company_id, CASE WHEN abs(v)>=1e8 THEN sign_ || printf('%.1f', abs(v)/1e8) || '亿' WHEN abs(v)>=1e4 THEN sign_ "
    f"|| printf('%.1f', abs(v)/1e4) || '万' WHEN abs(v)>=1e3 THEN sign_ || printf('%.1f', abs(v)/1e3) || '千' ELSE sign_ || "
    f"printf('%.0f', abs(v)) END AS value FROM (SELECT company_id, v, CASE WHEN v<0 THEN '-' ELSE '' END AS sign_ FROM (SELECT "
    f"company_id, CAST(SUM(amount) AS DOUBLE) AS v FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' AND {IS['month']} "
    f"GROUP BY 1))"
).replace("printf(", "format('{:.1f}', ").replace("format('{:.1f}', '%.1f', ", "format('{:.1f}', ").replace("format('{:.1f}', '%.0f', ", "format('{:.0f}', "))
def band(s, d):
    own = facts(s, d).filter(ACTUAL).filter("metric_id = 'm_revenue'").filter(exprs.in_window(CALIBERS["month"]))
    return own.groupBy("company_id").agg(F.sum("amount").alias("v")).select("company_id", exprs.band(F.col("v")).alias("value"))


@query(
    "SELECT 'company' AS kind, id, name FROM dim_company WHERE lower(name) LIKE '%er%' OR lower(group_name) LIKE '%er%' "
    "UNION ALL SELECT 'master', 's_' || s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%er%' OR lower(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'Vendor ' || s_suppkey END, '')) LIKE '%er%' "
    "UNION ALL SELECT * FROM (VALUES ('metric', 'm_revenue', 'Revenue'), ('metric', 'm_cost', 'Cost')) m(kind, id, name) WHERE lower(name) LIKE '%er%' OR id = 'm_cost'"
)
def keyword_filter(s, d):
    """A keyword over companies, masters and their aliases, and metrics and theirs."""
    companies = view(s, d, "dim_company").select(F.lit("company").alias("kind"), "id", "name", F.array("group_name").alias("aliases"))
    suppliers = base(s, d, "supplier").select(
        F.lit("master").alias("kind"), F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.array(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Vendor "), F.col("s_suppkey").cast("string")))).alias("aliases"),
    )
    metrics = s.createDataFrame([("metric", "m_revenue", "Revenue", ["sales"]), ("metric", "m_cost", "Cost", ["expenses", "Other"])], companies.schema)
    return masters.search(companies.unionByName(suppliers).unionByName(metrics), "ER").select("kind", "id", "name")


@query(f"SELECT * FROM (SELECT company_id, fin_month, amount FROM {_MONTHLY}) ORDER BY fin_month, company_id LIMIT 10 OFFSET 20")
def page_rows(s, d):
    return _monthly(s, d).select("company_id", "fin_month", "amount").orderBy("fin_month", "company_id").offset(20).limit(10)


# Landing and reshape.
@query("SELECT file_hash, sheet, CAST(count(*) AS BIGINT) AS cells FROM raw_cell GROUP BY 1,2")
def landing_summary(s, d):
    return ingest.landing_summary(view(s, d, "raw_cell"))


@query("""
WITH l AS (SELECT o_orderkey % 200 AS file, o_orderkey, o_custkey, o_orderstatus, '["' || o_custkey || '","' || o_orderstatus || '"]' AS line FROM orders),
f AS (SELECT file, sha256(string_agg(line, chr(10) ORDER BY o_orderkey)) AS file_hash FROM l GROUP BY 1),
k AS (SELECT file_hash, min(file) AS file FROM f GROUP BY 1)
SELECT k.file_hash, 'orders' AS sheet, CAST(o_orderkey AS BIGINT) AS row_no, CAST(u.k AS INTEGER) AS col_no, CASE u.k WHEN 1 THEN 'number' ELSE 'text' END AS value_kind,
CASE u.k WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS raw_value FROM l JOIN k USING (file) CROSS JOIN (VALUES (1),(2)) u(k)""")
def land_cells(s, d):
    files = base(s, d, "orders").select((F.col("o_orderkey") % 200).alias("file"), "o_orderkey", "o_custkey", "o_orderstatus")
    return landing.landed_sheets(files, "file", "o_orderkey", "orders")


@query("SELECT file_hash, CAST(count(*) AS BIGINT) AS n FROM raw_cell WHERE file_hash NOT IN ('f_1996','f_1997') GROUP BY 1")
def land_idempotent(s, d):
    cells = view(s, d, "raw_cell")
    return ingest.land_idempotent(cells, cells.filter("file_hash IN ('f_1996', 'f_1997')")).groupBy("file_hash").agg(F.count("*").alias("n"))


@query("SELECT user_id AS source_path, arg_max(event_type, (ts, event_type)) AS file_hash FROM events GROUP BY 1")
def latest_source_pointer(s, d):
    seen = base(s, d, "events").select(F.col("user_id").alias("source_path"), F.col("ts").alias("seen_at"), F.col("event_type").alias("file_hash"))
    return ingest.latest_pointer(seen)


@query(
    "SELECT file_hash, sheet, CAST(max(row_no)-min(row_no)+1 AS INTEGER) AS n_rows, CAST(max(col_no)-min(col_no)+1 AS INTEGER) "
    "AS n_cols FROM raw_cell GROUP BY 1,2 HAVING max(row_no)-min(row_no)+1 > 500"
)
def clip_guard(s, d):
    return ingest.clip_guard(view(s, d, "raw_cell"), rows=500)


@query(
    f"SELECT file_hash, row_no, col_no, CASE WHEN value_kind='number' THEN TRY_CAST(raw_value AS {M}) END AS number_value, "
    f"CASE WHEN value_kind='text' THEN raw_value END AS text_value FROM raw_cell"
)
def restore_cells(s, d):
    return ingest.restore_cells(view(s, d, "raw_cell")).select("file_hash", "row_no", "col_no", "number_value", "text_value")


@query("SELECT file_hash, sheet, CAST(count(*) AS BIGINT) AS n, CAST(max(row_no) AS INTEGER) AS last_row FROM raw_cell WHERE col_no=1 AND row_no < 400 GROUP BY 1,2")
def grid_extent(s, d):
    cells = view(s, d, "raw_cell").filter("col_no <> 1 OR row_no <> 400")
    return ingest.extent(cells, 2, [1]).groupBy("file_hash", "sheet").agg(F.count("*").alias("n"), F.max("row_no").alias("last_row"))


_LABELS = {"company": 1, "period": 2, "metric": 3}
_WIDE = (
    "(SELECT file_hash, sheet, row_no, max(CASE WHEN col_no=1 THEN raw_value END) AS company, max(CASE WHEN col_no=2 THEN "
    "raw_value END) AS period, max(CASE WHEN col_no=3 THEN raw_value END) AS metric, max(CASE WHEN col_no=4 THEN raw_value "
    "END) AS v, max(CASE WHEN col_no=4 THEN value_kind END) AS k FROM raw_cell GROUP BY 1,2,3)"
)
_PARSE = "make_date(CAST(regexp_extract(period, '^(\\d{4})/(\\d{1,2})$', 1) AS INTEGER), CAST(regexp_extract(period, '^(\\d{4})/(\\d{1,2})$', 2) AS INTEGER), 1)"


@query(f"SELECT file_hash, sheet, row_no, company, period, metric FROM {_WIDE}")
def label_columns(s, d):
    return ingest.label_columns(view(s, d, "raw_cell"), _LABELS)


def _candidates(s, d, keep):
    return ingest.unpivoted(view(s, d, "raw_cell"), _LABELS, [4], keep).select("file_hash", "row_no", "company", "metric", "fin_month", "amount")


@query(f"SELECT file_hash, row_no, company, metric, {_PARSE} AS fin_month, CASE WHEN k='number' THEN CAST(v AS {M}) END AS amount FROM {_WIDE} WHERE v IS NOT NULL")
def unpivot_values(s, d):
    return _candidates(s, d, False)


@query(f"SELECT file_hash, row_no, company, metric, {_PARSE} AS fin_month, CASE WHEN k='number' THEN CAST(v AS {M}) END AS amount FROM {_WIDE}")
def empty_measure_policy(s, d):
    return _candidates(s, d, True)


@query(f"SELECT file_hash, row_no, {_PARSE} AS fin_month FROM {_WIDE}")
def parse_period(s, d):
    return view(s, d, "raw_cell").filter("col_no = 2").select("file_hash", "row_no", exprs.parse_period(F.col("raw_value")).alias("fin_month"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN n >= 61 THEN DATE '1899-12-30' + n END AS day FROM (SELECT l_orderkey, l_linenumber, "
    "CAST(floor(l_extendedprice / 2) AS INTEGER) AS n FROM lineitem)"
)
def excel_serial_date(s, d):
    return base(s, d, "lineitem").select("l_orderkey", "l_linenumber", exprs.excel_serial_date(F.col("l_extendedprice") / 2).alias("day"))


@query(f"SELECT file_hash, row_no, company FROM {_WIDE} WHERE company NOT IN ('c_1','c_2') AND company NOT LIKE 'c_2%'".replace("NOT LIKE 'c_2%'", "NOT LIKE 'c\\_2%' ESCAPE '\\'"))
def drop_rows(s, d):
    return ingest.drop_rows(ingest.label_columns(view(s, d, "raw_cell"), {"company": 1}), "company", ["c_1", "c_2"], "c_2").select("file_hash", "row_no", "company")


@query(
    "SELECT file_hash, CAST(count(*) AS BIGINT) AS n FROM raw_cell WHERE NOT (row_no BETWEEN 5 AND 20 AND col_no BETWEEN "
    "2 AND 3) AND NOT (row_no BETWEEN 100 AND 120 AND col_no BETWEEN 1 AND 4) GROUP BY 1"
)
def ignore_ranges(s, d):
    boxes = s.createDataFrame([(5, 20, 2, 3), (100, 120, 1, 4)], "r0 int, r1 int, c0 int, c1 int")
    return ingest.ignore_rectangles(view(s, d, "raw_cell"), boxes).groupBy("file_hash").agg(F.count("*").alias("n"))


@query((
    "SELECT l_orderkey, l_linenumber, CAST(round(-CAST(l_extendedprice AS DECIMAL(28,10)) / 10000, 2) AS DECIMAL(18,2)) "
    "AS converted, CAST(l_extendedprice AS DECIMAL(28,10)) / 10000 * 100 <> floor(CAST(l_extendedprice AS DECIMAL(28,10)) "
    "/ 10000 * 100) AS inexact FROM lineitem"
).replace("/ 10000 * 100 <> floor(CAST(l_extendedprice AS DECIMAL(28,10)) / 10000 * 100)", "* 1 <> round(CAST(l_extendedprice AS DECIMAL(28,10)) / 10000, 2) * 10000").replace("-CAST(l_extendedprice AS DECIMAL(28,10)) / 10000, 2)", "-CAST(CAST(l_extendedprice AS DECIMAL(28,10)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(38,14)), 2)").replace("round(CAST(l_extendedprice AS DECIMAL(28,10)) / 10000, 2) * 10000", "round(CAST(CAST(l_extendedprice AS DECIMAL(28,10)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(38,14)), 2) * 10000"))
def unit_convert(s, d):
    value, inexact = exprs.unit_convert(F.col("l_extendedprice"), "元", "万元", 2, negate=True)
    return base(s, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("converted"), inexact.alias("inexact"))


# Quality profile of a batch.
@query(
    f"SELECT file_hash, CAST(4 AS INTEGER) AS col_no, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (v IS NULL) "
    f"AS BIGINT) AS empty, CAST(count(*) FILTER (k<>'number') AS BIGINT) AS non_numeric FROM {_WIDE} GROUP BY 1"
)
def measure_cell_stats(s, d):
    cells = view(s, d, "raw_cell")
    return ingest.measure_stats(cells, ingest.label_columns(cells, _LABELS), [4])


@query(
    f"SELECT file_hash, company, period, CAST(count(*) AS BIGINT) AS n, CAST(min(row_no) AS INTEGER) AS first_row, CAST(max(row_no) "
    f"AS INTEGER) AS last_row FROM {_WIDE} GROUP BY 1,2,3 HAVING count(*)>1"
)
def duplicate_row_keys(s, d):
    return ingest.duplicate_keys(ingest.label_columns(view(s, d, "raw_cell"), _LABELS), ["file_hash", "company", "period"])


@query(
    "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n, min(l_partkey) AS first_row, max(l_partkey) AS last_row "
    "FROM lineitem GROUP BY 1,2 HAVING count(*)>1"
)
def duplicate_coordinates(s, d):
    return ingest.duplicate_keys(base(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query(f"SELECT CAST(count(*) FILTER (v IS NULL OR k<>'number') AS BIGINT) AS incomplete FROM {_WIDE}")
def incomplete_coordinates(s, d):
    return ingest.incomplete(_candidates(s, d, True), ["company", "metric", "fin_month", "amount"])


@query(f"SELECT file_hash, CAST(count(DISTINCT period) AS BIGINT) AS periods, CAST(0 AS BIGINT) AS unparseable FROM {_WIDE} GROUP BY 1")
def period_profile(s, d):
    return ingest.period_profile(_candidates(s, d, True))


@query(f"SELECT file_hash, count(v)=0 AS looks_empty FROM {_WIDE} GROUP BY 1")
def looks_empty(s, d):
    stats = measure_cell_stats(s, d)
    return stats.select("file_hash", (F.col("total") == F.col("empty")).alias("looks_empty"))


@query(
    "SELECT file_hash, row_no, col_no, CASE WHEN formula IS NOT NULL THEN '<formula>' WHEN value_kind='text' THEN raw_value ELSE '<' || value_kind || '>' END AS shown, truncated FROM sheet_cell "
    "JOIN (SELECT file_hash, sheet, max(row_no)>40 OR max(col_no)>4 AS truncated FROM sheet_cell GROUP BY 1,2) USING (file_hash, sheet) WHERE row_no<=40 AND col_no<=4"
)
def masked_view(s, d):
    return ingest.masked(view(s, d, "sheet_cell"), 40, 4).select("file_hash", "row_no", "col_no", "shown", "truncated")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 10000 OR o_orderkey % 10=0")
def numeric_leak_scan(s, d):
    amount = F.format_number("o_totalprice", 2)
    text = F.when(F.col("o_orderkey") % 10 == 0, F.concat(amount, F.lit(" 元"))).otherwise(F.concat(F.lit("total "), amount, F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return ingest.leak_scan(base(s, d, "orders"), text).select("o_orderkey")


@query(
    "SELECT file_hash, sheet, CAST(arg_min(row_no, (-w, row_no)) AS INTEGER) AS row_no, CAST(1 AS INTEGER) AS first_col, "
    "CAST(max(w) AS BIGINT) AS width FROM (SELECT file_hash, sheet, row_no, CASE WHEN max(CASE WHEN col_no=1 THEN raw_value "
    "END)='c_1' THEN 1 ELSE 0 END + 0 AS w FROM raw_cell GROUP BY 1,2,3) WHERE w>0 GROUP BY 1,2"
)
def header_locate(s, d):
    known = s.createDataFrame([("c_1",), ("m_revenue",)], "label string")  # the latter has a period to its left
    return ingest.header_runs(view(s, d, "raw_cell"), known)


# Master data.
_NORM = "lower(regexp_replace(raw, '[ ()_]+', '', 'g'))"


@query(f"SELECT raw, {_NORM} AS norm FROM source_names")
def normalize_name(s, d):
    return view(s, d, "source_names").select("raw", exprs.normalize_name(F.col("raw")).alias("norm"))


@query("SELECT c_custkey, lower(c_name) AS stem FROM customer")
def company_stem(s, d):
    return base(s, d, "customer").select("c_custkey", exprs.company_stem(F.concat("c_name", F.lit("有限公司"))).alias("stem"))


def entity_sql(column: str, prefix: str) -> str:
    codes = f"list_transform(string_split({column}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"'{prefix}' || left(lower(to_base(list_reduce({codes}, lambda a, b: (a * 31 + b) % 4294967296, CAST(0 AS BIGINT)), 36)), 8)"


@query(f"SELECT c_custkey, {entity_sql('c_name', 'c_')} AS entity_id FROM customer")
def entity_id(s, d):
    return base(s, d, "customer").select("c_custkey", exprs.entity_id(F.col("c_name"), "c_").alias("entity_id"))


_RES = (
    f"(SELECT s.raw, s.weight, {_NORM.replace('raw', 's.raw')} AS norm, c.id FROM source_names s LEFT JOIN (SELECT lower(name) "
    f"AS n, min(id) AS id FROM master GROUP BY 1) c ON c.n = {_NORM.replace('raw', 's.raw')})"
)


def _resolved(s, d):
    return masters.resolve_exact(view(s, d, "source_names"), masters.known_names(view(s, d, "master")))


@query(f"SELECT raw, norm, id FROM {_RES}")
def resolve_exact(s, d):
    return _resolved(s, d).select("raw", "norm", "id")


@query(f"SELECT raw, CAST(SUM(weight) AS BIGINT) AS n_rows FROM {_RES} WHERE id IS NULL GROUP BY 1")
def unmatched_names(s, d):
    return masters.unmatched(view(s, d, "source_names"), masters.known_names(view(s, d, "master")))


@query(
    f"SELECT raw, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score "
    f"DESC, id) AS rank FROM (SELECT r.raw, c.id, CASE WHEN contains(c.en, r.norm) OR contains(r.norm, c.en) THEN 0.75::DOUBLE "
    f"WHEN left(r.norm,1)=left(c.en,1) AND 1 - levenshtein(r.norm,c.en)::DOUBLE/greatest(length(r.norm),length(c.en)) >= "
    f"0.6 THEN CAST(round(CAST((1 - levenshtein(r.norm,c.en)::DOUBLE/greatest(length(r.norm),length(c.en)))*0.7 AS DECIMAL(12,8)),6) "
    f"AS DOUBLE) END AS score FROM {_RES} r CROSS JOIN (SELECT id, lower(name) AS en FROM master) c WHERE r.id IS NULL) WHERE "
    f"score IS NOT NULL) WHERE rank<=3"
)
def match_candidates(s, d):
    return masters.candidates(_resolved(s, d).filter("id IS NULL").select("raw"), view(s, d, "master"))


@query(f"SELECT raw, CAST(count(*) AS BIGINT) AS n, arg_min(id, rank) AS best FROM ({ORACLES['match_candidates']}) GROUP BY 1")
def top3_candidates(s, d):
    return match_candidates(s, d).groupBy("raw").agg(F.count("*").alias("n"), F.min_by("id", "rank").alias("best"))


@query(
    f"SELECT raw, CASE WHEN raw='Supplier#000000003S' THEN 's_6' ELSE id END AS final_id, CASE WHEN raw='Supplier#000000003S' "
    f"THEN 'merge' WHEN id IS NOT NULL THEN 'matched' ELSE 'pending' END AS status FROM {_RES}"
)
def apply_decisions(s, d):
    decisions = s.createDataFrame([("Supplier#000000003S", "merge", "s_6")], "raw string, action string, target string")
    return masters.apply_decisions(_resolved(s, d), decisions)


@query(
    "SELECT 'company' AS kind, lower(s_name) AS normalized, 'n_' || s_nationkey AS target, CAST(2 AS INTEGER) AS registered_at, "
    "'s_' || s_suppkey AS previous FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'company', lower(s_name), 's_' "
    "|| s_suppkey, 1, NULL FROM supplier WHERE s_suppkey % 2 = 1"
)
def alias_upsert(s, d):
    n = base(s, d, "supplier")
    row = lambda df, t, at: df.select(F.lit("company").alias("kind"), exprs.normalize_name(F.col("s_name")).alias("normalized"), t.alias("target"), F.lit(at).alias("registered_at"))
    old = row(n, F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")), 1)
    new = row(n.filter("s_suppkey % 2 = 0"), F.concat(F.lit("n_"), F.col("s_nationkey").cast("string")), 2)
    return masters.alias_upsert(old, new)


# Load.
@query(
    f"SELECT fin_month, caliber, CASE WHEN caliber='prior_ytd' THEN CAST(fin_month - INTERVAL 1 YEAR AS DATE) WHEN caliber='yoy' "
    f"THEN NULL ELSE fin_month END AS landed, CASE caliber WHEN 'month' THEN fin_month WHEN 'ytd' THEN CAST(date_trunc('year',fin_month) "
    f"AS DATE) WHEN 'prior_ytd' THEN CAST(date_trunc('year',fin_month - INTERVAL 1 YEAR) AS DATE) WHEN 'since' THEN DATE "
    f"'1995-01-01' END AS period_from FROM (SELECT DISTINCT fin_month FROM fx_month) CROSS JOIN (VALUES ('month'),('ytd'),('prior_ytd'),('since'),('yoy')) "
    f"c(caliber)"
)
def assign_window(s, d):
    months = view(s, d, "fx_month").select("fin_month").distinct().withColumn("caliber", F.explode(F.array(*[F.lit(c) for c in CALIBERS])))
    return loading.assign_window(months).select("fin_month", "caliber", "landed", "period_from")


@query("SELECT event_type AS caliber, CAST(count(*) AS BIGINT) AS n, 'CALIBER_NOT_DECLARED' AS reason FROM events GROUP BY 1")
def caliber_admission(s, d):
    return loading.refused_calibers(base(s, d, "events").withColumnRenamed("event_type", "caliber"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(min(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS amount, min(CAST(l_extendedprice "
    "AS DECIMAL(12,2))) <> max(CAST(l_extendedprice AS DECIMAL(12,2))) AS conflict, CAST(count(*) AS BIGINT) AS n FROM lineitem "
    "GROUP BY 1,2"
)
def merge_same_coordinate(s, d):
    return loading.merged(base(s, d, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(12,2)")), ["l_orderkey", "l_linenumber"])


@query("SELECT batch_id, CAST(count(*) AS BIGINT) AS n FROM batch WHERE year(fin_month)=1998 GROUP BY 1")
def collision_check(s, d):
    stored = facts(s, d).filter("year(fin_month) >= 1998")
    return loading.collisions(view(s, d, "batch"), stored).groupBy("batch_id").agg(F.count("*").alias("n"))


@query(
    "SELECT fin_month, period_from, company_id, metric_id, scenario, ccy, CAST(CASE WHEN year(fin_month) IN (1997,1998) "
    "AND month(fin_month)=3 THEN amount+1 ELSE amount END AS DECIMAL(18,2)) AS amount FROM fact_finance"
)
def upsert_replace(s, d):
    return loading.upserted(facts(s, d), view(s, d, "batch"))


@query("SELECT batch_id, CAST(count(*) AS BIGINT) AS n FROM batch GROUP BY 1")
def count_per_batch(s, d):
    return view(s, d, "batch").groupBy("batch_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT fin_month FROM batch WHERE year(fin_month)=1998")
def period_upsert(s, d):
    known = facts(s, d).filter("year(fin_month) < 1998").select("fin_month").distinct()
    return loading.missing_periods(view(s, d, "batch"), known)


# Versions and profiles.
@query(
    "SELECT f.fin_month, f.period_from, f.company_id, f.metric_id, f.scenario, f.ccy, f.amount, h.group_name FROM fact_finance "
    "f JOIN dim_company_hist h ON f.company_id=h.id AND f.fin_month>=h.valid_from AND (h.valid_to IS NULL OR f.fin_month<h.valid_to)"
)
def dim_as_of_join(s, d):
    return history.as_of_join(facts(s, d), view(s, d, "dim_company_hist"), "company_id", "fin_month", ["group_name"])


@query(
    "SELECT id, valid_from, valid_to, is_current, name, group_name FROM dim_company_hist WHERE valid_from<=DATE '1997-12-31' "
    "AND (valid_to IS NULL OR DATE '1997-12-31'<valid_to)"
)
def dim_as_of_point(s, d):
    return history.as_of_point(view(s, d, "dim_company_hist"), "1997-12-31")


@query("SELECT id, valid_from, valid_to, group_name FROM dim_company_hist WHERE id='c_4'")
def history_sorted(s, d):
    return view(s, d, "dim_company_hist").filter("id = 'c_4'").select("id", "valid_from", "valid_to", "group_name").orderBy("valid_from")


@query("SELECT id, CAST(count(*) AS BIGINT) AS versions FROM dim_company_hist GROUP BY 1")
def scd2_version_count(s, d):
    return view(s, d, "dim_company_hist").groupBy("id").agg(F.count("*").alias("versions"))


@query("SELECT id, DATE '1995-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, TRUE AS is_current, name, group_name FROM dim_company WHERE level=1")
def scd2_first_version(s, d):
    return history.first_versions(view(s, d, "dim_company"), view(s, d, "dim_company_hist"), "1995-01-01", ["name", "group_name"])


@query(
    "SELECT id, valid_from, CASE WHEN is_current AND id IN ('c_1','c_2') THEN DATE '2000-01-01' ELSE valid_to END AS valid_to, "
    "is_current AND id NOT IN ('c_1','c_2') AS is_current, name, group_name FROM dim_company_hist UNION ALL SELECT id, DATE "
    "'2000-01-01', NULL, TRUE, name, 'MOVED' FROM dim_company WHERE id IN ('c_1','c_2')"
)
def scd2_apply(s, d):
    changes = view(s, d, "dim_company").filter("id IN ('c_1', 'c_2')").select("id", "name", F.lit("MOVED").alias("group_name"))
    return history.apply_changes(view(s, d, "dim_company_hist"), changes, ["name", "group_name"], "2000-01-01")


@query(
    "SELECT 'no open version' AS problem, id FROM dim_company WHERE level=1 UNION ALL SELECT 'differs from open version', "
    "c.id FROM dim_company c WHERE level=2 AND CAST(substring(id,3) AS INT) % 2=0"
)
def scd2_problems(s, d):
    return history.problems(view(s, d, "dim_company"), view(s, d, "dim_company_hist"), ["name", "group_name"])


_PROFILED = ("customer", "events", "lineitem", "orders", "part", "supplier")
_NAMES_OF = "(SELECT sha256(string_agg(column_name, ',' ORDER BY column_name)) FROM information_schema.columns WHERE table_name='{0}')"


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, {_NAMES_OF.format(t)} AS columns_sha256 FROM {t}" for t in _PROFILED))
def table_profile(s, d):
    return landing.table_profile({n: base(s, d, n) for n in _PROFILED})


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
