"""Registered queries of pins, axes, report rows and charts, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import exprs
from marlstone.model import CALIBERS
from marlstone.operators import measures, reports
from marlstone.operators.measures import Measure, measure_query
from marlstone.plans.fixtures import view
from marlstone.queries import _MONTHLY, _ORDER, _PIN, _SUMS, ACTUAL, IS, MONTH, M, _monthly, base, facts, query

_RATIO = "CAST(round(CAST({} AS DECIMAL(28,10)),6) AS DOUBLE)"


@query(
    f"SELECT strftime(fin_month,'%Y-%m') AS month, CAST(SUM(CASE WHEN {IS['month']} THEN amount END) AS {M}) AS value FROM "
    f"fact_finance WHERE scenario='actual' AND ccy='CNY' AND metric_id='m_revenue' GROUP BY 1"
)
def default_members(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue")], ("month",), {"ccy": "CNY"})


def _pinned(s, d, by):
    sums = [F.sum(F.when(reports.pinned(c, MONTH), F.col("amount"))).cast(measures.MONEY).alias(c) for c in _PIN]
    return facts(s, d).groupBy(*by).agg(*sums)  # members without a value in these months are shown too, so every month is read


@query(f"SELECT scenario, metric_id, {_SUMS} FROM fact_finance GROUP BY 1,2")
def as_of_pin(s, d):
    return _pinned(s, d, ["scenario", "metric_id"])


@query(f"SELECT business_line, CAST(SUM(amount) AS {M}) AS value FROM fact_line WHERE year(fin_month)=1998 AND month(fin_month)=6 GROUP BY 1")
def period_dim_pin(s, d):
    periods = view(s, d, "fx_month").select("fin_month").distinct().filter("year(fin_month) = 1998 AND month(fin_month) = 6")
    return view(s, d, "fact_line").join(F.broadcast(periods), "fin_month").groupBy("business_line").agg(F.sum("amount").cast(measures.MONEY).alias("value"))


@query(
    f"SELECT company_id, CAST(SUM(CASE WHEN {IS['month']} THEN amount END) AS {M}) AS value FROM fact_finance WHERE {ACTUAL} "
    f"AND metric_id='m_cost' AND company_id IN ('c_3','c_1','c_99','c_2','c_7') GROUP BY 1"
)
def axis_members(s, d):
    return measure_query(facts(s, d), [Measure("m_cost")], ("company_id",), {"company_id": _ORDER}, over=("ccy",))


@query(
    f"SELECT CAST(row_ord AS INTEGER) AS row_ord, o.company_id, t.actual, t.budget FROM (VALUES (0,'c_3'),(1,'c_1'),(2,'c_99'),(3,'c_2'),(4,'c_7')) "
    f"o(row_ord, company_id) LEFT JOIN (SELECT company_id, CAST(SUM(CASE WHEN scenario='actual' THEN amount END) AS {M}) "
    f"AS actual, CAST(SUM(CASE WHEN scenario='budget' THEN amount END) AS {M}) AS budget FROM fact_finance WHERE metric_id='m_cost' "
    f"AND {_PIN['ytd']} GROUP BY 1) t ON t.company_id=o.company_id"
)
def matrix_order(s, d):
    return reports.ordered(reports.pivot(facts(s, d), "company_id", "scenario", ["actual", "budget"], "ytd", MONTH, metric_id="m_cost"), "company_id", _ORDER)


@query(f"SELECT business_line, strftime(fin_month,'%Y') AS year, CAST(SUM(amount) AS {M}) AS value FROM fact_line GROUP BY 1,2")
def group_by_business_line(s, d):
    return view(s, d, "fact_line").groupBy("business_line", F.date_format("fin_month", "yyyy").alias("year")).agg(F.sum("amount").cast(measures.MONEY).alias("value"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS cells, CAST(count(CASE WHEN l_tax <> 0 THEN 1 END) AS BIGINT) AS shown FROM lineitem GROUP BY 1")
def finite_cells(s, d):
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_extendedprice", "l_tax"))
    return base(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("cells"), F.count(measures.finite(ratio)).alias("shown"))


@query(
    f"SELECT ccy, CASE WHEN v>=1e8 THEN format('{{:.1f}}', v/1e8) || '亿' WHEN v>=1e4 THEN format('{{:.1f}}', v/1e4) || '万' "
    f"WHEN v>=1e3 THEN format('{{:.1f}}', v/1e3) || '千' ELSE format('{{:.0f}}', v) END AS value, FALSE AS truncated FROM "
    f"(SELECT ccy, CAST(SUM(amount) AS DOUBLE) AS v FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' AND {IS['month']} "
    f"GROUP BY 1)"
)
def min_support_guard(s, d):
    return measure_query(facts(s, d), [Measure("m_revenue")], ("ccy",), audience="agent")


@query(
    f"SELECT coalesce(company_id, 'total') AS company_id, CAST(SUM(amount) AS {M}) AS value FROM fact_finance WHERE {ACTUAL} "
    f"AND metric_id='m_revenue' AND {IS['month']} GROUP BY ROLLUP(company_id)"
)
def company_total_vs_children(s, d):
    own = facts(s, d).filter(ACTUAL).filter("metric_id = 'm_revenue'").filter(exprs.in_window(CALIBERS["month"]))
    return own.rollup("company_id").agg(F.sum("amount").cast(measures.MONEY).alias("value")).withColumn("company_id", F.coalesce("company_id", F.lit("total")))


_BASES = f"(SELECT metric_id, {_SUMS} FROM fact_finance WHERE {ACTUAL} GROUP BY 1)"


@query(
    f"SELECT metric_id, month, ytd, prior_ytd FROM {_BASES} UNION ALL SELECT 'm_profit', CAST(r.month-c.month AS {M}), CAST(r.ytd-c.ytd "
    f"AS {M}), CAST(r.prior_ytd-c.prior_ytd AS {M}) FROM {_BASES} r, {_BASES} c WHERE r.metric_id='m_revenue' AND c.metric_id='m_cost'"
)
def derived_rows_union(s, d):
    pick = lambda metric, c: F.sum(F.when((F.col("metric_id") == metric) & reports.pinned(c, MONTH), F.col("amount"))).alias(f"{metric}_{c}")
    one = facts(s, d).filter(ACTUAL).agg(*[pick(m, c) for m in ("m_revenue", "m_cost") for c in _PIN])
    row = lambda name, value: F.struct(F.lit(name).alias("metric_id"), *[value(c).cast(measures.MONEY).alias(c) for c in _PIN])
    rows = [row(m, lambda c, m=m: F.col(f"{m}_{c}")) for m in ("m_revenue", "m_cost")] + [row("m_profit", lambda c: F.col(f"m_revenue_{c}") - F.col(f"m_cost_{c}"))]
    return one.select(F.inline(F.array(*rows)))


@query(
    f"SELECT company_id, {_RATIO.format('(CAST(ytd AS DOUBLE)-CAST(prior_ytd AS DOUBLE))/nullif(CAST(prior_ytd AS DOUBLE),0)')} "
    f"AS growth FROM (SELECT company_id, {_SUMS} FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' GROUP BY 1)"
)
def report_expr(s, d):
    rows = _pinned(s, d, ["company_id", "scenario", "metric_id"]).filter(ACTUAL).filter("metric_id = 'm_revenue'")
    now, before = F.col("ytd").cast("double"), F.col("prior_ytd").cast("double")
    return rows.select("company_id", F.round(F.try_divide(now - before, F.nullif(before, F.lit(0.0))).cast("decimal(28,10)"), 6).cast("double").alias("growth"))


@query(
    f"SELECT coalesce(nullif(concat_ws(' / ', company_id, ccy), ''), 'total') AS label, CAST(SUM(amount) AS {M}) AS value "
    f"FROM fact_finance WHERE {ACTUAL} AND metric_id='m_revenue' AND {IS['month']} GROUP BY ROLLUP(company_id, ccy)"
)
def metrics_to_chart(s, d):
    own = facts(s, d).filter(ACTUAL).filter("metric_id = 'm_revenue'").filter(exprs.in_window(CALIBERS["month"]))
    sums = own.rollup("company_id", "ccy").agg(F.sum("amount").cast(measures.MONEY).alias("value"))
    return sums.select(F.coalesce(F.nullif(F.concat_ws(" / ", "company_id", "ccy"), F.lit("")), F.lit("total")).alias("label"), "value")


@query(
    f"SELECT CAST(n AS INTEGER) AS months_ago, m.company_id, m.amount FROM (SELECT unnest(range(0, 13)) AS n) JOIN {_MONTHLY} "
    f"m ON m.fin_month = CAST(DATE '{MONTH}-01' - to_months(CAST(n AS INTEGER)) AS DATE)"
)
def relative_period(s, d):
    day = F.lit(f"{MONTH}-17").cast("date")
    periods = s.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(12))).alias("months_ago")).withColumn("fin_month", F.add_months(F.trunc(day, "MM"), -F.col("months_ago")))
    return _monthly(s, d).join(F.broadcast(periods), "fin_month").select("months_ago", "company_id", "amount")


@query(f"SELECT company_id, fin_month, CASE WHEN company_id='c_1' AND fin_month=DATE '1997-02-01' THEN CAST(1 AS {M}) ELSE amount END AS amount FROM {_MONTHLY}")
def cell_exceptions(s, d):
    changes = s.sql(f"SELECT 'c_1' AS company_id, DATE '1997-02-01' AS fin_month, CAST(1 AS {M}) AS changed")
    return _monthly(s, d).join(F.broadcast(changes), ["company_id", "fin_month"], "left").select("company_id", "fin_month", F.coalesce("changed", "amount").alias("amount"))
