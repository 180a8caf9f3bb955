"""Metric queries: conditional aggregates over one scan of a fact table, with guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.exprs import band, in_window
from marlstone.model import CALIBERS, DEFAULTS, DIMENSIONS, FACTS, FINANCE, Fact, Metric, Refused

MONEY = "decimal(18,2)"
AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}
LIMITS = {"human": 5000, "agent": 200}


@dataclass(frozen=True)
class Measure:
    metric: str
    caliber: str | None = "month"
    agg: str = "sum"
    name: str = "value"


def _dimension(name: str, years: int) -> Column:
    month = F.add_months("fin_month", -12 * years) if years else F.col("fin_month")
    if name == "month":
        return F.date_format(month, "yyyy-MM").alias("month")
    if name == "year":
        return F.date_format(month, "yyyy").alias("year")
    return F.col(name)


def declared_fact(name: str | None, declared: dict[str, Fact] | None) -> Fact:
    """The declaration of a fact table; without a name that of the usual one."""
    known = declared or {}
    if name and name not in known:
        raise Refused("FACT_UNKNOWN", name)
    if (name or FINANCE.name) not in known:
        raise Refused("FACT_NOT_DECLARED", name or FINANCE.name)
    return known[name or FINANCE.name]


def _caliber_fits(m: Measure, fact: Fact) -> None:
    if not m.metric:
        raise Refused("BAD_MEASURE", "a measure needs a metric")
    if not fact.calibers and m.caliber:
        raise Refused("PERIOD_TYPE_NOT_ON_FACT", fact.name)
    if fact.calibers and not m.caliber:
        raise Refused("BAD_MEASURE", f"{m.metric} needs a caliber")
    if m.caliber and (m.caliber not in fact.calibers or m.caliber not in CALIBERS):
        raise Refused("UNKNOWN_PERIOD_TYPE", m.caliber)
    if m.caliber and CALIBERS[m.caliber].kind == "calculator":
        raise Refused("CALIBER_IS_CALCULATOR", m.caliber)
    if m.caliber and not fact.window:
        raise Refused("CALIBER_UNRESOLVABLE", m.caliber)


def _check(measures: list[Measure], group_by: tuple[str, ...], filters: dict, metrics: dict[str, Metric], fact: Fact, to_ccy: str | None) -> int:
    if not measures:
        raise Refused("EMPTY_MEASURES")
    for name, values in filters.items():
        if name not in DIMENSIONS:
            raise Refused("UNKNOWN_FILTER", name)
        if isinstance(values, (list, tuple)) and not values:
            raise Refused("EMPTY_FILTER", name)
    if bad := [g for g in group_by if g not in DIMENSIONS]:
        raise Refused("PERIOD_TYPE_NOT_GROUPABLE" if bad[0] == "period_type" else "UNKNOWN_DIMENSION", bad[0])
    if missing := [n for n in (*group_by, *filters) if n not in fact.dimensions]:
        raise Refused("DIM_NOT_ON_FACT", missing[0])
    if to_ccy is not None and "ccy" not in fact.dimensions:
        raise Refused("CCY_NOT_ON_FACT", fact.name)
    for m in measures:
        if m.agg not in AGGREGATES:
            raise Refused("BAD_AGG", m.agg)
        _caliber_fits(m, fact)
        derived = metrics.get(m.metric, Metric(m.metric)).formula is not None
        if derived and ("metric_id" in group_by or "metric_id" in filters):
            raise Refused("DERIVED_METRIC_FILTER", m.metric)
        if derived and m.agg != "sum":
            raise Refused("BAD_AGG", "a derived metric is summed before its formula")
    years = {CALIBERS[m.caliber].years if m.caliber else 0 for m in measures}
    if len(years) > 1:
        raise Refused("CALIBER_SHIFT_CONFLICT")
    one_month = "month" in group_by or (isinstance(filters.get("month"), str)) or (isinstance(filters.get("month"), (list, tuple)) and len(filters["month"]) == 1)
    if any(m.caliber and CALIBERS[m.caliber].cumulative for m in measures) and not one_month:
        raise Refused("CUMULATIVE_TIME_UNPINNED")
    return years.pop()


def measure_query(
    facts: DataFrame, measures: list[Measure], group_by: tuple[str, ...] = (), filters: dict | None = None, metrics: dict[str, Metric] | None = None,
    rates: DataFrame | None = None, to_ccy: str | None = None, audience: str | None = None, limit: int | None = None, support: bool = False, over: tuple[str, ...] = (),
    fact: str | None = None, declared: dict[str, Fact] | None = FACTS,
) -> DataFrame:
    """Group keys and one column a measure, of the rows ``facts`` of a declared fact table.

    Without an audience the result is whole, as a step of a larger plan needs it. For one (human: 5000 groups, agent: 200), or with a
    limit, a column truncated tells whether groups were left out.

    over: dimensions that may be summed across although they have a default or
    need one member. With rates and to_ccy amounts are converted at their own
    month before aggregation; one missing or doubtful rate refuses the query.
    """
    metrics, filters = metrics or {}, {**(filters or {})}
    table = declared_fact(fact, declared)
    years = _check(measures, group_by, filters, metrics, table, to_ccy)
    for name, member in DEFAULTS.items():
        if name in table.dimensions and name not in group_by and name not in over:
            filters.setdefault(name, member)
    if "ccy" in table.dimensions and "ccy" not in group_by and "ccy" not in over and to_ccy is None and not isinstance(filters.get("ccy"), str):
        raise Refused("DIM_MIXED_AGGREGATION", "ccy")
    df = facts
    for name, values in filters.items():
        values = list(values) if isinstance(values, (list, tuple)) else [values]
        if name == "month":  # on the stored period, so that partitions prune
            df = df.filter(F.col("fin_month").isin([F.add_months(F.lit(f"{v}-01").cast("date"), 12 * years) for v in values]))
        elif name == "year":
            df = df.filter(F.year("fin_month").isin([int(v) + years for v in values]))
        else:
            df = df.filter(F.col(name).isin(values))
    needed = {i for m in measures for i in _inputs(m.metric, metrics)}
    df = df.filter(F.col("metric_id").isin(sorted(needed)))
    amount = F.col("amount")
    if to_ccy is not None:
        df = converted(df, rates, to_ccy)
        amount = F.col("converted")
    aggs: list[Column] = []
    for m in measures:
        for metric in _inputs(m.metric, metrics):
            window = in_window(CALIBERS[m.caliber]) if m.caliber else F.lit(True)
            value = F.when((F.col("metric_id") == metric) & window, amount)
            aggs.append(AGGREGATES[m.agg](value).alias(f"_{m.name}_{metric}"))
            aggs.append(F.count(value).alias(f"_{m.name}_{metric}_n"))
    keys = [_dimension(g, years) for g in group_by]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    columns = []
    for m in measures:
        columns.append(_value(m, metrics, out).alias(m.name))
        ns = [F.col(f"_{m.name}_{i}_n") for i in _inputs(m.metric, metrics)]
        columns.append((F.least(*ns) if len(ns) > 1 else ns[0]).alias(f"{m.name}_support"))
    out = out.select(*group_by, *columns)
    most = LIMITS[audience or "human"]
    cap = min(limit or most, most)
    if group_by and (limit is not None or audience):
        out = out.orderBy(*group_by).limit(cap + 1)  # one group more than is shown tells whether there are more
    if audience == "agent":
        out = guarded(out, [m.name for m in measures], cap)
    elif group_by and (limit is not None or audience):
        place = F.row_number().over(Window.orderBy(*group_by))  # over no more than those
        out = out.withColumns({"place": place, "truncated": F.count("*").over(Window.partitionBy()) > cap}).filter(F.col("place") <= cap).drop("place")
    return out if support else out.drop(*[f"{m.name}_support" for m in measures])


def _inputs(metric: str, metrics: dict[str, Metric]) -> list[str]:
    d = metrics.get(metric)
    return [metric] if d is None or d.formula is None else sorted({b for i in d.inputs for b in _inputs(i, metrics)})


def _formula(metric: str, m: Measure, metrics: dict[str, Metric]) -> Column:
    d = metrics.get(metric)
    if d is None or d.formula is None:
        return F.col(f"_{m.name}_{metric}").cast("double")
    return d.formula(*[_formula(i, m, metrics) for i in d.inputs])


def _value(m: Measure, metrics: dict[str, Metric], out: DataFrame) -> Column:
    d = metrics.get(m.metric)
    if d is not None and d.formula is not None:
        return F.round(_formula(m.metric, m, metrics).cast("decimal(28,10)"), 6).cast("double")
    c = F.col(f"_{m.name}_{m.metric}")
    return c.cast("long") if m.agg == "count" else F.round(c.cast("decimal(28,6)"), 2).cast(MONEY)


def rate_quality(rates: DataFrame) -> DataFrame:
    """One row per month and currency, so a repeated rate can't multiply facts; sound: exactly one positive rate."""
    return rates.groupBy("rate_month", "ccy").agg(F.min("rate").alias("rate"), F.count("*").alias("n")).withColumn("sound", (F.col("n") == 1) & (F.col("rate") > 0))


def converted(facts: DataFrame, rates: DataFrame, to_ccy: str) -> DataFrame:
    """facts with converted: amount at the rate of its own currency over that of to_ccy, both at the fact's month. Refuses if a rate is missing."""
    good = rate_quality(rates)
    source = good.select(F.col("rate_month").alias("fin_month"), "ccy", F.col("rate").alias("from_rate"), F.col("sound").alias("from_sound"))
    target = good.filter(F.col("ccy") == to_ccy).select(F.col("rate_month").alias("fin_month"), F.col("rate").alias("to_rate"), F.col("sound").alias("to_sound"))
    rates_of = source.join(target, "fin_month", "left")  # a row for each month and currency
    # What a rate is needed for is few pairs, so the check reads two columns and joins nothing large.
    needed = facts.filter("amount IS NOT NULL").select("fin_month", "ccy").distinct().join(rates_of, ["fin_month", "ccy"], "left")
    if not needed.filter(~F.coalesce(F.col("from_sound") & F.col("to_sound"), F.lit(False))).isEmpty():
        raise Refused("FX_RATE_MISSING", to_ccy)
    joined = facts.join(rates_of, ["fin_month", "ccy"], "left")
    # Multiplied first, and rounded once: a ratio of rates of its own would lose the digits of a small rate.
    exact = F.col("amount").cast("double") * F.col("from_rate").cast("double") / F.col("to_rate").cast("double")
    return joined.withColumn("converted", F.round(exact.cast("decimal(32,10)"), 6).cast("decimal(28,6)"))


def guarded(out: DataFrame, names: list[str], cap: int, least: int = 3) -> DataFrame:
    """Bands instead of values, and truncated; refuses cells with too few supporting rows. The result is run once: it has cap + 1 rows at most."""
    rows = out.limit(cap + 1).collect()
    if any(r[n] is not None and r[f"{n}_support"] < least for r in rows for n in names):
        raise Refused("TOO_FINE_GRAINED")
    shown = out.sparkSession.createDataFrame(rows[:cap], out.schema)
    return shown.withColumns({n: band(F.col(n)) for n in names} | {"truncated": F.lit(len(rows) > cap)})


def year_over_year(
    facts: DataFrame, metric: str, group_by: tuple[str, ...] = ("company_id", "month"), since: str | None = None, strict: bool = True, **options
) -> DataFrame:
    """(a - b) / b of each month, from ``since`` on, and the same month a year before. A zero base gives null.

    A group without the earlier leg refuses all; where not strict, it is listed without prev and yoy.
    """
    current, before = _yearly(facts, metric, group_by, since, **options)
    return legs(current, before, list(group_by), strict)


def missing_legs(facts: DataFrame, metric: str, group_by: tuple[str, ...] = ("company_id", "month"), since: str | None = None, **options) -> DataFrame:
    """The groups that refuse year_over_year."""
    current, before = _yearly(facts, metric, group_by, since, **options)
    return current.join(before, list(group_by), "left_anti").select(*group_by)


def _yearly(facts: DataFrame, metric: str, group_by: tuple[str, ...], since: str | None, **options) -> tuple[DataFrame, DataFrame]:
    leg = Measure(metric, name="cur")
    _caliber_fits(leg, declared_fact(options.get("fact"), options.get("declared", FACTS)))
    rows = facts.filter(in_window(CALIBERS[leg.caliber]))  # a group is there if it has rows, be their amounts null or not
    every = measure_query(rows, [leg], group_by, **options)
    before = every.withColumnRenamed("cur", "prev").withColumn("month", F.date_format(F.add_months(F.concat("month", F.lit("-01")).cast("date"), 12), "yyyy-MM"))
    return every if since is None else every.filter(F.col("month") >= since), before


def legs(current: DataFrame, before: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    joined = current.join(before, keys, "left")
    if strict and (lost := current.join(before, keys, "left_anti").limit(1).collect()):
        raise Refused("CALIBER_OPERAND_MISSING", ", ".join(str(lost[0][k]) for k in keys))
    cur, prev = F.col("cur").cast("double"), F.col("prev").cast("double")
    return joined.withColumn("yoy", F.round(F.try_divide(cur - prev, F.nullif(prev, F.lit(0.0))).cast("decimal(28,10)"), 6).cast("double"))


def aggregated(facts: DataFrame, grain: tuple[str, ...], fact: Fact = FINANCE, period: str = "fin_month") -> DataFrame:
    """A stored aggregate of a fact table over a grain. Periods, scenarios, currencies and windows can't be summed away."""
    lost = [c for c in (period, *(d for d in ("scenario", "ccy") if d in fact.dimensions), *([fact.window] if fact.window else [])) if c not in grain]
    if lost:
        raise Refused("MODEL_AGG_NONADDABLE", ", ".join(lost))
    return facts.groupBy(*grain).agg(F.sum("amount").cast(MONEY).alias("amount"))


def not_conserved(shares: DataFrame, member: str) -> DataFrame:
    """Members whose weights don't add up to one, with what they add up to."""
    return shares.groupBy(member).agg(F.sum("weight").cast("decimal(10,4)").alias("total")).filter("total <> 1")


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


GROSS = {
    "m_profit": Metric("m_profit", ("m_revenue", "m_cost"), lambda r, c: r - c),
    "m_margin": Metric("m_margin", ("m_profit", "m_revenue"), lambda p, r: F.try_divide(p, F.nullif(r, F.lit(0.0))), unit="%"),
}
