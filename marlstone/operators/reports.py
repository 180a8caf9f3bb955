"""Report blocks: matrices in declared order, cell patches, chart series and dashboard views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.exprs import in_window
from marlstone.model import CALIBERS, Metric, Refused

MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Block:
    """What a report block declares: the dimensions of its axes with their members, what is held fixed, one metric for all values, and
    the columns that its expressions name."""

    rows: str
    cols: str
    col_order: tuple[str, ...] = ()
    filters: dict[str, object] = field(default_factory=dict)
    metric: str | None = None
    caliber: str | None = None
    expr_refs: tuple[str, ...] = ()


def lint(block: Block) -> list[tuple[str, str]]:
    """(code, detail) of all that keeps a block from one well-defined answer."""
    found = []
    if block.metric is not None and (not block.metric.strip() or block.rows != "company_id" or block.cols != "caliber" or "metric_id" in block.filters):
        found.append(("VALUE_BINDING_BAD", "one metric for all values needs companies by calibers"))
    if block.rows == "caliber":
        found.append(("CALIBER_AXIS_COLS_ONLY", "a caliber is no column of a row"))
    one = block.filters.get("metric_id")
    if "metric_id" not in (block.rows, block.cols) and not block.metric and not (isinstance(one, str) and one):
        found.append(("UNCONSTRAINED_DIM", "metric"))
    if "caliber" not in (block.rows, block.cols) and not block.caliber:
        found.append(("UNCONSTRAINED_DIM", "caliber"))
    if unknown := [r for r in block.expr_refs if r not in block.col_order]:
        found.append(("EXPR_REFS", ", ".join(unknown)))
    return found


def accepted(block: Block) -> Block:
    """The block, if nothing is found against it."""
    if found := lint(block):
        raise Refused(*found[0])
    return block


def _stored_month(caliber: str, month: str) -> Column:
    return F.add_months(F.lit(f"{month}-01").cast("date"), 12 * CALIBERS[caliber].years)


def pinned(caliber: str, month: str) -> Column:
    """The window of a caliber at a report month; the caliber's own shift moves the pin, column by column."""
    return in_window(CALIBERS[caliber]) & (F.col("fin_month") == _stored_month(caliber, month))


def months_of(calibers: list[str], month: str) -> Column:
    """The stored months that a report of these calibers reads: other partitions are not touched."""
    return F.col("fin_month").isin([_stored_month(c, month) for c in calibers])


def ordered(result: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each declared label, in its place; labels without data have nulls."""
    if len(set(order)) != len(order):
        raise Refused("ORDER_DUPLICATE")
    spark = result.sparkSession
    rows = spark.createDataFrame(list(enumerate(order)), f"row_ord int, {key} string")
    return rows.join(result, key, "left").select("row_ord", *result.columns).orderBy("row_ord")


def by_caliber(facts: DataFrame, row: str, order: list[str], calibers: list[str], month: str, **pins: str) -> DataFrame:
    """Rows of one dimension, a column for each caliber. pins: dimensions held at one member. A block that lint speaks against is refused."""
    accepted(Block(row, "caliber", tuple(calibers), dict(pins)))
    df = facts.filter(F.col(row).isin(order) & months_of(calibers, month))
    for name, member in pins.items():
        df = df.filter(F.col(name) == member)
    out = df.groupBy(row).agg(*[F.sum(F.when(pinned(c, month), F.col("amount"))).cast(MONEY).alias(c) for c in calibers])
    return ordered(out, row, order)


def by_metric(facts: DataFrame, row: str, order: list[str], metrics: list[str | Metric], caliber: str, month: str, **pins: str) -> DataFrame:
    """Rows of one dimension, a column for each metric; derived metrics are computed from the sums. One scan. A block that lint speaks against is refused."""
    accepted(Block(row, "metric_id", tuple(m if isinstance(m, str) else m.id for m in metrics), dict(pins), caliber=caliber))
    base = sorted({i for m in metrics for i in ((m,) if isinstance(m, str) else m.inputs)})
    df = facts.filter(F.col(row).isin(order) & F.col("metric_id").isin(base) & pinned(caliber, month))
    for name, member in pins.items():
        df = df.filter(F.col(name) == member)
    sums = df.groupBy(row).agg(*[F.sum(F.when(F.col("metric_id") == b, F.col("amount"))).cast(MONEY).alias(b) for b in base])
    shown = [F.col(m) if isinstance(m, str) else F.round(m.formula(*[F.col(i).cast("double") for i in m.inputs]).cast("decimal(28,10)"), 6).cast("double").alias(m.id) for m in metrics]
    return ordered(sums.select(row, *shown), row, order)


def pivot(facts: DataFrame, row: str, column: str, members: list[str], caliber: str, month: str, **pins: str) -> DataFrame:
    """Members of one dimension by those of another. A block that lint speaks against is refused."""
    accepted(Block(row, column, tuple(members), dict(pins), caliber=caliber))
    df = facts.filter(pinned(caliber, month))
    for name, member in pins.items():
        df = df.filter(F.col(name) == member)
    return df.groupBy(row).pivot(column, members).agg(F.sum("amount").cast(MONEY))


def cells(matrix: DataFrame, columns: list[str], label: str, sheet: str, row: int, col: int) -> DataFrame:
    """Patches (sheet, row_no, col_no, value) from an anchor; nulls write nothing, labels that a sheet would run are quoted."""
    quoted = F.when(F.regexp_like(label, F.lit(r"^[=+\-@]")), F.concat(F.lit("'"), label)).otherwise(F.col(label))
    place = lambda at, value: F.struct((F.lit(col) + at).alias("col_no"), value.cast("string").alias("value"))
    every = F.explode(F.array(place(0, quoted), *[place(i + 1, F.col(c)) for i, c in enumerate(columns)]))
    return matrix.select((F.lit(row) + F.col("row_ord")).alias("row_no"), every.alias("x")).select(F.lit(sheet).alias("sheet"), "row_no", "x.*").filter("value IS NOT NULL")


def series(matrix: DataFrame, label: str, columns: list[str], by_rows: bool = True) -> DataFrame:
    """(series, category, value) of a matrix, by rows or by columns."""
    long = matrix.unpivot([label], columns, "column", "value")
    return long.select(F.col(label if by_rows else "column").alias("series"), F.col("column" if by_rows else label).alias("category"), "value")


def lookup(facts: DataFrame, keys: list[str], source: Column) -> DataFrame:
    """One row a coordinate: its value if it has just one row, else null and a conflict with its sources."""
    return facts.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(F.count("*") == 1, F.max("amount")).alias("value"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources")
    ).withColumn("status", F.when(F.col("n") > 1, "conflict").when(F.col("value").isNull(), "missing").otherwise("value"))


def month_over_month(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Change against exactly the month before; a gap or a zero base gives null."""
    before = monthly.select(*keys, F.add_months("fin_month", 1).alias("fin_month"), F.col("amount").alias("prev"))
    joined = monthly.join(before, [*keys, "fin_month"], "left")
    change = F.try_divide(F.col("amount").cast("double") - F.col("prev").cast("double"), F.nullif(F.col("prev").cast("double"), F.lit(0.0)))
    return joined.withColumn("mom", F.round(change.cast("decimal(28,10)"), 6).cast("double"))


def trend(monthly: DataFrame, keys: list[str], members: DataFrame, last: str, n: int = 12) -> DataFrame:
    """The n last periods up to one, for every member, with gaps as nulls."""
    periods = monthly.select("fin_month").distinct().filter(F.col("fin_month") <= F.lit(f"{last}-01").cast("date")).orderBy(F.desc("fin_month")).limit(n)
    return members.crossJoin(F.broadcast(periods)).join(monthly, [*keys, "fin_month"], "left")
