"""What a worksheet's cells say beside their amounts: columns, headers, keys, rules, labels and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.exprs import parse_period
from marlstone.operators.ingest import ROW, SHEET


def value_columns(ranges: list[tuple[int, int]], skipped: list[int]) -> list[int]:
    """Columns of the ranges (ends included) without the skipped ones; each once, in order."""
    return sorted({c for a, b in ranges for c in range(a, b + 1)} - set(skipped))


def column_calibers(headers: DataFrame, by_position: dict[int, str], by_header: dict[str, str]) -> DataFrame:
    """headers (col_no, raw_value, ...) with a caliber: the position's, else the text's, else null."""
    pick = lambda key, table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("string")
    return headers.withColumn("caliber", F.coalesce(pick(F.col("col_no"), by_position), pick(F.trim("raw_value"), by_header)))


def fixed_keys(rows: DataFrame, cells: DataFrame, literals: dict[str, str], places: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows with keys from outside the grid: literals, and one fixed cell (row, column) of the same sheet each."""
    at = [F.max(F.when((F.col("row_no") == r) & (F.col("col_no") == c), F.trim("raw_value"))).alias(n) for n, (r, c) in places.items()]
    here = F.lit(False)
    for r, c in places.values():
        here = here | ((F.col("row_no") == r) & (F.col("col_no") == c))
    found = cells.filter(here).groupBy(*SHEET).agg(*at)
    return rows.join(found, SHEET, "left").withColumns({n: F.lit(v) for n, v in literals.items()})


def degenerate(columns: list[str], constants: dict[str, str]) -> Column:
    """In-row and batch-constant degenerate values as JSON with sorted keys."""
    values = {c: F.col(c) for c in columns} | {n: F.lit(v) for n, v in constants.items()}
    return F.to_json(F.struct(*[values[n].alias(n) for n in sorted(values)]))


def pick_rule(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Rows with rule_id: the one for the row's metric, else the block's default. rules (metric_id, rule_id) are declared, so they are few."""
    return rows.join(rules, "metric_id", "left").withColumn("rule_id", F.coalesce("rule_id", F.lit(default)))


def first_rows(rows: DataFrame, keys: list[str], first: int = 8) -> DataFrame:
    """How many rows each key has, and the first of them, comma-joined. Only those first ones are gathered."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("row_no"))
    top = rows.withColumn("rank", rank).filter(F.col("rank") <= first).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("row_no")), ",").alias("first_rows"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(top, keys)


def computed_rows(cells: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows that carry a formula and were not dropped."""
    return cells.filter("formula IS NOT NULL").select(*ROW).distinct().join(dropped.select(*ROW), ROW, "left_anti")


def _headers(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The header texts from the anchor's column on, up to the first gap."""
    text = F.when(F.col("value_kind") == "text", F.trim("raw_value"))
    found = cells.filter((F.col("row_no") == row - 1) & (F.col("col_no") >= col)).select(*SHEET, F.col("col_no").alias("position"), text.alias("label")).filter("label <> ''")
    island = F.col("position") - col == F.row_number().over(Window.partitionBy(*SHEET).orderBy("position")) - 1
    return found.withColumn("island", island).filter("island").drop("island")


def region(cells: DataFrame, row: int, col: int) -> DataFrame:
    """(file_hash, sheet, row_no, label, computed, strays): the rows of the region at an anchor, which is as wide as its headers (one column without any).

    A row belongs to it if it has a label, left of the anchor, or, within the width, a formula or data; the first row with none of the
    three ends it.  label: null where a row has none; computed: it has a formula; strays: columns with data that isn't text, in order.
    """
    wide = _headers(cells, row, col).groupBy(*SHEET).agg(F.count("*").alias("width"))
    here = cells.filter((F.col("row_no") >= row) & (F.col("col_no") >= col - 1)).join(wide, SHEET, "left").filter(F.col("col_no") < col + F.coalesce("width", F.lit(1)))
    inner, text = F.col("col_no") >= col, F.when(F.col("value_kind") == "text", F.trim("raw_value"))
    stray = inner & (F.col("raw_value") != "") & (F.col("value_kind") != "text")
    rows = here.groupBy(*ROW).agg(
        F.max(F.when((F.col("col_no") == col - 1) & (text != ""), text)).alias("label"), F.coalesce(F.bool_or(inner & F.col("formula").isNotNull()), F.lit(False)).alias("computed"),
        F.coalesce(F.bool_or(inner & (F.col("raw_value") != "")), F.lit(False)).alias("data"), F.array_sort(F.collect_set(F.when(stray, F.col("col_no")))).alias("strays"),
    )
    present = rows.filter(F.col("label").isNotNull() | F.col("computed") | F.col("data"))
    island = F.col("row_no") - row == F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_no")) - 1
    return present.withColumn("island", island).filter("island").select(*ROW, "label", "computed", "strays")


def region_labels(cells: DataFrame, row: int, col: int) -> DataFrame:
    """(axis, position, label, computed) of the headers above an anchor and the rows of its region; a row without a label has a null."""
    columns = _headers(cells, row, col).select(*SHEET, F.lit("column").alias("axis"), "position", "label", F.lit(False).alias("computed"))
    return columns.unionByName(region(cells, row, col).select(*SHEET, F.lit("row").alias("axis"), F.col("row_no").alias("position"), "label", "computed"))


def stray_cells(cells: DataFrame, row: int, col: int, most: int = 20) -> DataFrame:
    """(file_hash, sheet, row_no, col_no, n_strays): where a region holds data that isn't text; values are not shown. The first of each sheet, and how many there are."""
    each = region(cells, row, col).select(*ROW, F.explode("strays").alias("col_no"))
    place = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_no", "col_no"))
    first = each.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    return first.join(each.groupBy(*SHEET).agg(F.count("*").alias("n_strays")), SHEET)


# Headers of columns that tell a period, a year, a month.
PERIOD_HEADERS = ("期数", "期间", "会计期间", "报告期", "所属期", "年月", "期间数")
YEAR_HEADERS = ("年份", "年度", "年")
MONTH_HEADERS = ("月份", "月")


def period_hint(cells: DataFrame, row: int, col: int, headers: tuple[tuple[str, ...], ...] = (PERIOD_HEADERS, YEAR_HEADERS, MONTH_HEADERS)) -> DataFrame:
    """(file_hash, sheet, col_no, month_col, fin_month): the one period that a sheet names beside the region at an anchor.

    Columns left of the labels count whose header, above the anchor's row, is one of the given ones, and of each kind the leftmost.  Their texts
    within the region's rows must be one and the same.  A period column goes first; else a year and a month column make the period.
    """
    period, year, month = headers
    text = F.when(F.col("value_kind") == "text", F.trim("raw_value"))
    left = cells.filter(F.col("col_no") <= col - 2).select(*ROW, "col_no", text.alias("label")).filter("label <> ''")
    kind = F.when(F.col("label").isin(*period), "period").when(F.col("label").isin(*year), "year").when(F.col("label").isin(*month), "month")
    heads = left.filter(F.col("row_no") == row - 1).select(*SHEET, "col_no", kind.alias("kind")).filter("kind IS NOT NULL").groupBy(*SHEET, "kind").agg(F.min("col_no").alias("col_no"))
    within = left.join(region(cells, row, col).select(*ROW), ROW, "left_semi")
    one = within.join(heads, [*SHEET, "col_no"]).groupBy(*SHEET, "kind", "col_no").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least = most")
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    told = one.groupBy(*SHEET).agg(*[pick(k, c).alias(f"{k}_{n}") for k in ("period", "year", "month") for c, n in (("col_no", "col"), ("least", "text"))])
    whole, number = parse_period(F.col("period_text")), F.coalesce(F.month(parse_period(F.col("month_text"))), F.col("month_text").try_cast("int"))
    y = F.col("year_text").try_cast("int")
    apart = F.when(y.between(1900, 2200) & number.between(1, 12), F.make_date(y, number, F.lit(1)))
    shown = told.select(*SHEET, F.when(whole.isNotNull(), F.col("period_col")).otherwise(F.col("year_col")).alias("col_no"), F.when(whole.isNull(), F.col("month_col")).alias("month_col"), F.coalesce(whole, apart).alias("fin_month"))
    return shown.filter("fin_month IS NOT NULL")


def axis_match(labels: DataFrame, keys: list[str], registries: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first registry (name, ids) that knows every label of a set, else null."""
    known = labels
    for name, ids in registries:
        known = known.join(ids.select(F.col("id").alias("label"), F.lit(True).alias(f"in_{name}")).distinct(), "label", "left")
    whole = known.groupBy(*keys).agg(*[F.bool_and(F.col(f"in_{n}").isNotNull()).alias(f"in_{n}") for n, _ in registries])
    return whole.select(*keys, F.coalesce(*[F.when(F.col(f"in_{n}"), F.lit(n)) for n, _ in registries]).alias("dimension"))
