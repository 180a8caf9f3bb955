"""From landed cells to candidate facts, and the quality profile of a batch. Every step is set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.exprs import parse_period

SHEET = ["file_hash", "sheet"]
ROW = [*SHEET, "row_no"]


def restore_cells(cells: DataFrame) -> DataFrame:
    """Typed values by kind; a number that isn't one is null."""
    typed = lambda kind, cast: F.when(F.col("value_kind") == kind, F.col("raw_value").try_cast(cast))
    return cells.withColumns({"number_value": typed("number", "decimal(18,2)"), "text_value": F.when(F.col("value_kind") == "text", F.col("raw_value")), "bool_value": typed("bool", "boolean"), "date_value": typed("date", "date")})


def landing_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SHEET).agg(F.count("*").alias("cells"))


def clip_guard(cells: DataFrame, rows: int = 20_000, columns: int = 512) -> DataFrame:
    """Sheets beyond the scan limits; these are refused whole."""
    extent = cells.groupBy(*SHEET).agg((F.max("row_no") - F.min("row_no") + 1).alias("n_rows"), (F.max("col_no") - F.min("col_no") + 1).alias("n_cols"))
    return extent.filter((F.col("n_rows") > rows) | (F.col("n_cols") > columns))


def land_idempotent(new: DataFrame, landed: DataFrame, key: str = "file_hash") -> DataFrame:
    """Cells of files whose content has not landed before."""
    return new.join(landed.select(key).distinct(), key, "left_anti")


def latest_pointer(seen: DataFrame) -> DataFrame:
    return seen.groupBy("source_path").agg(F.max_by("file_hash", F.struct("seen_at", "file_hash")).alias("file_hash"))


def extent(cells: DataFrame, anchor: int, labels: list[int]) -> DataFrame:
    """Rows of each sheet from the anchor down to the first with all label columns blank. Blank rows have no cells, so every position is made first."""
    last = cells.groupBy(*SHEET).agg(F.max("row_no").alias("last"))
    rows = last.filter(F.col("last") >= anchor).select(*SHEET, F.explode(F.sequence(F.lit(anchor), "last")).alias("row_no"))
    labelled = cells.filter(F.col("col_no").isin(labels) & (F.trim("raw_value") != "")).select(*ROW).distinct().withColumn("has", F.lit(True))
    marked = rows.join(labelled, ROW, "left")
    stop = marked.filter("has IS NULL").groupBy(*SHEET).agg(F.min("row_no").alias("stop"))
    return marked.join(stop, SHEET, "left").filter("stop IS NULL OR row_no < stop").select(*ROW)


def label_columns(cells: DataFrame, columns: dict[str, int]) -> DataFrame:
    """One row a sheet row, a column for each label."""
    pick = [F.max(F.when(F.col("col_no") == c, F.trim("raw_value"))).alias(n) for n, c in columns.items()]
    return cells.filter(F.col("col_no").isin(list(columns.values()))).groupBy(*ROW).agg(*pick)


def unpivoted(cells: DataFrame, labels: dict[str, int], values: list[int], keep_empty: bool) -> DataFrame:
    """A candidate fact for each row and value column, with its cell; empty cells are skipped or kept as nulls."""
    rows = label_columns(cells, labels)
    grid = rows.withColumn("col_no", F.explode(F.array(*[F.lit(v) for v in values])))
    amounts = cells.filter(F.col("col_no").isin(values)).select(*ROW, "col_no", "value_kind", F.col("raw_value").alias("value"))
    out = grid.join(amounts, [*ROW, "col_no"], "left" if keep_empty else "inner")
    return out.withColumn("amount", F.when(F.col("value_kind") == "number", F.col("value").try_cast("decimal(18,2)"))).withColumn("fin_month", parse_period(F.col("period"))) if "period" in labels else out


def drop_rows(rows: DataFrame, column: str, exact: list[str], prefix: str) -> DataFrame:
    """Rows without those whose label is one of ``exact`` or begins with ``prefix``; a row without a label stays."""
    out = F.col(column).isin(exact) | F.col(column).startswith(prefix)
    return rows.filter(~F.coalesce(out, F.lit(False)))


def ignore_rectangles(cells: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Cells outside all rectangles (r0, r1, c0, c1); the list is declared, so it is small."""
    inside = F.col("row_no").between(F.col("r0"), F.col("r1")) & F.col("col_no").between(F.col("c0"), F.col("c1"))
    return cells.join(F.broadcast(rectangles), inside, "left_anti")


def measure_stats(cells: DataFrame, rows: DataFrame, values: list[int]) -> DataFrame:
    """Total, empty and non-numeric value cells of each column."""
    grid = rows.select(*ROW).withColumn("col_no", F.explode(F.array(*[F.lit(v) for v in values])))
    joined = grid.join(cells.select(*ROW, "col_no", "value_kind"), [*ROW, "col_no"], "left")
    kind = F.col("value_kind")
    return joined.groupBy("file_hash", "col_no").agg(F.count("*").alias("total"), F.count_if(kind.isNull()).alias("empty"), F.count_if(kind != "number").alias("non_numeric"))


def duplicate_keys(rows: DataFrame, keys: list[str], place: str = "row_no") -> DataFrame:
    """Keys on more than one row, with the first rows they are on."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first_row"), F.max(place).alias("last_row")).filter("n > 1")


def incomplete(rows: DataFrame, keys: list[str]) -> DataFrame:
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return rows.agg(F.count_if(missing).alias("incomplete"))


def period_profile(rows: DataFrame) -> DataFrame:
    """How many periods each file has, and rows whose period can't be read."""
    return rows.groupBy("file_hash").agg(F.countDistinct("fin_month").alias("periods"), F.count_if(F.col("fin_month").isNull()).alias("unparseable"))


def masked(cells: DataFrame, max_row: int, max_col: int) -> DataFrame:
    """Texts as they are, formulas and other kinds as a marker: the structure without the numbers. truncated: the sheet has cells beyond the rectangle."""
    formula = F.col("formula").isNotNull() if "formula" in cells.columns else F.lit(False)
    shown = F.when(formula, F.lit("<formula>")).when(F.col("value_kind") == "text", F.col("raw_value")).otherwise(F.concat(F.lit("<"), "value_kind", F.lit(">")))
    within = (F.col("row_no") <= max_row) & (F.col("col_no") <= max_col)
    beyond = cells.groupBy(*SHEET).agg((F.count_if(~within) > 0).alias("truncated"))
    return cells.filter(within).withColumn("shown", shown).join(beyond, SHEET)


# Currency signs before an amount, and units after it.
_SIGNS, _UNITS = "¥￥$€£", ("%", "％", "元", "万元", "亿元", "千元", "人民币")
#: A text that is nothing but an amount: brackets, a sign, a currency, a plain or grouped number, a unit.
_AMOUNT = rf"^[（(]?\s*[-+−]?\s*[{_SIGNS}]?\s*(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?\s*(?:{'|'.join(_UNITS)})?\s*[)）]?$"
_DATE = r"(?<!\d)\d{4}([-/.])\d{1,2}\1\d{1,2}(?!\d)|(?<!\d)(?:19|20|21)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)"


def leak_scan(df: DataFrame, texts: Column, limit: int = 10_000) -> DataFrame:
    """Rows whose text is nothing but an amount, however small, or holds a number from the limit on. A date, also one in eight digits, is no such number within a text."""
    spaced = F.trim(F.translate(texts, "\u00a0\u2007\u202f", "   "))
    plain = F.regexp_replace(F.regexp_replace(spaced, _DATE, " "), r"(\d),(?=\d{3})", "$1")
    digits = F.transform(F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    return df.filter(spaced.rlike(_AMOUNT) | F.exists(digits, lambda x: x >= limit))


def header_runs(cells: DataFrame, known: DataFrame, axis_names: tuple[str, ...] = ()) -> DataFrame:
    """The longest horizontal run of known labels of each sheet; the topmost, then the leftmost, wins ties.

    What is left of a run's first label must be no text, or the name of an axis: texts that go on to the left make it part of something else.
    A run may begin within a longer one, after a label that is an axis's name too.
    """
    texts = cells.filter("value_kind = 'text' AND trim(raw_value) <> ''").select(*ROW, "col_no", F.trim("raw_value").alias("label"))
    marked = texts.join(known.select("label", F.lit(True).alias("known")).distinct(), "label", "left")
    order = Window.partitionBy(*ROW).orderBy("col_no")
    beside = F.lag(F.col("label")).over(order)
    free = F.when(F.lag("col_no").over(order) == F.col("col_no") - 1, beside.isin(*axis_names) if axis_names else F.lit(False)).otherwise(F.lit(True))
    placed = marked.withColumn("free", F.coalesce(free, F.lit(True))).filter("known").withColumn("island", F.col("col_no") - F.row_number().over(order))
    ends = placed.withColumn("last", F.max("col_no").over(Window.partitionBy(*ROW, "island"))).filter("free")
    runs = ends.select(*ROW, F.col("col_no").alias("first_col"), (F.col("last") - F.col("col_no") + 1).cast("long").alias("width"))
    best = F.max_by(F.struct("row_no", "first_col", "width"), F.struct("width", -F.col("row_no"), -F.col("first_col")))
    return runs.groupBy(*SHEET).agg(best.alias("b")).select(*SHEET, "b.*")
