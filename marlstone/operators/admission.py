"""Admission of a batch of worksheets: everything that speaks against it is found first, and one finding refuses all of it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.exprs import parse_period, typed_period, unit_checked
from marlstone.model import Refused
from marlstone.operators import ingest, loading, registry, sheets


@dataclass(frozen=True)
class SheetSpec:
    """Where a worksheet has what: columns of company, period and metric, value columns with their calibers, and rows to leave out.

    degenerate: columns of further keys in the row; constants: keys of the whole sheet; units: of value columns, from and to.
    """

    labels: dict[str, int]
    values: tuple[int, ...]
    calibers: dict[int, str]
    headers: dict[str, str]
    header_row: int = 1
    drop: tuple[str, ...] = ()
    drop_prefix: str = "\0"
    period_is_date: bool = False
    degenerate: dict[str, int] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    units: dict[int, tuple[str, str]] = field(default_factory=dict)
    rounding: str = "half_up"
    keep_empty: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> SheetSpec:
        """The declaration that ``to_json`` wrote down: lists are tuples and columns are numbers again."""
        x = json.loads(text)
        by_column = lambda d, f=lambda v: v: {int(k): f(v) for k, v in d.items()}
        return cls(**x | {"values": tuple(x["values"]), "drop": tuple(x["drop"]), "calibers": by_column(x["calibers"]), "units": by_column(x["units"], tuple)})


def _measured(spec: SheetSpec, value: Column) -> tuple[Column, Column]:
    """The amount of a number cell by the unit of its column, and why it is refused."""
    amount, why = unit_checked(value, "", "", spec.rounding)
    for c, (source, target) in spec.units.items():
        a, w = unit_checked(value, source, target, spec.rounding)
        amount, why = F.when(F.col("col_no") == c, a).otherwise(amount), F.when(F.col("col_no") == c, w).otherwise(why)
    return amount, why


def _kept(cells: DataFrame, spec: SheetSpec) -> DataFrame:
    """Rows that are not dropped, with their labels and what the findings ask of them: one pass over the cells."""
    value, kind = F.col("col_no").isin(list(spec.values)), F.col("value_kind")
    rows = cells.filter(F.col("row_no") > spec.header_row).groupBy(*ingest.ROW).agg(
        *[F.max(F.when(F.col("col_no") == c, F.trim("raw_value"))).alias(n) for n, c in (spec.labels | spec.degenerate).items()],
        F.count_if(value & (kind == "number") & _measured(spec, F.col("raw_value"))[1].isNotNull()).alias("invalid"),
        F.max(F.when(F.col("col_no") == spec.labels["period"], kind)).alias("period_kind"),
        F.count_if(value & (kind == "number")).alias("amounts"), F.count_if(value & (kind != "number")).alias("odd"), F.count_if(F.col("formula").isNotNull()).alias("formulas"),
    )
    return ingest.drop_rows(rows, "company", list(spec.drop), spec.drop_prefix)


def findings(cells: DataFrame, spec: SheetSpec, definitions: DataFrame | None = None, fact: str = "fact_finance") -> DataFrame:
    """file_hash, code, n and first_row of all that speaks against each file. definitions (metric_id, fact, derived) are declared."""
    kept, keys = _kept(cells, spec), list(spec.labels)
    of = lambda df, code: df.groupBy("file_hash").agg(F.lit(code).alias("code"), F.count("*").alias("n"), F.min("row_no").cast("int").alias("first_row"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bare = reduce(lambda a, b: a | b, map(empty, keys))
    wanted = "number" if spec.period_is_date else "text"
    is_wanted = F.coalesce(F.col("period_kind") == wanted, F.lit(False))
    read = typed_period(F.col("period_kind"), F.col("period"), spec.period_is_date)
    counted = {
        "COMPUTED_ROW_NOT_DROPPED": F.when(F.col("formulas") > 0, 1), "MEASURE_NON_NUMERIC": F.when(F.col("odd") > 0, F.col("odd")), "ROWKEY_EMPTY_IN_FILE": F.when(bare, 1),
        "TRANSFORM_VALUE_INVALID": F.when(F.col("invalid") > 0, F.col("invalid")), "PERIOD_CELL_NOT_TEXT": F.when(~empty("period") & ~is_wanted, 1), "PERIOD_UNPARSEABLE": F.when(~empty("period") & is_wanted & read.isNull(), 1),
    }
    writable = ~empty("company") & ~empty("metric") & is_wanted & read.isNotNull() & (F.col("amounts") > 0)
    by_file = kept.groupBy("file_hash").agg(*[x for c, n in counted.items() for x in (F.sum(n).alias(c), F.min(F.when(n.isNotNull(), F.col("row_no"))).alias(f"{c}_at"))], F.count_if(writable).alias("writable"))
    files = cells.select("file_hash").distinct().join(by_file, "file_hash", "left")
    said = [F.struct(F.lit(c).alias("code"), F.col(c).cast("long").alias("n"), F.col(f"{c}_at").cast("int").alias("first_row")) for c in counted]
    none = F.when(F.coalesce("writable", F.lit(0)) == 0, F.lit(1).cast("long"))
    said.append(F.struct(F.lit("NO_WRITABLE_ROWS").alias("code"), none.alias("n"), F.lit(None).cast("int").alias("first_row")))
    heads = cells.filter((F.col("row_no") == spec.header_row) & F.col("col_no").isin(list(spec.values)))
    same = ingest.duplicate_keys(kept.filter(~bare), ["file_hash", *keys, *spec.degenerate])
    found = [
        files.select("file_hash", F.inline(F.array(*said))).filter("n IS NOT NULL"),
        of(sheets.column_calibers(heads, spec.calibers, spec.headers).filter("caliber IS NULL"), "HEADER_UNMAPPED"),
        of(same.withColumnRenamed("first_row", "row_no"), "ROWKEY_DUPLICATE_IN_FILE"),
    ]
    if definitions is not None:
        named = kept.select("file_hash", "row_no", F.col("metric").alias("metric_id"))
        bad = registry.refused_inputs(named, definitions, fact).filter("reason <> 'METRIC_NOT_DECLARED'").select("metric_id")
        found.append(of(named.join(bad, "metric_id"), "METRIC_INPUT_INVALID"))
    return reduce(DataFrame.unionByName, found)


def refused_cells(cells: DataFrame, spec: SheetSpec) -> DataFrame:
    """file_hash, sheet, row_no, col_no, code and reason of each amount that the units, the precision or the rounding refuse."""
    amounts = cells.filter((F.col("row_no") > spec.header_row) & F.col("col_no").isin(list(spec.values)) & (F.col("value_kind") == "number"))
    found = amounts.withColumn("reason", _measured(spec, F.col("raw_value"))[1]).filter("reason IS NOT NULL")
    return found.join(_kept(cells, spec).select(*ingest.ROW), ingest.ROW, "left_semi").select(*ingest.ROW, "col_no", F.lit("TRANSFORM_VALUE_INVALID").alias("code"), "reason")


def expanded(cells: DataFrame, spec: SheetSpec) -> DataFrame:
    """A row for each amount: its cell (file_hash, sheet, row_no, col_no), the names as they are written, fin_month, caliber, amount, and its degenerate keys as JSON."""
    kept = _kept(cells, spec).select(*ingest.ROW, *spec.labels, *spec.degenerate)
    heads = cells.filter((F.col("row_no") == spec.header_row) & F.col("col_no").isin(list(spec.values)))
    calibers = sheets.column_calibers(heads, spec.calibers, spec.headers).select(*ingest.SHEET, "col_no", "caliber")
    amounts = cells.filter((F.col("row_no") > spec.header_row) & F.col("col_no").isin(list(spec.values)) & (F.col("value_kind") == "number"))
    amounts = amounts.select(*ingest.ROW, "col_no", _measured(spec, F.col("raw_value"))[0].alias("amount"))
    month = typed_period(F.lit("number"), F.col("period"), True) if spec.period_is_date else parse_period(F.col("period"))
    if spec.keep_empty:
        grid = kept.withColumn("col_no", F.explode(F.array(*map(F.lit, spec.values))))
        rows = grid.join(amounts, [*ingest.ROW, "col_no"], "left")
    else:
        rows = kept.join(amounts, ingest.ROW)
    extra = [*spec.degenerate, *spec.constants]
    keys = sheets.degenerate(list(spec.degenerate), spec.constants) if extra else F.lit(None).cast("string")
    out = rows.join(calibers, [*ingest.SHEET, "col_no"]).withColumns({n: F.lit(v) for n, v in spec.constants.items()})
    return out.select(*ingest.ROW, "col_no", "company", "metric", month.alias("fin_month"), "caliber", "amount", keys.alias("degenerate"), *extra)


def accepted(cells: DataFrame, spec: SheetSpec, definitions: DataFrame | None = None, fact: str = "fact_finance") -> None:
    """Refuses a batch that a single finding speaks against."""
    worst = findings(cells, spec, definitions, fact).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()  # a row for each code
    if worst:
        raise Refused(worst[0]["code"], ", ".join(f"{r['code']} {r['n']}" for r in worst))


def admitted(cells: DataFrame, spec: SheetSpec, definitions: DataFrame | None = None, fact: str = "fact_finance") -> DataFrame:
    """file_hash, row_no, company, metric, fin_month, caliber and amount of a batch without findings; a single one refuses the batch whole."""
    accepted(cells, spec, definitions, fact)
    return expanded(cells, spec).select("file_hash", "row_no", "company", "metric", "fin_month", "caliber", "amount")


def windowed(rows: DataFrame) -> DataFrame:
    """Rows (coordinates, caliber and amount) by the window their caliber lands in, one row a coordinate, with conflict; refuses calibers that don't land."""
    if refused := loading.refused_calibers(rows).orderBy("caliber").limit(1).collect():
        raise Refused(refused[0]["reason"], str(refused[0]["caliber"]))
    landed = loading.assign_window(rows).drop("fin_month").withColumnRenamed("landed", "fin_month")
    return loading.merged(landed, loading.COORDINATE).select(*loading.COORDINATE, "amount", "conflict")


def load(path: str, rows: DataFrame, on_conflict: str = "reject") -> None:
    """Admitted rows (coordinates, caliber and amount) into a stored fact table, all or nothing: what is refused has written nothing."""
    one = windowed(rows)
    if one.filter("conflict").limit(1).collect():
        raise Refused("COORDINATE_CONFLICT")
    loading.upsert_into(path, one.drop("conflict"), on_conflict)
