"""Landing: source grids become sparse typed cells."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.model import Refused


def _kind(t: T.DataType) -> str:
    return "number" if isinstance(t, T.NumericType) else "bool" if isinstance(t, T.BooleanType) else "date" if isinstance(t, (T.DateType, T.TimestampType)) else "text"


def land_cells(df: DataFrame, file_hash: str | None, sheet: str, row_no: str) -> DataFrame:
    """Cells (file_hash, sheet, row_no, col_no, value_kind, raw_value) of a table's other columns, in their order; nulls have no cell.

    file_hash: the digest of the file that the table is; None if the table has a column of that name.
    """
    columns = [f for f in df.schema if f.name not in (row_no, "file_hash")]
    cell = [F.struct(F.lit(i + 1).alias("col_no"), F.lit(_kind(f.dataType)).alias("value_kind"), F.col(f.name).cast("string").alias("raw_value")) for i, f in enumerate(columns)]
    digest = F.col("file_hash") if file_hash is None else F.lit(file_hash)
    rows = df.select(digest.alias("file_hash"), F.col(row_no).cast("long").alias("row_no"), F.explode(F.array(*cell)).alias("c"))
    return rows.withColumn("sheet", F.lit(sheet)).select("file_hash", "sheet", "row_no", "c.*").filter("raw_value IS NOT NULL")


#: The scan limits of a worksheet, and the bytes beyond which a file isn't read at all.
MAX_ROWS, MAX_COLUMNS, MAX_BYTES = 20_000, 512, 64 * 1024 * 1024
_PARSED = "path string, row_no long, col_no int, value_kind string, raw_value string, formula string, refused string"
_NUMBER = re.compile(r"-?\d+(\.\d+)?")


def _text(content: bytes, encoding: str | None) -> str:
    """The text of a file: in the declared encoding, or else by its byte order mark, as UTF-8, or in the national standard that holds GBK."""
    if encoding:
        return content.decode(encoding)
    if content.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return content.decode("utf-16")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("gb18030")


def _records(text: str, most: int = MAX_ROWS) -> Iterator[list[tuple[str, bool]]]:
    """Records of (field, quoted). A quoted field holds delimiters, doubled quotes and line breaks. Stops one beyond ``most`` records."""
    record: list[tuple[str, bool]] = []
    at, n, end = 0, 0, len(text)
    while at < end and n <= most:
        if quoted := text[at] == '"':
            parts, at = [], at + 1
            while True:
                close = text.find('"', at)
                if close < 0:
                    raise ValueError("a quote is not closed")
                parts.append(text[at:close])
                at = close + 1
                if at < end and text[at] == '"':
                    parts.append('"')
                    at += 1
                else:
                    break
            field = "".join(parts)
            if at < end and text[at] not in ",\r\n":
                raise ValueError("text after a closing quote")
        else:
            stop = _STOP.search(text, at)
            close = stop.start() if stop else end
            field, at = text[at:close], close
        record.append((field, quoted))
        if at < end and text[at] == ",":
            at += 1
            if at < end:
                continue
            record.append(("", False))  # a delimiter ends the file: an empty field follows it
        else:
            at += 2 if text.startswith("\r\n", at) else 1
        yield record
        record, n = [], n + 1
    if record and at >= end:
        yield record


_STOP = re.compile(r"[,\r\n]")


def _parse(frames: Iterator[pd.DataFrame], encoding: str | None) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _PARSED.split(", ")]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            cells, why = [], None
            try:
                for r, record in enumerate(_records(_text(bytes(content), encoding)), 1):
                    if r > MAX_ROWS or len(record) > MAX_COLUMNS:
                        why = "SHEET_TOO_LARGE"
                        break
                    for c, (field, quoted) in enumerate(record, 1):
                        if field:
                            kind = "number" if not quoted and _NUMBER.fullmatch(field) else "text"
                            cells.append((path, r, c, kind, field, field if field.startswith("=") else None, None))
            except UnicodeDecodeError:
                why = "ENCODING_UNKNOWN"
            except ValueError:
                why = "FILE_MALFORMED"
            yield pd.DataFrame([(path, None, None, None, None, None, why)] if why else cells, columns=columns).astype({"row_no": "Int64", "col_no": "Int32"})


def _read_files(spark: SparkSession, path: str, encoding: str | None) -> tuple[DataFrame, DataFrame]:
    """Every file (path, file_hash, refused), and what is in one file of each content. Contents of files beyond MAX_BYTES are not read."""
    if encoding:
        codecs.lookup(encoding)  # a name that no codec has is the caller's mistake, not a file's
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    read = files.filter(F.col("length") <= MAX_BYTES)
    seen = read.select("path", F.sha2("content", 256).alias("file_hash"), F.lit(None).cast("string").alias("refused"))
    large = files.filter(F.col("length") > MAX_BYTES).select("path", F.lit(None).cast("string").alias("file_hash"), F.lit("FILE_TOO_LARGE").alias("refused"))
    first = seen.groupBy("file_hash").agg(F.min("path").alias("path"))
    return seen.unionByName(large), read.select("path", "content").mapInPandas(partial(_parse, encoding=encoding), _PARSED).join(first, "path")


def land_files(spark: SparkSession, path: str, sheet: str = "sheet1", encoding: str | None = None) -> DataFrame:
    """Cells (file_hash, sheet, row_no, col_no, value_kind, raw_value, formula) of comma-separated text files, each known by the SHA-256 of its bytes.

    A file seen twice, under whatever name, is one.  Files are dealt to tasks; within one, quoted fields may hold delimiters, quotes and line breaks.
    Empty cells are absent and texts are not trimmed.  A field that begins with an equals sign is a formula.  encoding: declared, or detected.
    Files that can't land have no cell at all, and don't keep others from landing; refused_files names them.
    """
    cells = _read_files(spark, path, encoding)[1].filter("refused IS NULL")
    return cells.select("file_hash", F.lit(sheet).alias("sheet"), "row_no", "col_no", "value_kind", "raw_value", "formula")


def refused_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(path, file_hash, refused) of files that don't land: ENCODING_UNKNOWN, FILE_MALFORMED, SHEET_TOO_LARGE or FILE_TOO_LARGE. Copies are named each."""
    files, parsed = _read_files(spark, path, encoding)
    bad = parsed.filter("refused IS NOT NULL").select("file_hash", F.col("refused").alias("why"))
    return files.join(bad, "file_hash", "left").select("path", "file_hash", F.coalesce("refused", "why").alias("refused")).filter("refused IS NOT NULL")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and a fingerprint of the column set of each table."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.sha2(F.lit(",".join(sorted(df.columns))), 256).alias("columns_sha256")) for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def schema_drift(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Columns (column, declared, found, state) that are missing, extra or of another type, and n_lost: values that the declared columns don't keep."""
    want, have = {f.name: f.dataType for f in declared}, {f.name: f.dataType for f in df.schema}
    rows, lost = [], []
    for n in sorted({*want, *have}):
        if n not in want or n not in have or want[n] != have[n]:
            rows.append((n, want[n].simpleString() if n in want else None, have[n].simpleString() if n in have else None, "missing" if n not in have else "extra" if n not in want else "type changed"))
            kept = F.col(n).try_cast(want[n]).try_cast(have[n]).eqNullSafe(F.col(n)) if n in want and n in have else F.lit(n not in have)
            lost.append(F.count_if(~kept & (F.col(n).isNotNull() if n in have else F.lit(False))).alias(f"lost{len(lost)}"))
    shape = "column string, declared string, found string, state string, n_lost long"
    if not rows:
        return df.sparkSession.createDataFrame([], shape)
    values = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("column", "declared", "found", "state"), row, strict=True)], F.col(f"lost{i}").alias("n_lost")) for i, row in enumerate(rows)]
    return df.agg(*lost).select(F.inline(F.array(*values)))


_FOOTER = "file string, n_rows long, column string, found string, n_null long, unreadable string"


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each column of each file: its type and, from the statistics of the row groups, how many nulls it has (-1: not told)."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_type

    def columns(file: str) -> Iterator[tuple]:
        filesystem, path = fs.FileSystem.from_uri(file)
        with filesystem.open_input_file(path) as opened:
            meta = pq.ParquetFile(opened).metadata
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        nulls: dict[str, int] = {}
        for i in range(meta.num_columns):
            told = [g.column(i).statistics for g in groups]
            whole = all(t is not None and t.has_null_count for t in told)
            nulls[meta.schema.column(i).path] = sum(t.null_count for t in told) if whole else -1
        for field in meta.schema.to_arrow_schema():
            try:
                found = from_arrow_type(field.type).simpleString()
            except Exception:  # a type that Spark doesn't have: told by its own name
                found = str(field.type)
            yield file, meta.num_rows, field.name, found, nulls.get(field.name, -1), None

    for frame in frames:
        for file in frame["file"]:
            try:
                rows = list(columns(file))
            except Exception as e:  # the file is told as unreadable, whatever is wrong with it
                rows = [(file, None, None, None, None, type(e).__name__)]
            out = pd.DataFrame([(file, *r[1:]) for r in rows], columns=[c.split()[0] for c in _FOOTER.split(", ")])
            yield out.astype({"n_rows": "Int64", "n_null": "Int64"})


def file_schemas(spark: SparkSession, path: str, files_per_task: int = 200) -> DataFrame:
    """(file, n_rows, column, found, n_null, unreadable) from the footers of all Parquet files under a path, which executors read; no data is.

    n_null is null where statistics don't tell it, as for nested columns.  A file without columns has no row.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    paths = listed.select(F.col("_metadata.file_path").alias("file"))
    dealt = paths.repartition(max(1, min(4096, paths.count() // files_per_task)), "file")
    return dealt.mapInPandas(_footers, _FOOTER).withColumn("n_null", F.when(F.col("n_null") >= 0, F.col("n_null")))


def file_drift(schemas: DataFrame, declared: T.StructType, defaults: tuple[str, ...] = ()) -> DataFrame:
    """(file, column, declared, found, n_rows, n_null, state, blocking): where a file differs from the declaration.

    States: ``missing`` (readable as null or default), ``missing, not null`` (declared NOT NULL, without default, and the file has rows),
    ``extra``, ``type changed``, ``null values`` (in a column declared NOT NULL), ``nulls not told``, ``unreadable``.  All but the first
    block a load: columns are never dropped or cast silently.  schemas: as file_schemas gives them.
    """
    wanted = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("declared"), F.lit(f.nullable).alias("nullable"), F.lit(f.name in defaults).alias("default")) for f in declared])
    good = schemas.filter("unreadable IS NULL")
    files = good.groupBy("file").agg(F.max("n_rows").alias("rows"))
    want = files.select("file", "rows", F.inline(wanted)) if len(declared) else files.select("file", "rows", *[F.lit(None).cast(t).alias(c) for c, t in (("column", "string"), ("declared", "string"), ("nullable", "boolean"), ("default", "boolean"))]).limit(0)
    both = want.join(good.select("file", "column", "found", "n_rows", "n_null"), ["file", "column"], "full")
    strict, rows = ~F.col("nullable"), F.coalesce("n_rows", "rows")
    state = F.when(F.col("declared").isNull(), "extra").when(F.col("found").isNull(), F.when(strict & ~F.col("default") & (rows > 0), "missing, not null").otherwise("missing"))
    state = state.when(F.col("found") != F.col("declared"), "type changed").when(strict & (F.col("n_null") > 0), "null values").when(strict & F.col("n_null").isNull(), "nulls not told")
    told = both.select("file", "column", "declared", "found", rows.alias("n_rows"), "n_null", state.alias("state"))
    broken = schemas.filter("unreadable IS NOT NULL").select("file", "column", F.lit(None).cast("string").alias("declared"), "found", "n_rows", "n_null", F.lit("unreadable").alias("state"))
    return told.filter("state IS NOT NULL").unionByName(broken).withColumn("blocking", F.col("state") != "missing")


def accepted_files(spark: SparkSession, path: str, declared: T.StructType, defaults: tuple[str, ...] = ()) -> None:
    """Refuses (SCHEMA_DRIFT) a load from a path of which some file blocks it."""
    if blocked := file_drift(file_schemas(spark, path), declared, defaults).filter("blocking").orderBy("file", "column").limit(1).collect():
        raise Refused("SCHEMA_DRIFT", f"{blocked[0].state}: {blocked[0].column} in {blocked[0].file}")


def landed_sheets(df: DataFrame, file_col: str, row_col: str, sheet: str) -> DataFrame:
    """Cells of many files, each known by the digest of its content: its rows as JSON arrays, in order, so that no two contents are written alike. Files of equal content are one.

    A sheet is bounded by the scan limits, so the lines of one are gathered; files are many and meet by their name.
    """
    columns = [c for c in df.columns if c not in (file_col, row_col)]
    line = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row_col).cast("long").alias("row"), line.alias("line")))), lambda x: x["line"]), "\n")
    files = df.groupBy(file_col).agg(F.sha2(text, 256).alias("file_hash"))
    first = files.groupBy("file_hash").agg(F.min(file_col).alias(file_col))
    return land_cells(df.join(first, file_col).drop(file_col), None, sheet, row_col)
