"""Registered queries of worksheets, masters, loads and sinks, each with the SQL that checks it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from marlstone.functions import exprs
from marlstone.model import CALIBERS
from marlstone.operators import admission, archives, history, ingest, loading, registry, sheets
from marlstone.plans.fixtures import view
from marlstone.queries import ORACLES, base, entity_sql, facts, query
from marlstone.queries import alias_upsert as registered_aliases
from marlstone.queries import apply_decisions as decided_names
from marlstone.queries import match_candidates as suggestions
from marlstone.queries import unmatched_names as unmatched
from marlstone.sources import landing, scratch
from marlstone.streaming.incremental import incremental_landing as drain

HEADERS = {"this month": "month", "to date": "since"}
LABELS = {"company": 1, "period": 2, "metric": 3}
_ROWS = (
    "(SELECT file_hash, row_no, max(CASE WHEN col_no=1 THEN trim(raw_value) END) AS company, max(CASE WHEN col_no=2 THEN "
    "raw_value END) AS period, max(CASE WHEN col_no=2 THEN value_kind END) AS kind, max(CASE WHEN col_no=3 THEN raw_value "
    "END) AS metric FROM sheet_cell WHERE row_no > 1 GROUP BY 1,2)"
)
_PERIOD = "make_date(TRY_CAST(regexp_extract(period, '^(\\d{4})/(\\d{1,2})$', 1) AS INTEGER), TRY_CAST(regexp_extract(period, '^(\\d{4})/(\\d{1,2})$', 2) AS INTEGER), 1)"


def _body(s, d):
    return view(s, d, "sheet_cell").filter("row_no > 1")


def _rows(s, d):
    return ingest.label_columns(_body(s, d), LABELS)


# Worksheets.
@query("SELECT file_hash, CAST(col_no AS INTEGER) AS col_no, CAST(count(*) AS BIGINT) AS n FROM sheet_cell WHERE row_no > 1 AND col_no IN (4,5) GROUP BY 1,2")
def effective_value_columns(s, d):
    return _body(s, d).filter(F.col("col_no").isin(sheets.value_columns([(4, 6), (5, 5)], [6]))).groupBy("file_hash", "col_no").agg(F.count("*").alias("n"))


def _calibers(s, d):
    headers = view(s, d, "sheet_cell").filter("row_no = 1").filter(F.col("col_no").isin(sheets.value_columns([(4, 6)], [])))
    return sheets.column_calibers(headers, {5: "ytd"}, HEADERS).select("file_hash", "col_no", F.col("raw_value").alias("header"), "caliber")


@query(
    "SELECT file_hash, CAST(col_no AS INTEGER) AS col_no, raw_value AS header, CASE WHEN col_no=5 THEN 'ytd' WHEN raw_value='this "
    "month' THEN 'month' END AS caliber FROM sheet_cell WHERE row_no=1 AND col_no BETWEEN 4 AND 6"
)
def column_caliber(s, d):
    return _calibers(s, d)


@query("SELECT file_hash, CAST(col_no AS INTEGER) AS col_no, raw_value AS header FROM sheet_cell WHERE row_no=1 AND col_no=6")
def unmapped_headers(s, d):
    return _calibers(s, d).filter("caliber IS NULL").select("file_hash", "col_no", "header")


@query(f"SELECT file_hash, row_no, company, 'unit' AS title, 'CNY' AS ccy FROM {_ROWS}")
def fixed_keys(s, d):
    return sheets.fixed_keys(_rows(s, d), view(s, d, "sheet_cell"), {"ccy": "CNY"}, {"title": (1, 1)}).select("file_hash", "row_no", "company", "title", "ccy")


@query(f"""SELECT file_hash, row_no, {_PERIOD} AS fin_month, '{{"metric":"' || metric || '","origin":"sheet"}}' AS deg FROM {_ROWS} WHERE kind='text'""")
def row_keys(s, d):
    text = _body(s, d).filter("col_no <> 2 OR value_kind = 'text'")
    rows = ingest.label_columns(text, LABELS).filter("period IS NOT NULL")
    return rows.select("file_hash", "row_no", exprs.parse_period(F.col("period")).alias("fin_month"), sheets.degenerate(["metric"], {"origin": "sheet"}).alias("deg"))


@query(f"SELECT file_hash, row_no, CASE WHEN kind='number' THEN DATE '2026-06-01' ELSE {_PERIOD} END AS fin_month FROM {_ROWS}")
def typed_period(s, d):
    return _body(s, d).filter("col_no = 2").select("file_hash", "row_no", exprs.typed_period(F.col("value_kind"), F.col("raw_value"), True).alias("fin_month"))


def _transformed(s, d):
    rules = s.createDataFrame([("m_cost", "negate")], "metric_id string, rule_id string")
    rows = sheets.pick_rule(view(s, d, "fx_month"), rules, "to_10k")
    scaled = F.round(F.col("amount") * F.lit(Decimal("0.0001")), 2)
    return rows.withColumn("value", F.when(F.col("rule_id") == "negate", -F.col("amount")).when(F.col("rule_id") == "to_10k", scaled).otherwise(F.col("amount")).cast("decimal(18,2)"))


_RULE = "CASE WHEN metric_id='m_cost' THEN 'negate' ELSE 'to_10k' END"


@query(
    f"SELECT fin_month, company_id, scenario, ccy, metric_id, {_RULE} AS rule_id, CAST(CASE WHEN metric_id='m_cost' THEN "
    f"-amount ELSE round(amount*CAST(0.0001 AS DECIMAL(5,4)),2) END AS DECIMAL(18,2)) AS value FROM fx_month"
)
def pick_transform(s, d):
    return _transformed(s, d).select("fin_month", "company_id", "scenario", "ccy", "metric_id", "rule_id", "value")


@query(f"SELECT {_RULE} AS rule_id, CAST(count(*) AS BIGINT) AS n FROM fx_month GROUP BY 1")
def transform_counts(s, d):
    return _transformed(s, d).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    f"SELECT file_hash, 'company' AS dimension, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(row_no))[1:8], "
    f"',') AS first_rows FROM {_ROWS} WHERE company='' GROUP BY 1,2"
)
def empty_key_rows(s, d):
    long = _rows(s, d).unpivot(["file_hash", "row_no"], list(LABELS), "dimension", "label")
    return sheets.first_rows(long.filter("coalesce(trim(label), '') = ''"), ["file_hash", "dimension"])


@query(
    "SELECT file_hash, row_no FROM sheet_cell WHERE formula IS NOT NULL AND (file_hash, row_no) NOT IN (SELECT (file_hash, "
    "row_no) FROM sheet_cell WHERE col_no=1 AND raw_value='c_1')"
)
def computed_rows(s, d):
    cells = _body(s, d)
    return sheets.computed_rows(cells, cells.filter("col_no = 1 AND raw_value = 'c_1'")).select("file_hash", "row_no")


@query("SELECT file_hash, row_no, value_kind FROM sheet_cell WHERE row_no > 1 AND col_no=2 AND value_kind<>'text' AND raw_value<>''")
def non_text_period_cells(s, d):
    return _body(s, d).filter("col_no = 2 AND value_kind <> 'text' AND raw_value <> ''").select("file_hash", "row_no", "value_kind")


@query(
    "SELECT file_hash, 'column' AS axis, CAST(col_no AS INTEGER) AS position, raw_value AS label, FALSE AS computed FROM sheet_cell WHERE row_no=1 AND col_no>=2 "
    "UNION ALL SELECT file_hash, 'row', row_no, CASE WHEN row_no % 90<>0 THEN company_id END, row_no % 35=0 FROM sheet_row"
)
def region_labels(s, d):
    return sheets.region_labels(view(s, d, "sheet_cell"), 2, 2).drop("sheet")


@query(
    "SELECT file_hash, row_no, CAST(col_no AS INTEGER) AS col_no, n_strays FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY row_no, col_no) AS place, count(*) OVER (PARTITION BY file_hash) AS n_strays "
    "FROM sheet_cell WHERE row_no>=2 AND col_no>=2 AND value_kind<>'text') WHERE place<=20"
)
def stray_cells(s, d):
    return sheets.stray_cells(view(s, d, "sheet_cell"), 2, 2).drop("sheet")


@query("SELECT DISTINCT file_hash, CAST(1 AS INTEGER) AS col_no, CAST(CASE WHEN month(fin_month) % 2=0 THEN 2 END AS INTEGER) AS month_col, fin_month FROM dated_row")
def period_hint(s, d):
    return sheets.period_hint(view(s, d, "dated_cell"), 2, 4).drop("sheet")


@query(
    "SELECT file_hash, CAST(col_no AS INTEGER) AS col_no, CASE WHEN bool_and(raw_value IN ('m_revenue','m_cost')) THEN 'metric' "
    "WHEN bool_and(c.id IS NOT NULL) THEN 'company' END AS dimension FROM month_sheet LEFT JOIN dim_company c ON c.id=raw_value "
    "GROUP BY 1,2"
)
def axis_match(s, d):
    ids = lambda names: s.createDataFrame([(n,) for n in names], "id string")
    labels = view(s, d, "month_sheet").select("file_hash", "col_no", F.col("raw_value").alias("label"))
    return sheets.axis_match(labels, ["file_hash", "col_no"], [("caliber", ids(CALIBERS)), ("metric", ids(["m_revenue", "m_cost"])), ("company", view(s, d, "dim_company").select("id"))])


_KEPT = f"(SELECT * FROM {_ROWS} WHERE company NOT IN ('c_1'))"


@query(
    "SELECT file_hash, 'HEADER_UNMAPPED' AS code, CAST(count(*) AS BIGINT) AS n, CAST(1 AS INTEGER) AS first_row FROM sheet_cell WHERE row_no=1 AND col_no=6 GROUP BY 1 "
    f"UNION ALL SELECT file_hash, 'ROWKEY_DUPLICATE_IN_FILE', CAST(count(*) AS BIGINT), CAST(min(r) AS INTEGER) FROM (SELECT file_hash, company, period, metric, min(row_no) AS r FROM {_KEPT} WHERE company<>'' GROUP BY 1,2,3,4 HAVING count(*)>1) GROUP BY 1 "
    f"UNION ALL SELECT file_hash, 'COMPUTED_ROW_NOT_DROPPED', CAST(count(*) AS BIGINT), CAST(min(row_no) AS INTEGER) FROM {_KEPT} WHERE row_no % 35=0 GROUP BY 1 "
    f"UNION ALL SELECT file_hash, 'ROWKEY_EMPTY_IN_FILE', CAST(count(*) AS BIGINT), CAST(min(row_no) AS INTEGER) FROM {_KEPT} WHERE company='' GROUP BY 1 "
    f"UNION ALL SELECT file_hash, 'PERIOD_CELL_NOT_TEXT', CAST(count(*) AS BIGINT), CAST(min(row_no) AS INTEGER) FROM {_KEPT} WHERE kind<>'text' GROUP BY 1 "
    f"UNION ALL SELECT file_hash, 'METRIC_INPUT_INVALID', CAST(count(*) AS BIGINT), CAST(min(row_no) AS INTEGER) FROM {_KEPT} WHERE metric='m_cost' GROUP BY 1"
)
def admission_findings(s, d):
    spec = admission.SheetSpec(LABELS, (4, 5, 6), {5: "ytd"}, HEADERS, drop=("c_1",))
    definitions = s.createDataFrame([("m_revenue", "fact_finance", False), ("m_cost", "fact_finance", True)], "metric_id string, fact string, derived boolean")
    return admission.findings(view(s, d, "sheet_cell"), spec, definitions)


# Masters and declarations.
@query(
    f"SELECT u.raw, u.n_rows, c.candidates FROM ({ORACLES['unmatched_names']}) u LEFT JOIN (SELECT raw, string_agg(id, ',' "
    f"ORDER BY rank) AS candidates FROM ({ORACLES['match_candidates']}) m GROUP BY 1) c ON c.raw=u.raw"
)
def unresolved_report(s, d):
    return registry.unresolved_report(unmatched(s, d), suggestions(s, d)).select("raw", "n_rows", "candidates")


@query(
    "SELECT 'company' AS kind, lower(regexp_replace(name,'[ _]+','','g')) AS norm, min(id) AS id FROM dim_company GROUP "
    "BY 1,2 UNION ALL SELECT * FROM (VALUES ('metric','revenue','m_revenue'),('metric','sales','m_revenue'),('metric','cost','m_opex'))"
)
def master_snapshot(s, d):
    metrics = s.createDataFrame([("m_revenue", "Revenue"), ("m_cost", "Cost")], "id string, name string")
    aliases = s.createDataFrame([("Sales", "m_revenue"), ("Cost", "m_opex")], "alias string, target string")
    return registry.snapshot({"company": (view(s, d, "dim_company"), None), "metric": (metrics, aliases)})


@query(
    f"SELECT a.status, CAST(count(*) AS BIGINT) AS n_names, CAST(SUM(n.weight) AS BIGINT) AS n_rows FROM ({ORACLES['apply_decisions']}) "
    f"a JOIN source_names n ON n.raw=a.raw GROUP BY 1"
)
def load_outcome(s, d):
    return registry.load_outcome(decided_names(s, d), view(s, d, "source_names"))


@query(f"SELECT a.kind, a.normalized AS alias, a.target, c.name AS target_name FROM ({ORACLES['alias_upsert']}) a LEFT JOIN master c ON c.id=a.target")
def alias_list(s, d):
    return registry.alias_list(registered_aliases(s, d), view(s, d, "master"))


@query(
    "SELECT name, n_owners, CASE WHEN n_owners=0 THEN 'new_' || lower(name) WHEN n_owners=1 AND n_claims=1 THEN owner END AS id, CASE WHEN n_owners=0 THEN 'new' WHEN n_owners=1 AND n_claims=1 THEN 'kept' ELSE 'conflict' END AS "
    "state FROM (SELECT *, count(*) FILTER (n_owners=1) OVER (PARTITION BY owner) AS n_claims FROM (SELECT name, CAST(count(DISTINCT id) AS BIGINT) AS n_owners, CASE WHEN count(DISTINCT id)=1 THEN min(id) END AS owner "
    "FROM (SELECT a.s_name AS name, CASE WHEN o.s_suppkey % 3 <> 0 THEN 'm_' || o.s_suppkey END AS id FROM supplier "
    "a JOIN supplier o ON o.s_suppkey=a.s_suppkey OR (a.s_suppkey % 5=0 AND o.s_suppkey=a.s_suppkey+1)) GROUP BY 1))"
)
def metric_sync(s, d):
    every = base(s, d, "supplier").select("s_suppkey", "s_name")
    after = every.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("alias"))
    labels = F.array_compact(F.array("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.col("alias"))))
    declared = every.join(after, "s_suppkey", "left").select(F.col("s_name").alias("name"), labels.alias("labels"))
    owners = every.filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("label"), F.concat(F.lit("m_"), F.col("s_suppkey").cast("string")).alias("id"))
    return registry.metric_claims(declared, owners)


@query("SELECT metric_id, CAST(count(*) AS BIGINT) AS n, 'METRIC_IS_DERIVED' AS reason FROM fact_finance WHERE metric_id='m_cost' GROUP BY 1")
def metric_input_check(s, d):
    definitions = s.createDataFrame([("m_revenue", "fact_finance", False), ("m_cost", "fact_finance", True)], "metric_id string, fact string, derived boolean")
    return registry.refused_inputs(facts(s, d), definitions, "fact_finance")


@query(f"SELECT DISTINCT {entity_sql('c_name', 'cu_')} AS id, c_name AS name FROM customer")
def declared_rows(s, d):
    return registry.declared_rows(base(s, d, "customer").select(F.col("c_name").alias("name")), "cu_")


@query("SELECT s.raw, s.weight, c.id FROM source_names s LEFT JOIN (SELECT name, min(id) AS id FROM master GROUP BY 1) c ON c.name=s.raw")
def name_to_id_join(s, d):
    return registry.bridge_ids(view(s, d, "source_names"), view(s, d, "master"), "raw").select("raw", "weight", "id")


@query("SELECT raw FROM source_names EXCEPT SELECT name FROM master")
def name_difference(s, d):
    return view(s, d, "source_names").select("raw").subtract(view(s, d, "master").select("name"))


@query("SELECT c_name AS member, c_mktsegment AS business_line, CAST(count(*) AS BIGINT) AS n FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1,2")
def declared_rows_sync(s, d):
    customers = base(s, d, "customer")
    bridge = base(s, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_name").alias("member"), F.col("c_mktsegment").alias("business_line")).agg(F.count("*").alias("n"))
    return registry.synced(customers.select(F.col("c_name").alias("name")), bridge, "cu_").select("member", "business_line", "n")


# Loads and sinks.
@query("SELECT * FROM load_log ORDER BY imported_at DESC, batch_id LIMIT 50")
def batch_log(s, d):
    return registry.batch_log(view(s, d, "load_log"))


@query("SELECT spec_id, arg_max(batch_id, (imported_at, batch_id)) AS batch_id FROM load_log GROUP BY 1")
def latest_batch(s, d):
    return registry.latest_batch(view(s, d, "load_log"))


@query("SELECT batch_id, origin, direction FROM load_log WHERE direction='in' AND contains(lower(origin), 'sheet-1997')")
def batch_search(s, d):
    return registry.search(view(s, d, "load_log"), "in", "SHEET-1997").select("batch_id", "origin", "direction")


_PER_BATCH = "SELECT batch_id, CAST(count(*) AS BIGINT) AS n, CAST(SUM(amount) AS DECIMAL(28,2)) AS total FROM batch GROUP BY 1"


def _per_batch(df):
    return df.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("total"))


def _archived(s, d):
    path = scratch.folder(s, "archive")
    archives.archive(view(s, d, "batch"), path)
    return path


@query(_PER_BATCH)
def archive_batch(s, d):
    return _per_batch(archives.read_archive(s, _archived(s, d)))


@query("SELECT batch_id, fin_month, period_from, company_id, metric_id, scenario, ccy, amount FROM batch WHERE batch_id='b_1997'")
def read_archive(s, d):
    return archives.read_archive(s, _archived(s, d), "b_1997").select("batch_id", *loading.COORDINATE, "amount")


@query(_PER_BATCH)
def compact_archive(s, d):
    path = _archived(s, d)
    archives.compact(s, path)
    return _per_batch(archives.read_archive(s, path))


@query(
    "SELECT company_id, fin_month, CASE WHEN count(*)=1 THEN max(amount) END AS value, CASE WHEN count(*)>1 THEN 'conflict' "
    "ELSE 'value' END AS status FROM fx_month WHERE metric_id='m_revenue' GROUP BY 1,2"
)
def csv_export(s, d):
    from marlstone.queries import coordinate_lookup

    rows, path = coordinate_lookup(s, d).select("company_id", "fin_month", "value", "status"), scratch.folder(s, "csv")
    rows.write.option("header", True).csv(path)
    return s.read.schema(rows.schema).option("header", True).csv(path)


@query(
    "SELECT CAST(u.k AS INTEGER) AS col_no, CASE u.k WHEN 1 THEN 'number' ELSE 'text' END AS value_kind, CASE u.k WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN c_name "
    "ELSE c_mktsegment || ', \"' || c_nationkey || '\"' END AS raw_value FROM customer CROSS JOIN (VALUES (1),(2),(3)) u(k)"
)
def land_files(s, d):
    path, quote = scratch.folder(s, "sheets"), F.lit('"')
    third = F.concat("c_mktsegment", F.lit(", "), quote, F.col("c_nationkey").cast("string"), quote)
    base(s, d, "customer").repartition(8, "c_custkey").select("c_custkey", "c_name", third.alias("segment")).write.option("escape", '"').option("maxRecordsPerFile", landing.MAX_ROWS).csv(path)
    scratch.until_exit(s, path)
    return landing.land_files(s, path).select("col_no", "value_kind", "raw_value")


@query(
    "SELECT CAST(c_custkey AS BIGINT) AS row_no, CAST(u.k AS INTEGER) AS col_no, CASE u.k WHEN 1 THEN c_name || chr(10) || '\"' || c_mktsegment || '\", ' ELSE CAST(c_custkey AS VARCHAR) END AS raw_value "
    "FROM customer CROSS JOIN (VALUES (1),(2)) u(k)"
)
def land_broken_lines(s, d):
    """Fields that hold line breaks, quotes and delimiters; the second column tells the row that they came from. A file has no more rows than a sheet may have."""
    path, quote = scratch.folder(s, "broken"), F.lit('"')
    text = F.concat("c_name", F.lit("\n"), quote, F.col("c_mktsegment"), quote, F.lit(", "))
    base(s, d, "customer").select(text.alias("t"), "c_custkey").write.option("escape", '"').option("quoteAll", True).option("ignoreTrailingWhiteSpace", False).option("maxRecordsPerFile", landing.MAX_ROWS).csv(path)
    scratch.until_exit(s, path)
    cells = landing.land_files(s, path)
    key = cells.filter("col_no = 2").select("file_hash", "row_no", F.col("raw_value").cast("long").alias("key"))
    return cells.join(key, ["file_hash", "row_no"]).select(F.col("key").alias("row_no"), "col_no", "raw_value")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_DRIFT = (
    "SELECT '{p}' AS folder, '{c}' AS column, {want} AS declared, {have} AS found, '{state}' AS state, {blocking} AS blocking, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST({nulls} AS BIGINT) AS n_null FROM orders WHERE o_orderpriority='{p}' HAVING count(*) > 0"
)


@query(" UNION ALL ".join(
    _DRIFT.format(p=p, c=c, want=want, have=have, state=state, blocking=state != "missing", nulls=nulls) for p, c, want, have, state, nulls in (
        (_PRIORITIES[1], "price", "'double'", "NULL", "missing", "NULL"), (_PRIORITIES[2], "customer", "'bigint'", "NULL", "missing, not null", "NULL"),
        (_PRIORITIES[3], "status", "NULL", "'string'", "extra", "0"), (_PRIORITIES[4], "day", "'date'", "'string'", "type changed", "0"),
        (_PRIORITIES[4], "customer", "'bigint'", "'bigint'", "null values", "count(*) FILTER (o_custkey % 10=0)"),
    )
))
def schema_drift_by_file(s, d):
    """An archive of orders whose folders drift each in its own way."""
    path, orders = scratch.folder(s, "drifting"), base(s, d, "orders")
    key, price, day = F.col("o_orderkey").cast("long").alias("key"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderdate").cast("date").alias("day")
    customer = F.col("o_custkey").cast("long").alias("customer")
    shapes = ([key, customer, price, day], [key, customer, day], [key, price, day], [key, customer, price, day, F.col("o_orderstatus").alias("status")],
              [key, F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("long")).alias("customer"), price, F.col("o_orderdate").cast("string").alias("day")])
    for n, (priority, columns) in enumerate(zip(_PRIORITIES, shapes, strict=True)):
        orders.filter(F.col("o_orderpriority") == priority).select(*columns).write.parquet(f"{path}/folder={n}")
    scratch.until_exit(s, path)
    declared = s.createDataFrame([], "key long NOT NULL, customer long NOT NULL, price double, day date").schema
    drift = landing.file_drift(landing.file_schemas(s, path), declared)
    names = F.array(*[F.lit(p) for p in _PRIORITIES])
    folder = F.element_at(names, F.regexp_extract("file", r"folder=(\d)/", 1).cast("int") + 1)
    return drift.groupBy(folder.alias("folder"), "column", "declared", "found", "state", "blocking").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null")).filter("n_rows > 0")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def incremental_landing(s, d):
    files, events = scratch.folder(s, "incoming"), base(s, d, "events")
    for _ in range(2):  # the same files come twice
        events.write.mode("append").parquet(files)
    landed = drain(s, files, events.schema, scratch.folder(s, "landed"), scratch.folder(s, "offsets"))
    return landed.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "SELECT 'l_comment' AS column, 'string' AS declared, NULL AS found, 'missing' AS state, CAST(0 AS BIGINT) AS n_lost "
    "UNION ALL SELECT 'l_quantity', 'int', 'double', 'type changed', CAST(count(*) FILTER (CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) <> l_quantity) AS BIGINT) FROM lineitem "
    "UNION ALL SELECT 'l_extendedprice', 'int', 'double', 'type changed', CAST(count(*) FILTER (trunc(l_extendedprice) <> l_extendedprice) AS BIGINT) FROM lineitem "
    "UNION ALL SELECT 'l_tax', NULL, 'double', 'extra', CAST(count(l_tax) AS BIGINT) FROM lineitem"
)
def schema_drift(s, d):
    found = base(s, d, "lineitem")
    declared = found.drop("l_tax").withColumns({"l_quantity": F.lit(1), "l_extendedprice": F.lit(1), "l_comment": F.lit("")})
    return landing.schema_drift(found, declared.schema)


@query("SELECT id, strftime(valid_from, '%Y-%m-%d') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to, group_name FROM dim_company_hist")
def scd2_history(s, d):
    shown = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    return view(s, d, "dim_company_hist").orderBy("id", "valid_from").select("id", shown("valid_from"), shown("valid_to"), "group_name")


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, band FROM orders JOIN dim_customer_hist ON id=o_custkey AND o_orderdate>=valid_from AND (valid_to IS NULL OR o_orderdate<valid_to)")
def customer_as_of_join(s, d):
    """Each order with its customer's band at the time, from a history that grows with customers and years."""
    orders = base(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return history.as_of_join(orders, view(s, d, "dim_customer_hist"), "o_custkey", "day", ["band"])


@query("SELECT id, valid_from, valid_to, is_current, band FROM dim_customer_hist WHERE valid_from<=DATE '1997-12-31' AND (valid_to IS NULL OR DATE '1997-12-31'<valid_to)")
def customer_as_of_point(s, d):
    return history.as_of_point(view(s, d, "dim_customer_hist"), "1997-12-31")
