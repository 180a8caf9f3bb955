"""Report views over the driver's tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources import scratch

BASE = ("region", "nation", "customer", "supplier", "orders", "lineitem")
#: Views that are written once for each folder of tables, by a column, and read from there: the others build on them.
STORED = {"fx_month": "fin_month", "fact_finance": "fin_month", "raw_cell": "file_hash", "sheet_cell": "file_hash", "ledger_cell": "file_hash"}
_paths: dict[tuple[str, ...], dict[str, tuple[str, list[str]]]] = {}
#: Tables of a session, so that a folder is listed and a footer read once.
_frames: dict[tuple[str, str, str], DataFrame] = {}
VIEWS = {
    "fx_month": """
SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS fin_month, concat('c_', CAST(n.n_nationkey AS VARCHAR(10))) AS company_id, m.metric_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'actual' WHEN 'O' THEN 'budget' ELSE 'forecast' END AS scenario,
       CASE WHEN n.n_regionkey IN (0,1) THEN 'USD' ELSE 'CNY' END AS ccy,
       CAST(SUM(CASE WHEN m.metric_id='m_revenue' THEN CAST(l.l_extendedprice AS DECIMAL(12,2))*(1-CAST(l.l_discount AS DECIMAL(4,2)))
                     ELSE CAST(l.l_extendedprice AS DECIMAL(12,2))*(1-CAST(l.l_tax AS DECIMAL(4,2))) END) AS DECIMAL(18,2)) AS amount
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey
CROSS JOIN (SELECT 'm_revenue' AS metric_id UNION ALL SELECT 'm_cost' AS metric_id) m GROUP BY 1,2,3,4,5""",
    "fx_windows": """
SELECT *, CAST(date_trunc('year', fin_month) AS DATE) AS y0,
  SUM(amount) OVER (PARTITION BY company_id,metric_id,scenario,ccy,CAST(date_trunc('year', fin_month) AS DATE) ORDER BY fin_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ytd,
  SUM(amount) OVER (PARTITION BY company_id,metric_id,scenario,ccy ORDER BY fin_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ltd FROM fx_month""",
    "fact_finance": """
SELECT fin_month, fin_month AS period_from, company_id, metric_id, scenario, ccy, amount FROM fx_windows
UNION ALL SELECT fin_month, y0, company_id, metric_id, scenario, ccy, CAST(ytd AS DECIMAL(18,2)) FROM fx_windows WHERE fin_month<>y0
UNION ALL SELECT fin_month, DATE '1995-01-01', company_id, metric_id, scenario, ccy, CAST(ltd AS DECIMAL(18,2)) FROM fx_windows WHERE y0<>DATE '1995-01-01'""",
    "dim_fx_rate": """
SELECT rate_month, ccy, CASE WHEN ccy='CNY' THEN CAST(1 AS DECIMAL(12,6)) ELSE CAST(7 + CAST(month(rate_month) AS DECIMAL(4,0))/100 AS DECIMAL(12,6)) END AS rate
FROM (SELECT DISTINCT fin_month AS rate_month FROM fx_month) m CROSS JOIN (SELECT 'CNY' AS ccy UNION ALL SELECT 'USD' AS ccy) c""",
    "map_org_bl": """
SELECT concat('c_', CAST(n_nationkey AS VARCHAR(10))) AS company_id, 'bl_ind' AS bl_id, CAST(CASE WHEN n_nationkey % 3=0 THEN 0.6 ELSE 1.0 END AS DECIMAL(5,4)) AS weight
FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0
UNION ALL SELECT concat('c_', CAST(n_nationkey AS VARCHAR(10))), 'bl_con', CAST(CASE WHEN n_nationkey % 3=0 THEN 0.4 ELSE 1.0 END AS DECIMAL(5,4))
FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 1""",
    "dim_company": """
SELECT concat('c_', CAST(n_nationkey AS VARCHAR(10))) AS id, n_name AS name, concat('r_', CAST(n_regionkey AS VARCHAR(10))) AS parent_id, 2 AS level, r_name AS group_name
FROM nation JOIN region ON n_regionkey=r_regionkey
UNION ALL SELECT concat('r_', CAST(r_regionkey AS VARCHAR(10))), r_name, CAST(NULL AS VARCHAR(10)), 1, r_name FROM region""",
    "dim_company_hist": """
SELECT id, DATE '1995-01-01' AS valid_from, CASE WHEN CAST(substring(id,3) AS INT) % 2=0 THEN DATE '1998-01-01' END AS valid_to,
       CAST(substring(id,3) AS INT) % 2<>0 AS is_current, name, group_name FROM dim_company WHERE level=2
UNION ALL SELECT id, DATE '1998-01-01', CAST(NULL AS DATE), TRUE, name, concat('NEW_', group_name) FROM dim_company WHERE level=2 AND CAST(substring(id,3) AS INT) % 2=0""",
    "grid": """
SELECT concat('f_', CAST(year(fin_month) AS VARCHAR(4))) AS file_hash, 'sheet1' AS sheet,
       CAST(1+row_number() OVER (PARTITION BY year(fin_month) ORDER BY fin_month, company_id, metric_id) AS INT) AS row_no,
       company_id, metric_id, fin_month, amount FROM fx_month WHERE scenario='actual'""",
    "raw_cell": """
SELECT file_hash, sheet, row_no, 1 AS col_no, 'text' AS value_kind, company_id AS raw_value FROM grid
UNION ALL SELECT file_hash, sheet, row_no, 2, 'text', concat(CAST(year(fin_month) AS VARCHAR(4)), '/', CAST(month(fin_month) AS VARCHAR(2))) FROM grid
UNION ALL SELECT file_hash, sheet, row_no, 3, 'text', metric_id FROM grid
UNION ALL SELECT file_hash, sheet, row_no, 4, CASE WHEN row_no % 70=0 THEN 'text' ELSE 'number' END, CAST(amount AS VARCHAR(30)) FROM grid WHERE row_no % 50<>0""",
    "master": """
SELECT concat('s_', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name AS name FROM supplier""",
    "source_names": """
SELECT concat(s_name, CASE WHEN s_suppkey % 4 = 0 THEN ' ' WHEN s_suppkey % 4 = 1 THEN ' (X)' WHEN s_suppkey % 4 = 2 THEN '' ELSE 'S' END) AS raw,
       CAST(s_suppkey % 25 + 1 AS BIGINT) AS weight FROM supplier""",
    "batch": """
SELECT concat('b_', CAST(year(fin_month) AS VARCHAR(4))) AS batch_id, fin_month, period_from, company_id, metric_id, scenario, ccy,
       CAST(CASE WHEN month(fin_month) = 3 THEN amount + 1 ELSE amount END AS DECIMAL(18,2)) AS amount
FROM fact_finance WHERE year(fin_month) IN (1997, 1998)""",
    "load_log": """
SELECT concat('b_', CAST(year(fin_month) AS VARCHAR(4)), '_', CAST(month(fin_month) AS VARCHAR(2))) AS batch_id, concat('spec_', CAST(month(fin_month) % 3 AS VARCHAR(2))) AS spec_id,
       CASE WHEN month(fin_month) % 2=0 THEN 'out' ELSE 'in' END AS direction, concat('Sheet-', CAST(year(fin_month) AS VARCHAR(4)), '.xlsx') AS origin, fin_month AS imported_at, CAST(count(*) AS BIGINT) AS n_rows
FROM fx_month GROUP BY fin_month""",
    "fact_line": """
SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS fin_month, concat('c_', CAST(c.c_nationkey AS VARCHAR(10))) AS company_id, c.c_mktsegment AS business_line,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))*(1-CAST(l.l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,2)) AS amount
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey GROUP BY 1,2,3""",
    "sheet_row": """
SELECT concat('g_', CAST(year(fin_month) AS VARCHAR(4))) AS file_hash, CAST(1+row_number() OVER (PARTITION BY year(fin_month) ORDER BY fin_month, company_id, metric_id, scenario, ccy) AS INT) AS row_no,
       company_id, metric_id, fin_month, amount, ytd FROM fx_windows""",
    "sheet_cell": """
SELECT file_hash, 'sheet1' AS sheet, 1 AS row_no, col_no, 'text' AS value_kind, raw_value, CAST(NULL AS VARCHAR(30)) AS formula FROM (SELECT DISTINCT file_hash FROM sheet_row) f
CROSS JOIN (SELECT 1 AS col_no, 'unit' AS raw_value UNION ALL SELECT 2, 'period' UNION ALL SELECT 3, 'metric' UNION ALL SELECT 4, 'this month' UNION ALL SELECT 5, 'to date' UNION ALL SELECT 6, 'ratio') h
UNION ALL SELECT file_hash, 'sheet1', row_no, 1, 'text', CASE WHEN row_no % 90=0 THEN ' ' ELSE company_id END, CAST(NULL AS VARCHAR(30)) FROM sheet_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 2, CASE WHEN row_no % 60=0 THEN 'number' ELSE 'text' END,
       CASE WHEN row_no % 60=0 THEN '46174' ELSE concat(CAST(year(fin_month) AS VARCHAR(4)), '/', CAST(month(fin_month) AS VARCHAR(2))) END, CAST(NULL AS VARCHAR(30)) FROM sheet_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 3, 'text', metric_id, CAST(NULL AS VARCHAR(30)) FROM sheet_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 4, 'number', CAST(amount AS VARCHAR(30)), CASE WHEN row_no % 35=0 THEN concat('=SUM(D2:D', CAST(row_no AS VARCHAR(10)), ')') END FROM sheet_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 5, 'number', CAST(CAST(ytd AS DECIMAL(18,2)) AS VARCHAR(30)), CAST(NULL AS VARCHAR(30)) FROM sheet_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 6, 'number', '1', CAST(NULL AS VARCHAR(30)) FROM sheet_row WHERE row_no % 2=0""",
    "ledger_row": """
SELECT concat('l_', CAST(year(fin_month) AS VARCHAR(4))) AS file_hash, CAST(1+row_number() OVER (PARTITION BY year(fin_month) ORDER BY fin_month, company_id, metric_id, scenario, ccy) AS INT) AS row_no,
       name AS company, company_id, metric_id, fin_month, y0, scenario, ccy, amount, CAST(ytd AS DECIMAL(18,2)) AS ytd FROM fx_windows JOIN dim_company ON id=company_id""",
    "ledger_cell": """
SELECT file_hash, 'sheet1' AS sheet, 1 AS row_no, col_no, 'text' AS value_kind, raw_value, CAST(NULL AS VARCHAR(30)) AS formula FROM (SELECT DISTINCT file_hash FROM ledger_row) f
CROSS JOIN (SELECT 6 AS col_no, 'this month' AS raw_value UNION ALL SELECT 7, 'this year') h
UNION ALL SELECT file_hash, 'sheet1', row_no, 1, 'text', company, CAST(NULL AS VARCHAR(30)) FROM ledger_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 2, 'text', concat(CAST(year(fin_month) AS VARCHAR(4)), '/', CAST(month(fin_month) AS VARCHAR(2))), CAST(NULL AS VARCHAR(30)) FROM ledger_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 3, 'text', metric_id, CAST(NULL AS VARCHAR(30)) FROM ledger_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 4, 'text', scenario, CAST(NULL AS VARCHAR(30)) FROM ledger_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 5, 'text', ccy, CAST(NULL AS VARCHAR(30)) FROM ledger_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 6, 'number', CAST(amount AS VARCHAR(30)), CAST(NULL AS VARCHAR(30)) FROM ledger_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 7, 'number', CAST(ytd AS VARCHAR(30)), CAST(NULL AS VARCHAR(30)) FROM ledger_row""",
    "dated_row": """
SELECT concat('d_', CAST(year(fin_month) AS VARCHAR(4)), '_', CAST(month(fin_month) AS VARCHAR(2))) AS file_hash, CAST(1+row_number() OVER (PARTITION BY fin_month ORDER BY company_id, metric_id) AS INT) AS row_no,
       company_id, fin_month, month(fin_month) % 2=0 AS apart, amount FROM fx_month WHERE scenario='actual'""",
    "dated_cell": """
SELECT file_hash, 'sheet1' AS sheet, 1 AS row_no, col_no, 'text' AS value_kind, CASE col_no WHEN 4 THEN 'this month' WHEN 1 THEN CASE WHEN apart THEN '年份' ELSE '期间' END ELSE CASE WHEN apart THEN '月份' ELSE 'note' END END AS raw_value,
       CAST(NULL AS VARCHAR(30)) AS formula FROM (SELECT DISTINCT file_hash, apart FROM dated_row) f CROSS JOIN (SELECT 1 AS col_no UNION ALL SELECT 2 UNION ALL SELECT 4) h
UNION ALL SELECT file_hash, 'sheet1', row_no, 1, 'text', CASE WHEN apart THEN CAST(year(fin_month) AS VARCHAR(4)) ELSE concat(CAST(year(fin_month) AS VARCHAR(4)), '/', CAST(month(fin_month) AS VARCHAR(2))) END, CAST(NULL AS VARCHAR(30)) FROM dated_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 2, 'text', CASE WHEN apart THEN CAST(month(fin_month) AS VARCHAR(2)) ELSE company_id END, CAST(NULL AS VARCHAR(30)) FROM dated_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 3, 'text', company_id, CAST(NULL AS VARCHAR(30)) FROM dated_row
UNION ALL SELECT file_hash, 'sheet1', row_no, 4, 'number', CAST(amount AS VARCHAR(30)), CAST(NULL AS VARCHAR(30)) FROM dated_row""",
    "customer_year": """
SELECT o_custkey AS id, CAST(min(o_orderdate) AS DATE) AS valid_from, CASE WHEN count(*) > 2 THEN 'frequent' ELSE 'seldom' END AS band FROM orders GROUP BY o_custkey, year(o_orderdate)""",
    "dim_customer_hist": """
SELECT id, valid_from, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from) AS valid_to, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from) IS NULL AS is_current, band FROM customer_year""",
    "month_sheet": """
SELECT concat('h_', CAST(year(fin_month) AS VARCHAR(4)), '_', CAST(month(fin_month) AS VARCHAR(2))) AS file_hash, 'sheet1' AS sheet, row_no, col_no, raw_value FROM raw_cell JOIN
(SELECT file_hash AS of_file, row_no AS of_row, fin_month FROM grid) g ON file_hash=of_file AND row_no=of_row""",
}


def _needed(sql: str, stop: tuple[str, ...] = ()) -> list[str]:
    """The views that a statement and those views use, in order; what is under ``stop`` isn't looked into."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in need:
                if name not in stop:
                    visit(body.replace(name, ""))
                if name not in need:
                    need.append(name)

    visit(sql)
    return [n for n in VIEWS if n in need]


def with_views(sql: str, known: tuple[str, ...] = ()) -> str:
    """The statement under the definitions of all views that it or they use, but for those that are known as tables."""
    order = [n for n in _needed(sql, known) if n not in known]
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in order) + " " if order else "") + sql


def _stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files, so that what was made of older ones isn't taken for theirs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return " ".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files))


def _table(spark: SparkSession, path: str) -> DataFrame:
    key = (spark._jsparkSession.sessionUUID(), path, _stamp(spark, path))
    if key not in _frames:
        _frames[key] = spark.read.parquet(path)
    return _frames[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in BASE:
        _table(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    made = _paths.setdefault((spark.sparkContext.applicationId, sf_dir, *(_stamp(spark, f"{sf_dir}/{t}.parquet") for t in BASE)), {})
    known: tuple[str, ...] = ()
    for stored in [n for n in _needed(f"SELECT * FROM {name}") if n in STORED]:  # what one builds on comes before it
        if stored not in made:
            rows, path = spark.sql(with_views(f"SELECT * FROM {stored}", known)), scratch.folder(spark, stored)
            # Rebalancing deals a large partition to several tasks and joins small ones, by the sizes seen at run time.
            rows.hint("rebalance", STORED[stored]).write.partitionBy(STORED[stored]).parquet(path)
            scratch.until_exit(spark, path)
            made[stored] = path, rows.columns
        path, columns = made[stored]
        _table(spark, path).select(*columns).createOrReplaceTempView(stored)
        known = (*known, stored)
    return spark.sql(with_views(f"SELECT * FROM {name}", known))
