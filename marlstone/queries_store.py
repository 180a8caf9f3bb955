"""Registered queries of the published store: what two loads of ledgers leave for readers, and a replay of the later one."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import admission, registry, store
from marlstone.plans.fixtures import view
from marlstone.queries import entity_sql, query
from marlstone.sources import scratch

SPEC = admission.SheetSpec({"company": 1, "period": 2, "metric": 3}, (6, 7), {}, {"this month": "month", "this year": "ytd"}, degenerate={"scenario": 4, "ccy": 5})
GRAINS = {"by_company": ("fin_month", "period_from", "company_id", "scenario", "ccy")}
_stores: dict[tuple[str, str], store.Store] = {}


def _loaded(s, d) -> store.Store:
    """All files up to 1997 in a first batch, which makes m_cost a metric; those from 1997 on in a second one that replaces. Loaded once for each folder of tables."""
    key = (s.sparkContext.applicationId, d)
    if key not in _stores:
        made = store.Store(s, scratch.folder(s, "store"))
        scratch.until_exit(s, made.root)
        cells, metrics = view(s, d, "ledger_cell"), s.createDataFrame([("m_revenue", "m_revenue")], "id string, name string")
        names = registry.snapshot({"company": (view(s, d, "dim_company"), None), "metric": (metrics, None)})
        options = {"spec_id": "ledger", "aggregates": GRAINS, "on_conflict": "replace"}
        decisions = s.createDataFrame([("metric", "m_cost", "create", None)], "kind string, raw string, action string, target string")
        store.load(made, cells.filter("file_hash <= 'l_1997'"), [SPEC], names, decisions=decisions, batch_id="b_early", imported_at="1998-01-01", **options)
        store.load(made, cells.filter("file_hash >= 'l_1997'"), [SPEC], names, batch_id="b_late", imported_at="1999-01-01", **options)
        _stores[key] = made
    return _stores[key]


_BATCHES = "(SELECT 'b_early' AS batch_id, 0 AS lo, 1997 AS hi UNION ALL SELECT 'b_late', 1997, 9999)"
_METRIC = f"CASE WHEN metric_id='m_cost' THEN {entity_sql(chr(39) + 'm_cost' + chr(39), 'm_')} ELSE metric_id END"
_CELLS = (
    "(SELECT r.*, col_no, CASE col_no WHEN 6 THEN 'month' ELSE 'ytd' END AS caliber, CASE col_no WHEN 6 THEN fin_month ELSE y0 END AS period_from, CASE col_no WHEN 6 THEN amount ELSE ytd END AS value "
    "FROM ledger_row r CROSS JOIN (SELECT 6 AS col_no UNION ALL SELECT 7) c)"
)
_STAGED = (
    f"(SELECT batch_id, file_hash, 'sheet1' AS sheet, CAST(0 AS INTEGER) AS block, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS INTEGER) AS col_no, company, metric_id AS metric, company_id, {_METRIC} AS metric_id, "
    """fin_month, caliber, value AS amount, '{"ccy":"' || ccy || '","scenario":"' || scenario || '"}' AS degenerate """
    f"FROM {_CELLS} x JOIN {_BATCHES} b ON year(fin_month) BETWEEN lo AND hi)"
)
_FACTS = f"(SELECT DISTINCT fin_month, period_from, company_id, {_METRIC} AS metric_id, scenario, ccy, value AS amount, CASE WHEN year(fin_month) < 1997 THEN 'b_early' ELSE 'b_late' END AS batch_id FROM {_CELLS} x)"


@query(f"SELECT * FROM {_STAGED}")
def stage_rows(s, d):
    return _loaded(s, d).appended("staged")


@query(f"SELECT * FROM {_FACTS}")
def published_facts(s, d):
    return _loaded(s, d).facts()


@query(f"SELECT fin_month, period_from, company_id, scenario, ccy, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount FROM {_FACTS} GROUP BY 1,2,3,4,5")
def published_aggregate(s, d):
    return _loaded(s, d).aggregate("by_company")


@query(
    "SELECT *, CASE WHEN fact_rows < n_facts THEN 'replaced in part' ELSE 'whole' END AS state FROM (SELECT b.batch_id, count(*) AS n_staged, "
    "count(DISTINCT (fin_month, period_from, company_id, metric_id, scenario, ccy)) AS n_facts, count(*) AS staged_rows, "
    "count(DISTINCT CASE WHEN b.batch_id = 'b_late' OR year(fin_month) < 1997 THEN (fin_month, period_from, company_id, metric_id, scenario, ccy) END) AS fact_rows "
    f"FROM {_CELLS} x JOIN {_BATCHES} b ON year(fin_month) BETWEEN lo AND hi GROUP BY 1)"
)
def load_reconcile(s, d):
    return store.reconciled(_loaded(s, d))


@query(
    f"SELECT DISTINCT batch_id, kind, norm, id, '[{SPEC.to_json().replace(chr(39), chr(39) * 2)}]' AS rules FROM (SELECT batch_id, 'company' AS kind, lower(regexp_replace(company,'[ _]+','','g')) AS norm, company_id AS id FROM {_STAGED} a "
    f"UNION ALL SELECT batch_id, 'metric', replace(metric,'_',''), metric_id FROM {_STAGED} b)"
)
def batch_snapshot(s, d):
    made = _loaded(s, d)
    rules = made.log().select("batch_id", F.concat(F.lit("["), F.array_join("blocks", ","), F.lit("]")).alias("rules"))
    return made.appended("catalog").join(rules, "batch_id").select("batch_id", "kind", "norm", "id", "rules")


@query(
    "SELECT file_hash, 'sheet1' AS sheet, CAST(0 AS INTEGER) AS block, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS INTEGER) AS col_no, CASE WHEN row_no % 89 = 0 THEN 'extra' ELSE 'amount' END AS what "
    f"FROM {_CELLS} x WHERE year(fin_month) >= 1997 AND (row_no % 89 = 0 OR (row_no % 97 = 0 AND col_no = 6))"
)
def replay_diff(s, d):
    """Of the later batch, after an amount in some rows was edited and other rows were deleted."""
    cells = view(s, d, "ledger_cell").filter("file_hash >= 'l_1997' AND NOT (row_no > 1 AND row_no % 89 = 0)")
    edited = cells.withColumn("raw_value", F.when(F.expr("row_no > 1 AND row_no % 97 = 0 AND col_no = 6"), (F.col("raw_value").try_cast("decimal(18,2)") + 1).cast("string")).otherwise(F.col("raw_value")))
    return store.replay(_loaded(s, d), edited, "ledger")


@query(f"SELECT batch_id, CAST(count(*) AS BIGINT) AS n, CAST(SUM(amount) AS DECIMAL(28,2)) AS total FROM {_FACTS} a WHERE batch_id = 'b_late' GROUP BY 1")
def latest_published(s, d):
    made = _loaded(s, d)
    last = registry.latest_batch(made.log().select("spec_id", "batch_id", "imported_at")).select("batch_id")
    return made.facts().join(last, "batch_id", "left_semi").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("total"))
