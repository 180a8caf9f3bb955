"""All registered reporting queries. The modules register theirs when they are imported."""

from marlstone import queries_batches, queries_store, queries_views  # noqa: F401
from marlstone.queries import ORACLES, QUERIES, report_company_by_caliber

__all__ = ["ORACLES", "QUERIES", "report_company_by_caliber"]
