"""Declarations: calibers, metrics and refusals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column


class Refused(Exception):
    """A request that has no single well-defined answer. reason: a stable code."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


@dataclass(frozen=True)
class Caliber:
    """A window rule. kind: same, year_start, since or calculator; years: shift of the period, in years."""

    kind: str
    since: date | None = None
    years: int = 0

    @property
    def cumulative(self) -> bool:
        return self.kind in ("year_start", "since")


CALIBERS = {
    "month": Caliber("same"),
    "ytd": Caliber("year_start"),
    "prior_ytd": Caliber("year_start", years=-1),
    "since": Caliber("since", date(1995, 1, 1)),
    "yoy": Caliber("calculator"),
}


@dataclass(frozen=True)
class Metric:
    """inputs and formula make a derived metric: the formula maps columns of the inputs' aggregates to a column."""

    id: str
    inputs: tuple[str, ...] = ()
    formula: Callable[..., Column] | None = field(default=None, compare=False)
    unit: str = "money"


@dataclass(frozen=True)
class Fact:
    """A declared fact table: the dimensions its rows have, the calibers it is stored under, and the column that tells the window's start."""

    name: str
    dimensions: tuple[str, ...]
    calibers: tuple[str, ...] = ()
    window: str | None = None


DIMENSIONS = ("company_id", "metric_id", "scenario", "ccy", "month", "year")
DEFAULTS = {"scenario": "actual"}
FINANCE = Fact("fact_finance", DIMENSIONS, tuple(CALIBERS), "period_from")
FACTS = {FINANCE.name: FINANCE}
