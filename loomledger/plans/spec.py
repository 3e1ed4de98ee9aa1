"""The structured form of a question."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from ..functions.fiscal import Period


class Intent(Enum):
    TOTAL = "total"
    TREND = "trend"
    VARIANCE = "variance"
    BREAKDOWN = "breakdown"
    TOP_N = "top_n"
    RATIO = "ratio"
    COMPARISON = "comparison"
    SUMMARY = "summary"
    DETAIL = "detail"
    CORRELATION = "correlation"
    REGRESSION = "regression"
    VOLATILITY = "volatility"


@dataclass(frozen=True)
class QuerySpec:
    intent: Intent = Intent.SUMMARY
    period: Period | None = None
    comparison: str | None = None  # mom, qoq, yoy, bva or prior
    comparison_period: Period | None = None
    departments: tuple[str, ...] = ()
    parents: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    account_names: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    subsidiaries: tuple[str, ...] = ()
    not_departments: tuple[str, ...] = ()
    not_accounts: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    top_n: int | None = None
    ascending: bool = False
    compare_departments: bool = False
    questions: tuple[tuple[str, tuple[str, ...]], ...] = ()  # ambiguous words and their options
    confidence: float = 1.0

    @property
    def ambiguous(self) -> bool:
        return bool(self.questions)
