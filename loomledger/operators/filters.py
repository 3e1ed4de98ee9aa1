"""Ledger predicates as columns; all of them reach the scan or join as plain expressions.

A filter on a column that the ledger lacks keeps every row.  Department and account lists are ORs.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fiscal import Period, between, in_months_of, month_end
from ..functions.values import department_part


def any_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def all_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def department(names: Iterable[str]) -> Column:
    """A full path if a name has `` : ``, else the last segment; case does not matter."""
    path, part = F.lower("department_name"), F.lower(department_part(F.col("department_name")))
    return any_of((path if " : " in n else part) == n.strip().lower() for n in names)


def department_under(parents: Iterable[str]) -> Column:
    """The parent itself or anything below it."""
    path = F.lower("department_name")
    return any_of((path == p.lower()) | path.startswith(f"{p.lower()} :") | path.startswith(f"{p.lower()} (parent) :") for p in parents)


def period(p: Period) -> Column:
    return in_months_of(F.col("period_start"), p)


def months(p: Period) -> Column:
    """Whole months of the transaction date, for ledgers whose period follows from it; unlike ``period`` it reaches the scan."""
    return F.col("trandate").between(F.lit(p.start.replace(day=1)), F.lit(month_end(p.end)))


def date_range(p: Period) -> Column:
    return between(F.col("trandate"), p)


def account(names: Iterable[str]) -> Column:
    name = F.lower("account_name")
    return any_of(name.contains(n.lower()) for n in names)


def account_type(kind: str, values: Iterable[str], exclude_totals: bool = True) -> Column:
    """``prefix``, ``exact``, ``contains`` or ``in_list`` on the number; accounts named "total" go.  An unknown kind keeps all."""
    number, values = F.col("account_number"), list(values)
    made = {
        "prefix": lambda: any_of(number.startswith(v) for v in values),
        "exact": lambda: number.isin(values),
        "contains": lambda: any_of(number.contains(v) for v in values),
        "in_list": lambda: F.lower(number).isin([v.lower() for v in values]),
    }
    if kind not in made:
        return F.lit(True)
    out = made[kind]()
    return out & ~F.coalesce(F.lower("account_name").contains("total"), F.lit(False)) if exclude_totals else out


def account_name(kind: str, values: Iterable[str]) -> Column:
    name, values = F.lower("account_name"), [v.lower() for v in values]
    made = {"contains": name.contains, "exact": lambda v: name == v, "prefix": name.startswith}
    return any_of(made[kind](v) for v in values) if kind in made else F.lit(True)


def transaction_type(values: Iterable[str]) -> Column:
    return F.lower("type").isin([v.lower() for v in values])


def subsidiary(values: Iterable[str]) -> Column:
    return any_of(F.lower("subsidiary").contains(v.lower()) for v in values)


def excluding(pred: Column) -> Column:
    """Rows for which the predicate is not true, unknown ones included."""
    return ~F.coalesce(pred, F.lit(False))


NEEDS = {"period": "period_start", "account": "account_number", "account_name": "account_name", "type": "type", "department": "department_name", "subsidiary": "subsidiary"}


def apply(ledger: DataFrame, wanted: list[tuple[str, str, Column]]) -> tuple[DataFrame, list[str]]:
    """All of ``(needs, description, predicate)``; the descriptions say what was applied and what could not be."""
    audit, preds = [], []
    for needs, text, pred in wanted:
        if NEEDS.get(needs, needs) in ledger.columns:
            preds.append(pred)
            audit.append(text)
        else:
            audit.append(f"{text}: field not found")
    return ledger.where(all_of(preds)), audit
