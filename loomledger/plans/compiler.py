"""A :class:`QuerySpec` to a DataFrame, with the filter audit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, analysis, filters, series, structure, volatility
from .spec import Intent, QuerySpec

def conditions(spec: QuerySpec, with_period: bool = True, from_date: bool = True, named: bool = True) -> list[tuple[str, str, Column]]:
    """``from_date``: the period follows from the date (and reaches the scan), else from the posting period.  ``named``: accounts have names, so totals can be told."""
    out: list[tuple[str, str, Column]] = []
    if with_period and spec.period:
        out.append(("period", f"period {spec.period.name}", filters.months(spec.period) if from_date else filters.period(spec.period)))
    if spec.prefixes:
        out.append(("account", f"account prefix {', '.join(spec.prefixes)}", filters.account_type("prefix", spec.prefixes, named)))
    if spec.account_names:
        out.append(("account_name", f"account name {', '.join(spec.account_names)}", filters.account_name("contains", spec.account_names)))
    if spec.types:
        out.append(("type", f"type {', '.join(spec.types)}", filters.transaction_type(spec.types)))
    if spec.departments or spec.parents:
        pred = filters.any_of([filters.department(spec.departments), filters.department_under([p.replace(" (Parent)", "") for p in spec.parents])])
        out.append(("department", f"department {', '.join(spec.departments + spec.parents)}", pred))
    if spec.subsidiaries:
        out.append(("subsidiary", f"subsidiary {', '.join(spec.subsidiaries)}", filters.subsidiary(spec.subsidiaries)))
    if spec.not_departments:
        out.append(("department", f"not department {', '.join(spec.not_departments)}", filters.excluding(filters.department(spec.not_departments))))
    if spec.not_accounts:
        out.append(("account_name", f"not account {', '.join(spec.not_accounts)}", filters.excluding(filters.account(spec.not_accounts))))
    return out


def _applied(ledger: DataFrame, spec: QuerySpec, with_period: bool = True) -> DataFrame:
    return filters.apply(ledger, _conditions_for(ledger, spec, with_period))[0]


def _conditions_for(ledger: DataFrame, spec: QuerySpec, with_period: bool = True) -> list[tuple[str, str, Column]]:
    return conditions(spec, with_period, "trandate" in ledger.columns, "account_name" in ledger.columns)


def _both_sides(ledger: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows of revenue and costs alike: all filters but the accounts asked for."""
    return _applied(ledger, replace(spec, prefixes=(), account_names=()))


def compile_spec(ledger: DataFrame, spec: QuerySpec, budget: DataFrame | None = None) -> DataFrame:
    """The filters of the question hold for both sides of a comparison."""
    if spec.ambiguous:
        raise ValueError(f"to be decided first: {spec.questions}")
    dims = [d for d in spec.group_by if d in ledger.columns or d in ("month", "quarter", "year")]
    if spec.compare_departments and "department_name" not in dims:
        dims = ["department_name", *dims]
    if spec.comparison == "bva" and budget is not None:
        part, plan = _applied(ledger, spec), _applied(budget, spec)
        return structure.budget_variance(part, plan, [d for d in dims if d in ledger.columns] or ["account_number"])
    if spec.comparison_period is not None:
        part = _applied(ledger, spec, with_period=False)
        out = aggregate.compare(part, filters.months(spec.period), filters.months(spec.comparison_period), [d for d in dims if d in ledger.columns])
        return aggregate.top(out, spec.top_n, "current", spec.ascending) if spec.top_n else out
    part = _applied(ledger, spec)
    if spec.intent is Intent.TREND and not dims:
        return aggregate.by_period(part, "month").orderBy("period")
    if spec.intent is Intent.RATIO:
        return structure.margins(_both_sides(ledger, spec), dims)
    if spec.intent in (Intent.CORRELATION, Intent.REGRESSION):
        monthly = analysis.kept(analysis.driver_series(_both_sides(ledger, spec)))
        if spec.intent is Intent.REGRESSION:
            return series.regression(analysis.with_revenue(monthly), ["series"])
        return analysis.drivers(monthly)
    if spec.intent is Intent.VOLATILITY:
        return volatility.arch_effects(series.monthly(part, F.lit("total")))
    if spec.intent is Intent.DETAIL:
        return part.orderBy(F.desc("trandate"), *[c for c in part.columns if c != "trandate"]).limit(spec.top_n or 500)
    if spec.top_n:
        out = aggregate.group(part, dims or ["account_name"])
        by = F.col("total") if spec.ascending else F.abs("total")
        return aggregate.top(out, spec.top_n, by, spec.ascending, dims or ["account_name"])
    if spec.intent is Intent.BREAKDOWN and len(dims) == 1 and dims[0] in ledger.columns:
        return aggregate.shares(part, dims[0])
    return aggregate.group(part, dims) if dims else part.agg(F.coalesce(aggregate.total(), F.lit(0.0)).alias("total"), F.count("*").alias("n"))


def audit(ledger: DataFrame, spec: QuerySpec) -> list[str]:
    """What was applied, and a warning for what could not be."""
    return filters.apply(ledger, _conditions_for(ledger, spec))[1]
