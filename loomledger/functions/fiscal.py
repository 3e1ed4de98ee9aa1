"""Fiscal periods.  A fiscal year is named by the year it ends in; start month 1 is the calendar year.

Every relative period takes an explicit ``as_of`` date, so results can be reproduced.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

START_MONTH = 2
MONTHS = [m.lower() for m in calendar.month_name[1:]]


@dataclass(frozen=True)
class Period:
    """A closed interval of days."""

    start: date
    end: date
    name: str

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def add_months(d: date, n: int) -> date:
    """``n`` months later; the day is clamped to the month's length."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def month_end(d: date) -> date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


def months(first: date, count: int, name: str) -> Period:
    first = first.replace(day=1)
    return Period(first, month_end(add_months(first, count - 1)), name)


def fiscal_year_of(d: date, start: int = START_MONTH) -> int:
    return d.year + (start > 1 and d.month >= start)


def fiscal_year(fy: int, start: int = START_MONTH) -> Period:
    return months(date(fy - (start > 1), start, 1), 12, f"FY{fy}")


def fiscal_quarter_of(d: date, start: int = START_MONTH) -> int:
    return (d.month - start) % 12 // 3 + 1


def fiscal_quarter(fy: int, q: int, start: int = START_MONTH) -> Period:
    return months(add_months(fiscal_year(fy, start).start, 3 * (q - 1)), 3, f"FY{fy} Q{q}")


def fiscal_month(fy: int, m: int, start: int = START_MONTH) -> Period:
    return months(add_months(fiscal_year(fy, start).start, m - 1), 1, f"FY{fy} P{m}")


def year_to_date(as_of: date, start: int = START_MONTH) -> Period:
    """From the fiscal year's start to the last month that is over; the first month is always in."""
    fy = fiscal_year_of(as_of, start)
    first = fiscal_year(fy, start).start
    last = as_of if as_of == month_end(as_of) else as_of.replace(day=1) - timedelta(days=1)
    return Period(first, max(last, month_end(first)), f"FY{fy} YTD")


def year_to_day(as_of: date, start: int = START_MONTH) -> Period:
    """From the fiscal year's start to the very day."""
    fy = fiscal_year_of(as_of, start)
    return Period(fiscal_year(fy, start).start, as_of, f"FY{fy} to date")


def quarter_to_date(as_of: date, start: int = START_MONTH) -> Period:
    fy, q = fiscal_year_of(as_of, start), fiscal_quarter_of(as_of, start)
    return Period(fiscal_quarter(fy, q, start).start, as_of, f"FY{fy} Q{q} QTD")


def month_to_date(as_of: date) -> Period:
    return Period(as_of.replace(day=1), as_of, as_of.strftime("%b %Y MTD"))


def month_of(d: date) -> Period:
    return months(d, 1, d.strftime("%b %Y"))


def trailing_months(as_of: date, n: int, legacy: bool = False) -> Period:
    """The ``n`` months before ``as_of``'s month; ``legacy`` adds one more at the front."""
    return months(add_months(as_of.replace(day=1), -n - legacy), n + legacy, f"Trailing {n} months")


def trailing_quarters(as_of: date, n: int, start: int = START_MONTH) -> Period:
    current = fiscal_quarter(fiscal_year_of(as_of, start), fiscal_quarter_of(as_of, start), start)
    return months(add_months(current.start, -3 * n), 3 * n, f"Trailing {n} quarters")


def prior_year(p: Period) -> Period:
    """The same period a year before; days are clamped, and a month's end stays one."""
    end = add_months(p.end, -12)
    return Period(add_months(p.start, -12), month_end(end) if p.end == month_end(p.end) else end, f"{p.name} prior year")


def prior_period(p: Period) -> Period:
    """As many whole months just before (for whole months), else as many days."""
    if p.start.day == 1 and p.end == month_end(p.end):
        n = (p.end.year - p.start.year) * 12 + p.end.month - p.start.month + 1
        return months(add_months(p.start, -n), n, f"{p.name} prior")
    return Period(p.start - timedelta(days=p.days), p.start - timedelta(days=1), f"{p.name} prior")


def _year(text: str) -> int:
    return int(text) + (2000 if int(text) < 100 else 0)


def parse_period(text: str, as_of: date, start: int = START_MONTH) -> Period | None:
    """``FY26``, ``Q1 FY26``, ``FY2026 Q1``, ``FY2026 P3``, ``January 2024``, ``2024``, ``YTD`` …; None if it is none of these."""
    t = text.strip().lower()
    if m := re.fullmatch(r"(?:fy\s*(\d{2,4})\s*q([1-4])|q([1-4])\s*(?:fy)?\s*'?(\d{2,4}))", t):
        return fiscal_quarter(_year(m[1] or m[4]), int(m[2] or m[3]), start)
    if m := re.fullmatch(r"fy\s*(\d{2,4})\s*p(\d{1,2})", t):
        return fiscal_month(_year(m[1]), int(m[2]), start)
    if m := re.fullmatch(r"(?:fy|fiscal year)\s*(\d{2,4})", t):
        return fiscal_year(_year(m[1]), start)
    if m := re.fullmatch(r"([a-z]{3,9})\.?\s+(\d{4})", t):
        k = next((k for k, name in enumerate(MONTHS) if name.startswith(m[1])), None)
        return None if k is None else month_of(date(int(m[2]), k + 1, 1))
    if m := re.fullmatch(r"(?:cy|calendar year)?\s*(\d{4})", t):
        return months(date(int(m[1]), 1, 1), 12, m[1])
    if m := re.fullmatch(r"q([1-4])", t):
        return fiscal_quarter(fiscal_year_of(as_of, start), int(m[1]), start)
    named = {
        "ytd": lambda: year_to_date(as_of, start),
        "qtd": lambda: quarter_to_date(as_of, start),
        "mtd": lambda: month_to_date(as_of),
        "this month": lambda: month_of(as_of),
        "last month": lambda: month_of(add_months(as_of, -1)),
        "this quarter": lambda: fiscal_quarter(fiscal_year_of(as_of, start), fiscal_quarter_of(as_of, start), start),
        "last quarter": lambda: trailing_quarters(as_of, 1, start),
        "this year": lambda: fiscal_year(fiscal_year_of(as_of, start), start),
        "last year": lambda: fiscal_year(fiscal_year_of(as_of, start) - 1, start),
        "ttm": lambda: trailing_months(as_of, 12),
    }
    return named[t]() if t in named else None


# The same calendar as columns.


def fy(d: Column, start: int = START_MONTH) -> Column:
    return F.year(d) + (F.when(F.month(d) >= start, 1).otherwise(0) if start > 1 else F.lit(0))


def fq(d: Column, start: int = START_MONTH) -> Column:
    return (F.floor(F.pmod(F.month(d) - start, F.lit(12)) / 3) + 1).cast("int")


def fm(d: Column, start: int = START_MONTH) -> Column:
    return (F.pmod(F.month(d) - start, F.lit(12)) + 1).cast("int")


def quarter_label(d: Column, start: int = START_MONTH) -> Column:
    return F.concat(F.lit("FY"), fy(d, start).cast("string"), F.lit(" Q"), fq(d, start).cast("string"))


def short_quarter_label(d: Column, start: int = START_MONTH) -> Column:
    return F.concat(F.lit("Q"), fq(d, start).cast("string"), F.lit("'"), F.lpad(F.pmod(fy(d, start), F.lit(100)).cast("string"), 2, "0"))


def period_key(d: Column, grain: str) -> Column:
    """day, week (Monday weeks, ``%W``), month, quarter (calendar), year; anything else is month."""
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")
    keys = {
        "day": F.date_format(d, "yyyy-MM-dd"),
        "week": F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")),
        "quarter": F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
        "year": F.year(d).cast("string"),
    }
    return keys.get(grain, F.date_format(d, "yyyy-MM"))


def between(d: Column, p: Period) -> Column:
    return d.between(F.lit(p.start), F.lit(p.end))


def in_months_of(period_start: Column, p: Period) -> Column:
    """Month granularity: a month that the period only touches counts whole."""
    return period_start.between(F.lit(p.start.replace(day=1)), F.lit(p.end.replace(day=1)))
