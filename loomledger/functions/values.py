"""Parsing, formatting and naming of ledger values, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats in the order in which they are tried.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy")

# Account prefixes and what they classify; the longest that fits wins.
ACCOUNT_CLASSES = {
    "1": "Assets",
    "2": "Liabilities",
    "3": "Equity",
    "4": "Revenue",
    "5": "Operating Expenses",
    "51": "Cost of Goods Sold",
    "52": "R&D",
    "53": "Sales & Marketing",
    "59": "General & Administrative",
    "598": "Depreciation & Amortization",
    "6": "Interest",
    "7": "Income Tax & Other",
    "8": "Income Tax & Other",
}


def parse_amount(c: Column) -> Column:
    """``$1,234.50`` and ``(99.00)`` (negative); what cannot be read is 0."""
    plain = F.regexp_replace(F.trim(c.cast("string")), r"[$,\s]", "")
    plain = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
    return F.coalesce(plain.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def parse_date(c: Column) -> Column:
    """The first of ``DATE_FORMATS`` that fits, then the date in front of a time; else null."""
    text = F.trim(c.cast("string"))
    head = F.substring_index(F.substring_index(text, "T", 1), " ", 1)
    tries = [F.try_to_date(text, f) for f in DATE_FORMATS] + [F.try_to_date(head, f) for f in DATE_FORMATS[:4]]
    return F.coalesce(*tries)


def department_part(c: Column) -> Column:
    """The last segment of ``Category (Parent) : Department``."""
    return F.trim(F.element_at(F.split(c, " : "), -1))


def category_part(c: Column) -> Column:
    """The first segment, without ``(Parent)``."""
    return F.trim(F.regexp_replace(F.element_at(F.split(c, " : "), 1), r"\s*\(Parent\)\s*$", ""))


def statement_type(number: Column) -> Column:
    first = F.substring(F.trim(number), 1, 1)
    return F.when(first.isin(*"45678"), "income_statement").when(first.isin(*"123"), "balance_sheet").otherwise("unknown")


def account_class(number: Column) -> Column:
    number = F.trim(number)
    by_length = sorted(ACCOUNT_CLASSES.items(), key=lambda x: (-len(x[0]), x[0]))
    head, *rest = by_length
    return reduce(lambda c, k: c.when(number.startswith(k[0]), k[1]), rest, F.when(number.startswith(head[0]), head[1])).otherwise(F.lit(None))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def format_currency(c: Column) -> Column:
    size, sign = F.abs(c), F.when(c < 0, "-").otherwise("")
    body = (
        F.when(size >= 1e6, F.concat(F.format_number(size / 1e6, 2), F.lit("M")))
        .when(size >= 1e3, F.concat(F.format_number(size / 1e3, 2), F.lit("K")))
        .otherwise(F.format_number(size, 2))
    )
    return F.concat(sign, F.lit("$"), body)


def format_axis(c: Column) -> Column:
    size = F.abs(c)
    for_ = lambda unit, mark: F.concat(F.format_number(c / unit, 1), F.lit(mark))
    return F.when(size >= 1e9, for_(1e9, "B")).when(size >= 1e6, for_(1e6, "M")).when(size >= 1e3, for_(1e3, "K")).otherwise(F.format_number(c, 0))


def format_percentage(fraction: Column) -> Column:
    return F.format_string("%.2f%%", fraction * 100)


def format_ratio(c: Column) -> Column:
    return F.format_string("%.2fx", c)


def bucket(c: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step (from the highest) that the absolute value reaches."""
    head, *rest = steps
    return reduce(lambda w, s: w.when(F.abs(c) >= s[0], s[1]), rest, F.when(F.abs(c) >= head[0], head[1])).otherwise(otherwise)


def trend_strength(r2: Column) -> Column:
    return bucket(r2, [(0.7, "strong"), (0.4, "moderate")], "weak")


def correlation_strength(r: Column) -> Column:
    return bucket(r, [(0.7, "strong"), (0.4, "moderate"), (0.2, "weak")], "negligible")


def favourable(account_number: Column, variance: Column) -> Column:
    """Revenue above plan is good, expense (5-8) below plan is good; 0 is neither."""
    first = F.substring(account_number, 1, 1)
    good = F.when(first == "4", variance > 0).when(first.isin(*"5678"), variance < 0)
    return F.when((variance == 0) | good.isNull(), "neutral").when(good, "favorable").otherwise("unfavorable")


def within_tolerance(actual: Column, expected: Column, tolerance: float = 0.01) -> Column:
    return F.when(expected == 0, F.abs(actual) < 0.01).otherwise(F.abs((actual - expected) / expected) <= tolerance)


def tokens(c: Column) -> Column:
    """Distinct lower-case words; ``, & ( ) - /`` separate."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[,&()\-/]", " "), r"\s+"), lambda w: w != F.lit("")))


# Names and what they are called for short.
ABBREVIATIONS = {
    "general and administrative": ["g&a", "ga", "admin"],
    "general & administrative": ["g&a", "ga", "admin"],
    "research and development": ["r&d", "rd", "research"],
    "research & development": ["r&d", "rd", "research"],
    "sales and marketing": ["s&m", "sm", "sales marketing"],
    "sales & marketing": ["s&m", "sm", "sales marketing"],
    "cost of goods sold": ["cogs", "cos"],
    "cost of sales": ["cos", "cogs"],
    "north america": ["na"],
    "information technology": ["it"],
    "human resources": ["hr"],
    "customer success": ["cs"],
    "sales development": ["sdr"],
    "product development": ["pd", "product dev"],
    "accounts payable": ["ap"],
    "accounts receivable": ["ar"],
}


def aliases(c: Column) -> Column:
    """What a name may be called: itself, its parts, without ``(parent)``, with and without ``&``, acronym, abbreviations."""
    low = F.lower(F.trim(c))
    clean = F.trim(F.regexp_replace(F.regexp_replace(low, r"\s*\(parent\)\s*", " "), r"\s+", " "))
    parts = F.split(low, r" : | - | / |, | – ")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s*\(parent\)\s*", "")))
    words = F.regexp_extract_all(clean, F.lit(r"\b([a-z]+)\b"), F.lit(1))
    acronym = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    none = F.array().cast("array<string>")
    out = F.array_union(F.array(low, clean), F.filter(F.array_union(F.transform(parts, lambda p: F.trim(p)), bare), lambda p: F.length(p) > 1))
    out = F.array_union(out, F.when(F.size(bare) == 2, F.array(F.array_join(bare, " "))).otherwise(none))
    amp = F.array(F.replace(low, F.lit("&"), F.lit(" and ")), F.replace(F.replace(low, F.lit("&"), F.lit("")), F.lit("  "), F.lit(" ")), F.replace(low, F.lit(" & "), F.lit("")))
    out = F.array_union(out, F.when(low.contains("&"), amp).otherwise(none))
    out = F.array_union(out, F.when((F.size(words) >= 2) & F.length(acronym).between(2, 6), F.array(acronym)).otherwise(none))
    for name, short in ABBREVIATIONS.items():
        out = F.array_union(out, F.when(low.contains(name), F.array(*map(F.lit, short))).otherwise(none))
    return F.when(low == "", none).otherwise(F.array_distinct(out))


def match_score(term: Column, name: Column, alias: Column) -> Column:
    """How well ``term`` names an entity: 1 exact, 0.95 an alias, then by words of the last segment, words of all, substrings."""
    q, canon = F.lower(F.trim(term)), F.lower(name)
    child = F.trim(F.element_at(F.split(canon, " : "), -1))
    nested = canon.contains(" : ")
    qw, cw, aw = tokens(q), tokens(child), tokens(canon)
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    hits = F.size(F.array_intersect(qw, aw))
    n = F.size(qw)
    part = lambda a: F.when(a.contains(q), clamp(share(F.length(q), F.length(a)) + 0.1, 0.35, 0.6)).when(q.contains(a), F.lit(0.3)).otherwise(F.lit(0.0))
    cover = share(F.length(q), F.length(canon))
    return (
        F.when(q == canon, 1.0)
        .when(F.array_contains(alias, q) & ~(nested & (q == child)), 0.95)
        .when(nested & (q == child), 1.0)
        .when(nested & (n > 0) & (F.size(F.array_except(qw, cw)) == 0), clamp(0.85 + share(n, F.size(cw)) * 0.09, 0.85, 0.94))
        .when((n > 1) & (hits == n), clamp(0.5 + share(n, F.size(aw)) * 0.34, 0.6, 0.84))
        .when(n > 1, F.when(hits > 0, 0.3).otherwise(0.0))
        .when(canon.contains(q), F.when(F.length(q) >= 5, clamp(cover + 0.35, 0.6, 0.8)).otherwise(clamp(cover + 0.2, 0.5, 0.7)))
        .when(q.contains(canon), 0.35)
        .otherwise(F.coalesce(F.array_max(F.transform(alias, part)), F.lit(0.0)))
    )
