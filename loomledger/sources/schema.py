"""Canonical ledger columns and the names they may have in a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import parse_amount, parse_date

# Logical column and its names, the first that is present wins.
ALIASES = {
    "account_number": ["account_number", "acctnumber", "accountnumber", "account"],
    "account_name": ["account_name", "accountname", "acctname", "account_text"],
    "department_number": ["formulatext", "department_number"],
    "department_name": ["department_name", "department_text", "departmentname", "department"],
    "amount": ["amount", "netamount", "net_amount"],
    "debit": ["debitamount", "debit"],
    "credit": ["creditamount", "credit"],
    "trandate": ["trandate", "transaction_date", "date"],
    "periodname": ["accountingPeriod_periodname", "periodname", "postingperiod", "period"],
    "period_date": ["formuladate", "period_date"],
    "subsidiary": ["subsidiarynohierarchy", "subsidiary_text", "subsidiary"],
    "type": ["type", "transaction_type"],
    "type_text": ["type_text"],
    "memo": ["memo", "description"],
    "tranid": ["tranid", "transaction_id", "document_number"],
    "class": ["class_text", "class"],
    "vendor": ["vendor_entityid", "vendor"],
    "customer": ["customer_entityid", "customer"],
    "item": ["item_displayname", "item"],
    "location": ["location_text", "location"],
}


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Logical name to source column, regardless of case."""
    there = {c.lower(): c for c in reversed(columns)}
    return {k: there[n.lower()] for k, names in ALIASES.items() if (n := next((x for x in names if x.lower() in there), None))}


def canonical(raw: DataFrame) -> DataFrame:
    """The logical columns of a source whose values are text; unknown columns go, absent ones are not made up."""
    found = resolve_columns(raw.columns)
    cols = []
    for logical, source in found.items():
        c = raw[f"`{source}`"]
        if logical in ("amount", "debit", "credit"):
            c = parse_amount(c)
        elif logical in ("trandate", "period_date"):
            c = parse_date(c)
        else:
            c = c.cast("string")
        cols.append(c.alias(logical))
    out = raw.select(*cols)
    if "periodname" in found:
        out = out.withColumn("period_start", F.try_to_date(F.concat(F.lit("1 "), "periodname"), "d MMM yyyy"))
    elif "trandate" in found:
        out = out.withColumn("period_start", F.trunc("trandate", "MM")).withColumn("periodname", F.date_format("trandate", "MMM yyyy"))
    return out


def validate(df: DataFrame) -> None:
    """At least two of amount, date, account and type must be there."""
    have = resolve_columns(df.columns)
    if sum(any(k in have for k in ks) for ks in (("amount",), ("trandate", "period_date"), ("account_number", "account_name"), ("type",))) < 2:
        raise ValueError(f"this is no ledger: {df.columns}")
