"""Grouping, pivots, comparisons, shares, top-k and windows over ledger rows.

Money is summed as decimals and cast to double at the end, so results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fiscal
from ..functions.values import safe_divide

UNKNOWN = "Unknown"


def key(name: str) -> Column:
    """A group key; null is a group of its own name."""
    return F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN)).alias(name)


def total(c: str | Column = "amount") -> Column:
    return F.sum(c).cast("double")


MEASURES = {
    "sum": lambda c: total(c).alias("total"),
    "count": lambda c: F.count("*").alias("n"),
    "avg": lambda c: F.round(F.sum(c).cast("double") / F.count(c), 6).alias("mean"),
    "min": lambda c: F.min(c).cast("double").alias("low"),
    "max": lambda c: F.max(c).cast("double").alias("high"),
}


def group(ledger: DataFrame, dims: list[str], measures: tuple[str, ...] = ("sum", "count"), start: int = fiscal.START_MONTH) -> DataFrame:
    """By columns and the time dimensions month, quarter, fiscal_month and year (fiscal) of ``trandate``."""
    d = F.col("trandate")
    time = {
        "month": fiscal.period_key(d, "month"),
        "quarter": fiscal.quarter_label(d, start),
        "fiscal_month": F.concat(F.lit("FY"), fiscal.fy(d, start).cast("string"), F.lit(" M"), F.lpad(fiscal.fm(d, start).cast("string"), 2, "0")),
        "year": F.concat(F.lit("FY"), fiscal.fy(d, start).cast("string")),
    }
    keys = [time[x].alias(x) if x in time else key(x) for x in dims]
    return ledger.groupBy(*keys).agg(*(MEASURES[m](F.col("amount")) for m in measures))


def by_period(ledger: DataFrame, grain: str) -> DataFrame:
    k = fiscal.period_key(F.col("trandate"), grain).alias("period")
    return ledger.where("trandate is not null").groupBy(k).agg(*(MEASURES[m](F.col("amount")) for m in ("sum", "count", "avg")))


def by_fiscal_quarter(ledger: DataFrame, extra: str | None = None, start: int = fiscal.START_MONTH) -> DataFrame:
    d = F.col("trandate")
    keys = [fiscal.fy(d, start).cast("int").alias("fy"), fiscal.fq(d, start).alias("fq"), fiscal.short_quarter_label(d, start).alias("label")]
    return ledger.where("trandate is not null").groupBy(*keys, *([key(extra)] if extra else [])).agg(total().alias("total"), F.count("*").alias("n"))


def pivot(ledger: DataFrame, rows: str, columns: str, values: list[str], measure: str = "sum") -> DataFrame:
    """One column per value; the values are given, so no extra job looks for them."""
    agg = {"sum": total(), "count": F.count("*"), "avg": F.round(F.sum("amount").cast("double") / F.count("amount"), 6)}[measure]
    return ledger.groupBy(key(rows)).pivot(columns, values).agg(agg)


def compare(ledger: DataFrame, current: Column, prior: Column, dims: list[str]) -> DataFrame:
    """Both sides in one scan: ``current, prior, variance, variance_frac`` (of \\|prior\\|, null if that is 0)."""
    zero = F.lit(0).cast("decimal(18,4)")
    side = lambda cond: F.sum(F.when(cond, F.col("amount")).otherwise(zero))
    out = ledger.where(current | prior).groupBy(*map(key, dims)).agg(side(current).alias("c"), side(prior).alias("p"))
    return out.select(
        *dims,
        F.col("c").cast("double").alias("current"),
        F.col("p").cast("double").alias("prior"),
        (F.col("c") - F.col("p")).cast("double").alias("variance"),
        F.round(safe_divide(F.col("c") - F.col("p"), F.abs("p")), 6).alias("variance_frac"),
    )


def shares(ledger: DataFrame, dim: str) -> DataFrame:
    """Total per category and its share of the grand total."""
    by = ledger.groupBy(key(dim)).agg(F.sum("amount").alias("s"))
    # The grouped rows are few; their grand total is a one-row cross.
    whole = by.agg(F.sum("s").alias("w"))
    return by.crossJoin(F.broadcast(whole)).select(dim, F.col("s").cast("double").alias("total"), F.round(safe_divide(F.col("s"), F.col("w")), 6).alias("share_frac"))


def top(df: DataFrame, n: int, by: Column | str = "total", ascending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """A deterministic top or bottom ``n``: ties are broken by the remaining columns."""
    c = F.col(by) if isinstance(by, str) else by
    rest = ties if ties is not None else [x for x in df.columns if x != by]
    return df.orderBy(c.asc() if ascending else c.desc(), *rest).limit(n)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, bool]:
    """A page of a total order, and whether more follows."""
    more = bool(df.orderBy(*order).offset(offset + limit).limit(1).count())
    return df.orderBy(*order).offset(offset).limit(limit), more


def with_yoy(quarters: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Change on the quarter four rows before, as a fraction of its absolute total."""
    w = Window.partitionBy(*(extra or [])).orderBy("fy", "fq")
    before = F.lag("total", 4).over(w)
    return quarters.withColumn("yoy_frac", F.round(safe_divide(F.col("total") - before, F.abs(before)), 6))


def chart_by_day(ledger: DataFrame, least: int = 3) -> DataFrame:
    """``day, total`` for a line chart; nothing for under ``least`` days."""
    days = ledger.where("trandate is not null").groupBy(F.col("trandate").alias("day")).agg(total().alias("total"))
    enough = days.agg((F.count("*") >= least).alias("enough"))  # one row
    return days.crossJoin(F.broadcast(enough)).where("enough").drop("enough")


def chart_quarters(quarters: DataFrame, by: list[str], least: int = 4, compared: int = 8) -> DataFrame:
    """Quarters of each group that has ``least`` of them, with ``yoy_frac`` where it has ``compared``."""
    counted = with_yoy(quarters, by).withColumn("__k", F.count("*").over(Window.partitionBy(*by)))
    return counted.where(F.col("__k") >= least).withColumn("yoy_frac", F.when(F.col("__k") >= compared, F.col("yoy_frac"))).drop("__k")


def with_running_total(df: DataFrame, value: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(value).over(w))


def trailing(df: DataFrame, value: str, order: str, n: int, partition: list[str] | None = None) -> DataFrame:
    """Sum over the last ``n`` rows, this one included."""
    w = Window.partitionBy(*(partition or [])).orderBy(order).rowsBetween(1 - n, 0)
    return df.withColumn("trailing", F.sum(value).over(w))


def ratio_over_time(ledger: DataFrame, numerator: Column, denominator: Column) -> DataFrame:
    """Ratio of two filtered sums per month; months whose denominator is 0 are left out."""
    side = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,4)")))
    out = ledger.groupBy("period_start").agg(side(numerator).alias("a"), side(denominator).alias("b")).where("b <> 0")
    return out.select("period_start", F.round(safe_divide(F.col("a"), F.col("b")), 6).alias("ratio"))


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """First, last, average and change; no row for fewer than two months."""
    out = ratios.agg(F.min_by("ratio", "period_start").alias("first"), F.max_by("ratio", "period_start").alias("last"), F.round(F.avg("ratio"), 6).alias("average"), F.count("*").alias("n"))
    return out.where("n >= 2").select("first", "last", "average", F.round(F.col("last") - F.col("first"), 6).alias("change"), "n")
