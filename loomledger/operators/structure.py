"""Account trees, budgets, financial ratios and the period dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import favourable, safe_divide
from ..sources.scratch import Scratch
from .aggregate import key


def levels(tree: DataFrame) -> DataFrame:
    """``node, level`` of a closure (``trees.closure``): the root has level 0."""
    return tree.groupBy(F.col("descendant").alias("node")).agg(F.max("depth").cast("int").alias("level"))


def budget_variance(actual: DataFrame, budget: DataFrame, dims: list[str]) -> DataFrame:
    """Full outer join of both sides' sums; a missing side is 0.  ``variance_pct`` is of the budget, 0 if that is 0."""
    a = actual.groupBy(*map(key, dims)).agg(F.sum("amount").alias("a"))
    b = budget.groupBy(*map(key, dims)).agg(F.sum("budget_amount").alias("b"))
    zero = F.lit(0).cast("decimal(18,4)")
    both = a.join(b, dims, "full_outer").select(*dims, F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    variance = F.col("a") - F.col("b")
    out = both.select(
        *dims,
        F.col("a").cast("double").alias("actual"),
        F.col("b").cast("double").alias("budget"),
        variance.cast("double").alias("variance"),
        F.round(F.coalesce(safe_divide(variance, F.col("b")) * 100, F.lit(0.0)), 6).alias("variance_pct"),
    )
    return out.withColumn("status", favourable(F.col(dims[-1]), F.col("variance"))) if dims[-1] == "account_number" else out


def budget_lines(budget: DataFrame, accounts: DataFrame, periods: DataFrame, when: Column, dims: list[str]) -> DataFrame:
    """Budget rows ``account_id, period_id, amount`` by columns of both dimensions, for the periods that ``when`` takes.

    Rows of an account or a period that its dimension lacks are left out.  The condition is on periods, which are
    few: it is met before the join, and reaches a budget partitioned by period as a filter on partitions.
    """
    rows = budget.join(periods.where(when), "period_id").join(accounts, "account_id")
    return rows.groupBy(*map(key, dims)).agg(F.sum("amount").cast("double").alias("budget"), F.count("*").alias("n"))


def subsets(members: DataFrame, group: str, owner: str, item: str) -> DataFrame:
    """``group, owner, within``: pairs of owners of a group, the first one's items all among the second one's.

    An owner meets those that have its least item; of these pairs those are kept that lack none of the first one's
    items.  Repeated members change nothing, so they are nowhere made distinct.
    """
    members = Scratch(members.sparkSession).table(members.select(group, owner, item), "members")
    other = members.select(group, F.col(owner).alias("within"), item)
    least = members.groupBy(group, owner).agg(F.min(item).alias(item), F.bool_or(F.col(item).isNull()).alias("__open")).where("not __open")  # a null equals no item
    pairs = least.join(other, [group, item]).where(F.col(owner) != F.col("within")).select(group, owner, "within").distinct()
    each = pairs.join(members, [group, owner]).join(other.withColumn("__has", F.lit(True)), [group, "within", item], "left")
    return each.groupBy(group, owner, "within").agg(F.bool_and(F.coalesce("__has", F.lit(False))).alias("__all")).where("__all").select(group, owner, "within")


def budget_by(budget: DataFrame, dims: list[str], label: str = "account_name") -> DataFrame:
    """Budget per department, account or both, with the greatest label of each group."""
    return budget.groupBy(*map(key, dims)).agg(F.sum("budget_amount").cast("double").alias("budget"), F.max(label).alias("label"), F.count("*").alias("n"))


def actuals_by(ledger: DataFrame, dims: list[str], label: str = "account_name") -> DataFrame:
    """The same of actual amounts."""
    return ledger.groupBy(*map(key, dims)).agg(F.sum("amount").cast("double").alias("actual"), F.max(label).alias("label"), F.count("*").alias("n"))


def accuracy(pairs: DataFrame, expected: str, actual: str, tolerance: float = 0.01) -> DataFrame:
    """How many values are within ``tolerance`` of the expected ones (an expected 0 must be met), and their share; null for none."""
    e, a = F.col(expected), F.col(actual)
    near = F.when(e == 0, a == 0).otherwise(F.abs((a - e) / e) <= tolerance)
    return pairs.agg(F.count_if(near).alias("n_within"), F.count("*").alias("n"), F.round(F.avg(F.when(near, 1.0).otherwise(0.0)), 6).alias("accuracy"))


def suite_stats(results: DataFrame, status: str = "status") -> DataFrame:
    """``n, passed, failed, errors, pass_rate`` of test results; any other status counts in ``n`` only."""
    s = F.lower(status)
    passed = F.count_if(s == "pass")
    return results.agg(F.count("*").alias("n"), passed.alias("passed"), F.count_if(s == "fail").alias("failed"), F.count_if(s == "error").alias("errors"), F.round(passed / F.count("*"), 6).alias("pass_rate"))


def variance_totals(report: DataFrame) -> DataFrame:
    size = F.struct(F.abs("variance"), F.col("account_number"))
    worst = lambda s: F.max_by(F.when(F.col("status") == s, F.col("account_number")), F.when(F.col("status") == s, size))
    return report.agg(
        F.round(F.sum("actual"), 2).alias("actual"),
        F.round(F.sum("budget"), 2).alias("budget"),
        F.count_if(F.col("status") == "favorable").alias("n_favorable"),
        F.count_if(F.col("status") == "unfavorable").alias("n_unfavorable"),
        worst("favorable").alias("most_favorable"),
        worst("unfavorable").alias("most_unfavorable"),
    )


def _side(pred: Column) -> Column:
    return F.coalesce(F.sum(F.when(pred, F.col("amount"))), F.lit(0)).cast("double")


def prefix(*p: str) -> Column:
    out = F.lit(False)
    for x in p:
        out = out | F.col("account_number").startswith(x)
    return out


def margins(ledger: DataFrame, dims: list[str]) -> DataFrame:
    """Gross, operating and net margin per group; 0 where there is no revenue."""
    sums = {"revenue": _side(prefix("4")), "cogs": _side(prefix("51")), "opex": _side(prefix("5")), "other": _side(prefix("6", "7", "8"))}
    out = ledger.groupBy(*map(key, dims)).agg(*(c.alias(n) for n, c in sums.items()))
    of = lambda c: F.round(F.coalesce(safe_divide(c, F.col("revenue")), F.lit(0.0)), 6)
    r = F.col("revenue")
    return out.select(*dims, of(r - F.col("cogs")).alias("gross_margin"), of(r - F.col("opex")).alias("operating_margin"), of(r - F.col("opex") - F.col("other")).alias("net_margin"))


def liquidity(assets: Column, inventory: Column, liabilities: Column) -> list[Column]:
    """Current and quick ratio; infinite, with confidence 0, without liabilities."""
    of = lambda c: F.when(liabilities == 0, F.lit(float("inf"))).otherwise(c / liabilities)
    return [of(assets).alias("current_ratio"), of(assets - inventory).alias("quick_ratio"), F.when(liabilities == 0, 0.0).otherwise(1.0).alias("confidence")]


def change(current: Column, prior: Column) -> list[Column]:
    """``delta`` and ``delta_frac`` (of \\|prior\\|, 0 if that is 0): variance, period over period, comparative summary."""
    return [(current - prior).alias("delta"), F.coalesce(safe_divide(current - prior, F.abs(prior)), F.lit(0.0)).alias("delta_frac")]
