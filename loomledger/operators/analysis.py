"""Revenue and its drivers: correlation, seasonality, volatility and regression put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import series, volatility
from .structure import prefix

REVENUE = "revenue"


def driver_series(ledger: DataFrame, name: str | Column = "account_name") -> DataFrame:
    """Monthly sums of revenue (one series) and of every cost series, from one pass over the ledger."""
    name = F.col(name) if isinstance(name, str) else name
    return series.monthly(ledger.where(prefix("4", "5", "6", "7", "8")), F.when(prefix("4"), F.lit(REVENUE)).otherwise(name))


def kept(monthly: DataFrame) -> DataFrame:
    """The monthly sums, accounts times months, as a table of their own: several parts read them, the ledger is read once."""
    return Scratch(monthly.sparkSession).table(monthly, "monthly")


def drivers(monthly: DataFrame, adjust: bool = True, **options) -> DataFrame:
    """``series.revenue_drivers`` of the series of ``driver_series``, with p-values."""
    rows = series.dense(monthly)
    found = series.revenue_drivers(rows.where(F.col("series") != REVENUE), rows.where(F.col("series") == REVENUE), adjust=adjust, **options)
    return volatility.with_p_values(found)


def with_revenue(monthly: DataFrame) -> DataFrame:
    """``series, month, x, y``: each cost series beside the revenue of the same month."""
    costs = monthly.where(F.col("series") != REVENUE).select("series", "month", F.col("value").alias("x"))
    return costs.join(monthly.where(F.col("series") == REVENUE).select("month", F.col("value").alias("y")), "month")


def revenue_analysis(ledger: DataFrame, top_n: int = 10, significance: float = 0.05) -> DataFrame:
    """The ``top_n`` positive and negative drivers with their lag, r and p, seasonality, ARCH p-value and, for
    significant positive ones, the regression of revenue on them.

    A part that a short series lacks is null.
    """
    monthly = kept(driver_series(ledger))
    top = series.ranked_drivers(drivers(monthly), top_n)
    seasonal = series.seasonality_strength(series.decompose(series.dense(monthly))).select("series", F.col("strength").alias("seasonality"))
    arch = volatility.arch_effects(monthly).select("series", F.col("lm_p").alias("arch_p"))
    fits = series.regression(with_revenue(monthly), ["series"]).select("series", "slope", "r2")
    out = top.join(seasonal, "series", "left").join(arch, "series", "left").join(fits, "series", "left")
    explained = (F.col("direction") == "positive") & (F.col("p_value") < significance)
    return out.withColumns({c: F.when(explained, F.col(c)) for c in ("slope", "r2")})
