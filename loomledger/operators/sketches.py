"""Distinct counts and quantiles of a ledger from mergeable sketches, one row per day: a refresh reads new days only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(rows: DataFrame, day: str, distinct: list[str], numeric: list[str], lg_k: int = 12) -> DataFrame:
    """``day, n`` and a sketch per column: HyperLogLog for ``distinct``, KLL for ``numeric``; null values are in none."""
    hll = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"distinct_{c}") for c in distinct]
    kll = [F.kll_sketch_agg_double(F.col(c).cast("double")).alias(f"quantiles_{c}") for c in numeric]
    return rows.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"), *hll, *kll)


def refresh(sketches: DataFrame, rows: DataFrame, day: str, distinct: list[str], numeric: list[str]) -> DataFrame:
    """The sketches with those of days that they lack; the rows of days already there are not read beyond their day."""
    missing = rows.join(F.broadcast(sketches.select(F.col("day").alias(day))), day, "left_anti")  # days, whatever the rows
    return sketches.unionByName(daily(missing, day, distinct, numeric))


def summary(sketches: DataFrame, distinct: list[str], numeric: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``n``, the estimated number of distinct values and the quantiles, merged over the days given; no row is read again."""
    merged = sketches.agg(F.sum("n").alias("n"), *(F.hll_union_agg(f"distinct_{c}").alias(f"distinct_{c}") for c in distinct), *(F.kll_merge_agg_double(f"quantiles_{c}").alias(f"quantiles_{c}") for c in numeric))
    counts = [F.hll_sketch_estimate(f"distinct_{c}").alias(f"distinct_{c}") for c in distinct]
    ranks = F.array(*map(F.lit, at))
    return merged.select("n", *counts, *(F.kll_sketch_get_quantile_double(f"quantiles_{c}", ranks).alias(f"quantiles_{c}") for c in numeric))
