"""The longest prefix of a value in a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(facts: DataFrame, rules: DataFrame, value: str, prefix: str = "prefix") -> DataFrame:
    """Facts with the columns of the rule whose prefix is the longest that ``value`` begins with; nulls where none fits.

    Each distinct value is cut to every length that a rule has and joined by equality, so neither side is compared with
    all of the other.  Of rules with one prefix the least row counts; an empty prefix fits every value but null.
    """
    rest = [c for c in rules.columns if c != prefix]
    known = rules.where(F.col(prefix).isNotNull()).groupBy(F.col(prefix).alias("__prefix")).agg(F.min(F.struct(prefix, *rest)).alias("__rule"))
    lengths = [r[0] for r in known.select(F.length("__prefix")).distinct().collect()]  # as many as the longest rule has characters
    cuts = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    values = facts.select(F.col(value).cast("string").alias("__value")).where("__value is not null").distinct()
    cut = values.select("__value", F.explode(F.filter(cuts, lambda n: n <= F.length("__value"))).alias("__n"))
    cut = cut.withColumn("__prefix", F.left("__value", F.col("__n")))
    best = cut.join(known, "__prefix").groupBy("__value").agg(F.max_by("__rule", "__n").alias("__rule"))
    return facts.join(best, F.col(value).cast("string") == F.col("__value"), "left").select(*facts.columns, "__rule.*")
