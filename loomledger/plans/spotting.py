"""Terms of a table found in texts: of overlapping ones the longest, joined by all their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

BROADCAST_TERMS = 1 << 17
# Marks that may stand around a word without being part of it.
MARKS = """.,;:!?()"'-"""
EDGES = rf"^[{MARKS}]+|[{MARKS}]+$"


def words(text: Column) -> Column:
    """Lower-case words between blanks, without the marks around them; a mark alone (``&``) is a word if it is none of those."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def _longest_first(found: Column) -> Column:
    """Of ``n, at, term`` spans those that are left when the longest, then the first, take their words."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-x["n"]).alias("short"), x["at"].alias("at"), x["term"].alias("term"))))
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["at"] < x["at"] - x["short"]) & (x["at"] < y["at"] - y["short"]))
    none = F.array().cast("array<struct<short:int,at:int,term:string>>")
    return F.aggregate(ranked, none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))


def spot(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """The columns of ``texts`` but the text, with ``term, at, n_words`` for each occurrence that no longer one covers; ``at`` counts words from 0.

    Each word of a text with what follows it is cut to every length (in words) that a term has and joined by equality
    with the terms as a whole, so what is joined grows with the texts, however many terms begin alike.  Terms that are
    the same words are one, the least by text.  Null and empty texts and terms without a word have no occurrence.
    """
    keys = [c for c in texts.columns if c != text]
    known = terms.select(F.col(term).alias("term"), words(F.col(term)).alias("said")).where(F.size("said") > 0).groupBy("said").agg(F.min("term").alias("term"))
    known = Scratch(texts.sparkSession).table(known, "terms")
    sizes = known.groupBy(F.size("said").alias("n")).agg(F.count("*").alias("terms")).collect()  # a row per length
    lengths = F.array(*(F.lit(r.n) for r in sizes)).cast("array<int>")
    if sum(r.terms for r in sizes) <= BROADCAST_TERMS:
        known = F.broadcast(known)
    rows = texts.select(F.struct(F.monotonically_increasing_id().alias("__row"), *keys).alias("__of"), words(F.col(text)).alias("__words"))
    w = F.col("__words")
    cuts = lambda at: F.transform(F.filter(lengths, lambda n: at + n <= F.size(w)), lambda n: F.struct(at.alias("at"), F.slice(w, at + 1, n).alias("said")))
    places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1))
    each = rows.select("__of", F.inline(F.flatten(F.transform(places, cuts))))
    met = each.join(known, "said")
    spans = met.groupBy(F.col("__of.__row").alias("__row")).agg(F.any_value("__of").alias("__of"), F.collect_list(F.struct(F.size("said").alias("n"), "at", "term")).alias("found"))
    chosen = spans.select("__of", F.explode(_longest_first(F.col("found"))).alias("x"))
    return chosen.select(*(F.col("__of")[c].alias(c) for c in keys), "x.term", "x.at", (-F.col("x.short")).alias("n_words"))
