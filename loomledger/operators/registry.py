"""A catalogue of the names in a ledger, and looking terms up in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import aliases, match_score, tokens

# Kind of entity, its column, and what is listed with it.
KINDS = {
    "department": ("department_name", None),
    "account": ("account_name", "account_number"),
    "account_number": ("account_number", "account_name"),
    "subsidiary": ("subsidiary", None),
    "transaction_type": ("type", None),
}


def build(ledger: DataFrame) -> DataFrame:
    """``kind, name, n_rows, related, aliases`` of every distinct value, in one scan.

    Each row gives a (kind, name, related) triple per kind; counts are partial sums in each task.
    """
    there = [(k, c, r) for k, (c, r) in KINDS.items() if c in ledger.columns]
    text = lambda c: F.col(c).cast("string")
    triples = [F.struct(F.lit(k).alias("kind"), text(c).alias("name"), (text(r) if r in ledger.columns else F.lit(None).cast("string")).alias("related")) for k, c, r in there]
    rows = ledger.select(F.inline(F.array(*triples))).where("name is not null and trim(name) <> ''")
    counted = rows.groupBy("kind", "name", "related").agg(F.count("*").alias("n"))
    # The name comes out of an aggregate: a condition on names or aliases then stays above it, instead of being worked out for every ledger row.
    out = counted.groupBy("kind", F.col("name").alias("key")).agg(F.max("name").alias("name"), F.sum("n").alias("n_rows"), F.array_sort(F.collect_set("related")).alias("related"))
    return out.drop("key").withColumn("aliases", aliases(F.col("name")))


def index(registry: DataFrame) -> DataFrame:
    """The inverted index: a row per alias."""
    return registry.select(F.explode_outer("aliases").alias("alias"), "kind", "name", "n_rows").where("alias is not null")


def lookup(registry: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """``kind, name, score, n_rows``, best first; a blank term names nothing."""
    scored = registry.withColumn("score", F.round(match_score(F.lit(term), F.col("name"), F.col("aliases")), 4))
    found = scored.where((F.col("score") > 0) & F.lit(bool(term.strip())))
    return found.orderBy(F.desc("score"), F.desc("n_rows"), "kind", "name").limit(limit).select("kind", "name", "score", "n_rows")


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct strings of ``size`` characters in a text."""
    n = F.length(text) - size + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _all_grams(text: Column) -> Column:
    return F.concat(*(_grams(text, k) for k in range(1, GRAM + 1)))


def _marked(mark: str, texts: Column) -> Column:
    return F.transform(texts, lambda x: F.concat(F.lit(mark), x))


def entity_keys(registry: DataFrame) -> DataFrame:
    """``key, kind, name``: what the terms that score on an entity have in common with it.

    A term scores by being one of the entity's texts (its name, its last segment, an alias: key ``=``), by sharing a word
    (``w``), by lying in one of the texts (then each of its grams is one of theirs: ``g``) or by holding one (then it has
    that text's first gram: ``f``).
    """
    low = F.lower("name")
    own = F.array_distinct(F.concat(F.array(low, F.trim(F.element_at(F.split(low, " : "), -1))), F.col("aliases")))
    texts = registry.select("kind", "name", F.filter(own, lambda x: x != "").alias("texts"), tokens(low).alias("words"))
    grams = F.array_distinct(F.flatten(F.transform("texts", _all_grams)))
    first = F.array_distinct(F.transform("texts", lambda x: F.left(x, F.lit(GRAM))))
    keys = F.concat(_marked("=", F.col("texts")), _marked("w", F.col("words")), _marked("g", grams), _marked("f", first))
    return texts.select("kind", "name", F.explode_outer(keys).alias("key"))


def term_keys(terms: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """``term, key``: keys one of which every entity that scores ``least`` or more has.

    Of the grams of a term, which must all be there, the rarest is enough; likewise of its words, if sharing some of them (0.3) is not enough.
    """
    q = F.lower(F.trim("term"))
    asked = terms.select("term").where("term is not null").distinct().select("term", q.alias("q"), tokens(q).alias("words")).where("q <> ''")
    short = F.size("words") <= 1
    none = F.array().cast("array<string>")
    wide = F.when(F.length("q") >= GRAM, _grams(F.col("q"), GRAM)).otherwise(F.array("q"))
    every = F.concat(F.array(F.concat(F.lit("="), F.col("q"))), F.when(short, _marked("f", _all_grams(F.col("q")))).otherwise(none), _marked("w", F.col("words")) if least <= 0.3 else none)
    needed = F.array(F.when(short, _marked("g", wide)).otherwise(none), none if least <= 0.3 else _marked("w", F.col("words")))
    sets = asked.select("term", F.posexplode(needed).alias("which", "keys")).select("term", "which", F.explode("keys").alias("key"))
    found = sets.join(counts, "key", "left").groupBy("term", "which").agg(F.min_by("key", F.struct("n", "key")).alias("key"), F.count_if(F.col("n").isNull()).alias("missing"))
    return asked.select("term", F.explode(every).alias("key")).unionByName(found.where("missing = 0").select("term", "key")).distinct()


def lookup_all(registry: DataFrame, terms: DataFrame, least: float = 0.3) -> DataFrame:
    """``term, kind, name, n_rows, score``: every entity on which a term scores ``least`` (over 0) or more.

    Candidates come from an inverted index by a plain join, so terms are not compared with the whole catalogue; the
    index leaves none out (see ``entity_keys``).  Null and blank terms name nothing.
    """
    if least <= 0:
        raise ValueError("least must be over 0")
    keys = entity_keys(registry)
    asked = term_keys(terms, keys.groupBy("key").agg(F.count("*").alias("n")), least)
    candidates = asked.join(keys, "key").select("term", "kind", "name").distinct()
    score = F.round(match_score(F.col("term"), F.col("name"), F.col("aliases")), 4)
    return candidates.join(registry.select("kind", "name", "n_rows", "aliases"), ["kind", "name"]).withColumn("score", score).where(F.col("score") >= least).select("term", "kind", "name", "n_rows", "score")


def is_ambiguous(found: list, margin: float = 0.1) -> bool:
    """Whether several entities are about as good as the best."""
    return len(found) > 1 and found[0].score - found[1].score < margin
