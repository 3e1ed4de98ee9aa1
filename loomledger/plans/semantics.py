"""What finance words mean as filters.  The values are fixed: they say which accounts a word names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import index


@dataclass(frozen=True)
class Meaning:
    prefixes: tuple[str, ...] = ()
    account_names: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    subsidiaries: tuple[str, ...] = ()
    options: tuple[tuple[str, "Meaning"], ...] = field(default=())  # ambiguous: a choice to be made


def _prefix(*p: str) -> Meaning:
    return Meaning(prefixes=p)


def _name(*n: str) -> Meaning:
    return Meaning(account_names=n)


_COST_OF_SALES = Meaning(options=(("cost of goods sold accounts (51)", _prefix("51")), ("accounts named cost of sales", _name("cost of sales")), ("both", Meaning(("51",), ("cost of sales",)))))
_RND = Meaning(options=(("research and development accounts (52)", _prefix("52")), ("accounts named R&D", _name("r&d")), ("both", Meaning(("52",), ("r&d",)))))
_GNA = Meaning(options=(("general and administrative accounts (59)", _prefix("59")), ("accounts named G&A", _name("g&a")), ("both", Meaning(("59",), ("g&a",)))))
_SALES = Meaning(options=(("revenue accounts (4)", _prefix("4")), ("sales and marketing accounts (53)", _prefix("53"))))

# Words with one meaning each, then the meaning.
GROUPS: list[tuple[list[str], Meaning]] = [
    (["revenue", "sales revenue", "income", "revenues"], _prefix("4")),
    (["operating expenses", "opex", "operating costs", "expenses", "expense", "spend", "spending", "costs"], _prefix("5")),
    (["all expenses", "all expense"], _prefix("5", "6", "7", "8")),
    (["cogs", "cost of goods sold", "cost of sales", "cos"], _COST_OF_SALES),
    (["r&d", "research and development", "research & development"], _RND),
    (["sales and marketing", "sales & marketing", "s&m"], _prefix("53")),
    (["g&a", "general and administrative", "general & administrative"], _GNA),
    (["depreciation", "amortization", "depreciation and amortization", "depreciation & amortization", "d&a"], _prefix("598")),
    (["interest", "interest expense", "interest income"], _prefix("6")),
    (["income tax", "other expenses", "other income"], _prefix("7", "8")),
    (["salary", "salaries"], _name("salary", "salaries")),
    (["payroll", "compensation"], _name("payroll", "compensation")),
    (["benefits", "employee benefits"], _name("benefits")),
    (["rent", "rent expense"], _name("rent")),
    (["utilities", "utilities expense"], _name("utilities")),
    (["software", "software expense", "saas", "subscriptions"], _name("software", "subscription")),
    (["travel", "travel expense", "travel and entertainment", "t&e"], _name("travel")),
    (["insurance"], _name("insurance")),
    (["professional services", "consulting"], _name("professional", "consulting")),
    (["legal"], _name("legal")),
    (["assets", "asset"], _prefix("1")),
    (["liabilities", "liability"], _prefix("2")),
    (["equity"], _prefix("3")),
    (["sales and marketing expenses", "sales and marketing costs", "sales and marketing spend", "sales & marketing expenses", "s&m expenses"], Meaning(("53",), ("sales & marketing",))),
    (["product development costs", "r&d costs"], Meaning(("52",), ("r&d",))),
    (["g&a costs", "general and administrative costs"], Meaning(("59",), ("g&a",))),
    (["cost of sales cost", "cost of sales costs"], Meaning(("5",), ("cost of sales",))),
    (["sales"], _SALES),
    (["journal entries", "journals", "journal entry"], Meaning(types=("Journal",))),
    (["invoices", "customer invoices"], Meaning(types=("CustInvc",))),
    (["bills", "vendor bills"], Meaning(types=("VendBill",))),
    (["payments"], Meaning(types=("CustPymt", "VendPymt"))),
    (["expense reports"], Meaning(types=("ExpRept",))),
    (["us", "us subsidiary", "united states"], Meaning(subsidiaries=("US",))),
    (["uk", "uk subsidiary", "united kingdom"], Meaning(subsidiaries=("UK",))),
    (["europe", "emea"], Meaning(subsidiaries=("Europe", "EMEA"))),
    (["apac", "asia pacific"], Meaning(subsidiaries=("APAC",))),
    (["canada"], Meaning(subsidiaries=("Canada",))),
    (["australia"], Meaning(subsidiaries=("Australia",))),
    (["germany"], Meaning(subsidiaries=("Germany",))),
    (["france"], Meaning(subsidiaries=("France",))),
    (["parent company"], Meaning(subsidiaries=("Parent",))),
    (["consolidated"], Meaning(subsidiaries=("*",))),
]

TERMS: dict[str, Meaning] = {w: m for words, m in GROUPS for w in words}


def dictionary(spark: SparkSession) -> DataFrame:
    """``term, choice, kind, value``: a row per filter that a term stands for; ``choice`` is null unless the term is ambiguous."""
    rows = []
    for term, meaning in TERMS.items():
        for choice, m in meaning.options or ((None, meaning),):
            for kind, values in (("account_prefix", m.prefixes), ("account_name", m.account_names), ("type", m.types), ("subsidiary", m.subsidiaries)):
                rows.extend((term, choice, kind, v) for v in values)
    return spark.createDataFrame(rows, "term string, choice string, kind string, value string")


def resolve(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """``term, choice, kind, value`` for a table of terms: what the dictionary says, else the entities of that alias.

    Case and outer blanks do not matter; a term that neither knows has one row of nulls.
    """
    asked = asked.select(F.lower(F.trim("term")).alias("term")).distinct()
    known = asked.join(F.broadcast(dictionary(asked.sparkSession)), "term")  # a fixed table
    rest = asked.join(known.select("term").distinct(), "term", "left_anti")
    entities = index(registry).select(F.col("alias").alias("term"), F.lit(None).cast("string").alias("choice"), "kind", F.col("name").alias("value")).distinct()
    return known.select("term", "choice", "kind", "value").unionByName(rest.join(entities, "term", "left").select("term", "choice", "kind", "value"))
