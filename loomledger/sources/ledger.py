"""Ledgers: over the driver's tables, from files, synthetic; profiles, caches and sinks."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fiscal


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def sample_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger view of the order tables.  Spark reads only the columns that a query uses."""
    line, orders, customer, nation, region, part = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region", "part")
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .join(part, line.l_partkey == part.p_partkey)
    )
    kind = F.split("p_type", " ")[0]
    prefix = F.when(kind == "PROMO", "40").when(kind == "STANDARD", "51").when(kind == "ECONOMY", "52").when(kind == "SMALL", "53").when(kind == "MEDIUM", "59").otherwise("61")
    category = F.when(kind == "PROMO", "Revenue").when(kind == "STANDARD", "Cost of Sales").when(kind == "ECONOMY", "R&D").when(kind == "SMALL", "Sales & Marketing").when(kind == "MEDIUM", "G&A").otherwise("Interest")
    trandate = F.col("l_shipdate").cast("date")
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.concat(prefix, F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 2, "0"), F.lit("00")).alias("account_number"),
        F.concat(category, F.lit(" : "), F.col("p_brand")).alias("account_name"),
        F.concat(F.col("r_name"), F.lit(" (Parent) : "), F.col("n_name")).alias("department_name"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(5,2)"))).cast("decimal(18,4)").alias("amount"),
        trandate.alias("trandate"),
        F.trunc(trandate, "MM").alias("period_start"),
        F.date_format(trandate, "MMM yyyy").alias("periodname"),
        F.when(F.col("l_returnflag") == "N", "Journal").when(F.col("l_returnflag") == "R", "VendBill").otherwise("ExpRept").alias("type"),
        F.col("c_mktsegment").alias("subsidiary"),
    )


#: The same view for DuckDB.
LEDGER_SQL = """
ledger AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN '40' WHEN 'STANDARD' THEN '51' WHEN 'ECONOMY' THEN '52' WHEN 'SMALL' THEN '53' WHEN 'MEDIUM' THEN '59' ELSE '61' END
      || lpad(regexp_extract(p_brand, '(\\d+)', 1), 2, '0') || '00' AS account_number,
    CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 'Revenue' WHEN 'STANDARD' THEN 'Cost of Sales' WHEN 'ECONOMY' THEN 'R&D' WHEN 'SMALL' THEN 'Sales & Marketing' WHEN 'MEDIUM' THEN 'G&A' ELSE 'Interest' END
      || ' : ' || p_brand AS account_name,
    r_name || ' (Parent) : ' || n_name AS department_name,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))) AS DECIMAL(18,4)) AS amount,
    CAST(l_shipdate AS DATE) AS trandate,
    CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS period_start,
    strftime(l_shipdate, '%b %Y') AS periodname,
    CASE l_returnflag WHEN 'N' THEN 'Journal' WHEN 'R' THEN 'VendBill' ELSE 'ExpRept' END AS type,
    c_mktsegment AS subsidiary
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
)
"""


def sql_over(ledger: DataFrame, text: str, name: str = "ledger") -> DataFrame:
    """The result of a SQL query in which ``{ledger}`` stands for the ledger."""
    return ledger.sparkSession.sql(text, **{name: ledger})


def account_list(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """The first accounts by number, each with its (greatest) name."""
    return ledger.where("account_number is not null").groupBy("account_number").agg(F.max("account_name").alias("account_name")).orderBy("account_number").limit(limit)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The rows of paged JSON responses (``results`` arrays), every page of a folder in parallel; page order is not kept."""
    pages = spark.read.option("multiLine", "true").json(path)
    return pages.select(F.explode("results").alias("r")).select("r.*")


def synthetic_ledger(spark: SparkSession, rows: int, as_of=None, n_months: int = 12, seed: int = 7) -> DataFrame:
    """Seeded rows in the source's own text form, generated in parallel."""
    # Names that the generated rows draw from.
    departments = ["G&A (Parent) : Finance", "G&A (Parent) : People", "R&D (Parent) : Engineering", "R&D (Parent) : Product", "S&M (Parent) : Marketing", "S&M (Parent) : Sales"]
    accounts = ["410000", "511000", "521000", "531110", "531120", "591000", "598010", "611000"]
    categories = ["Revenue", "Cost of Sales", "R&D", "Sales & Marketing", "Sales & Marketing", "G&A", "G&A", "Interest"]
    types = ["VendBill", "Journal", "VendCred", "ExpRept"]
    start = as_of or fiscal.date(2025, 2, 1)
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(len(values))) + 1).cast("int"))
    k = (F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(len(accounts))) + 1).cast("int")
    cents = F.pmod(F.xxhash64("id", F.lit(seed + 3)), F.lit(1_000_000)) - 300_000
    day = F.add_months(F.lit(start), F.pmod(F.xxhash64("id", F.lit(seed + 4)), F.lit(n_months)).cast("int")) + F.pmod(F.xxhash64("id", F.lit(seed + 5)), F.lit(28)).cast("int")
    return spark.range(rows).select(
        F.element_at(F.array(*map(F.lit, accounts)), k).alias("account_number"),
        F.concat(F.element_at(F.array(*map(F.lit, categories)), k), F.lit(" : Line")).alias("account_name"),
        pick(departments, 1).alias("department_name"),
        (cents / 100).cast("decimal(18,2)").cast("string").alias("amount"),
        F.date_format(day, "M/d/yyyy").alias("trandate"),
        F.date_format(day, "MMM yyyy").alias("accountingPeriod_periodname"),
        pick(["US", "UK"], 6).alias("subsidiarynohierarchy"),
        pick(types, 7).alias("type"),
    )


def profile(df: DataFrame, *numeric: str) -> DataFrame:
    """``column, n, total, low, high, mean`` of each numeric column, in one pass."""
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.sum(c).cast("double").alias("total"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).cast("double").alias("mean")) for c in numeric]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x"))


class ResultCache:
    """Persisted results by query hash, for ``ttl`` seconds.  ``filtered`` answers any filter from a kept base."""

    def __init__(self, ttl: float = 900, clock=time.time):
        self.ttl, self.clock, self.held = ttl, clock, {}

    @staticmethod
    def key(spec: object) -> str:
        return hashlib.sha256(repr(spec).encode()).hexdigest()

    def get(self, spec: object, build) -> DataFrame:
        key, now = self.key(spec), self.clock()
        for k in [k for k, (at, _) in self.held.items() if now - at > self.ttl]:
            self.held.pop(k)[1].unpersist()
        if key not in self.held:
            self.held[key] = (now, build().persist())
        return self.held[key][1]

    def filtered(self, base: object, build, predicate) -> DataFrame:
        """Rows of the base (kept under its own key) for which the predicate holds: the source is read once for all filters."""
        return self.get(base, build).where(predicate)

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1][1].unpersist()


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Sinks: parquet (a ledger by fiscal year), JSON lines or CSV."""
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.option("header", "true").format(kind).save(path)


