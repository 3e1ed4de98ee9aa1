"""A stored ledger: partitioned by month, bucketed by account, with the chart of accounts in the same buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

MONTH, ACCOUNT = "period_start", "account_number"


class LedgerStore:
    """Two tables under one folder: lines by month (``period_start``) and, within, by a hash of the account; and accounts by the same hash.

    A question about a period reads its months only; lines meet their accounts without an exchange; late lines rewrite
    the months that they belong to and no other.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 8):
        self.spark, self.buckets = spark, buckets
        self.scratch = Scratch(spark)
        self.base = path or self.scratch.path("ledger")
        mark = uuid.uuid4().hex[:12]
        self.lines, self.accounts = f"loom_lines_{mark}", f"loom_accounts_{mark}"

    def _save(self, df: DataFrame, name: str, part: str, *partitions: str) -> None:
        out = df.write.mode("overwrite").option("path", f"{self.base}/{part}").bucketBy(self.buckets, ACCOUNT).sortBy(ACCOUNT)
        (out.partitionBy(*partitions) if partitions else out).saveAsTable(name)

    def write(self, ledger: DataFrame) -> LedgerStore:
        """Rows without a month go to the partition of null.  One task writes a month, or a part of a large one, so files stay few."""
        columns = [c for c in ledger.columns if c != MONTH]
        self._save(ledger.select(*columns, MONTH).repartition(F.col(MONTH), F.pmod(F.hash(ACCOUNT), F.lit(self.buckets))), self.lines, "lines", MONTH)
        return self

    def write_accounts(self, accounts: DataFrame) -> LedgerStore:
        """One row per account."""
        self._save(accounts.repartition(self.buckets, ACCOUNT), self.accounts, "accounts")
        return self

    def ledger(self) -> DataFrame:
        return self.spark.table(self.lines)

    def with_accounts(self, lines: DataFrame | None = None) -> DataFrame:
        """Lines with the columns of their account; both sides are in the same buckets already."""
        return (self.ledger() if lines is None else lines).join(self.spark.table(self.accounts).hint("merge"), ACCOUNT)

    def add(self, late: DataFrame) -> None:
        """Append late lines: the months that they name are rewritten, all others stay as they are.

        Overwriting single partitions is a setting of a session, so this happens in a session of its own.  What is read
        is written aside first: a table cannot be read and overwritten at once, and a failure then leaves it whole.
        """
        names = self.ledger().columns
        late = self.scratch.table(late.select(*names), "late")
        months = late.select(F.col(MONTH).alias("__month")).distinct()
        kept = self.ledger().join(F.broadcast(months), F.col(MONTH).eqNullSafe(F.col("__month")), "left_semi")  # months, whatever the lines
        aside = self.scratch.path("merged")
        kept.unionByName(late).write.parquet(aside)
        session = self.spark.newSession()
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        session.read.parquet(aside).select(*names).repartition(F.col(MONTH), F.pmod(F.hash(ACCOUNT), F.lit(self.buckets))).write.mode("overwrite").insertInto(self.lines)
        self.spark.catalog.refreshTable(self.lines)

    def drop(self) -> None:
        for name in (self.lines, self.accounts):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
