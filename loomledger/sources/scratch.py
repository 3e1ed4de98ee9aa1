"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir``: they cut a plan and, unlike executor storage, survive lost executors.

    Only a session on one machine may do without the setting; it then gets a temporary folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "")
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="loomledger-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
