"""What the training-data operators share: inputs, shared scratch tables and word splitting.

Conventions that hold for every operator here:

* Only the named id and text columns are read, so extra columns, whatever their names, change nothing.
* A null text is an empty text.  A row whose id is null cannot be named in a result and is left out.
* Repeated rows (same id, same text) are each processed; where a result has one row per document it
  has one per input row.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship



def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id long, text string`` and the columns ``carry`` of the rows that have an id; a null text becomes empty."""
    ship(df.sparkSession)
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
        *(df[c] for c in carry),
    ).where(F.col("doc_id").isNotNull())


def lower_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8, with A-Z (and nothing else) lower-cased."""
    return text.encode("utf-8").lower().split()


def words_column(text: Column) -> Column:
    """Runs of anything but ASCII white space, as an array column."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside frees its shuffle files at its end; else they stay until the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


class Workspace:
    """Parquet tables in the folder that driver and executors share (``spark.checkpoint.dir``).

    Iterative jobs cut their lineage by writing here and reading again; unlike executor storage,
    these files survive lost executors.  Only a session on one machine may do without the setting.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "")
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="loomledger-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        with shuffles_freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Free the files of tables that no later step reads."""
        for df in frames:
            self.remove(df._loom_path)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
