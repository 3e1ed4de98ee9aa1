"""A stream's days kept in a table that each batch corrects, late events included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PARTS = "event_type string, n long, total decimal(38,6), day date, batch long"


class DailyTable:
    """Events per day and type.  Each batch writes its own share of the days that it touches, and of no other, under its number.

    A batch that runs again replaces its shares, so its events count once; events that come days late change only their
    own day.  Reading adds the shares up; ``compact`` replaces those of finished batches by one.
    """

    def __init__(self, spark: SparkSession, path: str, time: str = "ts", value: str = "value"):
        self.spark, self.path, self.time, self.value = spark, path, time, value

    def upsert(self, events: DataFrame, batch: int) -> None:
        """Idempotent by ``batch``; the partition of a day without events in it is left as it is."""
        share = events.where(F.col(self.time).isNotNull()).groupBy("event_type", F.to_date(self.time).alias("day"))
        share = share.agg(F.count("*").alias("n"), F.sum(F.col(self.value).cast("decimal(28,6)")).cast("decimal(38,6)").alias("total")).withColumn("batch", F.lit(batch).cast("long"))
        share.select("event_type", "n", "total", "day", "batch").repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def follow(self, events: DataFrame, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
        """Takes all that a stream has now, batch by batch."""

        def write(batch: DataFrame, number: int) -> None:
            self.upsert(batch, number)
            if then:
                then(number)

        return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """``day, event_type, n, total`` over all batches."""
        shares = self.spark.read.schema(PARTS).parquet(self.path)
        return shares.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total").cast("double"), 4).alias("total"))

    def compact(self, upto: int, path: str) -> DailyTable:
        """A new table in which the batches through ``upto``, which must not run again, are one; later ones stay."""
        shares = self.spark.read.schema(PARTS).parquet(self.path)
        merged = shares.groupBy("event_type", "day", F.greatest(F.col("batch"), F.lit(upto)).alias("batch")).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"))
        merged.select("event_type", "n", "total", "day", "batch").repartition("day").write.partitionBy("day", "batch").parquet(path)
        return DailyTable(self.spark, path, self.time, self.value)
