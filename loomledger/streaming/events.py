"""Traces and activity as streams: daily statistics and sessions, and the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "trace_id string, query string, start_time timestamp, duration_ms double, status string, error_message string, user_id string, session_id string, channel string, metrics struct<cost:double,total_tokens:long>"


def traces(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Trace files of a folder; as a stream, files that appear later follow."""
    return (spark.readStream if streaming else spark.read).schema(TRACE).option("multiLine", "true").json(path)


def search(df: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    if status is not None:
        df = df.where(F.col("status") == status)
    if text:
        low = text.lower()
        df = df.where(F.lower("query").contains(low) | F.lower("trace_id").contains(low))
    return df


def trace_stats(df: DataFrame, *by: str) -> DataFrame:
    """Over all traces, or per status, day (of ``start_time``) or both."""
    keys = [F.to_date("start_time").alias("day") if c == "day" else F.col(c) for c in by]
    ok = F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(ok, 6).alias("success_rate"), F.round(F.sum("metrics.cost"), 6).alias("cost"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.round(F.avg("metrics.total_tokens"), 6).alias("mean_tokens"))


def first_seen(df: DataFrame, key: list[str], time: str = "ts", ttl: str = "30 minutes") -> DataFrame:
    """Of a stream's events with one key those that come after ``ttl`` of silence; older state is dropped."""
    return df.withWatermark(time, ttl).dropDuplicatesWithinWatermark(key)


def daily(df: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events and value per day and type.  On a stream a day is final ``delay`` after its end."""
    if df.isStreaming:
        df = df.withWatermark(time, delay)
    out = df.groupBy(F.window(time, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def sessions(df: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """A user's session ends when nothing happens for ``gap``."""
    if df.isStreaming:
        df = df.withWatermark(time, delay)
    out = df.groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    # A session window ends a gap after its last event.
    return out.select(user, F.col("w.start").alias("started"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("last_event"), "n")


def last_turns(df: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")
