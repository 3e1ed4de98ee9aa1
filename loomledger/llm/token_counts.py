"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are aggregated by encoded length (a partial sum in every task); suffix sums over the
histogram, whose size is the number of distinct lengths, then answer for any limit L how many tokens
there are, how many a cut at L keeps, and how many documents are longer.  The suffix sums run in two
levels (ranges of lengths, then lengths in a range), so no task sees the whole histogram.

Edge cases: a null or empty text has length 0; limits between lengths are answered from the next
smaller length; an empty table gives an empty histogram, and every answer for it is 0 (quantiles: None).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, texts
from .encoding import shared_encoder

RANGE = 1024


def encoded_lengths(docs: DataFrame, tokenizer_path: str, keeps_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path, keeps_space)
        for batch in batches:
            n = [len(x) // encoder.dtype.itemsize for x in encoder.encode(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def length_table(lengths: DataFrame) -> DataFrame:
    """Per distinct length: ``n_tokens, n_docs, docs_up_to, docs_longer, tokens_up_to, tokens_truncated, tokens_total``.

    ``tokens_truncated`` is what is left of the corpus when every document is cut at this length.
    """
    hist = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    hist = Workspace(lengths.sparkSession).table(hist, "histogram")  # both levels read it
    hist = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    hist = hist.withColumn("range", F.floor(F.col("n_tokens") / RANGE).cast("long"))
    after = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    longer = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(ranges, "range").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("d_after")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("t_after")).alias("tokens_longer"),
        "d_all",
        F.col("t_all").alias("tokens_total"),
    )
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_up_to"),
        "docs_longer",
        (F.col("tokens_total") - F.col("tokens_longer")).alias("tokens_up_to"),
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_truncated"),
        "tokens_total",
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``."""
    row = table.where(F.col("n_tokens") <= limit).orderBy(F.col("n_tokens").desc()).first()
    if row:
        return row.tokens_up_to + row.docs_longer * limit
    return limit * (table.agg(F.sum("n_docs")).first()[0] or 0)


def quantile(table: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents do not exceed."""
    row = table.where(F.col("docs_up_to") >= (F.col("docs_up_to") + F.col("docs_longer")) * F.lit(q)).orderBy("n_tokens").first()
    return row.n_tokens if row else None
