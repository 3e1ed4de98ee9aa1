"""Sum-of-squares packing of documents into sequences of at most ``capacity`` tokens.

Documents longer than a sequence are cut into full pieces with the remainder first; every other
document stays whole.  Pieces are dealt evenly to shards by hash and each shard packs its own: a
piece goes where it makes the sum, over residual gaps, of the squared number of open bins with that
gap smallest, which keeps every gap useful for what is still to come.  Larger pieces go first, and a
sequence is opened only when no open one has room.  What a shard leaves half open is packed once more across shards.  The state is one counter per gap.

Edge cases: a null or empty text is the end id alone; repeated documents are packed again; pieces
of exactly ``capacity`` fill a sequence by themselves; an empty table gives no sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, texts
from .encoding import ids_crc32, shared_encoder

PIECES_PER_SHARD = 60_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; the first takes what does not fill a sequence."""
    head = n % capacity or capacity
    return [(0, min(head, n)), *((at, capacity) for at in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, keeps_space: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path, keeps_space)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, encoder.dtype)
                rows.extend((doc, k, at, n, ids_crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), capacity)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``bin, offset`` of each length, taken in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    where: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        # Change of the sum when a bin's gap shrinks from g to g - size; gap 0 is closed and not counted.
        # A new sequence is opened only when no open one has room: pieces come largest first.
        best = capacity
        if size < capacity:
            gaps = np.flatnonzero(count[size:capacity]) + size
            if len(gaps):
                change = 2 * (np.where(gaps > size, count[gaps - size] + 1, 0) - count[gaps])
                best = int(gaps[change.argmin()])
        if best == capacity:
            bin_, used = n_bins, 0
            n_bins += 1
        else:
            bin_, used = where[best].pop()
            count[best] -= 1
        bins[k], offsets[k] = bin_, used
        if left := capacity - used - size:
            where[left].append((bin_, used + size))
            count[left] += 1
    return bins, offsets


def _pack_shard(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
    return frame.assign(bin=bins + (frame["shard"].to_numpy() << 32), offset=offsets)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, keeps_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece."""
    ws = Workspace(spark)
    cut_up = ws.table(pieces(texts(docs, id_col, text_col), tokenizer_path, end_id, capacity, keeps_space), "pieces")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_up.schema) + ", shard long, bin long, offset long"
    shards = max(1, math.ceil(cut_up.count() / PIECES_PER_SHARD))
    dealt = cut_up.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(shards)))
    packed = ws.table(dealt.groupBy("shard").applyInPandas(lambda frame: _pack_shard(frame, capacity), fields), "packed")

    # Half-open sequences of the shards, as items of a second packing; full ones stay as they are.
    fill = packed.groupBy("bin").agg(F.sum("length").alias("length"))
    open_ = fill.where(F.col("length") < capacity)
    again = max(1, math.ceil(open_.count() / PIECES_PER_SHARD))
    moved = (
        open_.select(F.col("bin").alias("doc_id"), F.lit(0).alias("piece"), "length", F.pmod(F.xxhash64("bin"), F.lit(again)).alias("shard"))
        .groupBy("shard")
        .applyInPandas(lambda frame: _pack_shard(frame, capacity), "doc_id long, piece int, length long, shard long, bin long, offset long")
        .select(F.col("doc_id").alias("bin"), (-1 - F.col("bin")).alias("to"), F.col("offset").alias("by"))
    )
    return packed.join(moved, "bin", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"),
    )
