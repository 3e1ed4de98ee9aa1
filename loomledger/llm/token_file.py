"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A file is a Parquet table with a row per block.  A block holds the ids of consecutive documents,
Huffman-coded into one bit string, with the bit offset of every ``CHECKPOINT``-th id, so that any
document can be decoded from the nearest checkpoint (``read_documents``).  The code comes from the id counts of the whole
corpus: lengths by package-merge, at most ``MAX_BITS``; only the lengths are stored (in each block),
because canonical codes follow from them.  Blocks are written in ascending id order.

Edge cases: a null or empty text is the end id alone; an alphabet of one id gets one-bit codes;
documents longer than a block get a block of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, texts
from .encoding import ids_crc32, shared_encoder

MAX_BITS = 16
BLOCK_TOKENS = 1 << 17
CHECKPOINT = 128
BLOCK_SCHEMA = "part int, block int, first_token long, n_tokens long, doc_ids binary, doc_tokens binary, checkpoints binary, code_lengths binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code length (uint8) of every symbol with a count, none over ``limit``: package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n, levels, level = len(order), [], weight
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weight, pairs])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)  # True: a symbol, False: a package of two from the level below
        level = merged[rank]
    take, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    depth[0] += 1
    depth[min(take, n)] -= 1
    lengths[order] = np.cumsum(depth[:n])
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    widths = lengths[order].astype(np.int64)
    steps = np.left_shift(np.int64(1), MAX_BITS - widths)
    codes[order] = ((np.cumsum(steps) - steps) >> (MAX_BITS - widths)).astype(np.uint32)
    return codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ids, and the bit offset of every ``CHECKPOINT``-th id."""
    widths = lengths[ids].astype(np.int64)
    ends = np.cumsum(widths)
    starts = ends - widths
    total = int(ends[-1]) if len(ends) else 0
    # Each code lies in the 64 bits from a 32-bit boundary on; codes of one boundary do not overlap, so they add up.
    word = starts >> 5
    window = codes[ids].astype(np.uint64) << (64 - widths - (starts & 31)).astype(np.uint64)
    words = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[first]] += np.add.reduceat(window >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT].astype("<i8")


@lru_cache(maxsize=2)
def decoding_table(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The id that each run of ``MAX_BITS`` bits begins with, and the code lengths, from the lengths as stored."""
    lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
    symbols = np.flatnonzero(lengths)
    table = np.zeros(1 << MAX_BITS, np.uint32)
    shift = MAX_BITS - lengths[symbols].astype(np.int64)
    order = np.argsort(canonical_codes(lengths)[symbols].astype(np.int64) << shift)
    filled = np.repeat(symbols[order], 1 << shift[order])
    table[: len(filled)] = filled
    return table, lengths.astype(np.int64)


def decode_bits(payload: bytes, checkpoints: np.ndarray, n: int, packed_lengths: bytes) -> np.ndarray:
    """Table-driven decoding: all stretches between checkpoints advance together, an id a step."""
    table, lengths = decoding_table(packed_lengths)
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    at = checkpoints.astype(np.int64).copy()
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    size = len(words) - 1
    for k in range(min(CHECKPOINT, n)):
        window = (words[np.minimum(at >> 3, size)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        got = table[window]
        out[k] = got
        at += lengths[got]
    return out.T.reshape(-1)[:n]


def decode_range(payload: bytes, checkpoints: np.ndarray, n: int, packed_lengths: bytes, first: int, size: int) -> np.ndarray:
    """Ids ``first`` to ``first + size`` of a block of ``n``, from the last checkpoint at or before the first of them."""
    low, high = first // CHECKPOINT, -(-(first + size) // CHECKPOINT)
    skipped = low * CHECKPOINT
    ids = decode_bits(payload, checkpoints[low:high], min(n, high * CHECKPOINT) - skipped, packed_lengths)
    return ids[first - skipped : first - skipped + size]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, keeps_space: bool) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids of the text and the end id, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path, keeps_space)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
            n = pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64())
            yield pa.record_batch([batch.column(0), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def write_token_file(spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, keeps_space: bool = False, vocabulary: int = 49_408, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every document, with ``end_id`` after each, to ``path``."""
    ws = Workspace(spark)
    width = 2 if vocabulary <= 1 << 16 else 4
    dtype = np.dtype(f"<u{width}")
    tokens = ws.table(tokenize(texts(docs, id_col, text_col), tokenizer_path, end_id, keeps_space), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, dtype), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    # As many rows as the vocabulary has ids, whatever the corpus.
    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    if not rows:
        spark.createDataFrame([], BLOCK_SCHEMA).write.parquet(path)
        return

    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zlib.compress(lengths.tobytes())
        held: list[tuple[int, bytes]] = []
        size = block = first = part = 0

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), dtype)
            payload, marks = encode_bits(ids, codes, lengths)
            per_doc = np.array([len(x) // width for _, x in held], "<i8")
            row = [part, block, first, len(ids), np.array([d for d, _ in held], "<i8").tobytes(), per_doc.tobytes(), marks.tobytes(), known, payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc, ids, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and size + len(ids) // width > BLOCK_TOKENS:
                    yield flush()
                    block, first, held, size = block + 1, first + size, [], 0
                held.append((doc, ids))
                size += len(ids) // width
        if held:
            yield flush()

    ordered.select("doc_id", "ids", "part").mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)
    ws.drop(tokens)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``), decoded from the blocks."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # A row for each part of the file: how many ids the parts before it hold.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(parts, key=lambda r: r.part):
        before[r.part], at = at, at + r.n

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_bits(r["payload"], np.frombuffer(r["checkpoints"], "<i8"), r["n_tokens"], r["code_lengths"])
                docs, sizes = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_tokens"], "<i8")
                ends = np.cumsum(sizes)
                each = np.split(ids, ends[:-1])
                cols = [pa.array(docs), pa.array(ends - sizes + r["first_token"] + before[r["part"]]), pa.array(sizes), pa.array([ids_crc32(x) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each document lies in its block."""
    for batch in batches:
        for r in batch.to_pylist():
            docs, sizes = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_tokens"], "<i8")
            place = [pa.array(np.full(len(docs), r[c], np.int32)) for c in ("part", "block")]
            yield pa.record_batch([pa.array(docs), *place, pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)], ["doc_id", "part", "block", "first", "n"])


def _decode_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            marks = np.frombuffer(r["checkpoints"], "<i8")
            ids = [decode_range(r["payload"], marks, r["n_tokens"], r["code_lengths"], w["first"], w["n"]).astype(np.int32) for w in r["wanted"]]
            yield pa.record_batch([pa.array([w["doc_id"] for w in r["wanted"]], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` of the documents whose id is in ``wanted``, decoding no more than lies between the checkpoints around each.

    Ids that the file lacks, and null ones, give no row; an id that is asked for twice gives the rows that it has once.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    index = blocks.select("part", "block", "doc_ids", "doc_tokens").mapInArrow(_index, "doc_id long, part int, block int, first long, n long")
    asked = wanted.select(wanted[id_col].cast("long").alias("doc_id")).distinct()
    # A block holds BLOCK_TOKENS ids or one document, so its list is bounded.
    per_block = index.join(asked, "doc_id").groupBy("part", "block").agg(F.collect_list(F.struct("doc_id", "first", "n")).alias("wanted"))
    coded = blocks.select("part", "block", "n_tokens", "checkpoints", "code_lengths", "payload")
    return coded.join(per_block, ["part", "block"]).mapInArrow(_decode_wanted, "doc_id long, ids array<int>")
