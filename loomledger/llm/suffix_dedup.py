"""Repeated byte strings: every byte that a ``LENGTH``-byte string occurring twice covers goes.

Sorting every suffix of a large corpus is out of reach, so suffixes are sampled by content: of the
hashes of all ``GRAM``-byte strings in a window of ``LENGTH`` bytes the least marks the window's
*anchor*.  Equal windows have equal anchors at equal offsets, so only suffixes at anchors that share
a hash can matter.  The stretch of text behind consecutive windows with one anchor is a *context*.

1. Anchors whose hash occurs once are dropped: their windows are unique.
2. Contexts that occur twice or more as a whole are repeated in full, wherever they occur; only one
   of the equal ones goes on.
3. The different contexts of one anchor are suffix-sorted: a merge sort that compares suffixes by
   their common extension, found by binary search over prefix polynomial hashes; extensions are
   verified byte by byte.  The extension to the right is the running minimum along the order, that
   to the left comes from the same hashes; together they say which windows two contexts share.
4. Anchors with more than ``SORTED`` different contexts go another, equally exact way that splits
   them over many tasks: their windows are counted by digest.

Rows of steps 2 and 4 carry no bytes to verify; what they compare are 128-bit BLAKE2b digests of all the
bytes, for which no two different texts with one digest are known.  Polynomial hashes only choose
anchors and speed the sort, whose extensions are verified.  Matches never cross documents: contexts
lie within one.  What is removed is judged on the input.

Edge cases: texts under ``LENGTH`` bytes stay whole; null texts are empty; a repeated row of one id is another
occurrence; runs of one character repeat themselves and go like any repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, texts
from .minhash import MASK, mix

LENGTH = 400
SPREAD = 128
GRAM = LENGTH - SPREAD + 1
SORTED = 64
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray, notes: np.ndarray) -> np.ndarray:
    """128-bit digests (two integers each) of stretches of ``data``, each followed by its note of four places."""
    digest = hashlib.blake2b
    parts = zip(starts.tolist(), ends.tolist(), notes.tolist())
    return np.frombuffer(b"".join([digest(data[i:j] + b"%4d" % n, digest_size=16).digest() for i, j, n in parts]), "<i8").reshape(-1, 2)


class PrefixHash:
    """Polynomial hashes of any stretch of ``data`` from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        size = SEGMENT + LENGTH
        self.back = _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_values()[data] * _powers(_BASE, size)[: len(data)], out=self.sums[1:])

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(_U).max, _U)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Per segment of a text: ``anchor hash, context digest, first window, windows, anchor - first window``."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - LENGTH + 1, SEGMENT):
        part = whole[at : at + SEGMENT + LENGTH - 1]
        one = PrefixHash(part)
        starts = np.arange(len(part) - GRAM + 1)
        grams = one.of(starts, starts + GRAM)
        low = _U((1 << 20) - 1)  # the position in the low bits makes the leftmost of equals the least
        anchor = (sliding_min((grams & ~low) | starts.astype(_U), SPREAD) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        a = anchor[first]
        yield grams[a], digests(part.tobytes(), first, last + LENGTH, a - first), first + at, last - first + 1, a - first


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "h", "c1", "c2", "at", "n", "a"]
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8")
            if len(data) >= LENGTH:
                for h, c, at, n, a in contexts(data):
                    parts.append([np.full(len(h), doc, np.int64), h.view(np.int64), c[:, 0], c[:, 1], at, n.astype(np.int16), a.astype(np.int16)])
        if parts:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts)], names)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts to sort, and the window digests of those of crowded anchors."""
    names = ["doc_id", "h", "at", "n", "a", "occurs", "bytes", "w1", "w2"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data = text.encode("utf-8")
            for x in wanted:
                part = data[x["at"] : x["at"] + x["n"] + LENGTH - 1]
                if not x["crowded"]:
                    rows.append((doc, x["h"], x["at"], x["n"], x["a"], x["occurs"], part, None, None))
                    continue
                starts = np.arange(x["n"])
                windows = digests(part, starts, starts + LENGTH, 0 * starts).tolist()
                rows.extend((doc, x["h"], x["at"] + t, 1, 0, x["occurs"], None, w1, w2) for t, (w1, w2) in enumerate(windows))
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class Suffix:
    """A context with its anchor, whose right and left extensions are compared by hash."""

    __slots__ = ("data", "anchor", "n", "sums", "spans", "row")

    def __init__(self, data: bytes, anchor: int, n: int, row: tuple[int, int, int]):
        self.data, self.anchor, self.n, self.row = data, anchor, n, row
        self.sums = PrefixHash(np.frombuffer(data, np.uint8)).sums
        self.spans: list[tuple[int, int]] = []


def _same(x: Suffix, y: Suffix, dx: int, dy: int, size: int) -> bool:
    """Whether ``size`` bytes at ``dx`` and ``dy`` have the same hash: sums aligned by a power of the base."""
    px = int(x.sums[dx + size]) - int(x.sums[dx])
    py = int(y.sums[dy + size]) - int(y.sums[dy])
    power = _powers(_BASE, SEGMENT + LENGTH)
    return (px * int(power[dy]) - py * int(power[dx])) & MASK == 0


def extension(x: Suffix, y: Suffix, right: bool) -> int:
    """How many bytes from (or before) both anchors agree: binary search, then verified on the bytes."""
    a, b = x.anchor, y.anchor
    low, high = 0, min(len(x.data) - a, len(y.data) - b) if right else min(a, b)
    while low < high:
        middle = (low + high + 1) // 2
        if _same(x, y, a, b, middle) if right else _same(x, y, a - middle, b - middle, middle):
            low = middle
        else:
            high = middle - 1
    if right and x.data[a : a + low] == y.data[b : b + low] or not right and x.data[a - low : a] == y.data[b - low : b]:
        return low
    pairs = zip(x.data[a:], y.data[b:]) if right else zip(x.data[:a][::-1], y.data[:b][::-1])  # a collision
    return next((k for k, (p, q) in enumerate(pairs) if p != q), high)


def _compare(x: Suffix, y: Suffix) -> int:
    k = extension(x, y, True)
    p, q = x.data[x.anchor + k : x.anchor + k + 1], y.data[y.anchor + k : y.anchor + k + 1]
    return (p > q) - (p < q)


def shared_windows(group: list[Suffix]) -> None:
    """Add to each context's spans the windows that another context of the same anchor has too."""
    group.sort(key=cmp_to_key(_compare))
    common = [extension(x, y, True) for x, y in zip(group, group[1:])]
    furthest = max(x.anchor for x in group)
    for i, x in enumerate(group):
        right = len(x.data)
        for j in range(i + 1, len(group)):
            right = min(right, common[j - 1])
            if right < LENGTH - furthest:
                break
            y = group[j]
            left = extension(x, y, False)
            for z in (x, y):
                low, high = max(0, z.anchor - left), min(z.n - 1, z.anchor + right - LENGTH)
                if low <= high:
                    z.spans.append((low, high))


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their anchor's hash; a group may go on in the next batch."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(7)))

    out: list[tuple[int, int, int]] = []

    def flush():
        made = pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["doc_id", "first", "last"])
        out.clear()
        return made

    for _, same in groupby(rows(), itemgetter(1)):
        group = [Suffix(r[6], r[4], r[3], (r[0], r[2], r[5])) for r in same]
        shared_windows(group)
        for x in group:
            doc, at, occurs = x.row
            if occurs == 1:
                out.extend((doc, at + low, at + high) for low, high in set(x.spans))
        if len(out) > 50_000:
            yield flush()
    yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data = text.encode("utf-8")
            runs: list[list[int]] = []
            for first, last in sorted((x["first"], x["last"]) for x in spans or ()):
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], last + LENGTH)
                else:
                    runs.append([first, last + LENGTH])
            kept, at = [], 0
            for begin, end in runs:
                kept.append(data[at:begin])
                at = end
            rest = b"".join([*kept, data[at:]])
            rows.append((doc, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, first, last``: ranges of starts of ``LENGTH``-byte strings that occur elsewhere too."""
    ws = Workspace(spark)
    found = ws.table(docs.mapInArrow(_find, "doc_id long, h long, c1 long, c2 long, at long, n short, a short"), "anchors")
    often = found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    shared = ws.table(found.join(often, "h"), "shared")
    ws.drop(found)
    each = shared.groupBy("h", "c1", "c2").agg(F.count("*").alias("occurs"), F.min(F.struct("doc_id", "at")).alias("x"), F.max("n").alias("n"), F.max("a").alias("a"))
    each = ws.table(each, "contexts")

    whole = shared.join(each.where("occurs > 1").select("h", "c1", "c2"), ["h", "c1", "c2"])
    whole = whole.select("doc_id", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"))

    mixed = each.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1").select("h", (F.col("contexts") > SORTED).alias("crowded"))
    wanted = each.join(mixed, "h").select("x.doc_id", F.struct("h", "x.at", "n", "a", "occurs", "crowded").alias("w"))
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    once = docs.join(by_doc, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "wanted")
    fetched = ws.table(once.mapInArrow(_fetch, "doc_id long, h long, at long, n short, a short, occurs long, bytes binary, w1 long, w2 long"), "bytes")

    few = fetched.where("bytes is not null").select("doc_id", "h", "at", "n", "a", "occurs", "bytes")
    few = few.repartition("h").sortWithinPartitions("h").mapInArrow(_sort, "doc_id long, first long, last long")
    windows = fetched.where("w1 is not null")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1")
    many = windows.where("occurs = 1").join(twice, ["w1", "w2"]).select("doc_id", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.union(few).union(many)


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes) per document."""
    docs = texts(docs, id_col, text_col)
    spans = repeated_spans(spark, docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)
