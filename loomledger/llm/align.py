"""Tokens of two vocabularies over one text, aligned by a sweep over where they end.

Both tokenizers read the same bytes (a blank and the text).  Each token gives an event where it ends; the events of
both sides are united, dealt out by document, sorted by offset and read by a machine that keeps the tokens since the
last common end.  Where both sides end, a group is closed; where either ends, the tokens that lie there are linked.
So a document has as many links as it has different ends.

Events of one side travel as runs: the ids of the tokens that end in one window of ``WINDOW`` bytes, in one row; a
token's end follows from the ids before it.  The machine holds a window of a document, never the whole.  Only a text
in which both sides have no common end for long makes it hold more.

Edge cases: a text that is null or empty, or that either vocabulary does not give back byte by byte (U+2581 for the
second one), has no tokens: a row of zeros and an empty digest.  Repeated rows and rows of one id with other texts are
each a document: rows get a number in the scan, and results are gathered by it.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, texts
from .encoding import ChunkEncoder

WINDOW = 1 << 15
BROADCAST_PAIRS = 1 << 21
_CUTS = re.compile(r"(?<=\S)(?=[ \n])|(?<=\S\n)(?=\S)")
EVENTS = "row long, doc_id long, side int, at long, ids binary"


class PlainEncoder(ChunkEncoder):
    """Strings of added tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, keeps_space=True)
        self.tokenizer.encode_special_tokens = True
        self.added = re.compile(r"(?!)")


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of each entry of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    out = [b""] * tokenizer.get_vocab_size()
    for entry, k in tokenizer.get_vocab().items():
        out[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece: U+2581 is a blank, ``<0xHH>`` a byte."""
    of = lambda k: bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
    return [of(k) for k in range(model.get_piece_size())]


class PairEncoder:
    """The ids of both vocabularies, each distinct chunk encoded once; two generations of chunks bound the cache.

    Both vocabularies cut a text before a blank or line end that follows something else, and after a single line end: the first
    by its pre-tokenisation, the second because no piece has a blank after another character, or a line end.
    """

    def __init__(self, a_path: str, b_path: str, cached: int = 350_000):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b, self.cached = PlainEncoder(a_path), SentencePieceProcessor(model_file=b_path), cached
        self.a_bytes, self.b_bytes = byte_level_bytes(self.a.tokenizer), piece_bytes(self.b)
        self.a_dtype, self.b_dtype = (np.dtype("<u2" if len(x) <= 1 << 16 else "<u4") for x in (self.a_bytes, self.b_bytes))
        self.cuts = not any(re.search(r"[^ ] |.\n|\n.", p.decode("utf-8", "replace")) for p in self.b_bytes)
        self.line_end = self._plain_a(["\n"])[0]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def _plain_a(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.a_dtype).tobytes() for e in self.a._batch(chunks)]

    def _checked(self, chunk: str, a: bytes, b: list[int]) -> tuple[bytes, bytes] | None:
        raw, got = chunk.encode(), np.array(b, self.b_dtype).tobytes()
        same = b"".join(map(self.b_bytes.__getitem__, b)) == raw == b"".join(map(self.a_bytes.__getitem__, np.frombuffer(a, self.a_dtype).tolist()))
        return (a, got) if same else None

    def _learn(self, keys: set[str]) -> None:
        """A key is a chunk after a blank, a chunk that begins with a line end, or, after U+0000, any chunk at all."""
        new = [k for k in keys if k not in self.known]
        for k in [k for k in new if k in self.older]:
            self.known[k] = self.older[k]
        new = [k for k in new if k not in self.known]
        spaced, lined, other = ([k for k in new if k[:1] not in ("\n", "\0")], [k for k in new if k[:1] == "\n"], [k for k in new if k[:1] == "\0"])
        got: dict[str, bytes] = {}
        self.a._learn(got, set(spaced), " ")
        for k, ids in zip(spaced, self.b.encode(spaced, num_threads=1)):
            self.known[k] = self._checked(" " + k, got[k], ids)
        got = {}
        self.a._learn(got, {k[1:] for k in lined}, "")
        for k, ids in zip(lined, self.b.encode(lined, num_threads=1)):  # in front stands the blank that it adds
            self.known[k] = self._checked(k, self.line_end + got[k[1:]], ids[1:])
        chunks = [k[1:] for k in other]
        for k, c, a, ids in zip(other, chunks, self._plain_a(chunks), self.b.encode(["\n" + c for c in chunks], num_threads=1)):
            self.known[k] = self._checked(c, a, ids[2:])

    def _keys(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return ["\0 " + text]
        if "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
            return text.replace("\n", " \n").split(" ")
        return ["\0" + c for c in _CUTS.split(" " + text)]

    def encode(self, part: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides for each text; none where the bytes differ."""
        if len(self.known) > self.cached:
            self.older, self.known = self.known, {}
        keys = [self._keys(t) for t in part]
        self._learn(set().union(*keys))
        for found in keys:
            got = list(map(self.known.__getitem__, found))
            if not got or None in got:
                got = []
            yield np.frombuffer(b"".join([x[0] for x in got]), self.a_dtype), np.frombuffer(b"".join([x[1] for x in got]), self.b_dtype)


@lru_cache(maxsize=1)
def pair_encoder(a_path: str, b_path: str) -> PairEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    return PairEncoder(a_path, b_path)


def end_events(docs: DataFrame, a_path: str, b_path: str, window: int = WINDOW) -> DataFrame:
    """The united events: ``row, doc_id, side, at, ids``, the tokens of a side (0 or 1) that end in the window from byte ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(a_path, b_path)
        lengths = [np.array(list(map(len, x)), np.int64) for x in (encoder.a_bytes, encoder.b_bytes)]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, ids = part.column("row").to_pylist(), part.column("doc_id").to_pylist()
                out: list[tuple] = []
                for row, doc_id, both in zip(rows, ids, encoder.encode(part.column("text").to_pylist())):
                    for side, tokens in enumerate(both):
                        if not len(tokens) and side:
                            continue
                        ends = np.cumsum(lengths[side][tokens])
                        if not len(tokens) or ends[-1] <= window:
                            out.append((row, doc_id, side, 0, tokens.tobytes()))
                            continue
                        at = (ends - 1) // window
                        first = np.flatnonzero(np.diff(at, prepend=-1))
                        out.extend((row, doc_id, side, int(at[i]) * window, tokens[i:j].tobytes()) for i, j in zip(first, [*first[1:], len(tokens)]))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["row", "doc_id", "side", "at", "ids"])

    numbered = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, EVENTS)


class Sweep:
    """The machine: takes windows of documents in order, gives groups and links of what is closed."""

    def __init__(self, a_path: str, b_path: str, keep_groups: bool = False):
        encoder = pair_encoder(a_path, b_path)
        self.sizes = len(encoder.a_bytes), len(encoder.b_bytes)
        self.dtypes = encoder.a_dtype, encoder.b_dtype
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in (encoder.a_bytes, encoder.b_bytes)]
        self.keep_groups = keep_groups
        self.step = max(self.sizes)
        self.written = [mark + str(k).encode() for mark in (b";", b",", b"|", b",") for k in range(self.step)]
        self.widths = np.array(list(map(len, self.written)), np.int64)
        self.open: dict | None = None  # the document that is being read

    def _new(self, row: int, doc_id: int) -> dict:
        return {"row": row, "doc_id": doc_id, "rest": [np.empty(0, d) for d in self.dtypes], "hash": hashlib.sha256(), "begun": False, "over": False}

    def read(self, batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        """Windows of different documents are swept together, up to ``most`` tokens; those of one document one after the other."""
        held: list[tuple[dict, list[np.ndarray]]] = []
        place, tokens = None, 0
        for batch in batches:
            for row, doc_id, side, at, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "side", "at", "ids"))):
                if self.open is None or self.open["row"] != row:
                    if self.open is not None:
                        self.open["over"] = True
                    if tokens > most:
                        yield self.result(held)
                        held, tokens = [], 0
                    self.open, place = self._new(row, doc_id), None
                if at != place:
                    if held and held[-1][0] is self.open:
                        yield self.result(held)
                        held, tokens = [], 0
                    held.append((self.open, [np.empty(0, d) for d in self.dtypes]))
                    place = at
                held[-1][1][side] = np.frombuffer(ids, self.dtypes[side])
                tokens += len(held[-1][1][side])
        if self.open is not None:
            self.open["over"] = True
            yield self.result(held)

    def result(self, units: list[tuple[dict, list[np.ndarray]]]) -> pa.RecordBatch:
        """A row for each unit: counts, linked id pairs with how often, and of a document that is over the digest of its groups."""
        n = len(units)
        sides = [[np.concatenate((doc["rest"][s], new[s])) for doc, new in units] for s in (0, 1)]
        counts = [np.array(list(map(len, x)), np.int64) for x in sides]
        ids = [np.concatenate(x).astype(np.int64) for x in sides]
        unit = [np.repeat(np.arange(n), c) for c in counts]
        spans = [np.bincount(unit[s], self.lengths[s][ids[s]], n).astype(np.int64) for s in (0, 1)]
        base = np.cumsum(np.maximum(*spans) + 1) - np.maximum(*spans) - 1
        ends = []
        for s in (0, 1):
            total = np.cumsum(self.lengths[s][ids[s]])
            ends.append(total - (np.cumsum(spans[s]) - spans[s])[unit[s]] + base[unit[s]])
        # Through the last common end of each unit; what follows waits for the next window.
        both = np.intersect1d(*ends, assume_unique=True)
        last = np.full(n, -1, np.int64)
        last[np.searchsorted(base, both, "right") - 1] = both
        for s in (0, 1):
            keep = ends[s] <= last[unit[s]]
            if not keep.all():
                done = np.bincount(unit[s][keep], minlength=n)
                for (doc, _), x, k in zip(units, sides[s], done.tolist()):
                    doc["rest"][s] = x[k:].copy()
                ids[s], ends[s], unit[s] = ids[s][keep], ends[s][keep], unit[s][keep]
            else:
                for doc, _ in units:
                    doc["rest"][s] = np.empty(0, self.dtypes[s])
        (a, b), (a_end, b_end), (a_unit, b_unit) = ids, ends, unit
        a_closes, b_closes = np.isin(a_end, both, assume_unique=True), np.isin(b_end, both, assume_unique=True)
        under_a, under_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end[~b_closes])
        # A link at each end: the token that ends there and the one of the other side that lies there.
        pair = np.concatenate((a * self.sizes[1] + b[under_a], a[under_b] * self.sizes[1] + b[~b_closes]))
        where = np.concatenate((a_unit, b_unit[~b_closes]))
        room = self.sizes[0] * self.sizes[1]
        keyed = np.sort(where * room + pair)
        starts = np.flatnonzero(np.diff(keyed, prepend=-1))
        times = np.diff(starts, append=len(keyed))
        bounds = np.searchsorted(keyed[starts], np.arange(n + 1) * room).astype(np.int32)
        pieces = self.groups(a, b, a_closes, b_closes, a_unit, b_unit, n)
        digests, kept = [], []
        for (doc, _), piece in zip(units, pieces):
            if not doc["begun"]:
                piece = piece[1:]
                doc["begun"] = bool(len(piece))
            doc["hash"].update(piece)
            kept.append(bytes(piece).decode() if self.keep_groups else None)
            digests.append((doc["hash"].hexdigest() if doc["begun"] else "") if doc["over"] else None)
        integers = [np.bincount(x, minlength=n) for x in (a_unit, b_unit, a_unit[a_closes], where)]
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in ((keyed[starts] % room).astype(np.int64), times.astype(np.int32))]
        head = [pa.array([doc[c] for doc, _ in units], pa.int64()) for c in ("row", "doc_id")]
        return pa.RecordBatch.from_arrays(
            [*head, *(pa.array(x.astype(np.int64)) for x in integers), pa.array(digests, pa.string()), pa.array(kept, pa.string()), *lists],
            names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"],
        )

    def groups(self, a, b, a_closes, b_closes, a_unit, b_unit, n: int) -> list[memoryview]:
        """``;a1,a2|b1`` for each group of a unit: ids go to their place by what closes before them."""
        a_group, b_group = (np.cumsum(x) - x for x in (a_closes, b_closes))
        codes = np.empty(len(a) + len(b), np.int64)
        b_before = np.concatenate(([0], np.flatnonzero(b_closes) + 1))
        a_through = np.flatnonzero(a_closes) + 1
        opens = lambda closes: np.concatenate(([True], closes[:-1]))[: len(closes)]
        codes[np.arange(len(a)) + b_before[a_group]] = a + self.step * ~opens(a_closes)
        codes[np.arange(len(b)) + a_through[b_group]] = b + self.step * (2 + ~opens(b_closes))
        text = memoryview(b"".join(map(self.written.__getitem__, codes.tolist())))
        widths = np.concatenate(([0], np.cumsum(self.widths[codes])))
        at = widths[np.concatenate(([0], np.cumsum(np.bincount(a_unit, minlength=n) + np.bincount(b_unit, minlength=n))))]
        return [text[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def swept(events: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """A row for each window of a document: closed groups, their links as id pairs (first id x vocabulary + second), how often.

    ``groups`` holds the text ``a1,a2|b1;a3|b2,b3`` if it is to be kept; the digest, of the whole document, stands in its last row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return Sweep(a_path, b_path, keep_groups).read(batches)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"
    return events.repartition("row").sortWithinPartitions("row", "at", "side").mapInArrow(run, schema)


def pair_counts(windows: DataFrame, second_size: int) -> DataFrame:
    """``pair, n, best``: links of each id pair in the whole corpus, and whether no pair of its second id has more."""
    counted = windows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    return counted.withColumn("second", F.col("pair") % second_size)


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``row, doc_id, groups, pairs, times`` for each window of a document: its groups as text, its links as id pairs and how often each."""
    return swept(end_events(docs, a_path, b_path), a_path, b_path, keep_groups=True).select("row", "doc_id", "groups", "pairs", "times")


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row per document.

    ``n_best``: links whose id pair has the highest count of its second id in the corpus; ``count_sum``: of these counts over links.
    """
    space = Workspace(spark)
    windows = space.table(swept(end_events(docs, a_path, b_path), a_path, b_path).drop("groups"), "windows")
    counts = space.table(pair_counts(windows, len(pair_encoder(a_path, b_path).b_bytes)), "pair-counts")
    best = counts.groupBy("second").agg(F.max("n").alias("most"))  # as many rows as the second vocabulary at most
    graded = counts.join(F.broadcast(best), "second").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if counts.count() <= BROADCAST_PAIRS:
        graded = F.broadcast(graded)
    links = windows.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(graded, F.col("pairs") == F.col("pair"))
    sums = links.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    integers = ("n_a", "n_b", "n_groups", "n_links")
    added = windows.select("row", "doc_id", *integers, "groups_sha256").unionByName(sums, allowMissingColumns=True).groupBy("row")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return added.agg(F.max("doc_id").alias("doc_id"), *map(total, (*integers, "n_best", "count_sum")), F.max("groups_sha256").alias("groups_sha256")).drop("row")
