"""Joins of intervals that overlap, as equi-joins on buckets of time (or of any number), and counts of them without pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

OWNERS = 1 << 14  # of a side of a block: its table of who met whom has that many squared bytes at most
BLOCKS = 8
TOGETHER = 1 << 18
PAIRS = 1 << 21


def _number(df: DataFrame, name: str) -> Column:
    """A place on a line of whole numbers: days of dates, microseconds of timestamps."""
    kind = dict(df.dtypes)[name]
    return F.unix_date(name).cast("long") if kind == "date" else F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.floor(name).cast("long")


def _bucketed(df: DataFrame, span: tuple[str, str], widths: list[int]) -> DataFrame:
    """With ``low, high`` and the interval's own level: the finest at which it lies in two buckets at most."""
    low, high = (_number(df, c) for c in span)
    out = df.withColumns({"__low": low, "__high": high}).where("__low <= __high")
    own = F.lit(len(widths) - 1)
    for level in reversed(range(len(widths) - 1)):
        own = F.when(F.col("__high") - F.col("__low") < widths[level], level).otherwise(own)
    return out.withColumn("__own", own)


def _levels(df: DataFrame) -> set[int]:
    return {r[0] for r in df.select("__own").distinct().collect()}  # a row per level at most


def _spread(df: DataFrame, widths: list[int], others: set[int], side: str) -> DataFrame:
    """A row per bucket of each level at which an interval of the other side may meet it: its own, and coarser ones in use there."""
    least = min(others, default=0)
    at = [F.when(F.lit(level in others) & (F.col("__own") < level) | (F.col("__own") == level) & F.lit(least <= level), F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))) for level, width in enumerate(widths)]
    places = F.flatten(F.array(*(F.coalesce(F.transform(buckets, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket"))), F.array().cast("array<struct<level:int,bucket:bigint>>")) for level, buckets in enumerate(at))))
    rows = df.withColumn("__at", F.explode(places)).select("*", F.col("__at.level").alias("__level"), F.col("__at.bucket").alias("__bucket")).drop("__at")
    return rows.withColumnsRenamed({c: f"{c}_{side}" for c in ("__low", "__high", "__own", "__level", "__bucket")})


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, base: int = 16, levels: int = 6) -> DataFrame:
    """Pairs of rows whose closed intervals have a point in common, each once, with the columns of both.

    ``width`` is the finest bucket (days for dates, microseconds for timestamps); each of ``levels`` is ``base`` times
    as wide as the one before.  An interval lies in two buckets of its own level at most, so long ones do not
    multiply; two intervals meet at the coarser of their levels, and the pair counts in the first bucket that both have.
    Rows without a start or an end, or whose end is before the start, meet nothing.  Names must differ between both sides.
    """
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    widths = [width * base**k for k in range(levels)]
    a, b = _bucketed(left, left_span, widths), _bucketed(right, right_span, widths)
    in_a, in_b = _levels(a), _levels(b)
    a, b = _spread(a, widths, in_b, "a"), _spread(b, widths, in_a, "b")
    c = F.col
    meets = (c("__low_a") <= c("__high_b")) & (c("__low_b") <= c("__high_a"))
    width_of = F.get(F.array(*map(F.lit, widths)), c("__level_a"))
    first = F.floor(F.greatest("__low_a", "__low_b") / width_of)
    keys = (c("__level_a") == c("__level_b")) & (c("__bucket_a") == c("__bucket_b"))
    pairs = a.join(b, keys & meets & (F.greatest("__own_a", "__own_b") == c("__level_a")) & (c("__bucket_a") == first))
    return pairs.select(*left.columns, *right.columns)


class _Block:
    """Who met whom among the owners of two groups (or of one), from their intervals in the order of their starts."""

    def __init__(self, alone: bool):
        self.alone = alone
        self.numbers: tuple[dict, ...] = ({}, {})
        self.pairs = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.met = np.zeros((0, 0), bool)
        none = np.zeros(0, np.int64)
        self.held = [(none, none, none), (none, none, none)]  # starts, ends and numbers of intervals that may go on

    def _numbered(self, side: int, owners: np.ndarray) -> np.ndarray:
        """Owners as numbers from 0, each side's own; an only group numbers both sides alike."""
        known = self.numbers[0 if self.alone else side]
        each, place = np.unique(owners, return_inverse=True)
        found = np.fromiter((known.setdefault(x, len(known)) for x in each.tolist()), np.int64, len(each))
        rows, columns = len(self.numbers[0]), len(self.numbers[0 if self.alone else 1])
        if rows > self.met.shape[0] or columns > self.met.shape[1]:
            grown = np.zeros((max(rows, min(OWNERS, 2 * self.met.shape[0])), max(columns, min(OWNERS, 2 * self.met.shape[1]))), bool)
            grown[: self.met.shape[0], : self.met.shape[1]] = self.met
            self.met = grown
            self.pairs = [np.pad(x, (0, n - len(x))) for x, n in zip(self.pairs, grown.shape)]
        return found[place]

    def _meet(self, one: np.ndarray, of: np.ndarray, first: np.ndarray, stop: np.ndarray, turned: bool) -> None:
        """Counts the pairs of each interval of ``one`` with those of ``of`` from ``first`` to ``stop``, some at a time."""
        some = np.flatnonzero(stop > first)
        ends = np.cumsum((stop - first)[some])
        for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            at = np.arange(low, min(low + PAIRS, int(ends[-1])))
            k = np.searchsorted(ends, at, "right")
            x = one[some[k]]
            y = of[at - (ends - stop[some])[k]]
            if turned:
                x, y = y, x
            if self.alone:
                x, y = x[x != y], y[x != y]
            self.met[x, y] = True
            for side, z in ((0, x), (1, y)):
                self.pairs[side] += np.bincount(z, minlength=len(self.pairs[side]))

    def add(self, side: np.ndarray, owners: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The next intervals by start: they meet those held and one another."""
        new = []
        for s in (0, 1):
            mine = np.flatnonzero(side == s)
            new.append((low[mine], high[mine], self._numbered(s, owners[mine])))
        (a, b), (held_a, held_b) = new, self.held
        # Of two intervals the later one's start lies in the earlier one; of new ones with equal starts the first side's is the earlier.
        span = lambda x, starts, how: (np.searchsorted(starts, x[0], how), np.searchsorted(starts, x[1], "right"))
        if self.alone:
            self._meet(held_a[2], a[2], *span(held_a, a[0], "left"), False)
            self._meet(a[2], a[2], np.arange(1, len(a[0]) + 1), span(a, a[0], "left")[1], False)
        else:
            for x in (held_a, a):
                self._meet(x[2], b[2], *span(x, b[0], "left"), False)
            for x, how in ((held_b, "left"), (b, "right")):
                self._meet(x[2], a[2], *span(x, a[0], how), True)
        last = low[-1]
        for s in (0, 1):
            both = [np.concatenate(z) for z in zip(self.held[s], new[s])]
            goes_on = both[1] >= last
            self.held[s] = tuple(z[goes_on] for z in both)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners, and with how many intervals and how many owners of the other group theirs met."""
        if self.alone:
            self.pairs[0] += self.pairs[1]
            self.met |= self.met.T.copy()
        out = [(np.array(list(self.numbers[s]), np.int64), self.pairs[s], self.met.sum(1 - s)) for s in ((0,) if self.alone else (0, 1))]
        return tuple(np.concatenate([x[k][: len(x[0])] for x in out]) for k in range(3))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, alone, side, owner, low, high`` in the order of block and start to counts per owner and block."""
    block, now, held, n = None, None, [], 0

    def made():
        return pa.record_batch([*map(pa.array, block.counts())], ["owner", "pairs", "others"])

    def chunks():
        nonlocal held, n
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                yield pa.concat_batches(held)
                held, n = [], 0
        if n:
            yield pa.concat_batches(held)

    for chunk in chunks():
        number, alone, *columns = (chunk.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        cuts = np.flatnonzero(np.diff(number)) + 1
        for first, stop in zip([0, *cuts], [*cuts, len(number)]):
            if number[first] != now:
                if block:
                    yield made()
                now, block = number[first], _Block(bool(alone[first]))
            block.add(*(x[first:stop] for x in columns))
    if block:
        yield made()


def overlap_counts(spans: DataFrame, owner: str, span: tuple[str, str]) -> DataFrame:
    """``owner, pairs, others``: with how many intervals of other owners, and of how many of these, each owner's overlap.

    Owners (a long column) are dealt into groups of about ``OWNERS``, and each two groups are a block.  A task reads a
    block's intervals by start and keeps those that go on and a table of who met whom, so no pair becomes a row and none
    is shuffled.  The pairs are still looked at, and there may be as many as the square of the intervals; intervals
    are sent as often as there are groups.  Owners that meet none have no row; rows without an owner, a start or an end, or whose end
    is before the start, meet nothing.
    """
    ship(spans.sparkSession)
    rows = spans.select(F.col(owner).cast("long").alias("owner"), _number(spans, span[0]).alias("low"), _number(spans, span[1]).alias("high")).where("owner is not null and low <= high")
    groups = max(BLOCKS, -(-rows.agg(F.countDistinct("owner")).first()[0] * 17 // (16 * OWNERS)))  # hashing fills some more than others
    mine, each = F.pmod(F.xxhash64("owner"), F.lit(groups)).cast("int"), F.sequence(F.lit(0), F.lit(groups - 1))
    rows = rows.withColumn("mine", mine).withColumn("its", F.explode(each))
    low, high = F.least("mine", "its"), F.greatest("mine", "its")
    block = (high * (high + 1) / 2).cast("int") + low
    dealt = rows.select(block.alias("block"), (F.col("mine") == F.col("its")).alias("alone"), F.when(F.col("mine") > F.col("its"), 1).otherwise(0).alias("side"), "owner", "low", "high")
    dealt = dealt.repartitionById(groups * (groups + 1) // 2, F.col("block")).sortWithinPartitions("block", "low")
    counted = dealt.mapInArrow(_met, "owner long, pairs long, others long")
    return counted.groupBy(F.col("owner").alias(owner)).agg(F.sum("pairs").alias("pairs"), F.sum("others").alias("others")).where("pairs > 0")
