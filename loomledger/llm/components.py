"""Connected components of an edge list: local union-find, then alternating star rounds.

Each partition first reduces its own edges to a spanning forest by union-find, so what is left for
the distributed rounds is small.  A round joins each node to the least of its neighbours (large
star, then small star); neighbour lists are never gathered, so a node that touches a third of the
graph is an ordinary skewed join key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


class UnionFind:
    """Union by least member with path halving."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def spanning_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
    pairs = [(sets.find(x), x) for x in list(sets.parent)]
    pairs = [(u, v) for u, v in pairs if u != v]
    yield pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def connected_components(ws: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the least member of each node's component.

    ``edges``: two long columns.  Self-loops and repeated edges are fine; nodes without an edge to
    another node, and roots themselves, have no row.  The caller drops the result's table.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    edges = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(a != b)
    now = ws.table(edges.mapInArrow(spanning_forest, "u long, v long").distinct().repartition("u"), "forest")
    mark = None
    for _ in range(rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            out = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
            out._loom_path = now._loom_path
            return out
        mark = new
        both = now.union(now.select("v", "u")).toDF("n", "x")
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("x > n").select(F.col("m").alias("u"), F.col("x").alias("v")).where("u <> v").distinct()
        roots = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(roots, "v")
        small = small.select(F.col("m").alias("u"), F.col("v")).union(small.select("m", "u")).where("u <> v").distinct()
        then, now = now, ws.table(small.mapInArrow(spanning_forest, "u long, v long").distinct(), "round")
        ws.drop(then)
    raise RuntimeError("components did not settle")
