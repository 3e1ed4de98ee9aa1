"""Trees of any depth, by pointer doubling: each round joins every node's jump with the jump it lands on.

After k rounds a jump spans 2 ** k edges, so a tree of depth d takes log2(d) rounds of joins over its nodes, whatever
its shape; each round is written to a table, which keeps plans small and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def _jumps(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, jump, steps``: one row per node; of several parents the least counts, a parent that is no node is a root above."""
    one = nodes.where("node is not null").groupBy("node").agg(F.min("parent").alias("jump"))
    return scratch.table(one.withColumn("steps", F.when(F.col("jump").isNull(), 0).otherwise(1)), "jumps")


def _rounds(n: int) -> int:
    """Rounds after which only a cycle still has somewhere to go."""
    return max(1, n.bit_length() + 1)


def depths(nodes: DataFrame) -> DataFrame:
    """``node, root, level`` of ``node, parent`` rows: the root has level 0.

    Nodes that lie on a cycle, or hang below one, have neither: their ``root`` and ``level`` are null.
    A parent that is not among the nodes counts as a root of level 0 but gets no row.
    """
    scratch = Scratch(nodes.sparkSession)
    now = _jumps(nodes, scratch).withColumn("last", F.coalesce("jump", "node"))
    now = scratch.table(now, "round")
    for _ in range(_rounds(now.count())):
        if now.where("jump is not null").isEmpty():
            break
        other = now.select(F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("steps").alias("more"), F.col("last").alias("end"))
        step = now.join(other, "jump", "left").select("node", F.col("further").alias("jump"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("end", "last").alias("last"))
        now = scratch.table(step, "round")
    reached = F.col("jump").isNull()
    return now.select("node", F.when(reached, F.col("last")).alias("root"), F.when(reached, F.col("steps")).cast("int").alias("level"))


def cycles(nodes: DataFrame) -> DataFrame:
    """``node``: those that never reach a root."""
    return depths(nodes).where("level is null").select("node")


def closure(nodes: DataFrame) -> DataFrame:
    """``ancestor, descendant, depth``; every node is its own ancestor.  Nodes on or below a cycle are left out.

    The pairs within 2 ** k edges, joined with the jumps of 2 ** k, give those within twice as many.
    """
    scratch = Scratch(nodes.sparkSession)
    good = depths(nodes).where("level is not null").select("node")
    now = scratch.table(_jumps(nodes, scratch).join(good, "node", "left_semi").select("node", "jump"), "jump")
    pairs = scratch.table(now.select(F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).alias("depth")), "pairs")
    span = 1
    while not now.where("jump is not null").isEmpty():
        above = pairs.join(now.where("jump is not null"), F.col("ancestor") == F.col("node")).select(F.col("jump").alias("ancestor"), "descendant", (F.col("depth") + span).alias("depth"))
        pairs = scratch.table(pairs.unionByName(above), "pairs")
        now = scratch.table(now.join(now.select(F.col("node").alias("jump"), F.col("jump").alias("further")), "jump", "left").select("node", F.col("further").alias("jump")), "jump")
        span *= 2
    return pairs


def rollup(facts: DataFrame, nodes: DataFrame, account: str = "account_number", amount: str = "amount") -> DataFrame:
    """``node, direct, rolled``: a node's own sum and that of all below it, without the pairs of the closure.

    What lies within 2 ** k edges below a node, and the same of the nodes exactly 2 ** k below it, is what lies within
    twice as many: a round is one grouping and one join over the nodes.  Facts are summed per account before; accounts
    outside the tree and nodes on or below a cycle are left out.
    """
    scratch = Scratch(nodes.sparkSession)
    good = depths(nodes).where("level is not null").select("node")
    zero = F.lit(0).cast("decimal(38,4)")
    direct = facts.groupBy(F.col(account).alias("node")).agg(F.sum(amount).cast("decimal(38,4)").alias("direct"))
    now = _jumps(nodes, scratch).join(good, "node", "left_semi").join(direct, "node", "left")
    now = scratch.table(now.select("node", "jump", F.coalesce("direct", zero).alias("direct"), F.coalesce("direct", zero).alias("rolled")), "rolled")
    while not now.where("jump is not null").isEmpty():
        below = now.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("rolled").cast("decimal(38,4)").alias("below"))
        further = now.select(F.col("node").alias("jump"), F.col("jump").alias("further"))
        now = now.join(below, "node", "left").join(further, "jump", "left").select("node", F.col("further").alias("jump"), "direct", (F.col("rolled") + F.coalesce("below", zero)).cast("decimal(38,4)").alias("rolled"))
        now = scratch.table(now, "rolled")
    return now.select("node", F.col("direct").cast("double").alias("direct"), F.col("rolled").cast("double").alias("rolled"))
