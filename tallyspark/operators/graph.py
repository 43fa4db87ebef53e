"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): rows (node, root), root being the smallest node reachable.

    Every round hooks nodes to a neighbour on one side (the smallest smaller, or the greatest greater one; an aggregate combined before
    the shuffle), flattens these trees by pointer jumping, and contracts the edges to the roots. Every node with edges has a smaller or
    a greater neighbour, so the side on which more nodes hook hooks at least half of them: rounds are at most the logarithm of the
    nodes. Joins are on node ids only, so skewed hubs can be split by the adaptive skew join; nothing is collected. Self-loops and null
    ends are ignored; no edges: no rows.
    """
    left = written(_canonical(edges), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        lows, highs = left.agg(F.count_distinct("lo"), F.count_distinct("hi")).first()
        own, other, pick = ("hi", "lo", F.min) if highs >= lows else ("lo", "hi", F.max)
        up = written(left.groupBy(F.col(own).alias("node")).agg(pick(other).alias("root")), "hook")
        while True:  # pointer jumping: depths halve
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = written(up.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jump")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        steps.append(up)
        lo = up.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        hi = up.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        moved = left.join(lo, "lo", "left").join(hi, "hi", "left")
        left = written(_canonical(moved.select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b"))), "edges")
    out = None
    for up in steps:
        if out is None:
            out = up
            continue
        over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(up)
    if out is None:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    every = written(out.unionByName(out.select(F.col("root").alias("node"), "root").distinct()), "rooted")
    names = every.groupBy("root").agg(F.min("node").alias("name"))  # what all hooked to need not be the smallest
    return every.join(names, "root").select("node", F.col("name").alias("root"))


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
