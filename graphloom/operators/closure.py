"""Transitive closure and fixpoint helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, cut_counted, cut_observed, stack


def closure(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """Strict reachability ``(src, dst, steps)`` over ``edges(src, dst)`` with the fewest steps.

    Path doubling: after round k all pairs within 2^k steps are known for good. Of a longer shortest path the
    first 2^k steps are themselves a shortest path, so only the pairs of exactly 2^k steps are joined with all,
    and rounds add pairs without touching the known ones. On cycles a node reaches itself, and nothing new
    ends the rounds. ``reflexive`` adds every node to itself with 0 steps. Nulls are no nodes; repeated edges
    count once.
    """
    new, seen = cut_observed(edges.select("src", "dst").dropna().distinct().withColumn("steps", F.lit(1).cast("bigint")), "closure", longest=F.max("steps"))
    known, reach = [new], 1
    while seen["longest"] == reach:
        left = new.where(F.col("steps") == reach).select("src", F.col("dst").alias("mid"))
        right = stack(known).select(F.col("src").alias("mid"), "dst", "steps")
        longer = left.join(right, "mid").groupBy("src", "dst").agg((F.min("steps") + reach).alias("steps"))
        new, seen = cut_observed(longer.join(stack(known).select("src", "dst"), ["src", "dst"], "left_anti"), "closure", longest=F.max("steps"))
        known.append(new)
        reach *= 2
    pairs = stack(known)
    if reflexive:
        nodes = edges.select(F.col("src").alias("v")).union(edges.select("dst")).dropna().distinct()
        own = nodes.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0).cast("bigint").alias("steps"))
        pairs = pairs.unionByName(own).groupBy("src", "dst").agg(F.min("steps").alias("steps"))
    return pairs


def reachable_from(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Semi-naive frontier search: ``start(item, node)`` extended along ``edges(src, dst)`` to a fixpoint.

    Only the newest pairs are joined in each round and pairs already known are left out, so cycles end.
    """
    known, n = cut_counted(start.select("item", "node").dropna().distinct(), "reach")
    front = known
    edges = cut(edges.select("src", "dst").dropna().distinct(), "reach-edges")
    while n:
        step = front.join(edges, front["node"] == edges["src"]).select("item", F.col("dst").alias("node")).distinct()
        front, n = cut_counted(step.join(known, ["item", "node"], "left_anti"), "reach")
        known = known.unionByName(front)
    return known
