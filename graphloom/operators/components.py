"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut_observed, drop_cut


def star_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest node.

    Alternating large-star and small-star steps: each connects the neighbours of a node to the smallest
    node seen, until all edges point at their component's smallest node. Both are one aggregation and
    one join on the edges, so a hub's neighbours stay rows and are never gathered in a list. Self-loops
    name a node that stands alone; null ends are ignored. Works on longs and strings.
    """
    e = edges.select("u", "v").dropna()
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    # edges are distinct, so their number and two sums of hashes tell whether a round changed anything
    mark = {"n": F.count(F.lit(1)), "a": F.bit_xor(F.xxhash64(F.lit(1), "u", "v")), "b": F.bit_xor(F.xxhash64(F.lit(2), "u", "v"))}
    cur, seen = cut_observed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star", **mark)

    while seen["n"]:
        # large star: larger neighbours to the smallest of the neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        before = seen
        new, seen = cut_observed(small.where("u <> v").distinct(), "star", **mark)
        drop_cut(cur)
        cur = new
        if seen == before:
            break
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
