"""Parent-child links to full hierarchies: roots, depths, paths, descendants and cycles.

Bottom-up peeling: each round removes all leaves (nodes without children) and also an independent set of the
nodes that have one parent and one child, whose two links become one longer link. So trees and chains take
rounds after the logarithm of their size, however high they are; where every inner node has several parents
and children, as in a ladder, a round takes one level. The rounds are undone in reverse order: a node's roots,
depths and paths come from the parents that it had when it was removed. What cannot be peeled contains
cycles; only that residue is searched for strongly connected components.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut, cut_counted, cut_observed, drop_cut, stack
from .ids import number_names


@dataclass
class Hierarchy:
    """``roots(node, root, depth, path)`` and ``trapped(node, on_cycle, unrooted)``."""

    roots: DataFrame
    trapped: DataFrame


def _least(rows: DataFrame, keys: list[str], size: str, seg: str, paths: bool) -> DataFrame:
    """The shortest row of each key; among equals the one whose nodes come first by id, so by name."""
    if not paths:
        return rows.groupBy(*keys).agg(F.min(size).alias(size)).withColumn(seg, F.expr("cast(array() as array<bigint>)"))
    return rows.groupBy(*keys).agg(F.min(F.struct(size, seg)).alias("m")).select(*keys, f"m.{size}", f"m.{seg}")


def _rank(col: Column, rnd: int) -> Column:
    return F.struct(F.xxhash64(F.lit(rnd), col), col)


def _choose(edges: DataFrame, rnd: int, paths: bool) -> DataFrame:
    """The nodes to remove in this round: ``(v, up(p, w, seg), down(c, w, seg))``; up and down null for leaves."""
    long, ids = F.lit(None).cast("bigint"), F.lit(None).cast("array<bigint>")
    as_child = edges.select(F.col("c").alias("v"), "p", F.col("w").alias("pw"), F.col("seg").alias("pseg"), long.alias("c"), long.alias("cw"), ids.alias("cseg"))
    as_parent = edges.select(F.col("p").alias("v"), long.alias("p"), long.alias("pw"), ids.alias("pseg"), "c", F.col("w").alias("cw"), F.col("seg").alias("cseg"))
    # of nodes with one parent and one child, the only ones whose values are used, each value is the single one
    segs = [F.max(c).alias(c) for c in ("pseg", "cseg")] if paths else []
    info = as_child.unionByName(as_parent).groupBy("v").agg(F.count("p").alias("np"), F.count("c").alias("nc"), *[F.min(c).alias(c) for c in ("p", "pw", "c", "cw")], *segs)
    if not paths:
        info = info.withColumns({c: F.expr("cast(array() as array<bigint>)") for c in ("pseg", "cseg")})
    some = info.where("nc = 0 or (np = 1 and nc = 1)")
    some = some.select("v", (F.col("nc") == 0).alias("leaf"), F.struct("p", F.col("pw").alias("w"), F.col("pseg").alias("seg")).alias("up"), F.struct("c", F.col("cw").alias("w"), F.col("cseg").alias("seg")).alias("down"))
    some = cut(some, "peel-info")
    a = some.where("not leaf").select(F.col("v").alias("a"))
    b = some.select(F.col("v").alias("b"), F.col("leaf").alias("b_leaf"))
    line = some.where("not leaf").join(a, F.col("up.p") == F.col("a"), "left").join(b, F.col("down.c") == F.col("b"), "left")
    own = _rank(F.col("v"), rnd)
    line = line.where(
        (F.col("a").isNull() | (own > _rank(F.col("a"), rnd)))
        & (F.col("b").isNull() | (~F.col("b_leaf") & (own > _rank(F.col("b"), rnd))))
    ).select("v", "up", "down")
    nothing = lambda c: F.lit(None).cast(some.schema[c].dataType).alias(c)
    return some.where("leaf").select("v", nothing("up"), nothing("down")).unionByName(line)


def _remove(edges: DataFrame, gone: DataFrame, paths: bool) -> DataFrame:
    """The edges after the round: links of removed nodes leave, bridged links come in."""
    joined = F.concat(F.col("up.seg"), F.array("v"), F.col("down.seg")) if paths else F.col("up.seg")
    left = edges.join(gone.select(F.col("v").alias("c")), "c", "left_anti")
    left = left.join(gone.where("up is not null").select(F.col("v").alias("p")), "p", "left_anti").select("p", "c", "w", "seg")
    bridged = gone.where("up is not null and up.p <> down.c").select(
        F.col("up.p").alias("p"), F.col("down.c").alias("c"), (F.col("up.w") + F.col("down.w")).alias("w"), joined.alias("seg")
    )
    return _least(left.unionByName(bridged), ["p", "c"], "w", "seg", paths)


def _relax(known: DataFrame, edges: DataFrame, paths: bool) -> DataFrame:
    """Candidates for the children of ``known(v, root, d, path)``."""
    path = F.concat("path", "seg", F.array("c")) if paths else F.col("path")
    return known.join(edges, known["v"] == edges["p"]).select(F.col("c").alias("v"), "root", (F.col("d") + F.col("w")).alias("d"), path.alias("path"))


def _shortest(rows: DataFrame, paths: bool) -> DataFrame:
    return _least(rows, ["v", "root"], "d", "path", paths)


def _core_roots(core: DataFrame, start: DataFrame, paths: bool) -> DataFrame:
    """Shortest links from the roots inside the residue: frontier search, cycle-safe."""
    known, frontier = start, start
    while True:
        step = _shortest(_relax(frontier, core, paths), paths)
        old = known.select("v", "root", F.col("d").alias("d0"), F.col("path").alias("path0"))
        better = step.join(old, ["v", "root"], "left").where(
            F.col("d0").isNull() | (F.struct("d", "path") < F.struct(F.col("d0").alias("d"), F.col("path0").alias("path")))
        )
        frontier, n = cut_counted(better.select("v", "root", "d", "path"), "frontier")
        if not n:
            return known
        known = cut(_shortest(known.unionByName(frontier), paths), "core-roots")


def _components_of_cycles(core: DataFrame) -> DataFrame:
    """``(v, scc)`` of the residue's nodes that lie in a strongly connected component of two or more.

    Nodes without a parent or without a child in what is left are trimmed; then the smallest ancestor id
    colours every node, and from each colour's namesake the nodes of that colour that reach it back are
    one component. Repeats on the rest.
    """
    edges, before = cut_counted(core.select("p", "c").distinct(), "scc")
    found: list[DataFrame] = []
    while True:
        while before:  # trim
            edges, n = cut_counted(
                edges.join(edges.select(F.col("c").alias("p")).distinct(), "p", "left_semi")
                .join(edges.select(F.col("p").alias("c")).distinct(), "c", "left_semi").select("p", "c"), "scc-trim")
            done, before = n == before, n
            if done:
                break
        if not before:
            return stack(found) if found else core.sparkSession.createDataFrame([], "v bigint, scc bigint")
        colour = cut(edges.select(F.col("p").alias("v")).distinct().withColumn("k", F.col("v")), "colour")
        while True:
            sent = edges.join(colour, F.col("p") == F.col("v")).groupBy("c").agg(F.min("k").alias("s"))
            new = colour.join(sent, F.col("v") == F.col("c"), "left")
            new, n = cut_counted(
                new.select("v", F.least("k", F.coalesce("s", "k")).alias("k"), (F.col("s") < F.col("k")).alias("moved")), "colour")
            moved = new.where("moved").head(1)
            colour = new.select("v", "k")
            if not moved:
                break
        same = cut(
            edges.join(colour.select(F.col("v").alias("p"), F.col("k").alias("kp")), "p")
            .join(colour.select(F.col("v").alias("c"), F.col("k").alias("kc")), "c").where("kp = kc").select("p", "c", F.col("kp").alias("k")), "same")
        reach = cut(colour.where("v = k"), "reach")
        front = reach
        while True:
            back = same.join(front.select(F.col("v").alias("c")), "c").select(F.col("p").alias("v"), "k").distinct()
            front, n = cut_counted(back.join(reach.select("v"), "v", "left_anti").select("v", "k"), "back")
            if not n:
                break
            reach = cut(reach.unionByName(front), "reach")
        many = reach.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
        found.append(cut(reach.join(many, "k", "left_semi").select("v", F.col("k").alias("scc")), "found"))
        done = reach.select("v")
        edges, before = cut_counted(edges.join(done.withColumnRenamed("v", "p"), "p", "left_anti").join(done.withColumnRenamed("v", "c"), "c", "left_anti").select("p", "c"), "scc")


def _lines_in_cycles(gone: DataFrame, scc: DataFrame) -> DataFrame:
    """``(v, scc)`` of the bridged nodes of a round whose two neighbours are one node or lie in one component."""
    lines = gone.where("up is not null").select("v", F.col("up.p").alias("p"), F.col("down.c").alias("c"))
    lines = lines.join(scc.select(F.col("v").alias("p"), F.col("scc").alias("sp")), "p", "left")
    lines = lines.join(scc.select(F.col("v").alias("c"), F.col("scc").alias("sc")), "c", "left")
    inside = lines.where("p = c or sp = sc").select("v", "p", "sp")
    own = inside.select("v", F.coalesce("sp", "p").alias("scc"))
    return own.unionByName(inside.where("sp is null").select(F.col("p").alias("v"), F.col("p").alias("scc"))).distinct()


def hierarchy(nodes: DataFrame, links: DataFrame, paths: bool = True) -> Hierarchy:
    """``nodes(node)`` and ``links(node, parent)`` into roots, depths, paths and cycles.

    A parent without a row among the nodes does not count; a root is a node without parents. For every
    node and each root that it reaches upward there is one row with the smallest number of steps and the
    path from root to node (among equally short paths the first by the names on it; empty without ``paths``,
    which spares carrying them). ``trapped`` names the nodes on a cycle, own parent included, and those that
    reach no root. Nulls are no nodes and no parents, repeated rows count once, an empty input gives two
    empty results.
    """
    ids = number_names(nodes.select("node"), ["node"], "nodes")
    pairs = links.select(F.col("node").alias("cn"), F.col("parent").alias("pn")).dropna().distinct()
    pairs = pairs.join(ids.select(F.col("node").alias("cn"), F.col("id").alias("c")), "cn")
    pairs = cut(pairs.join(ids.select(F.col("node").alias("pn"), F.col("id").alias("p")), "pn").select("p", "c"), "links")
    own_parent = pairs.where("p = c").select(F.col("p").alias("v"))
    none = F.expr("cast(array() as array<bigint>)")
    edges, left = cut_counted(pairs.where("p <> c").select("p", "c", F.lit(1).cast("bigint").alias("w"), none.alias("seg")), "edges")

    rounds: list[tuple[DataFrame, DataFrame, int, int]] = []
    while left:
        gone, seen = cut_observed(_choose(edges, len(rounds), paths), "peeled", n=F.count(F.lit(1)), lines=F.count("up"), closed=F.count_if(F.col("up.p") == F.col("down.c")))
        if not seen["n"]:
            break
        rounds.append((edges, gone, seen["lines"], seen["closed"]))
        edges, left = cut_counted(_remove(edges, gone, paths), "edges")

    # roots have no parent at all, self-links included
    has_parent = pairs.select(F.col("c").alias("id")).distinct()
    start = ids.join(has_parent, "id", "left_anti").select(
        F.col("id").alias("v"), F.col("id").alias("root"), F.lit(0).cast("bigint").alias("d"), (F.array("id") if paths else none).alias("path"))
    start = cut(start, "roots")
    known = [_core_roots(edges, start, paths)] if left else [start]
    comps = [cut(_components_of_cycles(edges), "sccs")]
    cyclic = left > 0
    for at, gone, lines, closed in reversed(rounds):
        into = at.join(gone.where("up is null").select(F.col("v").alias("c")), "c", "left_semi").select("p", "c", "w", "seg")
        if lines:
            into = into.unionByName(gone.where("up is not null").select(F.col("up.p").alias("p"), F.col("v").alias("c"), F.col("up.w").alias("w"), F.col("up.seg").alias("seg")))
        known.append(cut(_shortest(_relax(stack(known), into, paths), paths), "roots"))
        if closed or (lines and cyclic):
            rows, n = cut_counted(_lines_in_cycles(gone, stack(comps)), "sccs")
            if n:
                comps.append(rows)
                cyclic = True
        drop_cut(at, gone)

    dist = stack(known)
    cyc = own_parent.unionByName(stack(comps).select("v")).distinct().withColumn("on_cycle", F.lit(True))
    rooted = dist.select("v").distinct().withColumn("rooted", F.lit(True))
    trapped = ids.withColumnRenamed("id", "v").join(cyc, "v", "left").join(rooted, "v", "left")
    trapped = trapped.where("on_cycle or rooted is null").select("node", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), F.col("rooted").isNull().alias("unrooted"))
    named = dist.join(ids.select(F.col("id").alias("v"), "node"), "v").join(ids.select(F.col("id").alias("root"), F.col("node").alias("root_name")), "root")
    roots = named.select("node", F.col("root_name").alias("root"), F.col("d").cast("int").alias("depth"), "path", F.col("v").alias("node_id"))
    return Hierarchy(roots, trapped)


def named_paths(h: Hierarchy, nodes: DataFrame | None = None, sep: str = " > ") -> DataFrame:
    """``(node, root, depth, path)`` with the path as names joined by ``sep``."""
    names = h.roots.select("node_id", "node").distinct()
    steps = h.roots.select("node_id", "root", F.posexplode("path").alias("i", "step"))
    steps = steps.join(names.select(F.col("node_id").alias("step"), F.col("node").alias("name")), "step")
    text = steps.groupBy("node_id", "root").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("s"))
    text = text.select("node_id", "root", F.array_join(F.transform("s", lambda x: x["name"]), sep).alias("path"))
    return h.roots.select("node_id", "node", "root", "depth").join(text, ["node_id", "root"]).select("node", "root", "depth", "path")
