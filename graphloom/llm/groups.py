"""Pairwise matches into groups: strip leaves, compress chains, solve the core, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut, cut_counted, drop_cut, stack
from ..operators.components import star_components
from ..operators.ids import number_names


def _rank(col: Column, rnd: int) -> Column:
    return F.struct(F.xxhash64(F.lit(rnd), col), col)


def contract(edges: DataFrame, rnd: int) -> tuple[DataFrame, int]:
    """The vertices to remove from ``edges(u, v)``, u < v: ``(x, a, b)`` with neighbours a and b (b null: one), as a
    written table, and their number.

    All vertices of degree one and two are candidates; one is chosen if its rank in this round is above
    those of its candidate neighbours. So all leaves of a hub go at once, and a chain loses at least
    every so-manieth vertex in each round: list ranking by removal of independent sets.
    """
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    info = both.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("b")).where("n <= 2")
    cand = cut(info.select("x", "a", F.when(F.col("n") == 2, F.col("b")).alias("b")), "degree12")
    other = cand.select(F.col("x").alias("o"))
    rows = cand.join(other.withColumnRenamed("o", "oa"), F.col("a") == F.col("oa"), "left").join(other.withColumnRenamed("o", "ob"), F.col("b") == F.col("ob"), "left")
    own = _rank(F.col("x"), rnd)
    free = lambda o: F.col(o).isNull() | (own > _rank(F.col(o), rnd))
    out = cut_counted(rows.where(free("oa") & free("ob")).select("x", "a", "b"), "removed")
    drop_cut(cand)
    return out


def groups_of_ids(edges: DataFrame, min_removed: float = 0.02) -> DataFrame:
    """``(id, root)`` for every vertex of ``edges(u, v)``; equal roots, equal group.

    Rounds of ``contract`` run while a round removes at least ``min_removed`` of the edges; what is left
    is the reduced core, solved by star contraction. Removed vertices then take the root of the
    neighbour that they had, last round first. Each round's tables are written to the shared folder.
    """
    ends, n = cut_counted(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    cur = ends
    rounds: list[DataFrame] = []
    while n:
        gone, m = contract(cur, len(rounds))
        if not m:
            break
        rounds.append(gone)
        out = gone.select("x")
        kept = cur.join(out.withColumnRenamed("x", "u"), "u", "left_anti").join(out.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v")
        bridged = gone.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
        before, few = cur, m < min_removed * n
        cur, n = cut_counted(kept.unionByName(bridged).distinct(), "links")
        if before is not ends:
            drop_cut(before)
        if few:
            break
    all_ids = ends.select(F.col("u").alias("id")).union(ends.select("v")).distinct()
    alone = all_ids.join(stack(rounds).select(F.col("x").alias("id")), "id", "left_anti") if rounds else all_ids
    known = []
    if n:
        core = star_components(cur).select(F.col("node").alias("id"), F.col("component").alias("root"))
        known.append(cut(core, "core"))
        alone = alone.join(known[0].select("id"), "id", "left_anti")
    known.append(cut(alone.select("id", F.col("id").alias("root")), "roots"))
    for gone in reversed(rounds):
        have = stack(known)
        known.append(cut(gone.join(have, gone["a"] == have["id"]).select(F.col("x").alias("id"), "root"), "roots"))
    drop_cut(ends, *rounds)
    return stack(known)


def group_names(sets: DataFrame) -> DataFrame:
    """``sets(kind, names ARRAY)`` into ``(kind, group_key, member)``: names in one array are linked.

    Kinds never mix. The key is the group's smallest name in code point order. Null arrays, null and
    empty names and names alone in their group give no row; names are compared as they are given.
    """
    clean = sets.select("kind", F.array_sort(F.array_distinct(F.filter("names", lambda x: x.isNotNull() & (x != "")))).alias("names")).where("size(names) > 1")
    pairs = clean.select("kind", F.col("names")[0].alias("first"), F.explode(F.slice("names", 2, F.size("names") - 1)).alias("other")).distinct()
    pairs = cut(pairs, "pairs")
    named = pairs.select("kind", F.col("first").alias("name")).union(pairs.select("kind", "other"))
    ids = number_names(named, ["kind", "name"], "names")
    edges = pairs.join(ids.select("kind", F.col("name").alias("first"), F.col("id").alias("u")), ["kind", "first"])
    edges = edges.join(ids.select("kind", F.col("name").alias("other"), F.col("id").alias("v")), ["kind", "other"]).select("u", "v")
    groups = cut(groups_of_ids(edges), "groups")
    keys = groups.groupBy("root").agg(F.min("id").alias("key_id"))
    members = groups.join(keys, "root").join(ids, "id").select("kind", F.col("name").alias("member"), "key_id")
    return members.join(ids.select(F.col("id").alias("key_id"), F.col("name").alias("group_key")), "key_id").select("kind", "group_key", "member")
