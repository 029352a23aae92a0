"""Hierarchies against a brute-force search on random graphs, and the odd cases."""

import random
from collections import deque

import pytest

from graphloom.operators.closure import closure, reachable_from
from graphloom.operators.components import star_components
from graphloom.operators.hierarchy import hierarchy, named_paths


def brute(nodes, links):
    up = {n: {p for c, p in links if c == n and p in nodes} for n in nodes}
    down = {n: {c for c in nodes if n in up[c]} for n in nodes}
    roots = {}
    for r in (n for n in nodes if not up[n]):
        seen, q = {r: 0}, deque([r])
        while q:
            x = q.popleft()
            for y in down[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    q.append(y)
        for n, d in seen.items():
            roots[n, r] = d
    cyc = set()
    for n in nodes:
        seen, q = set(), deque(up[n])
        while q:
            x = q.popleft()
            if x == n:
                cyc.add(n)
                break
            if x not in seen:
                seen.add(x)
                q.extend(up[x])
    return roots, cyc | {n for n in nodes if not any(k[0] == n for k in roots)}


def run(spark, nodes, links):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(links, "node string, parent string")
    h = hierarchy(n, e)
    return {(r["node"], r["root"]): r["depth"] for r in h.roots.collect()}, {r["node"] for r in h.trapped.collect()}, h


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(60)]
    links = [(nodes[i], nodes[rnd.randrange(i)]) for i in range(1, 60) if rnd.random() < 0.85]
    links += [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(4 + 3 * seed)]
    roots, bad, _ = run(spark, nodes, links)
    assert (roots, bad) == brute(set(nodes), links)


def test_long_chain_and_figure_of_eight(spark):
    nodes = [f"c{i:03d}" for i in range(70)] + ["a", "b", "c", "d", "e"]
    links = [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 70)]
    links += [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "d"), ("e", "c000")]  # two cycles that share b, and a child below
    roots, bad, h = run(spark, nodes, links)
    assert (roots, bad) == brute(set(nodes), links)
    path = {(r["node"], r["root"]): r["path"] for r in named_paths(h).collect()}
    assert path["c069", "c000"].split(" > ") == nodes[:70]


def test_odd_rows(spark):
    n = spark.createDataFrame([("x",), ("x",), (None,), ("own",), ("y",)], "node string")
    e = spark.createDataFrame([("y", "x"), ("y", "x"), ("y", None), (None, "x"), ("own", "own"), ("x", "no row")], "node string, parent string")
    h = hierarchy(n, e)
    assert {(r["node"], r["root"], r["depth"]) for r in h.roots.collect()} == {("x", "x", 0), ("y", "x", 1)}
    assert [(r["node"], r["on_cycle"], r["unrooted"]) for r in h.trapped.collect()] == [("own", True, True)]


def test_empty(spark):
    h = hierarchy(spark.createDataFrame([], "node string"), spark.createDataFrame([], "node string, parent string"))
    assert not h.roots.collect() and not h.trapped.collect()


def test_closure_is_cycle_safe_and_idempotent(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "d"), ("a", "b")], "src string, dst string")
    c = closure(e)
    got = {(r["src"], r["dst"]): r["steps"] for r in c.collect()}
    assert got["a", "a"] == 3 and got["a", "d"] == 3 and len(got) == 12
    assert {(r["src"], r["dst"]) for r in closure(c.select("src", "dst")).collect()} == set(got)
    assert {(r["item"], r["node"]) for r in reachable_from(spark.createDataFrame([("i", "b")], "item string, node string"), e).collect()} == {("i", x) for x in "abcd"}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in star_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert star_components(spark.createDataFrame([], "u long, v long")).collect() == []
