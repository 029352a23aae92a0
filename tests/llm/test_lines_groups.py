import random

from pyspark.sql import functions as F

from graphloom.llm.groups import group_names, groups_of_ids
from graphloom.llm.lines import find_lines, letters, remove_lines, site_of


def test_sites(spark):
    paths = ["a-b/x/y.md", "./a-b/x.md", "a-b\\x\\y.md", "/a-b/x.md", "C:\\a-b\\x.md", ".//a-b//x.md", " a-b/x", "file.md", "", None]
    got = [r["s"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(site_of(F.col("p")).alias("s")).collect()]
    assert got == ["a-b"] * 7 + [None] * 3


def test_letters(spark):
    texts = ["**Still STUCK?** 12", "still  stuck", "STRAßE", "Straße", "1 2 3", "Ærø é", ""]
    got = [r["l"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(letters(F.col("t")).alias("l")).collect()]
    assert got == ["stillstuck"] * 2 + ["straße"] * 2 + ["", "ærøé", ""]


def test_lines(spark):
    rows = [(f"c{i}", f"p{i}", "s", f"Menu · {i}\nown {'abcdefghij'[i % 10] * (i + 1)}\n\nMENU") for i in range(10)] + [("c0", "p0", "s", "Menu · 0\nown a\n\nMENU")]
    rows += [(f"d{i}", f"q{i}", "t", "Menu") for i in range(5)] + [("e", "p99", "s", None), ("f", "p98", "s", ""), ("g", None, "s", "Menu"), ("h", "p1", None, "Menu"), (None, "p1", "s", "Menu")]
    df = spark.createDataFrame(rows, "chunk_id string, page string, site string, text string").withColumn("g", F.lit("clash")).withColumn("line_no", F.lit(7))
    df = df.select("chunk_id", "page", "site", "text")
    found = find_lines(df, "chunk_id", ["site"], "page", "text")
    assert {(r["chunk_id"], r["line_no"]) for r in found.collect()} == {(f"c{i}", n) for i in range(10) for n in (0, 3)}
    clean = {r["chunk_id"]: r["clean_text"] for r in remove_lines(df, "chunk_id", "text", found).collect()}
    assert clean["c1"] == "own bb\n" and clean["d1"] == "Menu" and clean["e"] is None and clean["f"] == ""
    assert find_lines(df.limit(0), "chunk_id", ["site"], "page", "text").collect() == []


def test_rows_without_key_stay(spark):
    df = spark.createDataFrame([(None, "a\nb"), (None, "a\nb"), (None, None), ("k", "a\nb"), ("k", "a\nb")], "k string, t string")
    found = spark.createDataFrame([("k", 0), (None, 1)], "k string, line_no int")
    got = sorted((r["k"] or "", r["clean_text"] or "") for r in remove_lines(df, "k", "t", found).collect())
    assert got == [("", ""), ("", "a\nb"), ("", "a\nb"), ("k", "b")]


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {x: find(x) for x in parent}


def partition(m):
    out = {}
    for x, r in m.items():
        out.setdefault(r, set()).add(x)
    return {frozenset(s) for s in out.values()}


def test_groups_of_all_shapes(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(150)]
    ring = [(1000 + i, 1000 + (i + 1) % 40) for i in range(40)]
    star = [(2000, 2001 + i) for i in range(80)]
    dense = [(3000 + a, 3000 + b) for a in range(12) for b in range(a)]  # a core that cannot be contracted
    loose = [(rnd.randrange(4000, 4300), rnd.randrange(4000, 4300)) for _ in range(180)]
    edges = [*chain, *ring, *star, *dense, *loose, (3000, 0)]
    got = {r["id"]: r["root"] for r in groups_of_ids(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert partition(got) == partition(roots([e for e in edges if e[0] != e[1]]))


def test_group_names(spark):
    rows = [("i", ["b", "a", None, "a"]), ("i", ["b", "c"]), ("c", ["b", "z"]), ("i", ["alone"]), ("i", None), ("i", []), ("i", ["", "x"]), ("i", ["ö", "Z"]), ("i", ["b", "a", None, "a"])]
    got = {tuple(r) for r in group_names(spark.createDataFrame(rows, "kind string, names array<string>")).collect()}
    assert got == {("i", "a", "a"), ("i", "a", "b"), ("i", "a", "c"), ("c", "b", "b"), ("c", "b", "z"), ("i", "Z", "Z"), ("i", "Z", "ö")}
    assert group_names(spark.createDataFrame([], "kind string, names array<string>")).collect() == []
