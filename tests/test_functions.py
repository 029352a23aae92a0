"""Functions and operators that SQL does not cover, against plain Python."""

import json
import random
import re
from difflib import SequenceMatcher
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import markdown as md
from graphloom.functions import similarity as sm
from graphloom.common import broadcast_blocks
from graphloom.functions import text as fx
from graphloom.functions.show import deduped_json
from graphloom.model import Recorded, Remote, Rules, failures, predict
from graphloom.operators import ground as gr
from graphloom.operators import retrieve as rt
from graphloom.operators import triples as tr
from graphloom.operators.cluster import average_linkage, cluster_sizes, fuzzy_name_clusters, nearest, resolution_ratios, vector_pairs
from graphloom.operators.evaluate import nested_tokens, paired
from graphloom.plans.answer import rag_answer, validate_answers
from graphloom.plans.preprocess import clean_pages
from graphloom.sources.turtle import parse_turtle


def test_ratio_and_bounds(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcd e") for _ in range(rnd.randrange(12)))
    data = [(word(), word()) for _ in range(200)] + [("", ""), (None, "a")]
    data += [("Éclair-9 å", "eclair_9 ä"), ("x" * 40, "xy" * 20)]
    df = spark.createDataFrame(data, "a string, b string").select("a", "b", F.length("a").alias("la"), F.length("b").alias("lb"), *sm.counted("a", "x"), *sm.counted("b", "y"))
    df = df.select("a", "b", sm.match_ratio("a", "b").alias("r"), sm.length_bound(F.col("la"), F.col("lb")).alias("c"), sm.count_bound("x", "y", F.col("la"), F.col("lb")).alias("g"), sm.fuzzy_score(F.col("a"), F.col("b")).alias("f"))
    for x in df.collect():
        if x["a"] is None:
            assert x["r"] is None and x["f"] == 0
            continue
        assert x["r"] == pytest.approx(SequenceMatcher(None, x["a"], x["b"]).ratio())
        assert x["r"] <= x["g"] + 1e-12 <= x["c"] + 1e-9
        a, b = x["a"].lower().strip(" "), x["b"].lower().strip(" ")
        ta, tb = set(re.findall("[a-z]+", a)), set(re.findall("[a-z]+", b))
        share = len(ta & tb) / max(len(ta), 1)
        assert x["f"] == pytest.approx(0.8 * SequenceMatcher(None, a, b).ratio() + 0.15 * share + 0.05 * (share > 0))
    assert spark.range(1).select(sm.fuzzy_match(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("m")).first()["m"] is True


def test_candidates_match_brute_force(spark):
    rnd = random.Random(5)
    words = ["Sensor", "unit", "Ward", "Clinic", "Tag", "study", "Nord", "x1"]
    name = lambda: " ".join(rnd.choice(words) + rnd.choice(["", "s", str(rnd.randrange(30))]) for _ in range(rnd.randrange(1, 4)))
    labels = [(f"u{i:03d}", name(), name() if i % 3 else None) for i in range(120)] + [("u000", "Another label", "f"), ("u999", "", "")]
    names = spark.createDataFrame(labels, "uri string, label string, fragment string").withColumn("fragment", F.coalesce("fragment", "label"))
    asked = [name() for _ in range(25)] + ["", "Wards", None]
    e = spark.createDataFrame([(a,) for a in asked], "entity string").withColumn("label", F.lit("clash"))
    key = lambda t: re.sub("s$", "", t.lower().strip(" "))
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {}
    for a in {x for x in asked if x is not None}:
        best = {}
        for uri, label, frag in labels:
            k, lk, fk = key(a), key(label), key(frag if frag is not None else label)
            et, lt = set(re.findall("[a-z]+", k)), {t for t in re.findall("[a-z]+", lk) if len(t) >= 4}
            share = len(et & lt) / max(len(et), 1)
            score = 1.0 if k in (lk, fk) else 0.45 * ratio(k, lk) + 0.35 * ratio(k, fk) + 0.15 * share + 0.05 * (share > 0)
            if score >= 0.5:
                best[uri] = max(best.get(uri, 0), score)
        want[a] = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    for limit in (16 << 20, 2000):  # the second makes several blocks of the query set
        with mock.patch.object(rt, "broadcast_blocks", lambda df, n=limit: broadcast_blocks(df, n)):
            got = {}
            for r in rt.candidates(e, names).collect():
                got.setdefault(r["entity"], []).append((r["rank"], r["uri"], r["score"]))
        assert set(got) == {k for k, v in want.items() if v}
        for k, v in got.items():
            assert [(u, pytest.approx(s)) for _, u, s in sorted(v)] == want[k]


def test_fuzzy_clusters_match_brute_force(spark):
    rnd = random.Random(6)
    base = ["Nordvik Ward", "Tag alpha", "Clinic of rest", "sensor unit nine"]
    names = sorted({rnd.choice(base) + rnd.choice(["", "s", " 1", " 2", " A"]) for _ in range(60)} | {"Zzz", ""})

    def terms(n):
        w = re.findall(r"\w+", n.lower())
        words = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        chars = []
        for t in (f" {x} " for x in n.lower().split()):
            for k in (3, 4):
                chars += [t[i : i + k] for i in range(len(t) - k + 1)] if len(t) > k else [t] if k == 3 or len(t) == 4 else []
        return {"w": words, "c": chars}

    bags = [terms(n) for n in names]
    vocab = sorted({(b, t) for x in bags for b in x for t in x[b]})
    df = {v: sum(v[1] in x[v[0]] for x in bags) for v in vocab}
    mat = np.zeros((len(names), len(vocab)))
    for i, x in enumerate(bags):
        for b, weight in (("w", 20.0), ("c", 5.0)):
            row = np.array([x[b].count(t) * (np.log((1 + len(names)) / (1 + df[b, t])) + 1) if k == b else 0.0 for k, t in vocab])
            if row.any():
                mat[i] += row / np.linalg.norm(row) * weight
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    unit = mat / np.where(norm > 0, norm, 1)
    groups = [[i] for i in range(len(names)) if norm[i] > 0]
    while True:
        best = max(((round(float(np.mean([unit[i] @ unit[j] for i in a for j in b])), 12), -ai, -bi) for ai, a in enumerate(groups) for bi, b in enumerate(groups) if ai < bi), default=(-1, 0, 0))
        if best[0] <= 0.6:
            break
        groups[-best[1]] += groups.pop(-best[2])
    want = {frozenset(names[i] for i in g) for g in groups if len(g) > 1}
    got = {}
    for r in fuzzy_name_clusters(spark.createDataFrame([(n,) for n in names] + [(names[1],), (None,)], "name string"), "name").collect():
        got.setdefault(r["cluster"], set()).add(r["name"] if "name" in r else r["key"])
    assert set(map(frozenset, got.values())) == want and all(k == min(v) for k, v in got.items())


def test_nested_texts(spark):
    rows = ['{"b":[{"x":1,"y":[2,2]},{"y":[2],"x":1},"A"],"a":null}', "[1,1,[1,1]]", "no", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [json.loads(r["d"]) if r["d"] else None for r in df.select(deduped_json("t").alias("d")).collect()] == [{"b": [{"x": 1, "y": [2]}, "A"], "a": None}, [1, [1]], None, None]
    assert [r["k"] for r in df.select(nested_tokens("t").alias("k")).collect()] == [["1", "2", "a", "b", "x", "y"], ["1"], [], []]
    ctx = spark.createDataFrame([('{"http://e#A%20b":["http://e#x%2Fy","50% # off"]}',)], "t string")
    assert json.loads(ctx.select(rt.readable_json(F.col("t")).alias("c")).first()["c"]) == {"A b": ["x/y", "50% # off"]}


def test_uri(spark):
    texts = ["a b+c/é-~.*_", "100%", "%zz", "ø", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["e"], r["d"]) for r in df.select(fx.uri_fragment("t").alias("e"), fx.uri_decode(fx.uri_fragment("t")).alias("d")).collect()]
    assert got[0][0] == "a%20b%2Bc%2F%C3%A9-~.%2A_" and [d for _, d in got] == texts
    assert df.select(fx.uri_decode("t").alias("d")).collect()[2]["d"] == "%zz"


def test_json_repair(spark):
    texts = ['{"a":1}', '[{"a":1},{"b"', '{"x":[{"a":1},{"b', "nothing", None, ""]
    got = [r["j"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fx.repaired_json("t").alias("j")).collect()]
    assert got == ['{"a":1}', '[{"a":1}]', '{"x":[{"a":1}]}', None, None, None]


def test_html(spark):
    assert spark.createDataFrame([("a &amp; b &eacute; &#8364;",), (None,)], "t string").select(fx.html_unescape("t").alias("u")).collect()[0]["u"] == "a & b é €"


PAGE = """---
title: "My page"
date: 2024-01-02
tags: [a, "b"]
draft: false
---
{{< alert >}}Mind <b>this</b>{{< /alert >}}
{{< card title="Big" subtitle="Small" >}}inner {{< img alt="A" src="x.png" >}}{{< /card >}}
## One
1) first
We are currently updating our support articles and some info may be outdated.
see [there](../other/index.en.md) and <a href="http://x">out</a>
### Two
text - end.
"""


def cleaned(spark, text, path="site/support/page/index.en.md"):
    return clean_pages(spark.createDataFrame([(path, text)], "source_path string, raw string")).first()


def test_page(spark):
    c = cleaned(spark, PAGE)
    assert c["front_matter"] == {"title": "My page", "date": "2024-01-02", "tags": '["a","b"]', "draft": "false"}
    text, flags = c["clean_text"], c["cleaning_flags"]
    assert "Warning: Mind this" in text and "## Big\ntitle: Big\n### Small\nsubtitle: Small" in text
    assert "Image: A (source: x.png)" in text and "[there](/site/support/other)" in text and "[out](http://x)" in text
    assert "1. first" in text and flags["boilerplate_removed"] and not flags["html_residue"] and not flags["shortcode_residue"]
    chunks = md.page_chunks(text, "My page", 12)
    assert all(x["token_count"] <= 12 for x in chunks) and [x["chunk_index"] for x in chunks] == list(range(len(chunks)))
    words = lambda t: t.split()
    assert words(" ".join(x["chunk_text_clean"] for x in chunks)) == words(text)


def test_shortcodes():
    cases = {
        '{{< img src="a.png" >}}': "Image source: a.png", '{{<img alt="x &amp; y"/>}}': "Image: x & y", "{{< img >}}": "",
        '{{< team-member name="Ann" name_line2="Lee" title="<b>Nurse</b>" linkedin="l" >}}': "Team member: Ann Lee; role: Nurse; linkedin: l",
        '{{< code language="py" title="T" >}}\nx = 1\n{{< /code >}}': "Code example (py): T\n```py\nx = 1\n```", "{{< code >}}": "Code example (text)",
        "{{< lead >}} a {{< alert >}}b{{< /alert >}} {{< /lead >}}": "Lead: a Warning: b", '{{< card title="T" text="t" >}}': "title: T\ntext: t",
        '{{< grid >}}{{< card title="A" >}}in{{< /card >}}{{< card label="B" >}}{{< /grid >}}': "## A\ntitle: A\ninlabel: B", "a {{< /alert >}} b": "a {{< /alert >}} b", '{{< x text="1" text="2 > 1" >}}': "text: 2 > 1",
        "no {{ marks": "no {{ marks", "": "",
    }
    assert {k: md.expand(k) for k in cases} == cases


def test_front_matter_and_html(spark):
    c = cleaned(spark, "---\na: 007\nb: -1.50\nc: [x, 'y z']\nd: \"q: r\"\n# e: no\nf: TRUE\na: 8\ng: []\nh:\n---\nbody")
    assert c["front_matter"] == {"a": "8", "b": "-1.50", "c": '["x","y z"]', "d": "q: r", "f": "true", "g": "[]", "h": ""} and c["clean_text"] == "body"
    assert cleaned(spark, "no block\n---\n")["front_matter"] == {} and cleaned(spark, None)["clean_text"] == "" and cleaned(spark, "---\nt: 1\n---")["clean_text"] == ""
    assert cleaned(spark, 'see <a class="x" href="/u"> <b>the\tpage</b> </a>,<br/><A HREF="mailto:v"><i></i></A> &lt;tag&gt; &eacute;')["clean_text"] == "see [the page](/u),\nmailto:v <tag> é"
    assert cleaned(spark, "[a](b.en.md) [c](../../../../x.md) [d](https://e) [f](/g) [h]( ../_index.da.md )")["clean_text"] == "[a](/site/support/page/b) [c](../../../../x.md) [d](https://e) [f](/g) [h](/site/support)"


def test_titles_in_a_row():
    s = [md.Section("A", 1, "# A", 0), md.Section("B", 2, "## B", 1), md.Section("C", 3, "### C\n" + "w " * 70, 2)]
    assert [x.title for x in md.groups(s, 100)[0].sections] == ["A", "B", "C"]
    assert [x.title for x in md.groups(s, 100, compat=True)[0].sections] == ["A", "C"]


def test_turtle():
    text = '''@prefix ex: <http://e#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    # note
    ex:a%20b a ex:C , <http://e#D> ; ex:p "x\\"\\u00e9\\n"@en , 5, 2.5 , true, "2024-01-01"^^xsd:date ; .
    ex:c.d ex:q """two
lines""" .'''
    got = list(parse_turtle(text))
    assert got[0] == ("http://e#a%20b", tr.RDF_TYPE, "http://e#C", "iri", None) and got[2][2] == 'x"é\n'
    assert [t[4] and t[4].split("#")[1] for t in got] == [None, None, None, "integer", "decimal", "boolean", "date", None]
    assert got[-1][0] == "http://e#c.d" and got[-1][2] == "two\nlines"
    for bad in ("ex:a ex:b ex:c .", "<a> <b> [ ] .", "@prefix ex: <e> . ex:a ex:b ex:c"):
        with pytest.raises((ValueError, IndexError)):
            list(parse_turtle(bad))


def test_typed_literals(spark):
    rows = [("True", "xsd:boolean"), ("t", "xsd:boolean"), ("007", "xsd:integer"), ("x", "xsd:integer"), ("1.5", "xsd:decimal"), ("v", "xsd:nope"), ("v", None), (None, "xsd:string")]
    got = [tuple(r["l"]) for r in spark.createDataFrame(rows, "v string, d string").select(tr.typed_literal(F.col("v"), F.col("d")).alias("l")).collect()]
    x = tr.XSD
    assert got == [("true", x + "boolean"), ("false", x + "boolean"), ("7", x + "integer"), ("x", None), ("1.5", x + "decimal"), ("v", None), ("v", None), (None, None)]


def triples(spark, rows):
    return spark.createDataFrame([(s, p, o, "iri", None) for s, p, o in rows], "s string, p string, o string, o_kind string, o_dtype string")


def test_inference_order_and_validation(spark):
    rows = [("x", tr.RDF_TYPE, "A"), ("A", tr.SUBCLASS, "B"), ("B", tr.SUBCLASS, "A"), ("B", tr.EQUIVALENT, "E"), ("E", tr.SUBCLASS, "F"), (tr.EX + "hasPart", tr.RDF_TYPE, tr.OBJECT_PROPERTY),
            (tr.EX + "hasPart", tr.DOMAIN, "A"), ("x", tr.EX + "hasPart", "y"), ("y", tr.EX + "hasPart", "x")]
    t = triples(spark, rows)
    assert {tuple(r) for r in tr.invalid_links(t).collect()} == {("y", tr.EX + "hasPart", "x")}
    types = lambda d: {(r["s"], r["o"]) for r in d.where(F.col("p") == tr.RDF_TYPE).collect() if r["s"] == "x"}
    once = tr.infer(tr.validate(t))
    assert types(once) == {("x", k) for k in "ABE"} and once.where(F.col("p") == tr.EX + "isPartOf").count() == 1
    assert types(tr.infer(t, saturate=True)) == {("x", k) for k in "ABEF"}
    assert {r["o"] for r in tr.direct_types(once).where("s = 'x'").collect()} == {"A", "B", "E"}
    assert {r["o"] for r in tr.direct_types(once, compat=True).where("s = 'x'").collect()} == {"E"}


def test_average_linkage():
    def brute(v, most):
        c = [[i] for i in range(len(v))]
        while len(c) > 1:
            d, a, b = min((np.mean([1 - v[i] @ v[j] for i in x for j in y]), p, q) for p, x in enumerate(c) for q, y in enumerate(c) if p < q)
            if d >= most:
                break
            c[a] += c.pop(b)
        return sorted(sorted(x) for x in c)

    rnd = np.random.default_rng(2)
    for _ in range(10):
        v = rnd.normal(size=(14, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        labels = average_linkage(list(range(14)), v, 0.3)
        assert sorted([i for i in range(14) if labels[i] == k] for k in set(labels)) == brute(v, 0.3)


def test_vectors(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(98, None), (99, [0.0] * 8)], "id long, v array<float>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.5}
    assert {(r["a"], r["b"]) for r in vector_pairs(df, "id", "v", 0.5, block_rows=20).collect()} == want
    top = nearest(df.where("id = 5"), df, "id", "id", "v", 3).orderBy("rank").collect()
    assert [r["item"] for r in top] == [int(i) for i in np.argsort(-np.round(u @ u[5], 6), kind="stable")[:3]]


def test_grounding():
    ctx = {"types": ["TeamMember"], "superclasses": {"TeamMember": ["Person"]}, "equivalent_classes": [], "class_descriptions": {"Person": {}}, "members": ["Al"], "chunk_id": ["1", "12"],
           "properties_by_type": {"TeamMember": {"outgoing_data_properties": [{"property": "hasRole", "value": "CTO & Founder"}, {"property": "level", "value": "1"}]}}}
    ctx["class_descriptions"] = {"Person": "a human being who acts"}
    m = gr.ground_one("The teammember is CTO & founder, a human being who acts, chunk 12.", ctx)
    assert m["types"] == ["TeamMember"] and m["superclasses"] == ["Person"] and m["property_values"] == {"hasRole": "cto & founder"} and m["chunk_id"] == ["12"] and m["members"] == []
    assert gr.ground_one("chunk 12", ctx, compat=True)["chunk_id"] == ["1", "12"]
    assert gr.ground_one("", ctx) is None


def test_merge_is_right_biased_and_idempotent(spark):
    empty = "array<string>"
    kind = "struct<" + ",".join(f"{f}:{empty}" for f in gr.FACETS) + ",property_values:map<string,string>>"
    r = (["b", "a"], None, [], ["p"], [], [], [], {"k": "old", "x": "1"})
    a = (["a", "c"], ["s"], None, [], [], [], [], {"k": "new"})
    df = spark.createDataFrame([(r, a)], f"r {kind}, a {kind}")
    m = df.select(*gr.merge_mappings()).first()
    assert m["types"] == ["a", "b", "c"] and m["superclasses"] == ["s"] and m["property_values"] == {"k": "new", "x": "1"}
    twice = df.select(F.struct(*gr.merge_mappings()).alias("r")).withColumn("a", F.col("r")).select(*gr.merge_mappings()).first()
    assert twice == m


def test_providers(spark):
    rows = spark.createDataFrame([("k1", ["A"]), ("k2", ["A", "B"])], "key string, classes array<string>")
    by = {r["key"]: r for r in predict(rows, "polysemy", Rules()).collect()}
    assert by["k1"]["by"] == "rule" and by["k1"]["result"]["decisions"][0]["action"] == "merge" and {d["action"] for d in by["k2"]["result"]["decisions"]} == {"reject"}
    told = spark.createDataFrame([("polysemy", "k2", '{"decisions":[{"class":"A","action":"merge"}')], "operator string, key string, output string")
    by = {r["key"]: r for r in predict(rows, "polysemy", Recorded(told)).collect()}
    assert [tuple(d) for d in by["k2"]["result"]["decisions"]] == [("A", "merge"), ("B", "reject")]  # left out classes are rejected
    far = predict(rows, "polysemy", Remote(lambda op, texts: ['{"decisions":[]}'] * len(texts), parallel=1)).where("key = 'k2'").first()
    assert far["by"] == "model" and {d["action"] for d in far["result"]["decisions"]} == {"reject"}

    def broken(op, texts):
        raise RuntimeError

    out = predict(rows, "polysemy", Remote(broken, parallel=1, tries=2))
    assert out.where("key = 'k2'").first()["by"] == "failed" and [tuple(r) for r in failures(out, "polysemy").collect()] == [("polysemy", "k2")]


def told(spark, operator, row, kind, output):
    rows = spark.createDataFrame([("k", *row)], f"key string, {kind}")
    return predict(rows, operator, Recorded(spark.createDataFrame([(operator, "k", output)], "operator string, key string, output string"))).first()


def test_outputs_are_held_to_the_row(spark):
    d = lambda *rows: json.dumps({"decisions": [dict(zip(("original_id", "action", "target_id"), r)) for r in rows]})
    for op in ("semantic_cluster", "class_equivalence"):
        got = told(spark, op, (["a", "b", "c", "d"],), "members array<string>", d(("a", "equivalent", "b"), ("b", "equivalent", "zz"), ("c", "equivalent", "c"), ("x", "equivalent", "a"), ("a", "keep_distinct", None)))
        assert [tuple(x) for x in got["result"]["decisions"]] == [("a", "equivalent", "b"), ("b", "keep_distinct", None), ("c", "keep_distinct", None), ("d", "keep_distinct", None)]
    axioms = '{"axioms":[{"subclass":"A","superclass":"Thing"},{"subclass":"A","superclass":"Nope"},{"subclass":"Z","superclass":"Thing"}]}'
    assert [tuple(x) for x in told(spark, "base_grounding", (["A"], ["Thing"]), "classes array<string>, base_classes array<string>", axioms)["result"]["axioms"]] == [("A", "Thing")]
    assert told(spark, "base_grounding", ([], ["Thing"]), "classes array<string>, base_classes array<string>", axioms)["by"] == "rule"
    assert [x["id"] for x in told(spark, "instances", (["A"],), "classes array<string>", '{"instances":[{"id":"i","class":"A"},{"id":"j","class":"B"}]}')["result"]["instances"]] == ["i"]
    bad = told(spark, "class_extraction", ("t",), "text string", "no json")
    assert bad["by"] == "failed" and bad["result"]["classes"] == []
    assert told(spark, "instance_cleanup", ("n",), "name string", '{"other": 1}')["result"]["action"] == "keep"


def test_cluster_figures(spark):
    c = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("e", "e"), ("e", "f"), ("e", "g")], "cluster string, key string")
    assert {tuple(r) for r in cluster_sizes(c).collect()} == {(2, 2, 4), (3, 1, 3)}
    assert {tuple(r) for r in resolution_ratios(spark.createDataFrame([("merge",), ("merge",), ("reject",)], "action string")).collect()} == {("merge", 2, 0.666667), ("reject", 1, 0.333333)}


def test_rag_and_answer_check(spark):
    docs = spark.createDataFrame([(1, "the blue lamp stands in the hall"), (2, "a red door leads out"), (3, None), (4, ""), (5, "the blue lamp again")], "doc_id long, text string")
    q = spark.createDataFrame([("q1", "where is the blue lamp"), ("q2", "zzz"), ("q3", None)], "key string, question string")
    got = {r["key"]: r for r in rag_answer(q, docs, Rules(), k=2).collect()}
    assert set(got["q1"]["doc_ids"]) == {1, 5} and "blue lamp stands" in got["q1"]["prompt"] and got["q1"]["answer"].startswith("I can't answer") and got["q3"]["doc_ids"] == []
    m = "struct<" + ",".join(f"{f}:array<string>" for f in gr.FACETS) + ",property_values:map<string,string>>"
    rows = spark.createDataFrame([("a", "E", (["T"], [], [], [], [], [], [], {"p": "v"})), ("b", "E", ([], [], [], [], [], [], [], {})), ("c", "E", None)], f"key string, entity string, mapped_entity {m}")
    out = {r["key"]: r for r in validate_answers(rows, Rules()).collect()}
    assert {k: r["decision"] for k, r in out.items()} == {"a": "accept", "b": "reject", "c": "reject"} and [tuple(x) for x in out["a"]["triples"]] == [("E", "be", "T"), ("E", "p", "v")]


def test_pairing_demands_both_sides(spark):
    a, b = spark.createDataFrame([("q1", 1), ("q2", 2)], "q string, x int"), spark.createDataFrame([("q1", 3)], "q string, x int")
    assert paired(a.where("q = 'q1'"), b, "q").first()["other_x"] == 3
    with pytest.raises(Exception, match="no result of the other system"):
        paired(a, b, "q").collect()
