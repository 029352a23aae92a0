"""Results that grow with a product of two tables are made late: the larger rows are not shuffled."""

import re
from difflib import SequenceMatcher
from unittest import mock

import pandas as pd
from oracle import SMALL

from graphloom.operators import resolve as rs
from graphloom.operators import retrieve as rt
from graphloom.operators import triples as tr
from graphloom.plans import catalogue

QUERIES = catalogue.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins_last(df):
    """No exchange of rows after the last join."""
    p = plan_of(df)
    return "BroadcastHashJoin" in p and p.index("BroadcastHashJoin") < p.index("Exchange")


def test_schema_types_are_not_shuffled(spark):
    rows = [("p", tr.DOMAIN, "A"), ("p", tr.DOMAIN, "B"), ("q", tr.DOMAIN, "B"), ("q", tr.DOMAIN, "C"), ("p", tr.RANGE, "D"), ("x", "p", "y"), ("x", "q", "y"), ("x", "q", "z"), ("w", "q", "z"), ("x", tr.RDF_TYPE, "C"), ("y", tr.RDF_TYPE, "E")]
    t = spark.createDataFrame([(*r, "iri", None) for r in rows] + [("v", "p", "1", "literal", None)], "s string, p string, o string, o_kind string, o_dtype string")
    domains, ranges = tr.types_by_schema(t, tr.DOMAIN), tr.types_by_schema(t, tr.RANGE)
    assert sorted(map(tuple, domains.collect())) == [("v", "A"), ("v", "B"), ("w", "B"), ("w", "C"), ("x", "A"), ("x", "B")]
    assert sorted(map(tuple, ranges.collect())) == [("y", "D")]
    assert joins_last(domains) and joins_last(ranges)


def test_property_descriptions_are_not_shuffled(spark):
    assert joins_last(QUERIES["context_property_descriptions"](spark, SMALL))


def test_rejections_once_per_set(spark):
    """A set of n classes costs n rows per name, not n for each of n."""
    n = 300
    members = [f"C{i:03}" for i in range(n)]
    sets = spark.createDataFrame([(c, members) for c in members], "class string, class_set array<string>")
    same = spark.createDataFrame([("ab", c, ["a b", "a-b", "ab"]) for c in members] + [("x", "Lone", ["X", "x"])], "name_key string, class string, individuals array<string>")
    actions = spark.createDataFrame([("a b", "C007", "reject"), ("ab", "C008", "merge"), ("x", "C001", "reject")], "name string, class string, action string")
    out = rs.surviving_groups(same, actions, sets)
    assert sorted(map(tuple, out.collect())) == [("ab", c, ["a-b", "ab"]) for c in members] + [("x", "Lone", ["X", "x"])]
    assert plan_of(rs.surviving_groups(same, actions, sets)).count("Generate explode(class_set") == 0


def test_best_by_tokens_are_the_first_of_all(spark):
    """The pairs of entities and names are scored by sets of tokens; equal names, several labels and ties included."""
    words = ["Hall", "Lamp", "Ward", "Kit", "Clinic"]
    rows = [(f"u{i:03}", f"{words[i % 5]} {words[i % 3]} {i % 7}", f"f {i}") for i in range(120)]
    rows += [(f"u{i:03}", f"{words[(i + 1) % 5]}s", f"f {i}") for i in range(0, 120, 4)] + [("v1", "Lone", "Ward Hall 3"), ("v2", "12", "x")]
    names = spark.createDataFrame(rows, "uri string, label string, fragment string")
    entities = spark.createDataFrame([(x,) for x in ["Hall Lamp 3", "Ward Hall 3", "clinic", "f 12", "12", "kit kit", "none", None, "Lamps"]], "entity string")
    tok = lambda x: {w for w in re.findall("[a-z]+", x)}
    key = lambda x: re.sub("s$", "", x.lower().strip())
    want = {}
    for (e,) in (tuple(r) for r in entities.dropna().collect()):
        for u, l, f in rows:
            a, b = tok(key(e)), {w for w in tok(key(l)) if len(w) >= 4}
            score = 1.0 if key(e) in (key(l), key(f)) else round(0.15 * len(a & b) / max(len(a), 1) + 0.05, 6) if a & b else None
            if score is not None:
                want[e, u] = max(want.get((e, u), (0, "")), (score, l))
    got = {(r.entity, r.uri): (r.score, r.label) for r in rt.token_scores(entities, names).collect()}
    assert got == want
    assert rt.token_scores(entities, names).count() == len(want)
    first = lambda e: sorted((-s, u, l) for (x, u), (s, l) in want.items() if x == e)[:3]
    best = {(r.entity, r["rank"]): (-r.score, r.uri, r.label) for r in rt.best_by_tokens(entities, names).collect()}
    assert best == {(e, k + 1): x for e in {e for e, _ in want} for k, x in enumerate(first(e))}


def test_few_names_go_to_the_ratio(spark):
    """Of names of one pattern only those that could be among the first are compared in full."""
    key = [f"ward tag {i}" for i in range(1000, 6000)]
    row = lambda c, x: {f"{c}{i}": x.count(a) for i, a in enumerate(rt.ALPHABET)} | {f"{c}39": sum(a not in rt.ALPHABET for a in x)}
    names = pd.DataFrame([{"uri": k, "label": k, "lk": k, "fk": k, "ln": len(k), "fn": len(k), "cf": 0.8, "lt": ["ward"]} | row("l", k) for k in key])
    asked = pd.DataFrame([{"entity": "ward tag 1234", "ek": "ward tag 1234", "en": 13, "et": ["ward", "tag"]} | row("e", "ward tag 1234")])
    best = [{}]
    with mock.patch.object(rt, "SequenceMatcher", wraps=SequenceMatcher) as made:
        m = mock.Mock(wraps=SequenceMatcher(None))
        made.return_value, made.side_effect = m, None
        rt._best_of(names, asked, best, 10, 0.5)
    score = {k: 1.0 if k == "ward tag 1234" else 0.45 * (r := SequenceMatcher(None, "ward tag 1234", k).ratio()) + 0.35 * r + 0.125 for k in key}
    want = sorted(score, key=lambda k: (-round(score[k], 9), k))[:10]
    assert sorted(best[0], key=lambda k: (-round(best[0][k][0], 9), k)) == want
    assert m.ratio.call_count < 1500
