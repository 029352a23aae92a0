"""Nested records and orphan references: odd cases and brute force."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from graphloom.operators.nested import Rule, emit, read_record, read_tag, write_tagged
from graphloom.operators.orphans import existence_intervals, orphan_counts, orphan_references, orphan_report
from graphloom.plans.dealt import LOG

REC = {"input": "q", "resolved_question_type": [{"reasoning": "r0"}, "plain", None, {"question_type": "t"}],
       "resolve_entity_candidates": [None, {"type": "entity", "candidates": {"label": "a", "score": "0,5"}}, {"candidates": [None, {"label": None, "score": 1}, "text"]}]}


def test_wrappings():
    s = json.dumps(REC)
    for text in (s, "﻿" + s, f"  \n{s}\n", json.dumps(s), f"[{s}]", json.dumps(f"[{s}]"), "﻿" + json.dumps(s)):
        assert read_record(text) == REC
    for text in (None, "", "  ", s[:-1], "null", "[]", f"[{s},{s}]", "3", '"x"', "[" * 100_000):
        assert read_record(text) is None


def test_tables(spark):
    df = spark.createDataFrame([("k1", json.dumps(REC), 1), ("k1", json.dumps(REC), 2), ("k2", '{"input"', 3), (None, json.dumps(REC), 4), ("k3", "{}", 5)], "log_id string, payload string, pk int")
    path = write_tagged(emit(df, "log_id", "payload", LOG))
    cand = {(r["pk"], r["parent_pk"], tuple(r["path"]), r["label"], r["score"]) for r in read_tag(spark, path, "candidate", {"label": "string", "score": "double"}).collect()}
    assert cand == {("k1/entry:1/candidate:0", "k1/entry:1", (1, 0), "a", 0.5), ("k1/entry:2/candidate:1", "k1/entry:2", (2, 1), None, 1.0)}
    types = {(r["path"][0], r["reasoning"]) for r in read_tag(spark, path, "question_type", {"reasoning": "string"}).collect()}
    assert types == {(0, "r0"), (1, "plain"), (3, None)}
    assert {r["pk"] for r in read_tag(spark, path, "log", {"input": "string"}).collect()} == {"k1", "k3"}


def test_objects_as_maps(spark):
    rule = Rule("r", "", (), children=(Rule("by", "m", ("kind",), key_as="kind", children=(Rule("x", "xs", ("v",), scalar_as="v"),)),))
    rows = [("a", json.dumps({"m": {"p": {"xs": ["1", None, "2"]}, "q": None, "s": {}, "t": "text"}})), ("b", json.dumps({"m": ["no map"]})), ("c", "{}")]
    path = write_tagged(emit(spark.createDataFrame(rows, "k string, p string"), "k", "p", rule))
    assert {(r["pk"], r["kind"]) for r in read_tag(spark, path, "by", {"kind": "string"}).collect()} == {("a/by:0", "p"), ("a/by:2", "s")}
    assert {(r["pk"], r["parent_pk"], r["v"]) for r in read_tag(spark, path, "x", {"v": "int"}).collect()} == {("a/by:0/x:0", "a/by:0", 1), ("a/by:0/x:2", "a/by:0", 2)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "log_id string, payload string")
    assert emit(df, "log_id", "payload", Rule("log", "", ("a",))).collect() == []


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_intervals_and_ties(spark):
    ev = [("a", day(1), False), ("a", day(1), False), ("a", day(2), False), ("a", day(5), True), ("a", day(9), False), ("b", day(3), False), ("b", day(3), True), (None, day(1), False), ("c", None, False), ("d", day(1), True)]
    e = spark.createDataFrame(ev, "name string, at timestamp_ntz, ends boolean")
    got = {(r["name"], r["from_at"], r["to_at"]) for r in existence_intervals(e).collect()}
    assert got == {("a", day(1), day(5)), ("a", day(9), None)}
    refs = [(1, "a", day(0)), (2, "a", day(1)), (3, "a", day(5)), (4, "a", day(8)), (5, "a", day(9)), (6, "b", day(4)), (7, None, day(4)), (8, "zz", day(4)), (9, "a", None)]
    r = spark.createDataFrame(refs, "ref int, name string, at timestamp_ntz").selectExpr("*", "date_format(at, 'yyyy-MM') period", "'x' to_at")
    assert {x["ref"] for x in orphan_references(r, e).collect()} == {1, 3, 4, 6, 8}


def test_heavy_names_match_brute_force(spark):
    rnd = random.Random(3)
    names = ["hot"] * 40 + [f"n{i}" for i in range(40)]
    ev = [(rnd.choice(names), day(rnd.randrange(200) / 4), rnd.random() < 0.3) for _ in range(200)]
    refs = [(i, rnd.choice(names), day(rnd.randrange(200) / 4)) for i in range(600)]

    def lost(name, at):
        born = max((t for n, t, e in ev if n == name and not e and t <= at), default=None)
        gone = max((t for n, t, e in ev if n == name and e and t <= at), default=None)
        return born is None or (gone is not None and gone >= born)

    e = spark.createDataFrame(ev, "name string, at timestamp_ntz, ends boolean")
    r = spark.createDataFrame(refs, "ref int, name string, at timestamp_ntz").selectExpr("*", "date_format(at, 'yyyy-MM') period")
    out = orphan_references(r, e, heavy_share=0.05)
    want = {i for i, n, t in refs if lost(n, t)}
    assert {x["ref"] for x in out.collect()} == want
    report = {tuple(x) for x in orphan_report(out, ["period"]).collect()}
    assert sum(x[1] for x in report) == len(want)
    assert {tuple(x) for x in orphan_counts(r.unionByName(r.limit(50)).withColumn("n", F.lit(7)), e, ["period"], ["ref"]).collect()} == report


def test_no_references(spark):
    r = spark.createDataFrame([], "ref int, name string, at timestamp_ntz, period string")
    e = spark.createDataFrame([], "name string, at timestamp_ntz, ends boolean")
    assert orphan_references(r, e).collect() == []
