"""Queries answer for all of their data, not for a part of it."""

import json
from urllib.parse import quote

from oracle import SMALL

from graphloom.operators import resolve as rs
from graphloom.plans import catalogue

QUERIES = catalogue.queries()


def test_scoped_classes_of_late_chunks(spark, tmp_path):
    df = spark.createDataFrame([("A", [0, 9000]), ("B", [4999]), (" C ", [5000]), ("D", [123456]), ("E", []), ("F", None)], "class string, chunk_ids array<bigint>")
    df.write.parquet(str(tmp_path / "tbox_classes.parquet"))
    assert sorted(r["class"] for r in QUERIES["kb_scoped_classes"](spark, str(tmp_path)).collect()) == ["A", "B", "C", "D"]
    assert sorted(r["class"] for r in rs.scoped_classes(df, 5000).collect()) == ["A", "B"]


def test_counts_of_all_contexts(spark):
    nodes = {r["node"] for r in QUERIES["kb_node_kinds"](spark, SMALL).where("kind in ('class', 'individual')").collect()}
    assert {r["uri"] for r in QUERIES["context_counts"](spark, SMALL).collect()} == nodes


def test_uris_of_whole_texts(spark, tmp_path):
    rows = [(1, "s", "one\ntwo  æ%\r\n\tthree\n"), (2, None, "\n\n#"), (3, "s", None), (4, "s", "")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["encoded"], r["decoded"]) for r in QUERIES["uri_roundtrip"](spark, str(tmp_path)).collect()}
    whole = {k: " ".join(x for x in (s or "", t) if x is not None) for k, s, t in rows}
    assert got == {k: (quote(v, safe=""), v) for k, v in whole.items()}


def test_question_types_in_lists(spark, tmp_path):
    one, other = {"question_type": "membership"}, {"question_type": "taxonomic"}
    logs = {"l1": [one, other], "l2": [None, "x", other], "l3": one, "l4": [], "l5": "membership", "l6": None}
    rows = [(k, "site", json.dumps({"input": "q", "resolved_question_type": v, "resolved_answer_form": [{"answer_form": "list"}]})) for k, v in logs.items()]
    spark.createDataFrame(rows, "log_id string, site string, payload string").write.parquet(str(tmp_path / "inference_logs.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    want = {"l1": "membership", "l2": "taxonomic", "l3": "membership"}
    assert {r["log_id"]: r["question_type"] for r in run("sample_questions")} == want
    assert {r["log_id"]: r["qt"] for r in run("question_labels")} == {k: want.get(k, "unknown") for k in logs}
    assert {r["tier"]: r["total"] for r in run("eval_pass_rates") if r["domain"] == "site" and r["check"] == "type_known"} == {"membership": 2, "taxonomic": 1, "unknown": 3, "(all)": 6}


def test_answers_on_whole_contexts(spark, tmp_path):
    ent = {"types": ["Lamp"], "superclasses": {"Lamp": ["Device"]}, "equivalent_classes": ["Light"], "class_descriptions": {"Lamp": None}, "members": [],
           "properties_by_type": {"Lamp": {"outgoing_data_properties": [{"property": "hasCode", "value": "DU 10701"}], "outgoing_object_properties": [{"property": "isIn", "object": "Hall"}]}}}
    obj = {"uri": "http://x/o#Big%20Hall", "types": ["Room"]}
    log = {"extracted_entity": {"primary_entity": "L1"}, "full_context": [{"entity_context": ent, "object_context": obj}], "generated_answer": {"answer": "a light with code DU 10701", "reasoning": "it stands in the hall, a room"}}
    spark.createDataFrame([("l1", json.dumps(log))], "log_id string, payload string").write.parquet(str(tmp_path / "inference_logs.parquet"))
    got = {tuple(r)[1:] for r in QUERIES["ground_answers"](spark, str(tmp_path)).collect()}
    assert got == {("L1", "be", "Light"), ("L1", "hasCode", "du 10701"), ("L1", "isIn", "hall"), ("Big Hall", "be", "Room")}


def test_subtree_sizes(spark, tmp_path):
    rows = [("A", []), ("B", ["A"]), ("C", ["A"]), ("D", ["B", "C"]), ("X", ["Y"]), ("Y", ["X"])]
    kind = "class string, parents array<string>"
    spark.createDataFrame(rows[:3], kind).write.parquet(str(tmp_path / "base_classes.parquet"))
    spark.createDataFrame(rows[3:], kind).write.parquet(str(tmp_path / "tbox_classes.parquet"))
    got = {r["class"]: r["descendants"] for r in QUERIES["p4_subtrees"](spark, str(tmp_path)).collect()}
    assert got == {"A": 3, "B": 1, "C": 1, "D": 0, "X": 2, "Y": 2}
