"""Whole jobs on small inputs: preprocess, build, clean, convert, ask, streams, files."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions.show import mapping_text
from graphloom.model import Recorded, Remote, Rules
from graphloom.operators import triples as tr
from graphloom.plans.answer import answer
from graphloom.plans.build import build_kb, kb_triples, resolve_classes, resolve_instances
from graphloom.plans.gold import gold_questions
from graphloom.plans.preprocess import preprocess
from graphloom.sources import files
from graphloom.sources.turtle import latest_file, read_turtle, write_turtle
from graphloom.streaming.questions import answer_stream, statements_by_window


def test_preprocess(spark, tmp_path):
    page = tmp_path / "in" / "site" / "support" / "p"
    page.mkdir(parents=True)
    (page / "index.en.md").write_text("---\ntitle: T\n---\n# T\n" + "word " * 30 + "\n## Next\nmore\n")
    (page / "index.da.md").write_text("# not read")
    report = preprocess(spark, str(tmp_path / "in"), str(tmp_path / "out"), 20).first()
    assert report["pages_total"] == 1 and report["chunks_total"] == 3 and report["languages"] == {"en": 1} and report["page_types"] == {"support": 1}
    chunks = files.read_chunks(spark, str(tmp_path / "out" / "chunks"), skip=spark.createDataFrame([("site/support/p/index.en::c0001",)], "chunk_id string"))
    rows = {r["chunk_id"]: r for r in chunks.collect()}
    assert set(rows) == {"site/support/p/index.en::c0000", "site/support/p/index.en::c0002"} and rows["site/support/p/index.en::c0000"]["section"]["part_total"] == 3


def recorded(spark):
    j = json.dumps
    rows = [
        ("class_extraction", "1", j({"classes": [{"class": "Sensor", "description": "measures"}, {"class": "Person", "description": "acts"}]})),
        ("class_extraction", "2", j({"classes": [{"class": "Sensor", "description": "later"}]})),
        ("base_grounding", "1", j({"axioms": [{"subclass": "Sensor", "superclass": "Thing"}, {"subclass": "Person", "superclass": "Thing"}]})),
        ("object_axioms", "1", j({"axioms": [{"domain": "Person", "property": "hasPart", "range": "Sensor"}]})),
        ("data_axioms", "1", j({"axioms": [{"domain": "Sensor", "property": "hasCode", "datatype": "xsd:integer"}]})),
        ("instances", "1", j({"instances": [{"id": "Unit 7", "class": "Sensor"}, {"id": "Ann Lee", "class": "Person"}, {"id": "unit-7", "class": "Sensor"}]})),
        ("instances", "2", j({"instances": [{"id": "Junk", "class": "Sensor"}]})),
        ("instance_links", "1", j({"links": [{"subject": "Ann Lee", "property": "hasPart", "object": "Unit 7"}, {"subject": "Unit 7", "property": "hasPart", "object": "Ann Lee"}]})),
        ("instance_values", "1", j({"values": [{"subject": "Unit 7", "property": "hasCode", "value": "42", "datatype": "xsd:integer"}]})),
        ("instance_cleanup", '{"name":"Junk","chunk_id":2}', j({"action": "remove"})),
        ("class_equivalence", "Gauge", j({"decisions": [{"original_id": "Sensor", "action": "equivalent", "target_id": "Gauge"}, {"original_id": "Sensor", "action": "equivalent", "target_id": "Nowhere"}]})),
        ("answer", "q1", j({"reasoning": "it has a code", "answer": "The hasCode of the sensor is 42"})),
    ]
    return Recorded(spark.createDataFrame(rows, "operator string, key string, output string"))


@pytest.fixture(scope="module")
def kb(spark):
    chunks = spark.createDataFrame([(1, "text one"), (2, "text two"), (3, None)], "chunk_no int, chunk_text_clean string")
    base = spark.createDataFrame([("Thing", "anything")], "class string, description string")
    return build_kb(chunks, base, recorded(spark))


def test_build_clean_and_convert(spark, kb, tmp_path):
    classes = {r["class"]: (r["description"], list(r["chunk_ids"])) for r in kb["classes"].collect()}
    assert classes == {"Thing": ("anything", []), "Sensor": ("measures", [1, 2]), "Person": ("acts", [1])}
    out = resolve_instances(kb, recorded(spark), str(tmp_path / "phases"))
    assert {tuple(r["individuals"]) for r in out["abox"].where("type = 'SameIndividual'").collect()} == {("Unit 7", "unit-7")}
    assert {(r["phase"], r["type"]) for r in out["pruned"].collect()} == {("phase5_cleanup", "ClassAssertion"), ("phase5_cleanup", "DeclareIndividual")}
    n = out["abox"].count()
    calls = Counter()

    class Counted(Recorded):
        def predict(self, rows, op):
            calls[op.name] += 1
            return super().predict(rows, op)

    out = resolve_instances(kb, Counted(recorded(spark).table), str(tmp_path / "phases"), resume_from=5)  # writes phase 5 again
    assert calls == {"instance_cleanup": 1}
    assert out["abox"].count() == n
    t = cut(kb_triples(out), "kb")
    have = {(r["s"].split("#")[-1], r["p"].split("#")[-1], r["o"].split("#")[-1]) for r in t.collect()}
    assert ("Unit%207", "type", "Thing") in have and ("Ann%20Lee", "hasPart", "Unit%207") in have and ("Unit%207", "isPartOf", "Ann%20Lee") in have
    assert ("Unit%207", "hasPart", "Ann%20Lee") not in have and ("Unit%207", "hasCode", "42") in have
    write_turtle(t, str(tmp_path / "ttl"))
    part = next((tmp_path / "ttl").glob("part*"))
    (tmp_path / "kb.ttl").write_text("".join(p.read_text() for p in sorted((tmp_path / "ttl").glob("part*"))))
    assert part.read_text().startswith("@prefix")
    back = read_turtle(spark, latest_file(spark, str(tmp_path)))
    assert back.exceptAll(t.select(*tr.COLUMNS)).isEmpty() and t.select(*tr.COLUMNS).exceptAll(back).isEmpty()
    with pytest.raises(FileNotFoundError):
        latest_file(spark, str(tmp_path / "phases"))

    q = spark.createDataFrame([("q1", "What is the code of Unit 7?"), ("q2", "hm"), ("q3", "What is Zyx Qqq?")], "key string, question string")
    rows = {r["key"]: r for r in answer(q, t, recorded(spark)).withColumn("seen", F.when(F.col("mapped_entity").isNotNull(), mapping_text("mapped_entity"))).collect()}
    assert rows["q1"]["status"] == "ok" and rows["q1"]["uri"].endswith("Unit%207") and rows["q1"]["question_type"] == "property"
    assert rows["q1"]["mapped_entity"]["property_values"] == {"hasCode": "42"} and rows["q1"]["mapped_entity"]["types"] == ["Sensor"]
    assert rows["q2"]["status"] == "the question type is unknown" and rows["q3"]["status"].startswith("entity: no candidates")

    gold = {r["case_id"]: r for r in gold_questions(t, 3).collect()}
    assert gold["quantification_1"]["gold"] and gold["definition_unanswerable_1"]["entity"].startswith("Imaginary ") and gold["definition_unanswerable_1"]["gold"] == []

    source = tmp_path / "questions"
    q.where("key = 'q1'").write.json(str(source))
    stream = answer_stream(spark.readStream.schema("key string, question string").json(str(source)), t, recorded(spark), str(tmp_path / "logs"), str(tmp_path / "check"))
    stream.processAllAvailable()
    stream.stop()
    assert spark.read.json(str(tmp_path / "logs")).select("key", "status").collect()[0]["status"] == "ok"


def test_class_equivalences(spark, kb):
    v = kb["classes"].unionByName(spark.createDataFrame([("Gauge", "measures too", [4])], "class string, description string, chunk_ids array<int>")).withColumn("embedding", F.when(F.col("class").isin("Sensor", "Gauge"), F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    out = resolve_classes(v, kb["axioms"], recorded(spark)).where("type = 'equivalentClass'")
    assert {(r["domains"][0], r["ranges"][0]) for r in out.collect()} == {("Entity", "Entity"), ("Sensor", "Gauge")}


def test_rules_only_builds_nothing_but_does_not_fail(spark):
    chunks = spark.createDataFrame([(1, "text")], "chunk_no int, chunk_text_clean string")
    out = build_kb(chunks, spark.createDataFrame([("Thing", "x")], "class string, description string"), Rules())
    assert out["abox"].count() == 0 and out["axioms"].count() == 0 and out["classes"].count() == 1 and out["failures"].count() == 0


def test_failed_chunks_are_named(spark):
    def call(op, texts):
        if op == "instances":
            raise RuntimeError
        return [json.dumps({"classes": [{"class": "A", "description": "d"}]}) if op == "class_extraction" else "{}" for _ in texts]

    out = build_kb(spark.createDataFrame([(1, "text")], "chunk_no int, chunk_text_clean string"), spark.createDataFrame([("Thing", "x")], "class string, description string"), Remote(call, parallel=1, tries=1))
    assert ("instances", "1") in {tuple(r) for r in out["failures"].collect()} and {r["class"] for r in out["classes"].collect()} == {"Thing", "A"}


def test_ontology_files(spark, tmp_path):
    doc = {"ontology_tbox": {"classes": [{"id": "A", "description": "d", "chunk_ids": [1]}], "axioms": [{"type": "SubClassOf", "subclass": "A", "superclass": "B", "chunk_id": 1}]},
           "ontology_abox": [{"type": "DeclareIndividual", "id": "x", "chunk_id": 1}], "pruned": {"p": [{"type": "DeclareIndividual", "id": "y", "chunk_id": 2}]}}
    (tmp_path / "o.json").write_text(json.dumps(doc, indent=2))
    kb = files.read_ontology(spark, str(tmp_path / "o.json"))
    assert kb["classes"].first()["id"] == "A" and kb["axioms"].first()["superclass"] == "B" and kb["pruned"].first()["phase"] == "p"
    files.write_ontology(kb, str(tmp_path / "out"), {"model": "none"})
    meta = spark.read.json(str(tmp_path / "out" / "metadata")).first()
    assert meta["num_abox"] == 1 and meta["num_pruned"] == 1
    assert files.read_base_classes(spark, str(tmp_path / "missing.json")).count() == 0 and files.read_base_axioms(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "base.json").write_text('[{"class": "A", "description": "d"}, {"class": "B"}]')
    assert files.read_base_classes(spark, str(tmp_path / "base.json")).count() == 2
    (tmp_path / "cut.json").write_text('[{"class": "A", "description": "d"}, {"class": ')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_base_classes(spark, str(tmp_path / "cut.json")).collect()
    for n in (1, 2):
        files.append_records(spark.createDataFrame([(n, "x")], "id int, label string"), str(tmp_path / "notes"))
    assert spark.read.json(str(tmp_path / "notes")).count() == 2
    (tmp_path / "t.jsonl").write_text('{"text": " a "}\n\n{"text": ""}\n{"other": 1}\n')
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path / "t.jsonl")).collect()] == ["a"]
    with pytest.raises(FileNotFoundError):
        files.load_prompt(str(tmp_path / "none.txt"))


def test_statement_stream(spark, tmp_path):
    rows = spark.sql("select * from values (1L, 'A', timestamp'2024-01-01 01:00:00'), (1L, 'A', timestamp'2024-01-01 01:00:00'), (2L, 'A', timestamp'2024-01-01 05:00:00'), (3L, 'B', timestamp'2024-02-01 00:00:00') t(assertion_id, type, asserted_at)")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    s = statements_by_window(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")))
    q = s.writeStream.outputMode("update").format("memory").queryName("statements").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["type"], r["n"]) for r in spark.table("statements").collect()} == {("A", 2), ("B", 1)}
