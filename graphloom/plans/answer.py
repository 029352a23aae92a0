"""Question answering in batches: parse, resolve, fetch, answer, ground."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut
from ..functions.text import prompt
from ..model import Recorded, Remote, Rules, predict
from ..operators import ground as gr
from ..operators import questions as qs
from ..operators import retrieve as rt
from ..operators.cluster import nearest, word_terms

Provider = Rules | Recorded | Remote


def parse_questions(questions: DataFrame, provider: Provider) -> DataFrame:
    """``(key, question)`` with type, form, entity, relation, object and a status instead of an error."""
    q = predict(questions, "question_type", provider)
    q = q.select("key", "question", qs.known_type(F.col("result.question_type")).alias("question_type"))
    for op, field in (("answer_form", "answer_form"), ("entity", "primary_entity"), ("relation", "relation"), ("object", "object")):
        q = cut(predict(q, op, provider), op)
        q = q.select(*[c for c in q.columns if c not in ("result", "by")], F.col(f"result.{field}").alias({"primary_entity": "entity"}.get(field, field)))
    q = q.withColumn("object", F.when(F.lower("object") != "null", F.col("object")))
    status = F.when(F.col("question_type") == "unknown", "the question type is unknown").when(F.col("entity").isNull(), "no entity was found in the question").otherwise("ok")
    return q.withColumn("status", status)


def fetch_context(parsed: DataFrame, triples: DataFrame, decisions: DataFrame | None = None, graph: rt.Graph | None = None) -> DataFrame:
    """Parsed questions with the context of their entity, and of their object if they compare. ``graph``: see
    ``retrieve.prepared``."""
    t = triples
    names = graph.names if graph else cut(rt.entity_labels(t), "labels")
    ok = parsed.where("status = 'ok'")
    wanted = ok.select("entity").unionByName(ok.where("question_type = 'comparative'").select(F.col("object").alias("entity"))).where("entity is not null").distinct()
    found = cut(rt.resolve(wanted, names, decisions), "resolved")
    ctx = cut(rt.context(t, found.where("uri is not null").select("uri").distinct(), graph=graph), "contexts")
    full = F.struct(*[c for c in ctx.columns if c != "uri"])
    ent = found.join(ctx.select("uri", full.alias("entity_context")), "uri", "left").select("entity", F.col("status").alias("entity_status"), "uri", "entity_context")
    obj = ent.select(F.col("entity").alias("object"), F.col("uri").alias("object_uri"), F.col("entity_context").alias("object_context"))
    out = parsed.join(ent, "entity", "left").join(obj, "object", "left")
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("uri").isNull(), F.concat(F.lit("entity: "), F.coalesce("entity_status", F.lit("none")))).when((F.col("question_type") == "comparative") & F.col("object_uri").isNull(), "object: unresolved").otherwise("ok")
    return out.withColumn("status", status).withColumn("object_context", F.when(F.col("question_type") == "comparative", F.col("object_context")))


def answer(questions: DataFrame, triples: DataFrame, provider: Provider, decisions: DataFrame | None = None, compat: bool = False, graph: rt.Graph | None = None) -> DataFrame:
    """Questions ``(key, question)`` with answer, reasoning, mappings of both contexts and a status."""
    rows = cut(fetch_context(cut(parse_questions(questions, provider), "parsed"), triples, decisions, graph), "fetched")
    told = predict(rows.withColumn("context", F.to_json("entity_context")), "answer", provider)
    told = cut(told.withColumn("answer", F.col("result.answer")).withColumn("reasoning", F.col("result.reasoning")).drop("result", "by", "context"), "answers")
    fields = [*gr.FACETS, "property_values"]
    out = told
    for side in ("entity", "object"):
        got = told.where(F.col(f"{side}_context").isNotNull())
        r = gr.ground(got, "key", "reasoning", f"{side}_context", compat).select("key", F.struct(*fields).alias("r"))
        a = gr.ground(got, "key", "answer", f"{side}_context", compat).select("key", F.struct(*fields).alias("a"))
        both = r.join(a, "key").select("key", *gr.merge_mappings())
        out = out.join(both.select("key", F.struct(*fields).alias(f"mapped_{side}")), "key", "left")
    return out


def hashed_vector(x: Column, size: int = 256) -> Column:
    """A text as ``size`` counts of its words and pairs of neighbouring words, by their hashes."""
    at = F.transform(word_terms(x), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))


def rag_answer(questions: DataFrame, docs: DataFrame, provider: Provider, k: int = 3, family: str = "phi", embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """The baseline without a graph: questions ``(key, question)`` answered from the ``k`` nearest of ``docs(doc_id,
    text)``. ``(key, question, doc_ids, prompt, answer, reasoning, by)``; questions without a document near them
    get an empty list. The vectors come from ``embed``, by default hashed words."""
    q = questions.select("key", "question", embed(F.col("question")).alias("v"))
    d = cut(docs.where("doc_id is not null and text is not null").select("doc_id", "text", embed(F.col("text")).alias("v")), "vectors")
    near = nearest(q, d, "key", "doc_id", "v", k).where("score > 0").select(F.col("query").alias("key"), F.col("item").alias("doc_id"), "rank")
    found = near.join(d.select("doc_id", "text"), "doc_id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("hits"))
    rows = questions.select("key", "question").join(found, "key", "left")
    texts = F.coalesce(F.array_join(F.transform("hits", lambda h: h["text"]), "\n\n"), F.lit(""))
    ids = F.coalesce(F.transform("hits", lambda h: h["doc_id"]), F.array().cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>"))
    system = F.lit("Answer the question from the context. If it is not there, say that you can't answer the question.")
    asked = prompt(system, F.concat(F.lit("Context:\n"), texts, F.lit("\n\nQuestion: "), F.coalesce("question", F.lit(""))), family)
    out = predict(rows.select("key", "question", ids.alias("doc_ids"), asked.alias("prompt")), "answer", provider)
    return out.select("key", "question", "doc_ids", "prompt", F.col("result.answer").alias("answer"), F.col("result.reasoning").alias("reasoning"), "by")


def validate_answers(answered: DataFrame, provider: Provider) -> DataFrame:
    """``answered`` with ``triples``, what its mapping of the entity states, and ``decision``: accept or reject."""
    got = answered.where("mapped_entity is not null").select("key", "entity", "mapped_entity.*")
    said = gr.mapping_triples(got, "key", "entity").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("entity", "relation", "object"))).alias("triples"))
    none = F.array().cast(said.schema["triples"].dataType)
    rows = answered.join(said, "key", "left").withColumn("triples", F.coalesce("triples", none))
    return predict(rows, "answer_check", provider).withColumn("decision", F.col("result.decision")).drop("result", "by")
