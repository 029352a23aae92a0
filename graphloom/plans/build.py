"""Knowledge-base construction and clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..common import cut, strip_name
from ..model import Recorded, Remote, Rules, failures, predict
from ..operators import resolve as rs
from ..operators.cluster import fuzzy_name_clusters, vector_clusters
from ..operators.triples import from_ontology, infer, validate
from ..sources.files import ASSERTION, AXIOM, phase

Provider = Rules | Recorded | Remote


def _full(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with all columns of ``schema``, missing ones null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def build_kb(chunks: DataFrame, base_classes: DataFrame, provider: Provider, limit: int | None = None) -> dict[str, DataFrame]:
    """Chunks into classes, axioms and assertions through the eight construction operators.

    ``chunks(chunk_no, chunk_text_clean)``; ``limit`` takes the first chunks only, to try things out. All
    chunks run side by side; a class's description is that of its first chunk. ``failures(operator, key)`` names
    the chunks for which an operator gave nothing that can be read; they go on with what the others gave.
    """
    failed: list[DataFrame] = []

    def ask(rows: DataFrame, operator: str) -> DataFrame:
        out = cut(predict(rows, operator, provider), operator)
        failed.append(failures(out, operator))
        return out

    c = chunks.select("chunk_no", F.col("chunk_text_clean").alias("text"))
    c = c if limit is None else c.where(F.col("chunk_no") < limit)
    c = c.withColumn("key", F.col("chunk_no").cast("string"))
    found = ask(c, "class_extraction")
    names = F.array_distinct(F.transform(F.coalesce("result.classes", F.array()), lambda x: x["class"]))
    found = found.withColumn("classes", F.filter(names, lambda x: x.isNotNull()))
    base = base_classes.agg(F.array_sort(F.collect_set("class")).alias("base_classes"))  # one row
    local = cut(found.select("key", "chunk_no", "text", "classes").crossJoin(F.broadcast(base)), "local")
    classes = rs.accumulate_classes(found.select(F.explode("result.classes").alias("x"), F.col("chunk_no").alias("chunk")).select("x.class", "x.description", "chunk").where("class is not null"))
    axioms = []
    for op, typed in (("base_grounding", True), ("local_subclassing", True), ("object_axioms", False), ("data_axioms", False)):
        rows = ask(local, op).select("chunk_no", F.explode("result.axioms").alias("x"))
        kind = F.lit("SubClassOf") if typed else F.lit(None).cast("string")
        axioms.append(rows.select(kind.alias("type"), "x.*", F.col("chunk_no").alias("chunk_id")))
    axioms = cut(_full(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), axioms), AXIOM), "axioms")
    inst = ask(local, "instances").select("key", "chunk_no", "text", "classes", F.col("result.instances").alias("instances"))
    people = inst.withColumn("individuals", F.array_distinct(F.transform(F.coalesce("instances", F.array()), lambda x: x["id"])))
    props = axioms.where("datatype is not null").groupBy(F.col("chunk_id").alias("chunk_no")).agg(F.array_sort(F.collect_set("property")).alias("properties"))
    links = ask(people.drop("instances"), "instance_links").select("chunk_no", F.explode("result.links").alias("x"))
    values = ask(people.drop("instances").join(props, "chunk_no", "left"), "instance_values").select("chunk_no", F.explode("result.values").alias("x"))
    one = inst.select("chunk_no", F.explode("instances").alias("x"))
    chunk = F.col("chunk_no").alias("chunk_id")
    abox = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        one.select(F.lit("DeclareIndividual").alias("type"), F.col("x.id").alias("id"), chunk).distinct(),
        one.select(F.lit("ClassAssertion").alias("type"), F.col("x.id").alias("individual"), F.col("x.class").alias("class"), chunk),
        links.select(F.lit("ObjectPropertyAssertion").alias("type"), "x.*", chunk), values.select(F.lit("DataPropertyAssertion").alias("type"), "x.*", chunk),
    ])
    keyed = cut(_full(abox, ASSERTION), "abox").withColumn("assertion_id", F.monotonically_increasing_id())
    upper = base_classes.select("class", "description", F.array().cast("array<int>").alias("chunk_ids"))
    return {"classes": upper.unionByName(classes, allowMissingColumns=True), "axioms": axioms, "abox": cut(keyed, "abox"), "failures": reduce(DataFrame.unionByName, failed)}


def resolve_classes(classes: DataFrame, axioms: DataFrame, provider: Provider, most: float = 0.3) -> DataFrame:
    """Axioms with the equivalences found among clusters of classes; ``classes(class, chunk_ids, embedding)``."""
    scoped = rs.scoped_classes(classes)
    clusters = vector_clusters(scoped, "class", "embedding", most).groupBy("cluster").agg(F.array_sort(F.collect_set("key")).alias("members"))
    out = predict(clusters.withColumnRenamed("cluster", "key"), "class_equivalence", provider)
    d = out.select(F.explode("result.decisions").alias("d")).select("d.*").where("target_id is not null")
    return rs.apply_equivalences(axioms, d)


def resolve_instances(kb: dict[str, DataFrame], provider: Provider, folder: str | None = None, resume_from: int | None = None) -> dict[str, DataFrame]:
    """The five phases of instance clean-up: name collisions, polysemy, fuzzy clusters, semantic merges, final
    clean-up. With ``folder``, each phase's decisions and table are written; ``resume_from`` reads those before that
    phase, whose model calls are not made again. Where the model fails, nothing is pruned or merged."""
    classes, axioms, abox = kb["classes"], kb["axioms"], kb["abox"]
    done = lambda n: resume_from is not None and n < resume_from
    sets = cut(rs.equivalence_sets(axioms), "sets")
    groups = cut(rs.name_groups(abox, sets), "groups")
    same = rs.same_name_individuals(groups)
    # 2: the same name under several classes
    poly = rs.polysemy_candidates(groups).withColumnRenamed("name_key", "key")

    def decide() -> DataFrame:
        acts = predict(poly, "polysemy", provider).where("by <> 'failed'").select("key", F.explode("result.decisions").alias("d")).select(F.col("key").alias("name_key"), "d.*")
        return acts.join(groups, ["name_key", "class"]).select(F.explode("names").alias("name"), "class", "action")

    acts = phase(decide, folder, "phase2_actions", done(2))
    kept, gone = rs.prune(abox, rs.rejected_nodes(abox, acts, sets))
    abox2 = phase(lambda: kept, folder, "phase2", done(2))
    pruned = rs.log_pruned(None, gone, "phase2_polysemy")
    same = rs.surviving_groups(same, acts, sets)
    # 3 and 4: names that are nearly the same
    names = abox2.where("type = 'ClassAssertion'").select(strip_name("individual").alias("name")).where("name is not null").distinct()
    fuzzy = phase(lambda: fuzzy_name_clusters(names, "name"), folder, "phase3", done(3))
    sem = fuzzy.groupBy("cluster").agg(F.array_sort(F.collect_set("key")).alias("members")).withColumnRenamed("cluster", "key")
    d = phase(lambda: predict(sem, "semantic_cluster", provider).select(F.explode("result.decisions").alias("d")).select("d.*").where("target_id is not null"), folder, "phase4_decisions", done(4))
    merged = rs.merged_individuals(d).unionByName(same.select("individuals")).distinct()
    rows = merged.select(F.lit("SameIndividual").alias("type"), "individuals", (-1 - F.monotonically_increasing_id()).alias("assertion_id"))
    abox4 = cut(abox2.unionByName(rows, allowMissingColumns=True), "phase4")
    # 5: what should not be there at all
    who = rs.individual_details(abox4, by_chunk=True).withColumn("key", F.to_json(F.struct("name", "chunk_id")))
    bad = predict(who, "instance_cleanup", provider).where("result.action = 'remove'").select("name", "chunk_id")
    kept, gone5 = rs.prune(abox4, cut(bad, "removed"))
    pruned = pruned.unionByName(rs.log_pruned(None, gone5, "phase5_cleanup"), allowMissingColumns=True)
    return {"classes": classes, "axioms": axioms, "abox": phase(lambda: kept, folder, "phase5"), "pruned": cut(pruned, "pruned")}


def kb_triples(kb: dict[str, DataFrame]) -> DataFrame:
    """Triples of an ontology, validated, then inferred."""
    return infer(validate(cut(from_ontology(kb["classes"], kb["axioms"], kb["abox"]), "triples")))
