"""Queries over the knowledge base that the domain tables hold, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, scratch_path, strip_name, table
from ..functions.text import readable
from ..operators import resolve as rs
from ..operators import retrieve as rt
from ..operators import triples as tr
from ..operators.cluster import char_terms, cosine_pairs, fuzzy_name_clusters, nearest, tfidf, vector_clusters, word_terms
from ..sources.turtle import write_turtle
from .dealt import sql_name

#: A property with an inverse, for the inverse rule on these tables.
INVERSE = {tr.EX + "hasPatch": tr.EX + "isPatchOf"}


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "base_classes").select("class", "parents", "description").unionByName(table(spark, d, "tbox_classes").select("class", "parents", "description"))


def _t(spark: SparkSession, d: str) -> DataFrame:
    return tr.from_ontology(_classes(spark, d), table(spark, d, "tbox_axioms"), table(spark, d, "abox"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return cut(_t(spark, d), "triples")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: individuals whose declaration's id is divisible by 50."""
    rows = table(spark, d, "abox").where("type = 'DeclareIndividual' and assertion_id % 50 = 0").select(strip_name("id").alias("entity")).where("entity is not null").distinct()
    return rows.withColumn("uri", tr.iri(F.col("entity")))


def _nodes(t: DataFrame, *kinds: str) -> DataFrame:
    """``(uri)``: all individuals and classes, or the nodes of the kinds given."""
    return t.where((F.col("p") == tr.RDF_TYPE) & F.col("o").isin(*(kinds or (tr.CLASS, tr.INDIVIDUAL)))).select(F.col("s").alias("uri")).distinct()


def kb_triples(spark, d):
    """All triples of the ontology tables."""
    return _t(spark, d)


def kb_stats(spark, d):
    return tr.stats(_t(spark, d))


def kb_node_kinds(spark, d):
    return tr.node_kinds(_t(spark, d))


def kb_pattern(spark, d):
    """Subjects of one predicate and object."""
    return tr.match(_t(spark, d), p=tr.RDF_TYPE, o=tr.INDIVIDUAL).select("s")


def kb_labels(spark, d):
    t = _kept(spark, d)
    return tr.labels(t, tr.node_kinds(t).select(F.col("node").alias("s")).distinct())


def kb_loose_classes(spark, d):
    return tr.loose_classes(_kept(spark, d))


def kb_loose_by_axioms(spark, d):
    """Classes that are loose if only axioms link classes, not the parents of the class tables."""
    t = tr.from_ontology(_classes(spark, d).drop("parents"), table(spark, d, "tbox_axioms"), table(spark, d, "abox"))
    return tr.loose_classes(cut(t, "triples"))


def kb_entity_axioms(spark, d):
    """Axioms of all individuals and classes."""
    t = _kept(spark, d)
    return tr.entity_axioms(t, _nodes(t).select(F.col("uri").alias("s")))


def kb_subclass_types(spark, d):
    """Types that the class graph adds."""
    return tr.types_by_subclass(_kept(spark, d))


def kb_members_by_class(spark, d):
    """Members of each class by inferred type."""
    t = _kept(spark, d)
    own = t.where((F.col("p") == tr.RDF_TYPE) & (F.col("o_kind") == "iri")).select("s", "o")
    people = own.where(F.col("o") == tr.INDIVIDUAL).select("s").distinct()
    types = own.unionByName(tr.types_by_subclass(t)).where(F.col("o") != tr.INDIVIDUAL).join(people, "s", "left_semi")
    return types.groupBy(readable(F.col("o")).alias("class")).agg(F.count(F.lit(1)).alias("members"))


def kb_equivalence_types(spark, d):
    return tr.types_by_equivalence(_kept(spark, d))


def kb_domain_types(spark, d):
    return tr.types_by_schema(_kept(spark, d), tr.DOMAIN)


def kb_range_types(spark, d):
    return tr.types_by_schema(_kept(spark, d), tr.RANGE)


def kb_inverse_links(spark, d):
    return tr.inverse_links(_kept(spark, d), INVERSE)


def kb_invalid_links(spark, d):
    return tr.invalid_links(_kept(spark, d))


def kb_inferred(spark, d):
    """Triples that the whole inference adds to the validated ones."""
    t = cut(tr.validate(_kept(spark, d)), "valid")
    return tr.inferred(t, inverses=INVERSE).select("s", "p", "o")


def kb_diff(spark, d):
    """The triples that are no labels and no types, as a difference of two graphs."""
    t = _kept(spark, d)
    return tr.diff(t, t.where(F.col("p").isin(tr.RDF_TYPE, tr.LABEL))).select("s", "p", "o")


def kb_superclasses(spark, d):
    return tr.subclass_closure(_kept(spark, d)).select(readable(F.col("src")).alias("class"), readable(F.col("dst")).alias("superclass"))


def kb_direct_types(spark, d):
    t = _kept(spark, d)
    full = cut(t.unionByName(tr._as_types(tr.types_by_subclass(t))), "typed")
    return tr.direct_types(full, compat=True)


def kb_same_as(spark, d):
    return tr.same_as_sets(_kept(spark, d))


def kb_equivalence_sets(spark, d):
    rows = rs.equivalence_sets(table(spark, d, "tbox_axioms"))
    return rows.select("class", F.array_join("class_set", "|").alias("class_set"))


def kb_same_pairs(spark, d):
    return tr.same_pairs(table(spark, d, "abox"))


def _groups(spark, d):
    return cut(rs.name_groups(table(spark, d, "abox"), cut(rs.equivalence_sets(table(spark, d, "tbox_axioms")), "sets"), ascii_only=True), "groups")


def kb_name_groups(spark, d):
    return _groups(spark, d).select("name_key", "class", F.array_join("names", "|").alias("names"))


def kb_polysemy(spark, d):
    return rs.polysemy_candidates(_groups(spark, d)).select("name_key", F.array_join("classes", "|").alias("classes"))


def _actions(groups):
    """A stand-in for a model's decisions: classes whose name ends in an even digit are rejected."""
    return groups.select(F.explode("names").alias("name"), "class", F.when(F.col("class").rlike("[02468]$"), "reject").otherwise("merge").alias("action"))


def kb_rejected(spark, d):
    g = _groups(spark, d)
    return rs.rejected_nodes(table(spark, d, "abox"), _actions(g), cut(rs.equivalence_sets(table(spark, d, "tbox_axioms")), "sets"))


def kb_surviving_groups(spark, d):
    return _surviving(table(spark, d, "abox"), cut(rs.equivalence_sets(table(spark, d, "tbox_axioms")), "sets"))


def _surviving(abox, sets):
    g = cut(rs.name_groups(abox, sets, ascii_only=True), "groups")
    out = rs.surviving_groups(g.withColumnRenamed("names", "individuals"), _actions(g), sets)
    return out.select("name_key", "class", F.array_join("individuals", "|").alias("individuals"))


def kb_surviving_spellings(spark, d):
    """As ``kb_surviving_groups``, with every individual also under its name in capitals."""
    abox = table(spark, d, "abox").where("type = 'ClassAssertion'")
    both = abox.unionByName(abox.withColumn("individual", F.upper("individual")))
    return _surviving(both, cut(rs.equivalence_sets(table(spark, d, "tbox_axioms")), "sets"))


def _pruned_nodes(spark, d):
    return table(spark, d, "pruned").where("type = 'ClassAssertion'").select(strip_name("individual").alias("name"), "chunk_id").where("name is not null")


def kb_prune(spark, d):
    """Assertions that fall with the pruned individuals."""
    kept, gone = rs.prune(table(spark, d, "abox"), _pruned_nodes(spark, d))
    return gone.select("assertion_id", "type").distinct()


def kb_kept(spark, d):
    kept, gone = rs.prune(table(spark, d, "abox"), _pruned_nodes(spark, d))
    return kept.groupBy("type").agg(F.countDistinct("assertion_id").alias("n"))


def kb_cleanup_counts(spark, d):
    return rs.cleanup_counts(table(spark, d, "tbox_classes"), table(spark, d, "tbox_axioms"), table(spark, d, "abox"), table(spark, d, "pruned"))


def kb_individuals(spark, d):
    """Class and properties of each individual."""
    return rs.individual_details(table(spark, d, "abox")).select("name", "class", F.array_join("properties", "|").alias("properties"))


def kb_individuals_by_chunk(spark, d):
    return rs.individual_details(table(spark, d, "abox"), by_chunk=True).select("name", "chunk_id", "class", F.size("properties").alias("n"))


def kb_scoped_classes(spark, d):
    return rs.scoped_classes(table(spark, d, "tbox_classes")).select(strip_name("class").alias("class")).distinct()


def kb_accumulate(spark, d):
    rows = table(spark, d, "tbox_classes").select(strip_name("class").alias("class"), "description", F.explode("chunk_ids").alias("chunk")).where("class is not null and chunk is not null")
    return rs.accumulate_classes(rows).select("class", "description", F.array_join("chunk_ids", ",").alias("chunks"))


def _decisions(spark, d):
    p = tr.same_pairs(table(spark, d, "abox")).where("a < b")
    return p.select(F.col("b").alias("original_id"), F.lit("equivalent").alias("action"), F.col("a").alias("target_id"))


def kb_merged(spark, d):
    return rs.merged_individuals(_decisions(spark, d)).select(F.array_join("individuals", "|").alias("individuals"))


def kb_apply_equivalences(spark, d):
    axioms = table(spark, d, "tbox_axioms").select("type", "domains", "ranges", "description")
    out = rs.apply_equivalences(axioms, _decisions(spark, d)).where("type = 'equivalentClass'")
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.get("domains", F.lit(0))).alias("firsts"))


def kb_degrees(spark, d):
    """Outgoing links per subject and property."""
    t = _t(spark, d).where(F.startswith("p", F.lit(tr.EX + "has")) & (F.col("o_kind") == "iri"))
    return t.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))


def kb_compare(spark, d):
    """Who of two linked individuals has more links (the subject on ties), and by how many."""
    from ..operators.questions import compare_gold

    t = cut(_t(spark, d).where(F.startswith("p", F.lit(tr.EX + "has")) & (F.col("o_kind") == "iri")).select("s", "p", "o"), "links")
    n = t.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = t.select("s", "o").distinct().join(n.withColumnRenamed("n", "ln"), "s").join(n.select(F.col("s").alias("o"), F.col("n").alias("rn")), "o")
    more, by = compare_gold(F.col("ln"), F.col("rn"), F.col("s"), F.col("o"))
    return rows.select("s", "o", more.alias("more"), by.alias("difference"))


def kb_property_values(spark, d):
    """Distinct values of each data property."""
    a = table(spark, d, "abox").where("type = 'DataPropertyAssertion'")
    return a.groupBy(strip_name("property").alias("property")).agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("vals")).where("property is not null")


def kb_schema_classes(spark, d):
    return tr.schema_classes(_kept(spark, d)).select("class", "description", F.array_join("parents", "|").alias("parents"))


def kb_schema_properties(spark, d):
    return tr.schema_properties(_kept(spark, d)).select("type", F.array_join("domains", "|").alias("domains"), F.array_join("ranges", "|").alias("ranges"))


def kb_turtle_roundtrip(spark, d):
    """What writing and reading Turtle loses (nothing) of the triples, by predicate."""
    t = _kept(spark, d)
    path = scratch_path(spark, "turtle")
    write_turtle(t, path)
    back = read_turtle_text(spark, path)
    a, b = t.select(*tr.COLUMNS), back.select(*tr.COLUMNS)
    lost = a.exceptAll(b).groupBy("p").agg(F.count(F.lit(1)).alias("lost"))
    return a.groupBy("p").agg(F.count(F.lit(1)).alias("n")).join(lost, "p", "left").select("p", "n", F.coalesce("lost", F.lit(0)).alias("lost"))


def read_turtle_text(spark, path):
    """Part files as Spark writes them end in .txt."""
    from ..sources import turtle as tt

    files = spark.read.text(path, wholetext=True)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(list(tt.parse_turtle(text)), columns=list(tt.COLUMNS))

    return files.mapInPandas(run, tt.TRIPLES).distinct()


# ---------------------------------------------------------------- retrieval

def entity_token_scores(spark, d):
    return rt.token_scores(_entities(spark, d), rt.entity_labels(_kept(spark, d)))


def entity_candidates(spark, d):
    c = rt.candidates(_entities(spark, d), rt.entity_labels(_kept(spark, d)))
    return c.select("entity", "uri", "label", F.round("score", 6).alias("score"), "rank")


def entity_resolution(spark, d):
    return rt.resolve(_entities(spark, d), rt.entity_labels(_kept(spark, d))).select("entity", "uri", "status")


def entity_enriched(spark, d):
    t = _kept(spark, d)
    c = cut(rt.candidates(_entities(spark, d), rt.entity_labels(t), top=3), "candidates")
    out = rt.enrich(c.select("uri").distinct(), t)
    return out.select("uri", "entity_type", F.array_join("types", "|").alias("types"), F.array_join("superclasses", "|").alias("superclasses"), F.size("object_properties").alias("n_object"), F.size("data_properties").alias("n_data"))


def context_properties(spark, d):
    t = _kept(spark, d)
    return rt.applicable(t, cut(_nodes(t), "nodes")).select("uri", "type", "direction", "property", "other")


def _contexts(spark, d, *fields):
    t = _kept(spark, d)
    return rt.context(t, cut(_nodes(t), "nodes"), fields=fields)


def context_provenance(spark, d):
    return _contexts(spark, d, "chunk_id", "types").select("uri", F.array_join("chunk_id", "|").alias("chunk_ids"), F.array_join("types", "|").alias("types"))


def context_class_descriptions(spark, d):
    return _contexts(spark, d, "class_descriptions").select("uri", F.explode("class_descriptions").alias("class", "description"))


def context_property_descriptions(spark, d):
    t = _kept(spark, d)
    twins = rt.twins_of(t, cut(_nodes(t), "nodes")).withColumnRenamed("twin", "s")
    c = rt.property_descriptions(t, twins.join(t.select("s", "p"), "s"))
    return c.select("uri", readable(F.col("p")).alias("property"), "description", F.array_join("domain", "|").alias("domains"), F.array_join("range", "|").alias("ranges"))


def context_members(spark, d):
    """Members of all classes."""
    t = _kept(spark, d)
    ctx = rt.context(t, cut(_nodes(t, tr.CLASS), "nodes"), fields=("members", "superclasses"))
    return ctx.select("label", F.array_join("members", "|").alias("members"), F.array_join(F.coalesce(F.element_at("superclasses", F.col("label")), F.array()), "|").alias("direct"))


def context_by_question_type(spark, d):
    """Which fields remain for each type of question."""
    from ..operators.questions import CONTEXT_FIELDS, keep_fields

    types = spark.createDataFrame([(k,) for k in [*CONTEXT_FIELDS, "other"]], "question_type string")
    c = keep_fields(_contexts(spark, d, "members", "chunk_id").join(F.broadcast(types)))  # nine rows
    has = lambda f: F.coalesce(F.size(f) >= 0, F.lit(False)).alias(f)
    return c.select("uri", "question_type", "status", has("members"), F.col("chunk_id").isNotNull().alias("chunk_id"))


def context_counts(spark, d):
    return rt.context_counts(_contexts(spark, d, *rt.COUNTED))


# ---------------------------------------------------------------- similarity

def name_similarity(spark, d):
    """Pairs of individuals' names whose combined tf-idf cosine is above 0.6."""
    names = table(spark, d, "abox").where("type = 'ClassAssertion'").select(strip_name("individual").alias("name")).where("name is not null").distinct()
    v = tfidf(names, "name", {"w": (word_terms(F.col("name")), 20.0), "c": (char_terms(F.col("name")), 5.0)})
    return cosine_pairs(v, "name", 0.6).select("a", "b", F.round("cos", 6).alias("cos"))


def name_clusters(spark, d):
    names = table(spark, d, "abox").where("type = 'ClassAssertion'").select(strip_name("individual").alias("name")).where("name is not null").distinct()
    return fuzzy_name_clusters(names, "name")


def vector_clusters_q(spark, d):
    return vector_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


def rag_topk(spark, d):
    """The three nearest vectors of every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "vec_id", "embedding", 3)


_ALL = (
    kb_triples, kb_stats, kb_node_kinds, kb_pattern, kb_labels, kb_loose_classes, kb_loose_by_axioms, kb_entity_axioms, kb_subclass_types, kb_members_by_class, kb_equivalence_types, kb_domain_types,
    kb_range_types, kb_inverse_links, kb_invalid_links, kb_inferred, kb_diff, kb_superclasses, kb_direct_types, kb_same_as, kb_equivalence_sets, kb_same_pairs, kb_name_groups, kb_polysemy,
    kb_rejected, kb_surviving_groups, kb_surviving_spellings, kb_prune, kb_kept, kb_cleanup_counts, kb_individuals, kb_individuals_by_chunk, kb_scoped_classes, kb_accumulate, kb_merged, kb_apply_equivalences,
    kb_degrees, kb_compare, kb_property_values, kb_schema_classes, kb_schema_properties, kb_turtle_roundtrip, entity_token_scores, entity_candidates, entity_resolution, entity_enriched,
    context_properties, context_provenance, context_class_descriptions, context_property_descriptions, context_members, context_by_question_type, context_counts,
    name_similarity, name_clusters, rag_topk,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL} | {"vector_clusters": vector_clusters_q}


# ---------------------------------------------------------------- SQL

_X = f"'{tr.EX}' || url_encode"


def _n(x: str) -> str:
    return sql_name(x)


_CHUNK = f"'{tr.EX}chunk_id'"
_TYPE, _LAB, _COM, _SUB, _DOM, _RNG, _EQ, _SAME = (f"'{x}'" for x in (tr.RDF_TYPE, tr.LABEL, tr.COMMENT, tr.SUBCLASS, tr.DOMAIN, tr.RANGE, tr.EQUIVALENT, tr.SAME_AS))
_CLS, _IND, _OP, _DP = (f"'{x}'" for x in (tr.CLASS, tr.INDIVIDUAL, tr.OBJECT_PROPERTY, tr.DATA_PROPERTY))
_XSD_LIST = ", ".join(f"'{x}'" for x in tr.XSD_TYPES)

#: The triples as a list of common table expressions ending in t(s, p, o, o_kind, o_dtype).
_T = f"""
c0 AS (SELECT {_n('class')} c, parents, description FROM base_classes UNION ALL SELECT {_n('class')}, parents, description FROM tbox_classes),
ax AS (SELECT {_n('type')} ty, {_n('subclass')} sb, {_n('superclass')} sp, {_n('domain')} dm, {_n('property')} pr, {_n('"range"')} rg, {_n('datatype')} dt, description ds, domains, ranges FROM tbox_axioms),
bs AS (SELECT * FROM ax WHERE coalesce(ds, '') <> '' AND ty IS NOT NULL AND ty NOT IN ('equivalentClass', 'SubClassOf')),
ab AS (SELECT type, {_n('id')} id, {_n('individual')} ind, {_n('class')} cls, {_n('subject')} sj, {_n('property')} pr, {_n('object')} ob, value v, split_part(datatype, ':', -1) k, chunk_id ch, individuals FROM abox),
sm AS (SELECT rn, {_n('x')} x FROM (SELECT rn, unnest(individuals) x FROM (SELECT row_number() OVER () rn, individuals FROM abox WHERE type = 'SameIndividual'))),
prs AS (SELECT DISTINCT a.x a, b.x b FROM sm a JOIN sm b ON a.rn = b.rn AND a.x <> b.x),
lit AS (SELECT sj, pr, v, CASE WHEN v IS NULL OR k IS NULL THEN NULL WHEN k = 'boolean' THEN k WHEN k = 'integer' THEN CASE WHEN regexp_full_match(trim(v), '[-+]?[0-9]+') THEN k END
  WHEN k = 'decimal' THEN CASE WHEN regexp_full_match(trim(v), '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN k END WHEN k IN ({_XSD_LIST}) THEN k END k FROM ab WHERE type = 'DataPropertyAssertion'),
t0 AS (
 SELECT {_X}(c) s, {_TYPE} p, {_CLS} o, 'iri' o_kind, NULL::VARCHAR o_dtype FROM c0 UNION ALL SELECT {_X}(c), {_LAB}, c, 'literal', NULL FROM c0 UNION ALL SELECT {_X}(c), {_COM}, description, 'literal', NULL FROM c0
 UNION ALL SELECT {_X}(c), {_SUB}, {_X}({_n('x')}), 'iri', NULL FROM (SELECT c, unnest(parents) x FROM c0)
 UNION ALL SELECT {_X}(ty), {_TYPE}, {_OP}, 'iri', NULL FROM bs UNION ALL SELECT {_X}(ty), {_LAB}, ty, 'literal', NULL FROM bs UNION ALL SELECT {_X}(ty), {_COM}, ds, 'literal', NULL FROM bs
 UNION ALL SELECT {_X}(ty), {_DOM}, {_X}({_n('x')}), 'iri', NULL FROM (SELECT ty, unnest(domains) x FROM bs) UNION ALL SELECT {_X}(ty), {_RNG}, {_X}({_n('x')}), 'iri', NULL FROM (SELECT ty, unnest(ranges) x FROM bs)
 UNION ALL SELECT {_X}(sb), {_SUB}, {_X}(sp), 'iri', NULL FROM ax WHERE ty = 'SubClassOf'
 UNION ALL SELECT {_X}({_n('domains[1]')}), {_EQ}, {_X}({_n('ranges[1]')}), 'iri', NULL FROM ax WHERE ty = 'equivalentClass'
 UNION ALL SELECT {_X}(pr), {_TYPE}, CASE WHEN dt IS NULL THEN {_OP} ELSE {_DP} END, 'iri', NULL FROM ax WHERE ty IS NULL UNION ALL SELECT {_X}(pr), {_LAB}, pr, 'literal', NULL FROM ax WHERE ty IS NULL
 UNION ALL SELECT {_X}(pr), {_DOM}, {_X}(dm), 'iri', NULL FROM ax WHERE ty IS NULL
 UNION ALL SELECT {_X}(pr), {_RNG}, CASE WHEN dt IS NULL THEN {_X}(rg) ELSE '{tr.XSD}' || split_part(dt, ':', -1) END, 'iri', NULL FROM ax WHERE ty IS NULL
 UNION ALL SELECT {_X}(id), {_TYPE}, {_IND}, 'iri', NULL FROM ab WHERE type = 'DeclareIndividual' UNION ALL SELECT {_X}(ind), {_TYPE}, {_X}(cls), 'iri', NULL FROM ab WHERE type = 'ClassAssertion'
 UNION ALL SELECT {_X}(sj), {_X}(pr), {_X}(ob), 'iri', NULL FROM ab WHERE type = 'ObjectPropertyAssertion'
 UNION ALL SELECT {_X}(sj), {_X}(pr), CASE k WHEN 'boolean' THEN CASE WHEN lower(v) = 'true' THEN 'true' ELSE 'false' END WHEN 'integer' THEN regexp_replace(ltrim(trim(v), '+'), '^(-?)0+([0-9])', '\\1\\2') WHEN 'decimal' THEN trim(v) ELSE v END, 'literal', '{tr.XSD}' || k FROM lit
 UNION ALL SELECT {_X}(coalesce(CASE type WHEN 'DeclareIndividual' THEN id WHEN 'ClassAssertion' THEN ind ELSE sj END)), {_CHUNK}, ch::VARCHAR, 'literal', '{tr.XSD}integer' FROM ab WHERE type <> 'SameIndividual'
 UNION ALL SELECT {_X}(a), {_SAME}, {_X}(b), 'iri', NULL FROM prs),
t AS MATERIALIZED (SELECT DISTINCT * FROM t0 WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)"""

_TY = f"ty AS MATERIALIZED (SELECT DISTINCT s, o FROM t WHERE p = {_TYPE} AND o_kind = 'iri')"
_CLO = f"sc AS (SELECT DISTINCT s a, o b FROM t WHERE p = {_SUB}), clo AS (SELECT a, b FROM sc UNION SELECT clo.a, sc.b FROM clo JOIN sc ON clo.b = sc.a)"
_ENT = f"ent AS (SELECT DISTINCT {_n('id')} entity FROM abox WHERE type = 'DeclareIndividual' AND assertion_id % 50 = 0), en AS (SELECT entity, {_X}(entity) uri FROM ent WHERE entity IS NOT NULL)"
_NODES = f"en AS (SELECT DISTINCT s uri FROM t WHERE p = {_TYPE} AND o IN ({_CLS}, {_IND}))"
_READ = lambda x: f"url_decode(split_part({x}, '#', -1))"
_EQSET = f"""
eq AS (SELECT DISTINCT x, y FROM (SELECT {_n('domains[1]')} x, {_n('ranges[1]')} y FROM tbox_axioms WHERE type = 'equivalentClass') WHERE x <> 'Entity' AND y <> 'Entity'),
es AS (SELECT x, y FROM eq UNION SELECT y, x FROM eq UNION SELECT x, x FROM eq UNION SELECT y, y FROM eq),
er AS (SELECT x, y FROM es UNION SELECT er.x, es.y FROM er JOIN es ON er.y = es.x)"""
_GROUPS = f"""{_EQSET},
ca AS (SELECT DISTINCT {_n('individual')} nm, {_n('class')} c FROM abox WHERE type = 'ClassAssertion'),
cx AS (SELECT DISTINCT nm, coalesce(er.y, c) c FROM ca LEFT JOIN er ON er.x = c WHERE nm IS NOT NULL AND c IS NOT NULL),
gr AS (SELECT lower(regexp_replace(nm, '[^a-zA-Z0-9]+', '', 'g')) k, c, nm FROM cx)"""
_LINKS = f"lk AS (SELECT DISTINCT s, p, o FROM t WHERE p LIKE '{tr.EX}has%' AND o_kind = 'iri')"
_VALID = f"""pp AS (SELECT DISTINCT s p FROM t WHERE p = {_TYPE} AND o = {_OP}), ls AS (SELECT DISTINCT s, t.p, o FROM t JOIN pp ON pp.p = t.p WHERE o_kind = 'iri'),
dm AS (SELECT DISTINCT s p, o c FROM t WHERE p = {_DOM}), rn AS (SELECT DISTINCT s p, o c FROM t WHERE p = {_RNG}),
bad AS (SELECT * FROM ls WHERE (p IN (SELECT p FROM dm) AND NOT EXISTS (SELECT 1 FROM dm JOIN ty ON ty.o = dm.c WHERE dm.p = ls.p AND ty.s = ls.s))
 OR (p IN (SELECT p FROM rn) AND NOT EXISTS (SELECT 1 FROM rn JOIN ty ON ty.o = rn.c WHERE rn.p = ls.p AND ty.s = ls.o)))"""
_SAMESET = f"sa AS (SELECT DISTINCT s, o FROM t WHERE p = {_SAME}), tw AS (SELECT uri, uri twin FROM en UNION SELECT tw.uri, sa.o FROM tw JOIN sa ON sa.s = tw.twin)"
_DIRECT = "dt AS (SELECT DISTINCT ty.s, ty.o FROM ty WHERE NOT EXISTS (SELECT 1 FROM ty u JOIN clo ON clo.a = u.o AND clo.b = ty.o AND clo.a <> clo.b WHERE u.s = ty.s AND NOT EXISTS (SELECT 1 FROM clo c2 WHERE c2.a = ty.o AND c2.b = u.o)))"


def _w(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def oracle_sql() -> dict[str, str]:
    schema = lambda sc, col: (
        _w(_T, _TY) + f"SELECT DISTINCT x s, c o FROM (SELECT DISTINCT {'t.s' if col == 's' else 't.o'} x, d.o c FROM t JOIN t d ON d.s = t.p AND d.p = {sc} AND d.o_kind = 'iri'"
        + ("" if col == "s" else " WHERE t.o_kind = 'iri'") + ") q WHERE NOT EXISTS (SELECT 1 FROM ty WHERE ty.s = q.x AND ty.o = q.c)")
    eqtypes = f"""ec AS (SELECT s a, o b FROM t WHERE p = {_EQ} UNION SELECT o, s FROM t WHERE p = {_EQ}), ee AS (SELECT a, b FROM ec UNION SELECT ee.a, ec.b FROM ee JOIN ec ON ee.b = ec.a)"""
    return {
        "kb_triples": _w(_T) + "SELECT * FROM t",
        "kb_stats": _w(_T) + f"SELECT count(*) triples, sum((p = {_TYPE} AND o = {_CLS})::INT)::BIGINT classes, sum((p = {_TYPE} AND o = {_IND})::INT)::BIGINT individuals, sum((p = {_TYPE} AND o = {_OP})::INT)::BIGINT object_properties, sum((p = {_TYPE} AND o = {_DP})::INT)::BIGINT datatype_properties FROM t",
        "kb_node_kinds": _w(_T) + f"SELECT DISTINCT s node, CASE o WHEN {_CLS} THEN 'class' WHEN {_IND} THEN 'individual' WHEN {_OP} THEN 'object_property' ELSE 'datatype_property' END kind FROM t WHERE p = {_TYPE} AND o IN ({_CLS}, {_IND}, {_OP}, {_DP})",
        "kb_pattern": _w(_T) + f"SELECT s FROM t WHERE p = {_TYPE} AND o = {_IND}",
        "kb_labels": _w(_T) + f"SELECT q.s, coalesce(l, {_READ('q.s')}) \"label\" FROM (SELECT DISTINCT s FROM t WHERE p = {_TYPE} AND o IN ({_CLS}, {_IND}, {_OP}, {_DP})) q LEFT JOIN (SELECT s, min(o) l FROM t WHERE p = {_LAB} GROUP BY s) z ON z.s = q.s",
        "kb_loose_classes": _w(_T) + f"SELECT DISTINCT s FROM t WHERE p = {_TYPE} AND o = {_CLS} AND s NOT IN (SELECT s FROM t WHERE p = {_SUB} UNION SELECT o FROM t WHERE p IN ({_SUB}, {_TYPE}))",
        "kb_loose_by_axioms": _w(_T) + f"""SELECT DISTINCT {_X}(c) s FROM c0 WHERE c IS NOT NULL AND {_X}(c) NOT IN (SELECT unnest([{_X}(sb), {_X}(sp)]) FROM ax WHERE ty = 'SubClassOf' AND sb IS NOT NULL AND sp IS NOT NULL)
 AND {_X}(c) NOT IN (SELECT o FROM t WHERE p = {_TYPE})""",
        "kb_entity_axioms": _w(_T, _NODES) + f"""SELECT DISTINCT q.s, category, q.p, q.o FROM (
 SELECT s, 'ClassAxiom' category, p, o FROM t WHERE p IN ({_SUB}, {_EQ}) OR (p = {_TYPE} AND o <> {_IND})
 UNION ALL SELECT s, 'ObjectPropertyAssertion', p, o FROM t WHERE p IN (SELECT s FROM t WHERE p = {_TYPE} AND o = {_OP})
 UNION ALL SELECT s, 'DataPropertyAssertion', p, o FROM t WHERE p IN (SELECT s FROM t WHERE p = {_TYPE} AND o = {_DP})
 UNION ALL SELECT s, 'AnnotationProperty', p, o FROM t WHERE p IN ({_LAB}, {_COM})) q JOIN en ON en.uri = q.s""",
        "kb_subclass_types": _w(_T, _TY, _CLO, recursive=True) + "SELECT DISTINCT ty.s, clo.b o FROM ty JOIN clo ON clo.a = ty.o EXCEPT SELECT s, o FROM ty",
        "kb_members_by_class": _w(_T, _TY, _CLO, f"al AS (SELECT s, o FROM ty UNION SELECT ty.s, clo.b FROM ty JOIN clo ON clo.a = ty.o)", recursive=True)
        + f"SELECT {_READ('o')} \"class\", count(*) members FROM al WHERE o <> {_IND} AND s IN (SELECT s FROM ty WHERE o = {_IND}) GROUP BY 1",
        "kb_equivalence_types": _w(_T, _TY, eqtypes, recursive=True) + "SELECT DISTINCT ty.s, ee.b o FROM ty JOIN ee ON ee.a = ty.o EXCEPT SELECT s, o FROM ty",
        "kb_domain_types": schema(_DOM, "s"), "kb_range_types": schema(_RNG, "o"),
        "kb_inverse_links": _w(_T) + f"SELECT DISTINCT o s, '{tr.EX}isPatchOf' p, s o FROM t WHERE p = '{tr.EX}hasPatch' AND o_kind = 'iri' EXCEPT SELECT s, p, o FROM t",
        "kb_invalid_links": _w(_T, _TY, _VALID) + "SELECT s, p, o FROM bad",
        "kb_inferred": _w(_T, _TY, _CLO, _VALID, f"""ok AS (SELECT * FROM t WHERE NOT (o_kind = 'iri' AND (s, p, o) IN (SELECT (s, p, o) FROM bad))),
 t1 AS (SELECT s, o FROM ty UNION SELECT ty.s, clo.b FROM ty JOIN clo ON clo.a = ty.o)""", eqtypes, f"""t2 AS (SELECT s, o FROM t1 UNION SELECT t1.s, ee.b FROM t1 JOIN ee ON ee.a = t1.o)""", recursive=True)
        + f"SELECT s, {_TYPE} p, o FROM (SELECT s, o FROM t2 EXCEPT SELECT s, o FROM ty) UNION ALL (SELECT DISTINCT o, '{tr.EX}isPatchOf', s FROM ok WHERE p = '{tr.EX}hasPatch' AND o_kind = 'iri' EXCEPT SELECT s, p, o FROM ok)",
        "kb_diff": _w(_T) + f"SELECT s, p, o FROM t WHERE p NOT IN ({_TYPE}, {_LAB})",
        "kb_superclasses": _w(_T, _CLO, recursive=True) + f"SELECT {_READ('a')} \"class\", {_READ('b')} superclass FROM clo",
        "kb_direct_types": _w(_T, _TY, _CLO, "al AS (SELECT s, o FROM ty UNION SELECT ty.s, clo.b FROM ty JOIN clo ON clo.a = ty.o)", "nr AS (SELECT * FROM clo WHERE a <> b)", recursive=True)
        + "SELECT s, o FROM al EXCEPT SELECT al.s, nr.b FROM al JOIN nr ON nr.a = al.o",
        "kb_same_as": _w(_T, f"e AS (SELECT s, o FROM t WHERE p = {_SAME} UNION SELECT o, s FROM t WHERE p = {_SAME})", "r AS (SELECT s, s x FROM e UNION SELECT r.s, e.o FROM r JOIN e ON e.s = r.x)", recursive=True) + "SELECT s node, min(x) component FROM r GROUP BY s",
        "kb_equivalence_sets": _w(_EQSET, recursive=True) + "SELECT x \"class\", string_agg(y, '|' ORDER BY y) class_set FROM er GROUP BY x",
        "kb_same_pairs": _w(_T) + "SELECT a, b FROM prs",
        "kb_name_groups": _w(_GROUPS, recursive=True) + "SELECT k name_key, c \"class\", string_agg(DISTINCT nm, '|' ORDER BY nm) names FROM gr WHERE k <> '' GROUP BY k, c",
        "kb_polysemy": _w(_GROUPS, recursive=True) + "SELECT k name_key, string_agg(DISTINCT c, '|' ORDER BY c) classes FROM gr WHERE k <> '' GROUP BY k HAVING count(DISTINCT c) > 1",
        "kb_rejected": _w(_GROUPS, f"""n0 AS (SELECT {_n('individual')} nm, {_n('class')} c, chunk_id FROM abox WHERE type = 'ClassAssertion')""", recursive=True)
        + "SELECT DISTINCT nm \"name\", chunk_id FROM n0 LEFT JOIN er ON er.x = n0.c WHERE nm IS NOT NULL AND regexp_matches(coalesce(er.y, c), '[02468]$') AND lower(regexp_replace(nm, '[^a-zA-Z0-9]+', '', 'g')) <> ''",
        "kb_surviving_groups": _w(_GROUPS, """bd AS (SELECT DISTINCT nm, c FROM gr WHERE k <> '' AND regexp_matches(c, '[02468]$')),
 sv AS (SELECT k, c, nm FROM gr WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.nm = gr.nm AND (bd.c = gr.c OR EXISTS (SELECT 1 FROM er WHERE er.x = gr.c AND er.y = bd.c))))""", recursive=True)
        + "SELECT k name_key, c \"class\", string_agg(DISTINCT nm, '|' ORDER BY nm) individuals FROM sv GROUP BY k, c HAVING count(DISTINCT nm) > 1",
        "kb_surviving_spellings": _w(_GROUPS.replace("FROM abox WHERE type = 'ClassAssertion')", "FROM (SELECT type, individual, class FROM abox UNION ALL SELECT type, upper(individual), class FROM abox) WHERE type = 'ClassAssertion')"), """bd AS (SELECT DISTINCT nm, c FROM gr WHERE k <> '' AND regexp_matches(c, '[02468]$')),
 sv AS (SELECT k, c, nm FROM gr WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.nm = gr.nm AND (bd.c = gr.c OR EXISTS (SELECT 1 FROM er WHERE er.x = gr.c AND er.y = bd.c))))""", recursive=True)
        + "SELECT k name_key, c \"class\", string_agg(DISTINCT nm, '|' ORDER BY nm) individuals FROM sv GROUP BY k, c HAVING count(DISTINCT nm) > 1",
        "kb_prune": _w(*_PRUNE) + "SELECT DISTINCT assertion_id, type FROM fallen",
        "kb_kept": _w(*_PRUNE) + "SELECT type, count(DISTINCT assertion_id) n FROM abox WHERE assertion_id NOT IN (SELECT assertion_id FROM fallen) GROUP BY type",
        "kb_cleanup_counts": "SELECT (SELECT count(*) FROM tbox_classes) num_classes, (SELECT count(*) FROM tbox_axioms) num_axioms, (SELECT count(*) FROM abox) num_instances, (SELECT count(*) FROM pruned) num_pruned, (SELECT string_agg(phase || '=' || n, ';' ORDER BY phase) FROM (SELECT phase, count(*) n FROM pruned GROUP BY phase)) phases",
        "kb_individuals": _w(*_DETAIL) + "SELECT c.nm \"name\", c.cls \"class\", coalesce(txt, '') properties FROM (SELECT nm, max(cls) cls FROM cl GROUP BY nm) c LEFT JOIN (SELECT nm, string_agg(DISTINCT tx, '|' ORDER BY tx) txt FROM pt GROUP BY nm) p ON p.nm = c.nm",
        "kb_individuals_by_chunk": _w(*_DETAIL) + "SELECT c.nm \"name\", c.ch chunk_id, c.cls \"class\", coalesce(n, 0)::INT n FROM (SELECT nm, ch, max(cls) cls FROM cl GROUP BY nm, ch) c LEFT JOIN (SELECT nm, ch, count(DISTINCT tx) n FROM pt GROUP BY nm, ch) p ON p.nm = c.nm AND p.ch IS NOT DISTINCT FROM c.ch",
        "kb_scoped_classes": f"SELECT DISTINCT {_n('class')} \"class\" FROM tbox_classes WHERE len(chunk_ids) > 0",
        "kb_accumulate": f"""WITH r AS (SELECT {_n('class')} c, description, unnest(chunk_ids) ch FROM tbox_classes)
 SELECT c "class", arg_min(description, {{'a': ch, 'b': description}}) description, (SELECT string_agg(ch, ',' ORDER BY ch) FROM (SELECT DISTINCT ch FROM r q WHERE q.c = r.c AND ch IS NOT NULL)) chunks FROM r WHERE c IS NOT NULL AND ch IS NOT NULL GROUP BY c""",
        "kb_merged": _w(_T) + "SELECT a || '|' || string_agg(b, '|' ORDER BY b) individuals FROM prs WHERE a < b GROUP BY a",
        "kb_apply_equivalences": _w(_T) + "SELECT type, count(*) n, count(DISTINCT f) firsts FROM (SELECT type, domains[1] f FROM tbox_axioms WHERE type = 'equivalentClass' UNION ALL SELECT 'equivalentClass', b FROM (SELECT DISTINCT b FROM prs WHERE a < b)) GROUP BY type",
        "kb_degrees": _w(_T, _LINKS) + "SELECT s, p, count(*) n FROM lk GROUP BY s, p",
        "kb_compare": _w(_T, _LINKS, "n AS (SELECT s, count(*) n FROM lk GROUP BY s)") + "SELECT q.s, q.o, CASE WHEN a.n >= b.n THEN q.s ELSE q.o END more, abs(a.n - b.n) difference FROM (SELECT DISTINCT s, o FROM lk) q JOIN n a ON a.s = q.s JOIN n b ON b.s = q.o",
        "kb_property_values": f"SELECT pr property, coalesce(string_agg(DISTINCT value, '|' ORDER BY value), '') vals FROM (SELECT {_n('property')} pr, value FROM abox WHERE type = 'DataPropertyAssertion') WHERE pr IS NOT NULL GROUP BY pr",
        "kb_schema_classes": _w(_T, f"lb AS (SELECT s, min(o) l FROM t WHERE p = {_LAB} GROUP BY s)") + f"""SELECT l "class", coalesce((SELECT min(o) FROM t WHERE p = {_COM} AND t.s = q.s), 'No definition available.') description,
 coalesce((SELECT string_agg(DISTINCT x.l, '|' ORDER BY x.l) FROM t JOIN lb x ON x.s = t.o WHERE t.p = {_SUB} AND t.s = q.s), '') parents FROM (SELECT DISTINCT s FROM t WHERE p = {_TYPE} AND o = {_CLS}) q JOIN lb ON lb.s = q.s""",
        "kb_schema_properties": _w(_T, f"lb AS (SELECT s, min(o) l FROM t WHERE p = {_LAB} GROUP BY s)") + f"""SELECT 'subClassOf' AS "type", '' domains, '' ranges UNION ALL SELECT l,
 coalesce((SELECT string_agg(DISTINCT {_READ('o')}, '|' ORDER BY {_READ('o')}) FROM t WHERE p = {_DOM} AND t.s = q.s), ''), coalesce((SELECT string_agg(DISTINCT {_READ('o')}, '|' ORDER BY {_READ('o')}) FROM t WHERE p = {_RNG} AND t.s = q.s), '')
 FROM (SELECT DISTINCT s FROM t WHERE p = {_TYPE} AND o = {_OP}) q JOIN lb ON lb.s = q.s""",
        "kb_turtle_roundtrip": _w(_T) + "SELECT p, count(*) n, 0::BIGINT lost FROM t GROUP BY p",
        "entity_token_scores": _w(_T, _ENT, f"""nm AS (SELECT DISTINCT q.s uri, coalesce(l.o, {_READ('q.s')}) lab, {_READ('q.s')} frag FROM (SELECT DISTINCT s FROM t WHERE p = {_TYPE} AND o IN ({_CLS}, {_IND})) q LEFT JOIN t l ON l.s = q.s AND l.p = {_LAB}),
 e AS (SELECT entity, regexp_replace(trim(lower(entity)), 's$', '') k FROM en), n AS (SELECT uri, lab, regexp_replace(trim(lower(lab)), 's$', '') lk, regexp_replace(trim(lower(frag)), 's$', '') fk FROM nm),
 et AS (SELECT entity, k, list_distinct(regexp_extract_all(k, '[a-z]+')) ts FROM e), nt AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lk, '[a-z]+')), lambda x: len(x) >= 4) ts FROM n),
 sc AS (SELECT entity, uri, lab, CASE WHEN k = lk OR k = fk THEN 1.0 ELSE 0.15 * len(list_intersect(et.ts, nt.ts)) / greatest(len(et.ts), 1) + 0.05 END::DOUBLE x FROM et JOIN nt ON len(list_intersect(et.ts, nt.ts)) > 0 OR k = lk OR k = fk)""")
        + "SELECT entity, uri, arg_max(lab, {'a': round(x, 6), 'b': lab}) \"label\", max(round(x, 6)) score FROM sc GROUP BY entity, uri",
        "context_properties": _w(_T, _TY, _CLO, _NODES, _SAMESET, _DIRECT, f"""dom AS (SELECT DISTINCT s p, o c FROM t WHERE p = {_DOM}),
 fit AS (SELECT DISTINCT x.o ty, dom.p FROM (SELECT DISTINCT dt.o FROM dt JOIN en ON en.uri = dt.s) x JOIN dom ON dom.c = x.o OR EXISTS (SELECT 1 FROM clo WHERE a = x.o AND b = dom.c)),
 st AS (SELECT DISTINCT uri, CASE WHEN o_kind = 'iri' THEN 'out_object' ELSE 'out_data' END direction, p, o other, o_dtype FROM tw JOIN t ON t.s = tw.twin UNION SELECT uri, 'in_object', p, s, NULL FROM tw JOIN t ON t.o = tw.twin AND o_kind = 'iri')""", recursive=True)
        + "SELECT st.uri, dt.o \"type\", direction, st.p property, other FROM st JOIN dt ON dt.s = st.uri JOIN fit ON fit.ty = dt.o AND fit.p = st.p",
        "context_counts": _w(_T, _TY, _CLO, _NODES, _SAMESET, _DIRECT, f"""dom AS (SELECT DISTINCT s p, o c FROM t WHERE p = {_DOM}),
 fit AS (SELECT DISTINCT x.o ty, dom.p FROM (SELECT DISTINCT dt.o FROM dt JOIN en ON en.uri = dt.s) x JOIN dom ON dom.c = x.o OR EXISTS (SELECT 1 FROM clo WHERE a = x.o AND b = dom.c)),
 st AS (SELECT DISTINCT uri, CASE WHEN o_kind = 'iri' THEN 'out_object' ELSE 'out_data' END direction, p, o other, o_dtype FROM tw JOIN t ON t.s = tw.twin UNION SELECT uri, 'in_object', p, s, NULL FROM tw JOIN t ON t.o = tw.twin AND o_kind = 'iri')""", f"""ap AS (SELECT DISTINCT st.uri, {_READ('dt.o')} k FROM st JOIN dt ON dt.s = st.uri JOIN fit ON fit.ty = dt.o AND fit.p = st.p),
 cn AS (SELECT DISTINCT s FROM t WHERE p = {_TYPE} AND o = {_CLS}), sk AS (SELECT dt.s uri, {_READ('dt.o')} k FROM dt JOIN clo ON clo.a = dt.o UNION SELECT t.s, {_READ('t.s')} FROM t JOIN cn ON cn.s = t.s WHERE p = {_SUB}),
 tp AS (SELECT s uri, count(DISTINCT {_READ('o')}) n FROM dt GROUP BY s), su AS (SELECT uri, count(*) n FROM sk GROUP BY uri), pc AS (SELECT uri, count(*) n FROM ap GROUP BY uri),
 tt AS (SELECT uri, count(DISTINCT CASE WHEN p = {_EQ} THEN {_READ('o')} END) ne, count(DISTINCT CASE WHEN p = {_CHUNK} THEN o END) nc FROM tw JOIN t ON t.s = tw.twin GROUP BY uri),
 me AS (SELECT o uri, count(DISTINCT {_READ('t.s')}) n FROM t JOIN cn ON cn.s = t.o WHERE p = {_TYPE} GROUP BY o), lb AS (SELECT s, min(o) l FROM t WHERE p = {_LAB} GROUP BY s)""", recursive=True)
        + f"""SELECT en.uri, coalesce(lb.l, {_READ('en.uri')}) AS "label", coalesce(tp.n, 0)::INT n_types, coalesce(su.n, 0)::INT n_superclasses, coalesce(tt.ne, 0)::INT n_equivalent_classes, coalesce(pc.n, 0)::INT n_properties_by_type,
 coalesce(tt.nc, 0)::INT n_chunk_id, coalesce(me.n, 0)::INT n_members FROM en LEFT JOIN lb ON lb.s = en.uri LEFT JOIN tp ON tp.uri = en.uri LEFT JOIN su ON su.uri = en.uri LEFT JOIN pc ON pc.uri = en.uri LEFT JOIN tt ON tt.uri = en.uri LEFT JOIN me ON me.uri = en.uri""",
        "context_provenance": _w(_T, _TY, _CLO, _NODES, _SAMESET, _DIRECT, recursive=True) + f"""SELECT uri, coalesce((SELECT string_agg(DISTINCT o, '|' ORDER BY o) FROM tw JOIN t ON t.s = tw.twin AND t.p = {_CHUNK} WHERE tw.uri = en.uri), '') chunk_ids,
 coalesce((SELECT string_agg(DISTINCT {_READ('o')}, '|' ORDER BY {_READ('o')}) FROM dt WHERE dt.s = en.uri), '') types FROM en""",
        "context_class_descriptions": _w(_T, _NODES, _SAMESET, recursive=True) + f"SELECT DISTINCT uri, {_READ('t.o')} \"class\", (SELECT min(o) FROM t q WHERE q.s = t.o AND q.p = {_COM}) description FROM tw JOIN t ON t.s = tw.twin AND t.p = {_TYPE}",
        "context_property_descriptions": _w(_T, _NODES, _SAMESET, recursive=True) + f"""SELECT DISTINCT uri, {_READ('x.p')} property, (SELECT min(o) FROM t q WHERE q.s = x.p AND q.p = {_COM}) description,
 coalesce((SELECT string_agg(DISTINCT {_READ('o')}, '|' ORDER BY {_READ('o')}) FROM t q WHERE q.s = x.p AND q.p = {_DOM}), '') domains, coalesce((SELECT string_agg(DISTINCT {_READ('o')}, '|' ORDER BY {_READ('o')}) FROM t q WHERE q.s = x.p AND q.p = {_RNG}), '') ranges
 FROM (SELECT DISTINCT uri, t.p FROM tw JOIN t ON t.s = tw.twin WHERE t.p IN (SELECT s FROM t WHERE p = {_TYPE} AND o = {_OP})) x""",
        "context_members": _w(_T, "cl AS (SELECT DISTINCT c FROM c0)") + f"""SELECT c AS "label", coalesce((SELECT string_agg(DISTINCT {_READ('s')}, '|' ORDER BY {_READ('s')}) FROM t WHERE p = {_TYPE} AND o = {_X}(c)), '') members,
 coalesce((SELECT string_agg(DISTINCT {_READ('o')}, '|' ORDER BY {_READ('o')}) FROM t WHERE p = {_SUB} AND s = {_X}(c)), '') "direct" FROM cl WHERE c IS NOT NULL""",
        "context_by_question_type": _w(_T, _NODES, "q AS (SELECT unnest(['definition', 'taxonomic', 'capability', 'property', 'existential', 'membership', 'comparative', 'quantification', 'other']) question_type)")
        + "SELECT uri, question_type, CASE WHEN question_type = 'other' THEN 'unknown question type' ELSE 'ok' END status, question_type IN ('membership', 'quantification') members, question_type IN ('comparative', 'quantification') chunk_id FROM en, q",
        "name_similarity": _w(f"""nm AS (SELECT DISTINCT {_n('individual')} n FROM abox WHERE type = 'ClassAssertion'), na AS (SELECT n FROM nm WHERE n IS NOT NULL),
 ws AS (SELECT n, regexp_extract_all(lower(n), '[\\p{{L}}\\p{{N}}_]+') w FROM na),
 tw AS (SELECT n, 'w' b, unnest(w) t FROM ws UNION ALL SELECT n, 'w', w[i] || ' ' || w[i + 1] FROM (SELECT n, w, unnest(range(1, len(w))) i FROM ws)),
 pw AS (SELECT n, ' ' || unnest(list_filter(regexp_split_to_array(lower(n), '\\s+'), lambda x: x <> '')) || ' ' p FROM na),
 tc AS (SELECT n, 'c' b, p[i:i + 2] t FROM (SELECT n, p, unnest(range(1, len(p) - 1)) i FROM pw WHERE len(p) > 3) UNION ALL SELECT n, 'c', p FROM pw WHERE len(p) <= 3
  UNION ALL SELECT n, 'c', p[i:i + 3] FROM (SELECT n, p, unnest(range(1, len(p) - 2)) i FROM pw WHERE len(p) > 4) UNION ALL SELECT n, 'c', p FROM pw WHERE len(p) = 4),
 tf AS (SELECT n, b, t, count(*) f FROM (SELECT * FROM tw UNION ALL SELECT * FROM tc) GROUP BY ALL), df AS (SELECT b, t, count(*) d FROM tf GROUP BY ALL),
 x AS (SELECT tf.n, tf.b, tf.t, f * (ln((1 + (SELECT count(*) FROM na))::DOUBLE / (1 + d)) + 1) x FROM tf JOIN df ON df.b = tf.b AND df.t = tf.t),
 y AS (SELECT n, b, t, x / sqrt(sum(x * x) OVER (PARTITION BY n, b)) * CASE b WHEN 'w' THEN 20.0 ELSE 5.0 END::DOUBLE y FROM x), v AS MATERIALIZED (SELECT n, b || ':' || t t, y / sqrt(sum(y * y) OVER (PARTITION BY n)) w FROM y)""")
        + "SELECT a.n a, b.n b, round(sum(a.w * b.w), 6) cos FROM v a JOIN v b ON a.t = b.t AND a.n < b.n GROUP BY a.n, b.n HAVING sum(a.w * b.w) > 0.6",
        "rag_topk": """SELECT query, item, score, rank FROM (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INT rank FROM (
 SELECT q.vec_id query, v.vec_id item, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) score
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 3""",
    }


_PRUNE = (f"nd AS (SELECT DISTINCT {_n('individual')} nm, chunk_id ch FROM pruned WHERE type = 'ClassAssertion')",
          f"""ka AS (SELECT assertion_id, type, chunk_id ch, unnest(CASE type WHEN 'ClassAssertion' THEN [{_n('individual')}] WHEN 'DeclareIndividual' THEN [{_n('id')}] WHEN 'DataPropertyAssertion' THEN [{_n('subject')}] WHEN 'ObjectPropertyAssertion' THEN [{_n('subject')}, {_n('object')}] ELSE [] END) nm FROM abox)""",
          "fallen AS (SELECT ka.* FROM ka JOIN nd ON nd.nm = ka.nm AND nd.ch IS NOT DISTINCT FROM ka.ch)")
_DETAIL = (f"cl AS (SELECT nm, ch, cls FROM (SELECT {_n('individual')} nm, chunk_id ch, {_n('class')} cls FROM abox WHERE type = 'ClassAssertion') WHERE nm IS NOT NULL)",
           f"pt AS (SELECT nm, ch, concat_ws(': ', p, v) tx FROM (SELECT {_n('subject')} nm, chunk_id ch, {_n('property')} p, CASE WHEN type = 'DataPropertyAssertion' THEN value ELSE {_n('object')} END v FROM abox WHERE type IN ('DataPropertyAssertion', 'ObjectPropertyAssertion')) WHERE nm IS NOT NULL)")
