"""Queries of the general training-data problems (2, 4 and 6) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, strip_name, table
from ..operators.hierarchy import Hierarchy, hierarchy, named_paths
from ..operators.nested import Rule, emit, read_tag, write_tagged
from ..operators.closure import closure
from ..operators.orphans import orphan_counts, orphan_references

# ---------------------------------------------------------------- problem 2

LOG = Rule(
    "log", "", ("input", "error"),
    children=(
        Rule("question_type", "resolved_question_type", ("reasoning", "question_type"), scalar_as="reasoning"),
        Rule("entry", "resolve_entity_candidates", ("type", "entity"), children=(
            Rule("candidate", "candidates", ("label", "score", "uri")),
        )),
    ),
)


_SIDES = (("outgoing_object_properties", "object"), ("outgoing_data_properties", "value"), ("incoming_object_properties", "subject"))


def _context(tag: str) -> Rule:
    """A context with its types, members, superclasses by type and properties by type."""
    return Rule(tag, tag, ("uri", "label"), children=(
        Rule(f"{tag}_type", "types", ("name",), scalar_as="name"), Rule(f"{tag}_member", "members", ("name",), scalar_as="name"),
        Rule(f"{tag}_by_type", "properties_by_type", ("type",), key_as="type", children=tuple(Rule(f"{tag}_{side}", side, ("property", field)) for side, field in _SIDES)),
    ))


#: All parts of a log.
WHOLE_LOG = Rule("log", "", ("input", "error"), children=(
    *LOG.children, Rule("answer_form", "resolved_answer_form", ("reasoning", "answer_form"), scalar_as="reasoning"), Rule("primary_entity", "extracted_entity", ("reasoning", "primary_entity")),
    Rule("answer", "generated_answer", ("reasoning", "answer"), scalar_as="answer"),
    Rule("context", "full_context", ("question_type",), children=(_context("entity_context"), _context("object_context"))),
))


def _log_tables(spark: SparkSession, d: str, rule: Rule = LOG) -> str:
    return write_tagged(emit(table(spark, d, "inference_logs"), "log_id", "payload", rule))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Candidate objects and non-empty reasoning texts with their positions."""
    path = _log_tables(spark, d)
    cands = read_tag(spark, path, "candidate", {}, payload=False)
    cands = cands.select(F.col("record_id").alias("log_id"), F.lit("candidate").alias("node"), F.col("path")[0].alias("entry_pos"), F.col("path")[1].alias("candidate_pos"))
    types = read_tag(spark, path, "question_type", {"reasoning": "string"}).where("reasoning <> ''")
    types = types.select(F.col("record_id").alias("log_id"), F.lit("reasoning").alias("node"), F.col("path")[0].alias("entry_pos"), F.lit(-1).alias("candidate_pos"))
    return cands.unionByName(types)


def p2_logs(spark: SparkSession, d: str) -> DataFrame:
    """One row for each readable log."""
    return read_tag(spark, _log_tables(spark, d), "log", {"input": "string", "error": "string"}).select(F.col("pk").alias("log_id"), "input", "error")


def p2_question_types(spark: SparkSession, d: str) -> DataFrame:
    rows = read_tag(spark, _log_tables(spark, d), "question_type", {"reasoning": "string", "question_type": "string"})
    return rows.select(F.col("pk").alias("question_type_key"), F.col("parent_pk").alias("log_id"), F.col("path")[0].alias("pos"), "reasoning", "question_type")


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = read_tag(spark, _log_tables(spark, d), "entry", {"type": "string", "entity": "string"})
    return rows.select(F.col("pk").alias("entry_key"), F.col("parent_pk").alias("log_id"), F.col("path")[0].alias("pos"), "type", "entity")


def p2_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = read_tag(spark, _log_tables(spark, d), "candidate", {"label": "string", "score": "double", "uri": "string"})
    return rows.select(F.col("pk").alias("candidate_key"), F.col("parent_pk").alias("entry_key"), F.col("path")[1].alias("pos"), "label", "score", "uri")


def p2_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their reasoning, by log."""
    rows = read_tag(spark, _log_tables(spark, d, WHOLE_LOG), "answer", {"reasoning": "string", "answer": "string"})
    return rows.select(F.col("pk").alias("answer_key"), F.col("parent_pk").alias("log_id"), F.col("path")[0].alias("pos"), "reasoning", "answer")


def p2_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of entities with the number of their types, members and typed property lists: three tables of one
    emission, joined by their keys."""
    path = _log_tables(spark, d, WHOLE_LOG)
    rows = read_tag(spark, path, "entity_context", {"uri": "string"})
    for tag, n in (("entity_context_type", "n_types"), ("entity_context_member", "n_members"), ("entity_context_by_type", "n_typed")):
        count = read_tag(spark, path, tag, {}, payload=False).groupBy(F.col("parent_pk").alias("pk")).agg(F.count(F.lit(1)).alias(n))
        rows = rows.join(count, "pk", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return rows.select(F.col("pk").alias("context_key"), F.col("record_id").alias("log_id"), "uri", "n_types", "n_members", "n_typed")


def p2_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the entities' contexts with their type, the key of their parent and their place in it."""
    path = _log_tables(spark, d, WHOLE_LOG)
    types = read_tag(spark, path, "entity_context_by_type", {"type": "string"}).select(F.col("pk").alias("parent_pk"), "type")
    sides = [read_tag(spark, path, f"entity_context_{side}", {"property": "string", field: "string"}).select("parent_pk", F.element_at("path", -1).alias("pos"), F.lit(side).alias("side"), "property", F.col(field).alias("value")) for side, field in _SIDES]
    return reduce(DataFrame.unionByName, sides).join(types, "parent_pk").select(F.col("parent_pk").alias("typed_key"), "type", "side", "pos", "property", "value")


# ---------------------------------------------------------------- problem 4

def _class_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of both class tables, names stripped."""
    rows = table(spark, d, "base_classes").select("class", "parents").unionByName(table(spark, d, "tbox_classes").select("class", "parents"))
    rows = rows.select(strip_name("class").alias("node"), "parents").where("node is not null")
    links = rows.select("node", F.explode("parents").alias("parent")).select("node", strip_name("parent").alias("parent"))
    return rows.select("node"), links.dropna()


def _class_hierarchy(spark: SparkSession, d: str, paths: bool) -> Hierarchy:
    return hierarchy(*_class_links(spark, d), paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Roots and depths of every class; classes caught in cycles or without a root have root '' and depth -1."""
    h = _class_hierarchy(spark, d, paths=False)
    rows = h.roots.select(F.col("node").alias("class"), "root", "depth")
    bad = h.trapped.select(F.col("node").alias("class"), F.lit("").alias("root"), F.lit(-1).alias("depth"))
    return rows.unionByName(bad)


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path from each root that a class reaches."""
    return named_paths(_class_hierarchy(spark, d, paths=True)).withColumnRenamed("node", "class")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every class with each of its descendants and the smallest number of steps; a class on a cycle is its own."""
    nodes, links = _class_links(spark, d)
    have = nodes.distinct()
    edges = links.distinct().join(have.select(F.col("node").alias("parent")), "parent", "left_semi")
    return closure(edges.select(F.col("parent").alias("src"), F.col("node").alias("dst"))).select(F.col("src").alias("class"), F.col("dst").alias("descendant"), F.col("steps").cast("int").alias("depth"))


def p4_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """The number of distinct descendants of every class; a class on a cycle counts itself."""
    nodes, _ = _class_links(spark, d)
    sizes = p4_descendants(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("descendants"))
    rows = nodes.distinct().withColumnRenamed("node", "class").join(sizes, "class", "left")
    return rows.select("class", F.coalesce("descendants", F.lit(0)).alias("descendants"))


# ---------------------------------------------------------------- problem 6

def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    abox = table(spark, d, "abox")
    rows = abox.where("type in ('ObjectPropertyAssertion', 'ClassAssertion')").select(
        "assertion_id", "asserted_at", F.explode(F.when(
            F.col("type") == "ClassAssertion", F.array(F.struct(F.lit("individual").alias("ref_field"), F.col("individual").alias("name"))),
        ).otherwise(F.array(
            F.struct(F.lit("subject").alias("ref_field"), F.col("subject").alias("name")),
            F.struct(F.lit("object").alias("ref_field"), F.col("object").alias("name")),
        ))).alias("r"))
    refs = rows.select("assertion_id", F.col("r.ref_field"), strip_name("r.name").alias("name"), F.col("asserted_at").alias("at"), F.date_format("asserted_at", "yyyy-MM").alias("period"))
    born = abox.where("type = 'DeclareIndividual'").select(strip_name("id").alias("name"), F.col("asserted_at").alias("at"), F.lit(False).alias("ends"))
    gone = table(spark, d, "pruned").where("type = 'DeclareIndividual'").select(strip_name("id").alias("name"), F.col("pruned_at").alias("at"), F.lit(True).alias("ends"))
    return refs, born.unionByName(gone)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References to individuals that are not declared at the time of the statement."""
    return orphan_references(*_references(spark, d)).select("assertion_id", "ref_field", "period").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and missing names by field and month."""
    return orphan_counts(*_references(spark, d), ["ref_field", "period"], ["assertion_id", "ref_field"])


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_logs, p2_question_types, p2_entries, p2_candidates, p2_answers, p2_contexts, p2_properties, p4_found, p4_paths, p4_descendants, p4_subtrees, p6_found, p6_report)}


# ---------------------------------------------------------------- SQL

#: White space as Unicode has it, for RE2.
WS = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_name(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g'), '')"


_P2 = r"""
WITH raw AS (SELECT DISTINCT log_id, trim(ltrim(trim(payload, e' \n\r\t'), chr(65279)), e' \n\r\t') p FROM inference_logs WHERE log_id IS NOT NULL),
a AS (SELECT log_id, p::JSON j FROM raw WHERE json_valid(p)),
b AS (SELECT log_id, CASE WHEN json_type(j) = 'VARCHAR' THEN (CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END) ELSE j END j FROM a),
c AS (SELECT log_id, CASE WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN j->0 ELSE j END j FROM b),
logs AS (SELECT DISTINCT ON (log_id) log_id, j FROM c WHERE json_type(j) = 'OBJECT'),
q AS (SELECT log_id, CASE WHEN json_type(j->'resolved_question_type') = 'ARRAY' THEN (j->'resolved_question_type')::JSON[] ELSE [j->'resolved_question_type'] END l FROM logs),
e AS (SELECT log_id, CASE WHEN json_type(j->'resolve_entity_candidates') = 'ARRAY' THEN (j->'resolve_entity_candidates')::JSON[] ELSE [j->'resolve_entity_candidates'] END l FROM logs),
qt AS (SELECT log_id, g - 1 pos, l[g] n FROM q, LATERAL (SELECT unnest(range(1, len(l) + 1)) g) WHERE json_type(l[g]) IN ('OBJECT', 'VARCHAR')),
en AS (SELECT log_id, g - 1 pos, l[g] n FROM e, LATERAL (SELECT unnest(range(1, len(l) + 1)) g) WHERE json_type(l[g]) = 'OBJECT'),
el AS (SELECT log_id, pos, CASE WHEN json_type(n->'candidates') = 'ARRAY' THEN (n->'candidates')::JSON[] ELSE [n->'candidates'] END l FROM en),
ca AS (SELECT log_id, pos epos, g - 1 pos, l[g] n FROM el, LATERAL (SELECT unnest(range(1, len(l) + 1)) g) WHERE json_type(l[g]) = 'OBJECT')
"""

_P2_PARTS = _P2 + """,
gl AS (SELECT log_id, CASE WHEN json_type(j->'generated_answer') = 'ARRAY' THEN (j->'generated_answer')::JSON[] ELSE [j->'generated_answer'] END l,
 CASE WHEN json_type(j->'full_context') = 'ARRAY' THEN (j->'full_context')::JSON[] ELSE [j->'full_context'] END fl FROM logs),
ga AS (SELECT log_id, g - 1 pos, l[g] n FROM gl, LATERAL (SELECT unnest(range(1, len(l) + 1)) g) WHERE json_type(l[g]) IN ('OBJECT', 'VARCHAR')),
fc AS (SELECT log_id, g - 1 fpos, CASE WHEN json_type(fl[g]->'entity_context') = 'ARRAY' THEN (fl[g]->'entity_context')::JSON[] ELSE [fl[g]->'entity_context'] END l FROM gl, LATERAL (SELECT unnest(range(1, len(fl) + 1)) g) WHERE json_type(fl[g]) = 'OBJECT'),
cx AS (SELECT log_id, log_id || '/context:' || fpos || '/entity_context:' || (g - 1) k, l[g] n FROM fc, LATERAL (SELECT unnest(range(1, len(l) + 1)) g) WHERE json_type(l[g]) = 'OBJECT'),
tk AS (SELECT k, n->'properties_by_type' m, json_keys(n->'properties_by_type') ks FROM cx WHERE json_type(n->'properties_by_type') = 'OBJECT'),
ty AS (SELECT k, i, ks[i] t, json_extract(m, '$."' || ks[i] || '"') n FROM tk, LATERAL (SELECT unnest(range(1, len(ks) + 1)) i) WHERE json_type(json_extract(m, '$."' || ks[i] || '"')) = 'OBJECT')
"""

_EVENTS = f"""
WITH d AS (SELECT {sql_name('id')} n, asserted_at t FROM abox WHERE type = 'DeclareIndividual'),
p AS (SELECT {sql_name('id')} n, pruned_at t FROM pruned WHERE type = 'DeclareIndividual'),
r0 AS (SELECT assertion_id, 'subject' ref_field, {sql_name('subject')} n, asserted_at t FROM abox WHERE type = 'ObjectPropertyAssertion'
 UNION ALL SELECT assertion_id, 'object', {sql_name('object')}, asserted_at FROM abox WHERE type = 'ObjectPropertyAssertion'
 UNION ALL SELECT assertion_id, 'individual', {sql_name('individual')}, asserted_at FROM abox WHERE type = 'ClassAssertion'),
r AS (SELECT DISTINCT * FROM r0 WHERE n IS NOT NULL AND t IS NOT NULL),
born AS (SELECT r.assertion_id, r.ref_field, max(d.t) m FROM r JOIN d ON d.n = r.n AND d.t <= r.t GROUP BY ALL),
gone AS (SELECT r.assertion_id, r.ref_field, max(p.t) m FROM r JOIN p ON p.n = r.n AND p.t <= r.t GROUP BY ALL),
o AS (SELECT r.assertion_id, r.ref_field, strftime(r.t, '%Y-%m') period, r.n FROM r
 LEFT JOIN born b ON b.assertion_id = r.assertion_id AND b.ref_field = r.ref_field
 LEFT JOIN gone g ON g.assertion_id = r.assertion_id AND g.ref_field = r.ref_field
 WHERE b.m IS NULL OR g.m >= b.m)
"""

_LINKS = f"""
rows AS (SELECT {sql_name('class')} c, parents FROM base_classes UNION ALL SELECT {sql_name('class')}, parents FROM tbox_classes),
n AS (SELECT DISTINCT c FROM rows WHERE c IS NOT NULL),
l0 AS (SELECT DISTINCT c, {sql_name('p')} p FROM (SELECT c, unnest(parents) p FROM rows WHERE c IS NOT NULL)),
l AS (SELECT c, p FROM l0 WHERE p IN (SELECT c FROM n))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + """SELECT log_id, 'candidate' node, epos::INT entry_pos, pos::INT candidate_pos FROM ca
 UNION ALL SELECT log_id, 'reasoning', pos::INT, -1 FROM qt WHERE coalesce(CASE WHEN json_type(n) = 'VARCHAR' THEN n->>'$' ELSE n->>'reasoning' END, '') <> ''""",
        "p2_logs": _P2 + "SELECT log_id, j->>'input' AS input, j->>'error' AS error FROM logs",
        "p2_question_types": _P2 + """SELECT log_id || '/question_type:' || pos question_type_key, log_id, pos::INT pos,
 CASE WHEN json_type(n) = 'VARCHAR' THEN n->>'$' ELSE n->>'reasoning' END reasoning, CASE WHEN json_type(n) = 'OBJECT' THEN n->>'question_type' END question_type FROM qt""",
        "p2_entries": _P2 + "SELECT log_id || '/entry:' || pos entry_key, log_id, pos::INT pos, n->>'type' \"type\", n->>'entity' entity FROM en",
        "p2_candidates": _P2 + """SELECT log_id || '/entry:' || epos || '/candidate:' || pos candidate_key, log_id || '/entry:' || epos entry_key, pos::INT pos,
 n->>'label' AS label, try_cast(replace(n->>'score', ',', '.') AS DOUBLE) score, n->>'uri' uri FROM ca""",
        "p2_answers": _P2_PARTS + """SELECT log_id || '/answer:' || pos answer_key, log_id, pos::INT pos, CASE WHEN json_type(n) = 'OBJECT' THEN n->>'reasoning' END reasoning,
 CASE WHEN json_type(n) = 'VARCHAR' THEN n->>'$' ELSE n->>'answer' END answer FROM ga""",
        "p2_contexts": _P2_PARTS + """SELECT k context_key, log_id, n->>'uri' uri, CASE json_type(n->'types') WHEN 'ARRAY' THEN len(list_filter((n->'types')::JSON[], lambda x: json_type(x) IN ('VARCHAR', 'OBJECT'))) WHEN 'VARCHAR' THEN 1 WHEN 'OBJECT' THEN 1 ELSE 0 END n_types,
 CASE json_type(n->'members') WHEN 'ARRAY' THEN len(list_filter((n->'members')::JSON[], lambda x: json_type(x) IN ('VARCHAR', 'OBJECT'))) WHEN 'VARCHAR' THEN 1 WHEN 'OBJECT' THEN 1 ELSE 0 END n_members,
 (SELECT count(*) FROM ty WHERE ty.k = cx.k) n_typed FROM cx""",
        "p2_properties": _P2_PARTS + ", " + ", ".join(f"""s{i} AS (SELECT k || '/entity_context_by_type:' || (i - 1) tk, t, '{side}' side, '{field}' f, CASE json_type(n->'{side}') WHEN 'ARRAY' THEN (n->'{side}')::JSON[] ELSE [n->'{side}'] END l FROM ty)""" for i, (side, field) in enumerate(_SIDES))
        + " " + " UNION ALL ".join(f"SELECT tk typed_key, t AS \"type\", side, (g - 1)::INT pos, l[g]->>'property' property, l[g]->>'{field}' AS \"value\" FROM s{i}, LATERAL (SELECT unnest(range(1, len(l) + 1)) g) WHERE json_type(l[g]) = 'OBJECT'" for i, (side, field) in enumerate(_SIDES)),
        "p4_found": f"""WITH RECURSIVE {_LINKS},
 up AS (SELECT c node, c root, 0 depth FROM n WHERE c NOT IN (SELECT c FROM l) UNION SELECT l.c, up.root, up.depth + 1 FROM up JOIN l ON l.p = up.node WHERE up.depth < (SELECT count(*) FROM n)),
 best AS (SELECT node, root, min(depth) depth FROM up GROUP BY ALL),
 anc AS (SELECT c, p FROM l UNION SELECT anc.c, l.p FROM anc JOIN l ON l.c = anc.p)
 SELECT node "class", root, depth::INT depth FROM best
 UNION ALL SELECT c, '', -1 FROM n WHERE c IN (SELECT c FROM anc WHERE c = p) OR c NOT IN (SELECT node FROM best)""",
        "p4_paths": f"""WITH RECURSIVE {_LINKS},
 up AS (SELECT c node, c root, [c] path FROM n WHERE c NOT IN (SELECT c FROM l)
  UNION ALL SELECT l.c, up.root, list_append(up.path, l.c) FROM up JOIN l ON l.p = up.node WHERE NOT list_contains(up.path, l.c)),
 best AS (SELECT node, root, min({{'k': len(path), 'p': path}}) b FROM up GROUP BY ALL)
 SELECT node "class", root, (b.k - 1)::INT depth, array_to_string(b.p, ' > ') path FROM best""",
        "p4_descendants": f"""WITH RECURSIVE {_LINKS},
 down AS (SELECT p src, c dst, 1 steps FROM l UNION SELECT down.src, l.c, down.steps + 1 FROM down JOIN l ON l.p = down.dst WHERE down.steps < (SELECT count(*) FROM n))
 SELECT src "class", dst descendant, min(steps)::INT depth FROM down GROUP BY ALL""",
        "p4_subtrees": f"""WITH RECURSIVE {_LINKS}, anc AS (SELECT c, p FROM l UNION SELECT anc.c, l.p FROM anc JOIN l ON l.c = anc.p)
 SELECT n.c "class", count(anc.c) descendants FROM n LEFT JOIN anc ON anc.p = n.c GROUP BY n.c""",
        "p6_found": _EVENTS + "SELECT DISTINCT assertion_id, ref_field, period FROM o",
        "p6_report": _EVENTS + "SELECT ref_field, period, count(*) orphans, count(DISTINCT n) missing_names FROM o GROUP BY ALL",
    }
