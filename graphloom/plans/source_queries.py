"""Queries through readers and writers, page functions, labels and small operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, scratch_path, table
from ..functions import markdown as md
from ..functions import show
from ..functions import text as fx
from ..model import Rules, predict
from ..operators import evaluate as ev
from ..operators import questions as qs
from ..operators import retrieve as rt
from ..operators import triples as tr
from ..sources import files
from . import kb_queries as kb
from .dealt import _P2, p2_logs
from .gold import described_properties
from .preprocess import clean_pages
from .text_queries import _L, _case, _chunks, _logs


# ---------------------------------------------------------------- readers and writers

def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read back, without those of one language, which count as done."""
    c = _chunks(spark, d)
    path = scratch_path(spark, "chunks")
    c.select(*[x for x in files.CHUNK.names if x in c.columns]).write.json(path)
    rows = files.read_chunks(spark, path, skip=c.where("language = 'da'").select("chunk_id"))
    return rows.select("chunk_id", "page_title", "token_count", F.col("section.section_title").alias("section_title"), F.size("section.group_titles").alias("titles"))


def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as JSON lines and read as a corpus for retrieval."""
    path = scratch_path(spark, "texts")
    table(spark, d, "documents").select("text").write.json(path)
    return files.read_texts(spark, path)


def source_pending(spark: SparkSession, d: str) -> DataFrame:
    """Logs still to do: those that the appended results of the readable ones do not name."""
    path = scratch_path(spark, "results")
    files.write_logs(p2_logs(spark, d), path, "run-1")
    done = spark.read.schema("log_id string, input string, run_id string").json(path)
    return files.pending(table(spark, d, "inference_logs").select("log_id").distinct(), done, ["log_id"])


def source_records(spark: SparkSession, d: str) -> DataFrame:
    """Report rows appended as records, read back with their schema; nested maps included."""
    path = scratch_path(spark, "records")
    r = table(spark, d, "report").dropDuplicates(["run_id"])
    half = F.col("chunks_total").isNull()
    for rows in (r.where(half), r.where(~half)):
        files.append_records(rows.select("run_id", "content_root", "pages_total", "languages"), path)
    back = spark.read.schema("run_id string, content_root string, pages_total int, languages map<string,int>").json(path)
    return back.select("run_id", "content_root", "pages_total", F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("languages"))


def source_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The counts that the writer of an ontology notes beside it."""
    path = scratch_path(spark, "ontology")
    files.write_ontology({"classes": table(spark, d, "tbox_classes"), "axioms": table(spark, d, "tbox_axioms"), "abox": table(spark, d, "abox"), "pruned": table(spark, d, "pruned")}, path, {"model": "none"})
    return spark.read.json(f"{path}/metadata").select("num_classes", "num_axioms", "num_abox", "num_pruned")


# ---------------------------------------------------------------- pages

def _page(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", F.coalesce("page_title", F.lit("")).alias("t"), F.coalesce("language", F.lit("")).alias("lang"), F.coalesce("source_path", F.lit("")).alias("path"))


def page_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Front matter of pages made of each chunk's title: texts, numbers, lists and the body below."""
    raw = F.concat(F.lit("---\nold: 1\ntitle: '"), F.col("t"), F.lit("'\nn: 0042\ndraft: TRUE\ntags: [x, \"y z\"]\nold: 2\n---\n# "), F.col("t"))
    meta, body = md.front_matter(raw)
    p = _page(spark, d).select("chunk_id", meta.alias("m"), body.alias("body"))
    return p.select("chunk_id", F.col("m.title").alias("title"), F.col("m.n").alias("n"), F.col("m.draft").alias("draft"), F.col("m.tags").alias("tags"), F.col("m.old").alias("old"), "body")


def page_shortcodes(spark: SparkSession, d: str) -> DataFrame:
    """Nested and single shortcodes around each chunk's title."""
    text = F.concat(F.lit("{{< lead >}}{{< alert >}}"), F.col("t"), F.lit("{{< /alert >}} "), F.col("t"), F.lit('{{< /lead >}}\n{{< img src="a.png" >}}\n{{< code language="sql" >}}\n'), F.col("lang"), F.lit("\n{{< /code >}}"))
    return _page(spark, d).select("chunk_id", md.shortcodes_expanded(text).alias("said"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and relative links as routes from the root of the tree."""
    text = F.concat(F.lit('<a class="b" href="../'), F.col("lang"), F.lit('/index.en.md"><b>up</b></a> [side](x.da.md) [out](https://a/b) [top](/c)'))
    return _page(spark, d).where(F.regexp_like("path", F.lit(r"^[A-Za-z0-9-]+(/[A-Za-z0-9-]+)+/[^/\\]+$"))).select("chunk_id", md.decoded_and_routed(md.without_tags(text), F.col("path")).alias("links"))


def page_clean(spark: SparkSession, d: str) -> DataFrame:
    """Chunks' texts through the whole cleaning of pages: text and flags."""
    raw = _chunks(spark, d).select("chunk_id", F.concat(F.lit("site/"), F.col("chunk_id"), F.lit(".en.md")).alias("source_path"), F.col("chunk_text_clean").alias("raw"))
    p = clean_pages(raw.select("source_path", "raw"))
    return p.select(F.regexp_extract("source_path", r"^site/(.*)\.en\.md$", 1).alias("chunk_id"), "clean_text", F.col("cleaning_flags.boilerplate_removed").alias("noisy"), F.col("cleaning_flags.html_residue").alias("html"))


def show_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the printers say of each context's types, members and question."""
    l = _logs(spark, d)
    said = F.concat_ws("\n", show.list_text("types", F.col("types")), show.list_text("members", F.col("members")))
    return l.select("log_id", said.alias("said"), fx.prompt(F.lit("Answer."), F.coalesce("input", F.lit("-")), "phi").alias("phi"), fx.prompt(F.lit("Answer."), F.coalesce("input", F.lit("-")), "chatml").alias("chatml"))


# ---------------------------------------------------------------- graph

def kb_exists(spark, d):
    """Individuals of which something is the same."""
    t = kb._kept(spark, d)
    return tr.exists(kb._nodes(t, tr.INDIVIDUAL), t, {"uri": "s"}, p=tr.SAME_AS)


def kb_filter_axioms(spark, d):
    """The labels of all nodes and their statements of one data property."""
    t = kb._kept(spark, d)
    a = cut(tr.entity_axioms(t, kb._nodes(t).select(F.col("uri").alias("s"))), "axioms")
    return tr.filter_axioms(a, "HASACCURACY", "DataPropertyAssertion").unionByName(tr.filter_axioms(a, "any", "AnnotationProperty").where(F.col("p") == tr.LABEL)).select("s", "p", "o")


def kb_described(spark, d):
    """The values of each subject's own properties."""
    return described_properties(kb._kept(spark, d)).select("s", "property", F.array_join("vals", "|").alias("vals"))


def context_annotations(spark, d):
    """Annotations of all nodes; of several values that of the last twin holds."""
    return kb._contexts(spark, d, "annotations").select("uri", F.explode("annotations").alias("annotation", "value"))


def entity_profiles(spark, d):
    """Kind, types, superclasses and numbers of properties of all nodes."""
    t = kb._kept(spark, d)
    out = rt.enrich(cut(kb._nodes(t), "nodes"), t)
    return out.select("uri", "entity_type", F.array_join("types", "|").alias("types"), F.array_join("superclasses", "|").alias("superclasses"), F.size("object_properties").alias("n_object"), F.size("data_properties").alias("n_data"), F.size("annotations").alias("n_notes"))


def entity_choice(spark, d):
    """The chosen of the three best names by token scores."""
    c = rt.best_by_tokens(kb._entities(spark, d), rt.entity_labels(kb._kept(spark, d)))
    return rt.choose(cut(c, "ranked")).select("entity", "uri", "status")


# ---------------------------------------------------------------- questions

def question_canonical(spark, d):
    """Labels of logs in their canonical form."""
    rows = _logs(spark, d).select("log_id", "question_type", "answer_form", F.col("entity").alias("object_value"))
    return qs.normalize_labels(rows).select("log_id", "question_type", "answer_form", "relation", "object_value")


def question_categories(spark, d):
    """Categories and tiers as ids of cases tell them."""
    n = F.regexp_extract("log_id", r"(\d+)$", 1).cast("int").cast("string")
    case = F.concat_ws("_", F.coalesce("question_type", F.lit("none")), n)
    return _logs(spark, d).select("log_id", qs.category_of_number(F.concat(F.lit("q"), n)).alias("by_number"), qs.category_of_prefix(case).alias("by_prefix"), qs.tier_of(case).alias("tier"))


def question_rules(spark, d):
    """Type and form that the rules give to each question, without a model."""
    q = _logs(spark, d).where("input is not null").select(F.col("log_id").alias("key"), F.col("input").alias("question"))
    t = predict(q, "question_type", Rules()).select("key", "question", qs.known_type(F.col("result.question_type")).alias("question_type"))
    return predict(cut(t, "types"), "answer_form", Rules()).select("key", "question_type", F.col("result.answer_form").alias("answer_form"), "by")


def eval_paired(spark, d):
    """Two systems' results side by side by question."""
    l = _logs(spark, d)
    return ev.paired(l.select("log_id", "question_type"), l.select("log_id", "answer_form"), "log_id").select("log_id", "question_type", "other_answer_form")


_ALL = (
    source_chunks, source_texts, source_pending, source_records, source_metadata, page_front_matter, page_shortcodes, page_links, page_clean, show_texts, kb_exists, kb_filter_axioms, kb_described,
    context_annotations, entity_profiles, entity_choice, question_canonical, question_categories, question_rules, eval_paired,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# ---------------------------------------------------------------- SQL

def oracle_sql() -> dict[str, str]:
    T, w, read = kb._T, kb._w, kb._READ
    forms = {k: v for k, v in qs.ANSWER_FORMS.items()}
    first = {k: v[0] for k, v in forms.items()}
    form = f"CASE WHEN list_contains(string_split({_case({k: '|'.join(v) for k, v in forms.items()}, 'qt')}, '|'), trim(lower(answer_form))) THEN trim(lower(answer_form)) ELSE {_case(first, 'qt')} END"
    page = r"""WITH p AS (SELECT DISTINCT ON (chunk_id) chunk_id, coalesce(page_title, '') t, coalesce("language", '') lang, coalesce(source_path, '') path FROM chunks)"""
    order = ["definition", "taxonomic", "capability", "property", "membership", "comparative", "quantification"]
    props = f"NOT IN ({kb._TYPE}, {kb._LAB}, {kb._COM}, {kb._SUB}, {kb._DOM}, {kb._RNG}, {kb._EQ}, {kb._SAME}, {kb._CHUNK})"
    own = lambda kind: f"(SELECT count(DISTINCT p) FROM t WHERE t.s = en.uri AND p IN (SELECT s FROM t WHERE p = {kb._TYPE} AND o = {kind}))::INT"
    nl = r"replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    scores = kb.oracle_sql()["entity_token_scores"]
    return {
        "source_chunks": """SELECT DISTINCT ON (chunk_id) chunk_id, page_title, token_count, "section".section_title section_title, coalesce(len("section".group_titles), -1)::INT titles FROM chunks WHERE "language" IS DISTINCT FROM 'da'""",
        "source_texts": "SELECT trim(text) AS text FROM documents WHERE trim(text) <> ''",
        "source_pending": _P2 + "SELECT DISTINCT log_id FROM inference_logs WHERE log_id IS NOT NULL AND log_id NOT IN (SELECT log_id FROM logs)",
        "source_records": """SELECT run_id, content_root, pages_total, (SELECT string_agg(e.key || '=' || e.value, ',' ORDER BY e.key) FROM (SELECT unnest(map_entries(languages)) e)) languages FROM (SELECT DISTINCT ON (run_id) * FROM report)""",
        "source_metadata": "SELECT (SELECT count(*) FROM tbox_classes) num_classes, (SELECT count(*) FROM tbox_axioms) num_axioms, (SELECT count(*) FROM abox) num_abox, (SELECT count(*) FROM pruned) num_pruned",
        "page_front_matter": page + """ SELECT chunk_id, trim(t) title, '42' n, 'true' draft, '["x","y z"]' tags, '2' "old", '# ' || t body FROM p""",
        "page_shortcodes": page + """, q AS (SELECT chunk_id, lang, regexp_replace(trim(t), '[ \t]+', ' ', 'g') a, regexp_replace(t, '[ \t]+', ' ', 'g') b FROM p)
 SELECT chunk_id, trim('Lead: ' || trim(CASE WHEN a = '' THEN '' ELSE 'Warning: ' || a END || ' ' || trim(b))) || chr(10) || 'Image source: a.png' || chr(10) || 'Code example (sql)' || CASE WHEN lang = '' THEN '' ELSE chr(10) || '```sql' || chr(10) || lang || chr(10) || '```' END said FROM q""",
        "page_links": page + r""" SELECT chunk_id, '[up](/' || regexp_replace(path, '/[^/]*/[^/]*$', '') || '/' || lang || ') [side](/' || regexp_replace(path, '/[^/]*$', '') || '/x) [out](https://a/b) [top](/c)' links FROM p WHERE regexp_full_match(path, '[A-Za-z0-9-]+(/[A-Za-z0-9-]+)+/[^/\\]+')""",
        "page_clean": rf"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, regexp_replace(regexp_replace(regexp_replace(coalesce(chunk_text_clean, ''), '\{{\{{<[^>"]*>\}}\}}', '', 'g'), '<br ?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') x FROM chunks),
 n AS (SELECT chunk_id, regexp_replace({nl.format('x')}, '(?m)^[ \t]*(\d+)[\.)][ \t]+(.*?)[ \t]*$', '\1. \2', 'g') x FROM c),
 l AS (SELECT chunk_id, i, CASE WHEN trim(s[i]) = '' THEN '' ELSE nullif(trim(regexp_replace(regexp_replace(s[i], '(?i)We are currently updating our support articles and some info may be outdated\.?|Read release notes here\.?', '', 'g'), '[ \t\n\x0b\f\r]{{2,}}', ' ', 'g'), ' .:-'), '') END y
  FROM (SELECT chunk_id, s, unnest(range(1, len(s) + 1)) i FROM (SELECT chunk_id, string_split(x, chr(10)) s FROM n))),
 j AS (SELECT chunk_id, coalesce(string_agg(y, chr(10) ORDER BY i), '') y FROM l GROUP BY chunk_id),
 z AS (SELECT chunk_id, trim(regexp_replace(regexp_replace(regexp_replace(y, '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{{3,}}', e'\n\n', 'g'), e'\n ') clean_text FROM j)
 SELECT chunk_id, clean_text, regexp_matches(x, '(?i)We are currently updating our support articles and some info may be outdated\.?|Read release notes here\.?') noisy, regexp_matches(clean_text, '<[^>]+>') html FROM z JOIN n USING (chunk_id)""",
        "show_texts": _L + """SELECT log_id, concat_ws(chr(10), CASE WHEN len(types) > 0 THEN 'types: ' || array_to_string(types, ', ') END, CASE WHEN json_type(ec->'members') = 'ARRAY' AND json_array_length(ec->'members') > 0 THEN 'members: ' || array_to_string((ec->'members')::VARCHAR[], ', ') END) said,
 '<|system|>' || chr(10) || 'Answer.<|end|>' || chr(10) || '<|user|>' || chr(10) || coalesce(input, '-') || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) phi,
 '<|im_start|>system' || chr(10) || 'Answer.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(input, '-') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) chatml FROM lx""",
        "kb_exists": w(T) + f"SELECT DISTINCT s uri FROM t WHERE p = {kb._TYPE} AND o = {kb._IND} AND s IN (SELECT s FROM t WHERE p = {kb._SAME})",
        "kb_filter_axioms": w(T, kb._NODES) + f"""SELECT DISTINCT s, p, o FROM t WHERE s IN (SELECT uri FROM en) AND (p = {kb._LAB} OR (lower(split_part(p, '#', -1)) = 'hasaccuracy' AND p IN (SELECT s FROM t WHERE p = {kb._TYPE} AND o = {kb._DP})))""",
        "kb_described": w(T) + f"SELECT s, {read('p')} property, string_agg(DISTINCT CASE WHEN o_kind = 'iri' THEN {read('o')} ELSE o END, '|' ORDER BY CASE WHEN o_kind = 'iri' THEN {read('o')} ELSE o END) vals FROM t WHERE p {props} GROUP BY s, p",
        "context_annotations": w(T, kb._NODES, kb._SAMESET, recursive=True) + f"SELECT uri, {read('p')} annotation, arg_max(o, {{'a': twin, 'b': o}}) AS \"value\" FROM tw JOIN t ON t.s = tw.twin WHERE p IN ({kb._LAB}, {kb._COM}) GROUP BY uri, p",
        "entity_profiles": w(T, kb._NODES) + f"""SELECT uri, CASE WHEN EXISTS (SELECT 1 FROM t WHERE s = uri AND p = {kb._TYPE} AND o = {kb._CLS}) THEN 'Class' ELSE 'NamedIndividual' END entity_type,
 coalesce((SELECT string_agg(DISTINCT {read('o')}, '|' ORDER BY {read('o')}) FROM t WHERE s = uri AND p = {kb._TYPE} AND o NOT IN ({kb._CLS}, {kb._IND})), '') types,
 coalesce((SELECT string_agg(DISTINCT {read('o')}, '|' ORDER BY {read('o')}) FROM t WHERE s = uri AND p = {kb._SUB}), '') superclasses,
 {own(kb._OP)} n_object, {own(kb._DP)} n_data, (SELECT count(DISTINCT p) FROM t WHERE s = uri AND p IN ({kb._LAB}, {kb._COM}))::INT n_notes FROM en""",
        "entity_choice": f"""WITH q AS ({scores}), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, uri) k FROM q), b AS (SELECT entity, least(count(*), 3) n, max(score) m FROM q GROUP BY entity)
 SELECT r.entity, uri, CASE WHEN n = 1 OR m = 1 THEN 'sure' ELSE 'first of several' END status FROM r JOIN b ON b.entity = r.entity WHERE k = 1""",
        "question_canonical": _L + f"""SELECT log_id, qt question_type, {form} answer_form, {_case(qs.RELATIONS, 'qt')} relation,
 CASE WHEN NOT (qt IN ('definition', 'unknown', 'quantification') OR {form} = 'list' OR (qt = 'capability' AND {form} = 'value')) THEN entity END object_value FROM lx""",
        "question_categories": _L + f"""SELECT log_id, CASE WHEN n BETWEEN 1 AND 49 THEN [{', '.join(f"'{x}'" for x in order)}][(n - 1) // 7 + 1] END by_number,
 CASE WHEN question_type IN ({', '.join(f"'{x}'" for x in qs.CONTEXT_FIELDS)}) THEN question_type END by_prefix, CASE n WHEN 1 THEN 'canonical' WHEN 2 THEN 'paraphrased' WHEN 3 THEN 'typo' ELSE 'unknown' END tier FROM lx""",
        "question_rules": _L + rf""", g AS (SELECT log_id, trim(lower(input)) s FROM lx WHERE input IS NOT NULL),
 k AS (SELECT log_id, CASE WHEN regexp_matches(s, '^(how many|how much|count|number of)') THEN 'quantification' WHEN regexp_matches(s, '^compare|\b(difference between|more .* than|fewer .* than|versus|vs\.?)\b') THEN 'comparative'
  WHEN regexp_matches(s, '^(which|what|list|name)\b.*\b(members?|instances?|examples?)\b') THEN 'membership' WHEN regexp_matches(s, '\b(kinds?|types?|subtypes?|subclass(es)?|superclass(es)?) of\b|^is .* an? ') THEN 'taxonomic'
  WHEN regexp_matches(s, '^(can|could|is .* able|does .* (support|allow))\b') THEN 'capability' WHEN regexp_matches(s, '^(what (is|are)|define|who is)\b') AND NOT regexp_matches(s, '\b(of|for)\b') THEN 'definition'
  WHEN regexp_matches(s, '^(what|which|where|when|who|does|do|has|have)\b') THEN 'property' ELSE 'unknown' END qt FROM g)
 SELECT log_id "key", qt question_type, {_case(first, 'qt')} answer_form, CASE WHEN {_case({k: str(len(v)) for k, v in forms.items()}, 'qt')} = '1' THEN 'rule' ELSE 'model' END AS "by" FROM k""",
        "eval_paired": _L + "SELECT log_id, question_type, answer_form other_answer_form FROM lx",
    }
