"""Queries on texts, pages, questions, grounding and evaluation, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut, table
from ..functions import text as fx
from ..model import Rules
from ..operators import evaluate as ev
from ..operators import ground as gr
from ..operators import questions as qs
from ..operators.nested import read_record
from .answer import parse_questions
from .dealt import _P2, _P2_PARTS, _SIDES
from .preprocess import chunk_pages, clean_pages


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def text_keys(spark, d):
    """Normal forms of page titles."""
    t = _chunks(spark, d).select("chunk_id", F.col("page_title").alias("t"))
    return t.select("chunk_id", fx.entity_key("t").alias("entity_key"), fx.name_key("t", True).alias("name_key"), F.array_join(fx.letter_tokens("t"), " ").alias("tokens"), fx.squash("t").alias("squashed"), fx.grader_key("t").alias("grader"))


def uri_roundtrip(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    e = fx.uri_fragment(F.concat_ws(" ", "source", "text"))
    return t.select("doc_id", e.alias("encoded"), fx.uri_decode(e).alias("decoded"))


def token_counts(spark, d):
    return _chunks(spark, d).select("chunk_id", fx.token_count("chunk_text_clean").alias("tokens"))


def text_ngrams(spark, d):
    """Runs of four words of every document."""
    w = fx.words(fx.squash("text"))
    return table(spark, d, "documents").select("doc_id", F.explode(fx.ngrams(w, 4)).alias("gram")).groupBy("gram").agg(F.countDistinct("doc_id").alias("docs")).where("docs > 1")


def text_tidy(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.tidy_blanks("text").alias("tidy"))


def text_untagged(spark, d):
    return _chunks(spark, d).select("chunk_id", fx.strip_tags("chunk_text_clean").alias("plain"), F.col("quality_flags.has_html_residue").isNotNull().alias("flagged"))


def text_lists(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.list_numbers("text").alias("listed"))


def text_noise(spark, d):
    """Texts with a notice on top, cleaned of it."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Read release notes here.\n"), F.col("text")).alias("t"))
    return t.select("doc_id", fx.has_noise("t").alias("noisy"), fx.drop_noise("t").alias("clean"))


def text_blocks(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(fx.blocks("text")).alias("block_no", "block"))


def text_cut_words(spark, d):
    """Blocks above 40 words in pieces of 40."""
    b = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(fx.blocks("text")).alias("block_no", "block")).where(fx.token_count("block") > 40)
    return b.select("doc_id", "block_no", F.posexplode(fx.cut_words("block", 40)).alias("piece_no", "piece"))


def text_sections(spark, d):
    """A heading owns the lines below it: number, level, title and lines of each section."""
    l = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("level", fx.heading_level("line"))
    sec = F.count("level").over(W.partitionBy("doc_id").orderBy("n"))
    l = l.withColumn("section", sec)
    return l.groupBy("doc_id", "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), fx.heading_title("line"))).alias("title"), F.count(F.lit(1)).alias("lines"))


def text_residue(spark, d):
    return _chunks(spark, d).select("chunk_id", F.inline(F.array(fx.residue_flags("chunk_text_clean"))))


def page_attributes(spark, d):
    p = _chunks(spark, d).select("source_path").distinct()
    return p.select("source_path", fx.page_language("source_path").alias("language"), fx.page_kind("source_path").alias("kind"), fx.page_type("source_path").alias("type"), fx.page_id("source_path").alias("page_id"), fx.page_slug("source_path").alias("slug"), fx.section_path("source_path").alias("section"))


def page_report(spark, d):
    """Pages by language and page type, with totals of both, and pages with residue."""
    c = _chunks(spark, d).groupBy("page_id", "language", "page_type").agg(F.max(fx.residue_flags("chunk_text_clean").getField("has_html_residue")).alias("html"), F.count(F.lit(1)).alias("chunks"))
    out = c.groupingSets([[F.col("language")], [F.col("page_type")], []], "language", "page_type").agg(F.count(F.lit(1)).alias("pages"), F.sum("chunks").alias("chunks"), F.count_if("html").alias("html_pages"))
    return out.select(F.coalesce("language", F.lit("(all)")).alias("language"), F.coalesce("page_type", F.lit("(all)")).alias("page_type"), "pages", "chunks", "html_pages")


def chunk_neighbours(spark, d):
    """Section titles before and after each chunk's group on its page."""
    g = _chunks(spark, d).select("page_id", F.col("section.group_start_index").alias("start"), F.col("section.section_title").alias("title")).groupBy("page_id", "start").agg(F.min("title").alias("title"))
    w = W.partitionBy("page_id").orderBy("start")
    return g.select("page_id", "start", "title", F.lag("title").over(w).alias("prev_title"), F.lead("title").over(w).alias("next_title"), (F.row_number().over(w) - 1).alias("group_no"))


def chunk_parts(spark, d):
    """Running chunk number per page, number of the part and of all parts of its group."""
    c = _chunks(spark, d).select("page_id", "chunk_id", "chunk_index", F.col("section.group_start_index").alias("start"))
    page, grp = W.partitionBy("page_id").orderBy("chunk_index", "chunk_id"), W.partitionBy("page_id", "start")
    return c.select("chunk_id", (F.row_number().over(page) - 1).alias("running"), F.row_number().over(grp.orderBy("chunk_index", "chunk_id")).alias("part"), F.count(F.lit(1)).over(grp).alias("parts"))


def chunk_documents(spark, d):
    """Documents as pages through cleaning, sectioning, grouping and packing at 60 tokens."""
    raw = table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/support/"), F.col("doc_id").cast("string"), F.lit(".en.md")).alias("source_path"), F.col("text").alias("raw"))
    pages = cut(clean_pages(raw), "pages")
    return chunk_pages(pages, 60).select("chunk_id", "page_type", "token_count", "chunk_text_clean", F.col("section.part_total").alias("part_total"))


# ---------------------------------------------------------------- questions

_LOG = "input string, question_type string, answer_form string, answer string, reasoning string, entity string, types array<string>, superclasses array<string>, members array<string>, text string, entity_context string, object_context string"


def _object(x: object) -> dict:
    """An object as it is, of a list the first object in it, else an empty one."""
    return next((v for v in (x if isinstance(x, list) else [x]) if isinstance(v, dict)), {})


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """``(log_id, ...)``: the parts of each readable log that questions and grounding need."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for k, p in zip(b["log_id"], b["payload"]):
                r = read_record(p)
                if r is None or k is None:
                    continue
                obj = lambda n: _object(r.get(n))  # noqa: E731,B023
                ent, other = (_object(obj("full_context").get(n)) for n in ("entity_context", "object_context"))
                sup = [x for v in (ent.get("superclasses") or {}).values() for x in v]
                ans = obj("generated_answer")
                rows.append((k, r.get("input"), obj("resolved_question_type").get("question_type"), obj("resolved_answer_form").get("answer_form"), ans.get("answer"), ans.get("reasoning"), obj("extracted_entity").get("primary_entity"), ent.get("types"), sup, ent.get("members"), p, *(json.dumps(c) if c else None for c in (ent, other))))
            yield pd.DataFrame(rows, columns=["log_id", *[c.split()[0] for c in _LOG.split(", ")]])

    rows = table(spark, d, "inference_logs").select("log_id", "payload").mapInPandas(run, f"log_id string, {_LOG}")
    return cut(rows.dropDuplicates(["log_id"]), "logs")


def question_labels(spark, d):
    """Canonical relation, allowed and given forms, axiom kind, base property and null objects."""
    q = _logs(spark, d).select("log_id", qs.known_type(F.col("question_type")).alias("qt"), F.col("answer_form").alias("af"))
    r = qs.relation_of(F.col("qt"))
    return q.select("log_id", "qt", r.alias("relation"), F.array_join(qs.allowed_forms(F.col("qt")), "|").alias("forms"), qs.known_form(F.col("qt"), F.col("af")).alias("form"), qs.form_is_given(F.col("qt")).alias("given"),
                    qs.axiom_kind(r).alias("kind"), qs.base_property(r).alias("base"), qs.object_is_null(F.col("qt"), qs.known_form(F.col("qt"), F.col("af"))).alias("no_object"))


def question_abstentions(spark, d):
    return _logs(spark, d).select("log_id", qs.abstains(F.col("answer")).alias("abstains"))


def question_parse(spark, d):
    """Questions through the five parsing stages with deterministic rules."""
    q = _logs(spark, d).select(F.col("log_id").alias("key"), F.col("input").alias("question")).where("question is not null")
    return parse_questions(q, Rules()).select("key", "question_type", "answer_form", "entity", "relation", "object", "status")


def json_repair(spark, d):
    """Payloads that can be read as they are, after repair, or not at all."""
    p = table(spark, d, "inference_logs").select("log_id", F.trim("payload").alias("p")).distinct()
    whole = F.try_parse_json("p").isNotNull()
    return p.select(F.when(F.col("p").isNull() | (F.col("p") == ""), "empty").when(whole, "whole").when(fx.repaired_json("p").isNotNull(), "repaired").otherwise("lost").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def template_fill(spark, d):
    """Chained replacements in order, the second on the result of the first."""
    q = _logs(spark, d).select("log_id", "input")
    pairs = F.array(F.struct(F.lit("study").alias("old"), F.lit("clinic").alias("new")), F.struct(F.lit("clinic").alias("old"), F.lit("ward").alias("new")))
    return q.select("log_id", fx.replace_in_order("input", pairs).alias("filled"))


def sample_questions(spark, d):
    """The first three questions of each type."""
    return qs.sample_per_group(_logs(spark, d).where("question_type is not null").select("log_id", "question_type"), ["question_type"], ["log_id"], 3)


# ---------------------------------------------------------------- grounding

def ground_exact(spark, d):
    """Types and superclasses of the fetched context that the question names."""
    l = _logs(spark, d).where("input is not null and types is not null")
    return l.select("log_id", F.array_join(gr.exact_mentions(l, "input", "types"), "|").alias("types"), F.array_join(gr.exact_mentions(l, "input", "superclasses"), "|").alias("superclasses"))


def ground_answers(spark, d):
    """Answers and reasonings mapped to the whole contexts of their logs, merged; first those of the entity, then
    those of the object, which is named by its label or URI."""
    l = _logs(spark, d)
    of = lambda k: F.get_json_object("object_context", f"$.{k}")
    other = l.withColumn("entity", F.coalesce(of("label"), fx.readable(of("uri"))))
    return _grounded(l, "entity_context").unionByName(_grounded(other, "object_context"))


def ground_spoken(spark, d):
    """Answers that speak of all that their context states, mapped back to it: nothing is lost on the way."""
    l = _logs(spark, d).where("entity_context is not null")
    side = "array<struct<property:string,object:string,value:string,subject:string>>"
    typed = "map<string,struct<" + ",".join(f"{x}:{side}" for x in ("outgoing_object_properties", "outgoing_data_properties", "incoming_object_properties")) + ">>"
    rows = F.map_values(F.from_json("entity_context", f"properties_by_type {typed}")["properties_by_type"])
    said = lambda x: F.transform(x, lambda i: F.concat_ws(" ", i["property"], i["object"], i["value"], i["subject"]))
    none = F.array().cast("array<string>")
    facts = F.flatten(F.transform(rows, lambda t: F.concat(*[F.coalesce(said(t[x]), none) for x in ("outgoing_object_properties", "outgoing_data_properties", "incoming_object_properties")])))
    spoken = F.array_join(F.concat(*[F.coalesce(x, none) for x in (F.col("types"), F.col("superclasses"), facts)]), " ; ")
    m = gr.ground(l.select("log_id", spoken.alias("spoken"), "entity_context"), "log_id", "spoken", "entity_context")
    return gr.mapping_triples(m.join(l.select("log_id", "entity"), "log_id"), "log_id", "entity")


def _grounded(logs: DataFrame, context: str) -> DataFrame:
    l = logs.where(F.col(context).isNotNull())
    fields = [*gr.FACETS, "property_values"]
    r = gr.ground(l, "log_id", "reasoning", context).select("log_id", F.struct(*fields).alias("r"))
    a = gr.ground(l, "log_id", "answer", context).select("log_id", F.struct(*fields).alias("a"))
    m = r.join(a, "log_id").select("log_id", *gr.merge_mappings())
    return gr.mapping_triples(m.join(l.select("log_id", "entity"), "log_id"), "log_id", "entity")


# ---------------------------------------------------------------- evaluation

def _checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks that can be read off the logs themselves."""
    l = _logs(spark, d).join(table(spark, d, "inference_logs").select("log_id", "site").distinct(), "log_id")
    c = lambda n, x: F.struct(F.lit(n).alias("name"), F.coalesce(x, F.lit(False)).alias("passed"))
    return l.select("log_id", F.col("site").alias("domain"), F.coalesce("question_type", F.lit("unknown")).alias("tier"), F.array(
        c("has_input", F.col("input").isNotNull()), c("type_known", F.col("question_type").isin(*qs.ANSWER_FORMS)), c("form_allowed", F.array_contains(qs.allowed_forms(F.col("question_type")), F.col("answer_form"))),
        c("entity_found", F.contains("input", F.col("entity")))).alias("checks"))


def eval_pass_rates(spark, d):
    return ev.pass_rates(ev.check_rows(_checks(spark, d), ["domain", "tier"]))


def eval_resolution(spark, d):
    """Rates of resolution of cases with tiers by their number."""
    l = _logs(spark, d)
    n = F.regexp_extract("log_id", r"(\d+)$", 1).cast("int")
    case = F.when(n % 4 == 0, F.concat(F.lit("unresolvable_"), "log_id")).otherwise(F.concat("log_id", F.lit("_"), (n % 4).cast("string")))
    checks = F.array(F.struct(F.lit("resolution_failure").alias("name"), F.col("types").isNull().alias("passed")), F.struct(F.lit("resolution_success").alias("name"), F.col("types").isNotNull().alias("passed")),
                     F.struct(F.lit("correct_resolved_entity").alias("name"), (F.size(F.coalesce("types", F.array())) == 1).alias("passed")))
    return ev.resolution_rates(ev.check_rows(l.select(case.alias("case_id"), checks.alias("checks")), ["case_id"]))


def eval_grounding(spark, d):
    """Category metrics with their precedence, from flags read off the logs."""
    l = _logs(spark, d)
    n = F.regexp_extract("log_id", r"(\d+)$", 1).cast("int")
    on = lambda name, x: F.when(x, F.lit(name))
    passed = F.filter(F.array(on("correct_question_type", n % 2 == 0), on("correct_entity_resolution", n % 3 == 0), on("correct_object_resolution", n % 5 < 3), on("grounding_preferred", n % 7 == 0), on("abstain_expected", n % 4 == 1)), lambda x: x.isNotNull())
    cases = l.select(qs.known_type(F.col("question_type")).alias("category"), (n % 3 != 2).alias("answerable"), passed.alias("passed"), F.col("types").isNotNull().alias("entity_resolved"), (n % 11 != 0).alias("object_resolved"), (n % 2 == 1).alias("entity_subset"), (n % 3 == 1).alias("object_subset"))
    return ev.grounding_metrics(cases)


def _manual(spark, d):
    l = _logs(spark, d)
    n = F.regexp_extract("log_id", r"(\d+)$", 1).cast("int")
    names = F.array(*[F.lit(x) for x in ev.LABELS])
    return l.select(F.when(n % 2 == 0, "graph").otherwise("rag").alias("system"), qs.known_type(F.col("question_type")).alias("category"), F.get(names, n % 7).alias("classification"), F.when(n % 10 == 0, ev.UNANSWERABLE).otherwise("-").alias("gold_answer"))


def eval_labels(spark, d):
    return ev.label_shares(_manual(spark, d))


def eval_pivot(spark, d):
    out = ev.label_pivot(_manual(spark, d))
    return out.select("system", "category", *[F.col(f"`{l}`").alias(f"n{i}") for i, l in enumerate(ev.LABELS)])


def eval_within(spark, d):
    """Whether the classes of each log's context are within those of its superclasses."""
    l = _logs(spark, d).where("types is not null")
    return l.select("log_id", ev.within(ev.flat_tokens([F.col("types")]), ev.flat_tokens([F.col("types"), F.col("superclasses")])).alias("inside"), ev.facets_hold([F.col("types")], [F.col("superclasses")]).alias("held"))


_ALL = (
    text_keys, uri_roundtrip, token_counts, text_ngrams, text_tidy, text_untagged, text_lists, text_noise, text_blocks, text_cut_words, text_sections, text_residue, page_attributes, page_report,
    chunk_neighbours, chunk_parts, chunk_documents, question_labels, question_abstentions, question_parse, json_repair, template_fill, sample_questions, ground_exact, ground_answers, ground_spoken,
    eval_pass_rates, eval_resolution, eval_grounding, eval_labels, eval_pivot, eval_within,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# ---------------------------------------------------------------- SQL

_C = "WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_D = "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_BLK = _D + r""", b0 AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \t]+$', '', 'g'), '\n(?:[ \t]*\n)+'), lambda x: trim(x, e'\n \t')), lambda x: x <> '') l FROM d),
 bl AS (SELECT doc_id, i - 1 block_no, l[i] block FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM b0))"""
_SQL_TYPES = ", ".join(f"'{t}'" for t in qs.ANSWER_FORMS)
def _first(x: str) -> str:
    """An object as it is, of a list the first object in it."""
    return f"CASE json_type({x}) WHEN 'OBJECT' THEN {x} WHEN 'ARRAY' THEN list_filter(({x})::JSON[], lambda v: json_type(v) = 'OBJECT')[1] END"


#: The logs' parts, as _logs gives them.
_L = _P2 + f""", l0 AS (SELECT log_id, j->>'input' input, {_first("j->'resolved_question_type'")} rq, {_first("j->'resolved_answer_form'")} ra, {_first("j->'generated_answer'")} ga, {_first("j->'extracted_entity'")} ee,
  {_first("j->'full_context'")} fc, regexp_extract(log_id, '([0-9]+)$', 1)::INT n FROM logs),
 lg AS (SELECT log_id, input, n, rq->>'question_type' question_type, ra->>'answer_form' answer_form, ga->>'answer' answer, ee->>'primary_entity' entity, {_first("fc->'entity_context'")} ec FROM l0),
 lx AS (SELECT *, CASE WHEN json_type(ec->'types') = 'ARRAY' THEN (ec->'types')::VARCHAR[] END types, list_transform(flatten(list_transform(json_keys(ec->'superclasses'), lambda k: json_extract(ec->'superclasses', '$."' || k || '"')::VARCHAR[])), lambda x: x) supers,
 CASE WHEN trim(lower(question_type)) IN ({_SQL_TYPES}) THEN trim(lower(question_type)) ELSE 'unknown' END qt FROM lg)
"""


def _case(d: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"


def oracle_sql() -> dict[str, str]:
    first = {k: v[0] for k, v in qs.ANSWER_FORMS.items()}
    forms = {k: "|".join(v) for k, v in qs.ANSWER_FORMS.items()}
    rel = _case(qs.RELATIONS, "qt")
    kind = {"be": "AnnotationProperty", "be subtype of": "ClassAxiom", "have property": "DataPropertyAssertion"}
    base = {"be": "isAbout", "be subtype of": "subClassOf", "have property": "hasQuality", "have member": "isAbout"}
    form = f"CASE WHEN list_contains(string_split({_case(forms, 'qt')}, '|'), trim(lower(answer_form))) THEN trim(lower(answer_form)) ELSE {_case(first, 'qt')} END"
    pct = "round(coalesce(100.0 * {0} / nullif({1}, 0), 0.0), 2)::DOUBLE"
    metrics = [m for m in ev._METRICS]
    labels = list(ev.LABELS)
    man = _L + f""", m AS (SELECT CASE WHEN n % 2 = 0 THEN 'graph' ELSE 'rag' END system, qt category, [{', '.join("'" + l + "'" for l in labels)}][n % 7 + 1] lab, n % 10 = 0 un FROM lx)"""
    return {
        "text_keys": _C + r""" SELECT chunk_id, regexp_replace(trim(lower(page_title)), 's$', '') entity_key, lower(regexp_replace(page_title, '[^a-zA-Z0-9]+', '', 'g')) name_key, coalesce(array_to_string(regexp_extract_all(lower(page_title), '[a-z]+'), ' '), '') tokens,
 trim(regexp_replace(lower(page_title), '\s+', ' ', 'g')) squashed, trim(regexp_replace(regexp_replace(lower(page_title), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) grader FROM c""",
        "uri_roundtrip": r"SELECT doc_id, url_encode(concat_ws(' ', coalesce(source, ''), text)) encoded, concat_ws(' ', coalesce(source, ''), text) decoded FROM documents",
        "token_counts": _C + r" SELECT chunk_id, len(regexp_extract_all(chunk_text_clean, '[^ \t\n\x0b\f\r]+'))::INT tokens FROM c",
        "text_ngrams": _D + r""", w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n\x0b\f\r]+') w FROM d), g AS (SELECT doc_id, array_to_string(w[i:i + 3], ' ') gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) i FROM w))
 SELECT gram, count(DISTINCT doc_id) docs FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1""",
        "text_tidy": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{3,}', e'\n\n', 'g'), e'\n ') tidy FROM documents""",
        "text_untagged": _C + " SELECT chunk_id, regexp_replace(chunk_text_clean, '<[^>]+>', '', 'g') plain, quality_flags.has_html_residue IS NOT NULL flagged FROM c",
        "text_lists": r"SELECT doc_id, regexp_replace(text, '(?m)^[ \t]*(\d+)[\.)][ \t]+(.*?)[ \t]*$', '\1. \2', 'g') listed FROM documents",
        "text_noise": _D + r""", l AS (SELECT doc_id, string_split('Read release notes here.' || chr(10) || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) l FROM d),
 k AS (SELECT doc_id, i, CASE WHEN trim(l[i]) = '' THEN '' ELSE nullif(trim(regexp_replace(regexp_replace(l[i], '(?i)We are currently updating our support articles and some info may be outdated\.?|Read release notes here\.?', '', 'g'), '[ \t\n\x0b\f\r]{2,}', ' ', 'g'), ' .:-'), '') END x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM l))
 SELECT doc_id, TRUE noisy, coalesce(string_agg(x, chr(10) ORDER BY i), '') clean FROM k GROUP BY doc_id""",
        "text_blocks": _BLK + " SELECT doc_id, block_no::INT block_no, block FROM bl",
        "text_cut_words": _BLK + r""", w AS (SELECT doc_id, block_no, regexp_extract_all(block, '[^ \t\n\x0b\f\r]+') w FROM bl) SELECT doc_id, block_no::INT block_no, i::INT piece_no, array_to_string(w[i * 40 + 1:i * 40 + 40], ' ') piece
 FROM (SELECT *, unnest(range(0, (len(w) - 1) // 40 + 1)) i FROM w WHERE len(w) > 40)""",
        "text_sections": _D + r""", l AS (SELECT doc_id, i, s[i] line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) i FROM (SELECT doc_id, string_split(text, chr(10)) s FROM d))),
 h AS (SELECT doc_id, i, line, nullif(len(regexp_extract(trim(line), '^(#{1,6})[ \t\n\x0b\f\r]+(.*)$', 1)), 0) lv, regexp_extract(trim(line), '^(#{1,6})[ \t\n\x0b\f\r]+(.*)$', 2) ti FROM l), s AS (SELECT *, count(lv) OVER (PARTITION BY doc_id ORDER BY i) sec FROM h)
 SELECT doc_id, sec "section", max(lv)::INT "level", max(CASE WHEN lv IS NOT NULL THEN ti END) title, count(*) AS "lines" FROM s GROUP BY doc_id, sec""",
        "text_residue": _C + " SELECT chunk_id, regexp_matches(chunk_text_clean, '<[^>]+>') has_html_residue, contains(chunk_text_clean, '{{<') OR contains(chunk_text_clean, '>}}') has_shortcode_residue FROM c",
        "page_attributes": r"""WITH p AS (SELECT DISTINCT source_path sp, replace(source_path, '\', '/') q FROM chunks) SELECT sp source_path, CASE WHEN sp LIKE '%.en.md' THEN 'en' WHEN sp LIKE '%.da.md' THEN 'da' ELSE 'unknown' END AS "language",
 CASE WHEN split_part(q, '/', -1) LIKE '$_index%' ESCAPE '$' THEN 'section_index' WHEN split_part(q, '/', -1) LIKE 'index%' THEN 'leaf_page' ELSE 'content_page' END kind,
 CASE WHEN contains(lower(q), '/news/') THEN 'publication' WHEN contains(lower(q), '/support/') THEN 'support' ELSE 'general' END "type", regexp_replace(q, '\.md$', '') page_id,
 CASE WHEN split_part(q, '/', -1) LIKE 'index%' THEN split_part(q, '/', -2) ELSE regexp_replace(split_part(q, '/', -1), '\.[^.]*$', '') END slug, regexp_replace(q, '/[^/]*$', '') "section" FROM p""",
        "page_report": _C + """, p AS (SELECT page_id, "language", page_type, max(regexp_matches(chunk_text_clean, '<[^>]+>')::INT) html, count(*) n FROM c GROUP BY ALL)
 SELECT coalesce("language", '(all)') AS "language", coalesce(page_type, '(all)') page_type, count(*) pages, sum(n)::BIGINT chunks, coalesce(sum(html), 0)::BIGINT html_pages FROM p GROUP BY GROUPING SETS (("language"), (page_type), ())""",
        "chunk_neighbours": _C + """, g AS (SELECT page_id, "section".group_start_index st, min("section".section_title) ti FROM c GROUP BY ALL)
 SELECT page_id, st "start", ti title, lag(ti) OVER w prev_title, lead(ti) OVER w next_title, (row_number() OVER w - 1)::INT group_no FROM g WINDOW w AS (PARTITION BY page_id ORDER BY st NULLS FIRST)""",
        "chunk_parts": _C + """ SELECT chunk_id, (row_number() OVER (PARTITION BY page_id ORDER BY chunk_index NULLS FIRST, chunk_id) - 1)::INT running, row_number() OVER (PARTITION BY page_id, "section".group_start_index ORDER BY chunk_index NULLS FIRST, chunk_id)::INT part, count(*) OVER (PARTITION BY page_id, "section".group_start_index) parts FROM c""",
        "question_labels": _L + f"""SELECT log_id, qt, {rel} relation, {_case(forms, 'qt')} forms, {form} form, CASE WHEN {_case(forms, 'qt')} NOT LIKE '%|%' THEN {_case(forms, 'qt')} END given,
 coalesce({_case(kind, rel)}, 'Unknown') kind, coalesce({_case(base, rel)}, CASE WHEN {rel} LIKE '%be%' THEN 'isAbout' END, 'unknown') base, qt IN ('definition', 'unknown', 'quantification') OR {form} = 'list' OR (qt = 'capability' AND {form} = 'value') no_object FROM lx""",
        "question_abstentions": _L + "SELECT log_id, contains(lower(coalesce(answer, '')), 'can''t answer') OR trim(coalesce(answer, '')) = '' abstains FROM lx",
        "json_repair": r"""WITH p AS (SELECT DISTINCT log_id, trim(payload) p FROM inference_logs), h AS (SELECT p, CASE WHEN contains(p, '}') THEN left(p, length(p) - instr(reverse(p), '}') + 1) END h FROM p)
 SELECT CASE WHEN p IS NULL OR p = '' THEN 'empty' WHEN json_valid(p) THEN 'whole' WHEN json_valid(h) OR json_valid(h || ']') OR json_valid(h || '}') OR json_valid(h || ']}') THEN 'repaired' ELSE 'lost' END kind, count(*) n FROM h GROUP BY 1""",
        "template_fill": _L + "SELECT log_id, replace(replace(input, 'study', 'clinic'), 'clinic', 'ward') filled FROM lx",
        "sample_questions": _L + "SELECT log_id, question_type FROM (SELECT log_id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY log_id) r FROM lx WHERE question_type IS NOT NULL) WHERE r <= 3",
        "eval_pass_rates": _L + f""", k AS (SELECT coalesce(site, '(none)') "domain", coalesce(question_type, 'unknown') tier, unnest([{{'c': 'type_known', 'p': coalesce(question_type IN ({_SQL_TYPES}), FALSE)}},
  {{'c': 'form_allowed', 'p': coalesce(list_contains(string_split(coalesce({_case(forms, 'question_type')}, 'assertion|value|list'), '|'), answer_form), FALSE)}}, {{'c': 'entity_found', 'p': coalesce(contains(input, entity), FALSE)}}]) x
  FROM lx JOIN (SELECT DISTINCT log_id l2, site FROM inference_logs) z ON z.l2 = lx.log_id)
 SELECT coalesce("domain", '(all)') AS "domain", coalesce(tier, '(all)') tier, x.c "check", sum(x.p::INT)::BIGINT passed, count(*) total, {pct.format('sum(x.p::INT)', 'count(*)')} pct FROM k GROUP BY GROUPING SETS (("domain", tier, x.c), ("domain", x.c), (tier, x.c), (x.c))""",
        "eval_resolution": _L + f""", k AS (SELECT 'unresolvable' side, 'overall' tier, 'resolution_failure' ck, types IS NULL p FROM lx WHERE n % 4 = 0
  UNION ALL SELECT 'resolvable', unnest([['canonical', 'paraphrased', 'typo'][n % 4], 'overall']), 'resolution_success', types IS NOT NULL FROM lx WHERE n % 4 > 0
  UNION ALL SELECT 'resolvable', unnest([['canonical', 'paraphrased', 'typo'][n % 4], 'overall']), 'correct_resolved_entity', coalesce(len(types) = 1, FALSE) FROM lx WHERE n % 4 > 0)
 SELECT side, tier, ck "check", sum(p::INT)::BIGINT passed, count(*) total, {pct.format('sum(p::INT)', 'count(*)')} pct FROM k GROUP BY side, tier, ck""",
        "eval_grounding": _L + f""", ga AS (SELECT qt category, n % 3 <> 2 answerable, n % 2 = 0 qtp, n % 3 = 0 oe, n % 5 < 3 oo, n % 7 = 0 pf, n % 4 = 1 ab, types IS NOT NULL er, n % 11 <> 0 ob, n % 2 = 1 es, n % 3 = 1 os, qt = 'comparative' cm FROM lx),
 gb AS (SELECT *, NOT answerable AND ab abst, er AND NOT (NOT answerable AND ab) AND (NOT cm OR ob) mapped, CASE WHEN answerable AND cm THEN es AND oe AND os AND oo WHEN answerable THEN es AND oe WHEN cm THEN es AND os ELSE es END wi FROM ga),
 gf AS (SELECT category, answerable, qtp correct_question_type, FALSE correct_answer_form, FALSE correct_entity, FALSE correct_relation, FALSE correct_object, abst correctly_abstained, er entity_resolved_n, oe AND (er OR NOT answerable) correct_entity_resolution,
  cm AND er AND NOT abst AND ob object_resolved_n, cm AND er AND NOT abst AND ob AND oo correct_object_resolution, pf AND CASE WHEN answerable THEN mapped ELSE er AND NOT abst END preferred_grounding_match, mapped AND (pf OR wi) acceptable_grounding,
  mapped AND NOT (pf OR wi) unacceptable_grounding, NOT mapped no_mapping_performed FROM gb),
 gg AS (SELECT coalesce(category, '(all)') category, answerable, count(*) total, sum((category = 'comparative')::INT) object_expected, {', '.join(f'sum({m}::INT) {m}' for m in metrics)} FROM gf GROUP BY GROUPING SETS ((answerable, category), (answerable))),
 go AS (SELECT answerable, count(*) oe FROM gf WHERE category = 'comparative' GROUP BY answerable),
 u AS ({' UNION ALL '.join(f"SELECT category, gg.answerable, '{m.removesuffix('_n')}' metric, {m}::BIGINT n, " + {'correct_object_resolution': 'object_resolved_n', 'correct_entity_resolution': 'entity_resolved_n', 'object_resolved_n': "CASE WHEN category = '(all)' THEN coalesce(oe, 0) WHEN category = 'comparative' THEN total ELSE 0 END"}.get(m, 'total') + '::BIGINT base FROM gg LEFT JOIN go ON go.answerable = gg.answerable' for m in metrics)})
 SELECT *, {pct.format('n', 'base')} pct FROM u""",
        "eval_labels": man + f""", g AS (SELECT system, coalesce(category, '(all)') category, count(*) total, sum(un::INT) unanswerable, sum((NOT un)::INT) answerable, {', '.join(f"sum((lab = '{l}')::INT) l{i}" for i, l in enumerate(labels))} FROM m GROUP BY GROUPING SETS ((system, category), (system))),
 u AS ({' UNION ALL '.join(f"SELECT system, category, '{l}' AS " + '"label"' + f", l{i}::BIGINT n, {b}::BIGINT base FROM g" for i, (l, b) in enumerate(ev.LABELS.items()))}) SELECT *, {pct.format('n', 'base')} pct FROM u""",
        "eval_pivot": man + f" SELECT system, category, {', '.join(f'''sum((lab = '{l}')::INT)::BIGINT n{i}''' for i, l in enumerate(labels))} FROM m GROUP BY system, category",
        "ground_exact": _L + r""", w AS (SELECT log_id, types, supers, regexp_extract_all(lower(input), '[^ \t\n\x0b\f\r]+') w FROM lx WHERE input IS NOT NULL AND types IS NOT NULL),
 k AS (SELECT *, flatten(list_transform(range(1, 5), lambda z: list_transform(range(1, len(w) - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' ')))) ks FROM w)
 SELECT log_id, array_to_string(list_sort(list_distinct(list_filter(types, lambda x: list_contains(ks, trim(regexp_replace(lower(x), '\s+', ' ', 'g')))))), '|') types,
 array_to_string(list_sort(list_distinct(list_filter(supers, lambda x: list_contains(ks, trim(regexp_replace(lower(x), '\s+', ' ', 'g')))))), '|') superclasses FROM k""",
        "ground_spoken": _L + ", " + _P2_PARTS.removeprefix(_P2).lstrip(", \n") + f""", one AS (SELECT log_id, min(k) k FROM cx GROUP BY log_id),
 pr AS ({" UNION ALL ".join(f"SELECT k, i * 1000000 + {n} * 100000 + g nr, l[g]->>'property' relation, l[g]->>'{f}' v FROM (SELECT k, i, CASE json_type(n->'{x}') WHEN 'ARRAY' THEN (n->'{x}')::JSON[] ELSE [n->'{x}'] END l FROM ty), LATERAL (SELECT unnest(range(1, len(l) + 1)) g) WHERE json_type(l[g]) = 'OBJECT'" for n, (x, f) in enumerate(_SIDES))}),
 pv AS (SELECT k, relation, arg_max(trim(regexp_replace(lower(v), '\\s+', ' ', 'g')), nr) AS "object" FROM pr WHERE relation IS NOT NULL GROUP BY k, relation)
 SELECT DISTINCT log_id, entity, 'be' relation, unnest(list_concat(coalesce(types, []), coalesce(supers, []))) AS "object" FROM lx WHERE ec IS NOT NULL AND json_type(ec) = 'OBJECT'
 UNION ALL SELECT one.log_id, entity, pv.relation, pv."object" FROM one JOIN pv ON pv.k = one.k JOIN lx ON lx.log_id = one.log_id WHERE pv."object" <> ''""",
        "eval_within": _L + "SELECT log_id, len(types) > 0 inside, coalesce(len(list_filter(types, lambda x: NOT list_contains(coalesce(supers, []), x))) = 0, FALSE) held FROM lx WHERE types IS NOT NULL",
    }
