"""Queries of the problems on texts (1, 3, 5, 7, 8 and 9), and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, strip_name, table
from .groups import group_names
from .lines import find_lines, frequent_lines, remove_lines, site_of
from .lookalike import classes, pairs, same_form
from .mix import mixture
from .split import split_texts
from .tokens import decode, encode


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "page_id", "page_type", "chunk_text_clean", site_of(F.col("source_path")).alias("site"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand on at least 6 pages and 10 % of the pages of their site and page type."""
    return find_lines(_chunks(spark, d), "chunk_id", ["site", "page_type"], "page_id", "chunk_text_clean")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's text without those lines."""
    rows = _chunks(spark, d)
    found = find_lines(rows, "chunk_id", ["site", "page_type"], "page_id", "chunk_text_clean")
    return remove_lines(rows.select("chunk_id", "chunk_text_clean"), "chunk_id", "chunk_text_clean", found).select("chunk_id", "clean_text")


def p1_frequent(spark: SparkSession, d: str) -> DataFrame:
    """How many frequent lines each site and page type has, and the widest spread of one."""
    rows = _chunks(spark, d)
    named = rows.select("site", "page_type", F.xxhash64("site", "page_type").alias("g")).dropna().distinct()
    freq = frequent_lines(rows, ["site", "page_type"], "page_id", "chunk_text_clean")
    return freq.join(named, "g").groupBy("site", "page_type").agg(F.count(F.lit(1)).alias("lines"), F.max("pages").alias("most_pages"), F.max("group_pages").alias("group_pages"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    strip = lambda c: F.transform(F.coalesce(c, F.array()), strip_name)
    people = table(spark, d, "abox").where("type = 'SameIndividual'").select(F.lit("individual").alias("kind"), strip(F.col("individuals")).alias("names"))
    kinds = table(spark, d, "tbox_axioms").where("type = 'equivalentClass'").select(F.lit("class").alias("kind"), F.concat(strip(F.col("domains")), strip(F.col("ranges"))).alias("names"))
    return people.unionByName(kinds)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One group key for all names that are linked directly or by others."""
    return group_names(_linked(spark, d))


def _limited_groups(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "report").groupBy("run_id").agg(F.max("chunk_max_tokens").alias("most"), F.max("chunk_overlap_tokens").alias("shared"))
    texts = F.filter(F.transform("sections", lambda s: s["text"]), lambda t: t.isNotNull())
    groups = table(spark, d, "section_groups").select("group_id", "run_id", F.array_join(texts, "\n\n").alias("text"))
    return groups.join(cut(limits, "limits"), "run_id", "left")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every group's text in pieces within its run's limit."""
    rows = split_texts(_limited_groups(spark, d).where("group_id is not null"), "group_id", "text", "most", "shared")
    return rows.dropDuplicates(["group_id", "piece_no"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose text is over the limit, so has more than one piece."""
    rows = split_texts(_limited_groups(spark, d).where("group_id is not null"), "group_id", "text", "most", "shared", with_text=False)
    return rows.where("piece_no = 0 and n_pieces > 1").select("group_id").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's ids decode to its text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = decode(cut(encode(docs, "doc_id", "text"), "ids"), "doc_id", "ids").withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The training order of the mixed sources."""
    return mixture(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the sources reach in it."""
    return mixture(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose different texts look the same."""
    return pairs(table(spark, d, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look the same as another text, by class."""
    return classes(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "class_id", "texts", "members")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one form."""
    return same_form(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "form")


_ALL = (p1_found, p1_clean, p1_frequent, p3_found, p5_found, p5_pieces, p7_ids, p7_roundtrip, p8_mixture, p8_shares, p9_found, p9_classes, p9_forms)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# White space as Unicode has it, for RE2.
_WS = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _name(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '')"


_P1 = r"""
WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, page_id, page_type, chunk_text_clean txt, regexp_extract(replace(trim(source_path), '\', '/'), '^(?:[A-Za-z]:)?(?:\.{0,2}/)*([^/]+)/', 1) site FROM chunks),
ok AS (SELECT * FROM c WHERE site <> '' AND page_type IS NOT NULL AND page_id IS NOT NULL AND chunk_id IS NOT NULL),
pages AS (SELECT site, page_type, count(DISTINCT page_id) n FROM ok GROUP BY ALL),
sp AS (SELECT *, string_split(txt, chr(10)) ls FROM ok WHERE txt IS NOT NULL),
l AS (SELECT chunk_id, page_id, site, page_type, g - 1 line_no, lower(upper(regexp_replace(ls[g], '[^\p{L}]+', '', 'g'))) k FROM sp, LATERAL (SELECT unnest(range(1, len(ls) + 1)) g)),
f AS (SELECT l.site, l.page_type, k, count(DISTINCT page_id) pg, any_value(p.n) n FROM l JOIN pages p ON p.site = l.site AND p.page_type = l.page_type WHERE k <> '' GROUP BY ALL HAVING pg >= 6 AND pg * 10 >= any_value(p.n)),
hit AS (SELECT chunk_id, line_no FROM l JOIN f USING (site, page_type, k))
"""

_P3 = f"""
WITH RECURSIVE a AS (SELECT 'individual' kind, row_number() OVER () || 'i' k, individuals ns FROM abox WHERE type = 'SameIndividual'
 UNION ALL SELECT 'class', row_number() OVER () || 'c', list_concat(coalesce(domains, []), coalesce(ranges, [])) FROM tbox_axioms WHERE type = 'equivalentClass'),
m AS (SELECT DISTINCT kind, k, {_name('x')} n FROM (SELECT kind, k, unnest(ns) x FROM a)),
e AS (SELECT DISTINCT a.kind, a.n x, b.n y FROM m a JOIN m b ON a.k = b.k AND a.kind = b.kind WHERE a.n IS NOT NULL AND b.n IS NOT NULL AND a.n <> b.n),
r AS (SELECT kind, x, x y FROM e UNION SELECT r.kind, r.x, e.y FROM r JOIN e ON e.kind = r.kind AND e.x = r.y)
SELECT kind, min(y) group_key, x member FROM r GROUP BY kind, x
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT chunk_id, line_no::INT line_no FROM hit",
        "p1_clean": _P1 + """, gone AS (SELECT chunk_id, list(line_no) g FROM hit GROUP BY ALL),
 all_c AS (SELECT DISTINCT ON (chunk_id) chunk_id, chunk_text_clean txt FROM chunks)
 SELECT chunk_id, CASE WHEN g IS NULL THEN txt ELSE (SELECT coalesce(string_agg(s[i], chr(10) ORDER BY i), '') FROM (SELECT string_split(txt, chr(10)) s), LATERAL (SELECT unnest(range(1, len(s) + 1)) i) WHERE NOT list_contains(g, i - 1)) END clean_text
 FROM all_c LEFT JOIN gone USING (chunk_id)""",
        "p1_frequent": _P1 + "SELECT site, page_type, count(*) AS \"lines\", max(pg) most_pages, max(n) group_pages FROM f GROUP BY ALL",
        "p3_found": _P3,
        "p5_found": rf"""
WITH lim AS (SELECT run_id, max(chunk_max_tokens) m FROM report GROUP BY 1),
t AS (SELECT DISTINCT group_id, run_id, list_aggregate(list_filter(list_transform(sections, lambda s: s.text), lambda x: x IS NOT NULL), 'string_agg', chr(10) || chr(10)) txt FROM section_groups WHERE group_id IS NOT NULL)
SELECT DISTINCT group_id FROM t JOIN lim USING (run_id) WHERE len(regexp_extract_all(coalesce(txt, ''), '[^{_WS}]+')) > greatest(m, 1) AND m IS NOT NULL""",
        "p7_roundtrip": "SELECT doc_id, TRUE AS same FROM documents",
    }
