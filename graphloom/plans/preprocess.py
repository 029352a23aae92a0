"""Markdown tree to pages, chunks and a report."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import cut
from ..ddl import schema
from ..functions import text as fx
from ..functions import markdown as md
from ..functions.markdown import page_chunks
from ..sources.files import CHUNK, read_markdown, write_report

def clean_pages(raw: DataFrame) -> DataFrame:
    """``raw(source_path, raw)`` into pages; null texts count as empty.

    Cleaning: shortcodes, tags, links, lists, notices and blanks, in this order; what is left over is flagged.
    Values of the front matter are texts: lists as JSON.
    """
    path = F.col("source_path")
    meta, body = md.front_matter(F.coalesce("raw", F.lit("")))
    p = raw.select("source_path", meta.alias("front_matter"), md.shortcodes_expanded(body).alias("t"))
    p = p.withColumn("t", md.without_tags(F.col("t"))).withColumn("t", md.decoded_and_routed(F.col("t"), path)).withColumn("t", fx.list_numbers("t"))
    p = p.withColumn("noisy", fx.has_noise("t")).withColumn("clean_text", fx.tidy_blanks(fx.drop_noise("t")))
    left = fx.residue_flags("clean_text")
    value = lambda k: F.nullif(F.element_at("front_matter", F.lit(k)), F.lit(""))
    layout = value("layout")
    return p.select(
        "source_path", "front_matter", "clean_text",
        F.struct(F.col("noisy").alias("boilerplate_removed"), left["has_shortcode_residue"].alias("shortcode_residue"), left["has_html_residue"].alias("html_residue")).alias("cleaning_flags"),
        F.coalesce(value("title"), F.lit("")).alias("title"), value("date").alias("date"), value("externalUrl").alias("external_url"),
        fx.page_id(path).alias("page_id"), fx.page_language(path).alias("language"), fx.page_type(F.concat(F.lit("/"), path), layout).alias("page_type"), fx.page_kind(path).alias("page_kind"),
        fx.section_path(path).alias("section_path"), fx.page_slug(path).alias("slug"))


def chunk_pages(pages: DataFrame, max_tokens: int = 1000, compat: bool = False) -> DataFrame:
    """Pages into chunk records of at most ``max_tokens`` white-space tokens."""
    core = schema("page_id string, chunk_index int, chunk_text_clean string, token_count int")
    core = T.StructType([*core.fields, CHUNK["section"], CHUNK["quality_flags"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": p, **c} for p, t, title in zip(batch["page_id"], batch["clean_text"], batch["title"]) for c in page_chunks(t or "", title or "", max_tokens, compat)]
            yield pd.DataFrame(rows, columns=core.names)

    cut_up = pages.select("page_id", "clean_text", "title").mapInPandas(run, core)
    own = pages.select("page_id", F.col("title").alias("page_title"), "source_path", "language", "page_type", F.struct("title", "date", F.col("external_url").alias("externalUrl")).alias("provenance"))
    out = cut_up.join(own, "page_id").withColumn("chunk_id", F.concat("page_id", F.lit("::c"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")))
    return out.select(*CHUNK.names)


def page_report(pages: DataFrame, chunks: DataFrame, content_root: str, max_tokens: int) -> DataFrame:
    """One row: totals, counts by language and page type, and three quality sums."""
    count = lambda c: pages.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"{c}s"))
    flag = lambda c: F.count_if(F.col(f"cleaning_flags.{c}"))
    sums = pages.agg(F.count(F.lit(1)).alias("pages_total"), F.struct(
        flag("shortcode_residue").alias("pages_with_shortcode_residue"), flag("html_residue").alias("pages_with_html_residue"), flag("boilerplate_removed").alias("pages_with_boilerplate_removed")).alias("quality"))
    out = sums.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks_total"))).crossJoin(count("language")).crossJoin(count("page_type"))  # one row each
    return out.withColumns({"run_at": F.current_timestamp(), "content_root": F.lit(content_root), "chunk_max_tokens": F.lit(max_tokens)})


def preprocess(spark: SparkSession, root: str, out: str, max_tokens: int = 1000, glob: str = "*.en.md") -> DataFrame:
    """The whole job: writes pages, chunks and the report under ``out`` and gives the report."""
    pages = cut(clean_pages(read_markdown(spark, root, glob)), "pages")
    chunks = cut(chunk_pages(pages, max_tokens), "chunks")
    pages.write.mode("overwrite").json(f"{out}/pages")
    chunks.write.mode("overwrite").json(f"{out}/chunks")
    report = cut(page_report(pages, chunks, root, max_tokens), "report")
    write_report(report, f"{out}/report")
    return report
