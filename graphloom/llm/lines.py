"""Lines repeated across the documents of one site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import bounded_broadcast, cut


def site_of(path: Column) -> Column:
    """The first folder of a path, however it is written: back-slashes, leading ``./``, ``/``, drive letters."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    first = F.regexp_extract(p, r"^(?:[A-Za-z]:)?(?:\.{0,2}/)*([^/]+)/", 1)
    return F.when(first != "", first)


def letters(line: Column) -> Column:
    """The letters of a line (category L) in order, lower case by simple mappings (letter by letter);
    '' for a line without letters."""
    return F.lower(F.upper(F.regexp_replace(line, r"[^\p{L}]+", "")))


def _lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line with letters: the group's hash ``g``, 128 bits of hash of the line, its number."""
    parts = F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    group = F.xxhash64(*keys)
    rows = docs.select(*[c for c in docs.columns if c != text], group.alias("g"), parts).withColumn("l", letters(F.col("line"))).where("l <> ''")
    return rows.withColumn("h1", F.xxhash64(F.lit(1), "g", "l")).withColumn("h2", F.xxhash64(F.lit(2), "l"))


def frequent_lines(docs: DataFrame, group: list[str], page: str, text: str, min_pages: int = 6, min_share: float = 0.1) -> DataFrame:
    """Lines that stand on at least ``min_pages`` pages and ``min_share`` of the pages of their group.

    Gives ``(g, h1, h2, pages, group_pages)``. Pages are counted distinct per group and line hash: the
    distinct (line, page) pairs spread over all tasks by their own hash, so a site that holds a third
    of all rows is no hot key, and both counts are combined before they are shuffled. Only hashes are
    shuffled. Rows with a null group column or page take no part; null texts count as pages without lines.
    """
    docs = docs.dropna(subset=[*group, page])
    sized = docs.select(F.xxhash64(*group).alias("g"), F.xxhash64(page).alias("p")).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("group_pages"))
    lines = _lines(docs.select(*group, F.xxhash64(page).alias("p"), text), group, text)
    seen = lines.groupBy("g", "h1", "h2", "p").agg(F.lit(1)).groupBy("g", "h1", "h2").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    hit = seen.join(sized, "g").where(F.col("pages") >= F.col("group_pages") * min_share - 1e-9)
    return cut(hit.select("g", "h1", "h2", "pages", "group_pages"), "frequent-lines")


def find_lines(docs: DataFrame, key: str, group: list[str], page: str, text: str, min_pages: int = 6, min_share: float = 0.1) -> DataFrame:
    """``(key, line_no)`` of every line to remove, each once however often its row was delivered."""
    freq = frequent_lines(docs, group, page, text, min_pages, min_share)
    lines = _lines(docs.dropna(subset=[key, *group, page]).select(key, *group, text), group, text)
    hit = lines.join(bounded_broadcast(freq), ["g", "h1", "h2"], "left_semi")
    return hit.select(key, "line_no").distinct()


def remove_lines(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``docs`` with ``clean_text``: the text without the found lines; one row per key that is not null.

    A text whose lines are all removed becomes ''; null texts stay null, as do rows without a hit their
    text. Rows with a null key are kept as they are.
    """
    out = found.groupBy(F.col(key).alias("_k")).agg(F.collect_set("line_no").alias("_gone"))
    once = docs.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))
    rows = once.join(cut(out, "line-numbers"), F.col(key) == F.col("_k"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return rows.withColumn("clean_text", F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_k", "_gone")
