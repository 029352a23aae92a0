"""Column functions on texts and URIs. All run inside the JVM but the ones that say otherwise."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ URIs

def uri_fragment(x: Col) -> Column:
    """Percent-encode all but unreserved characters; null gives null."""
    e = F.url_encode(_c(x))
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def uri_decode(x: Col) -> Column:
    """Decode percent escapes; '+' stays; a text with a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B"))), _c(x))


def after_hash(x: Col) -> Column:
    """The part after the last '#'; the whole text if there is none."""
    return F.substring_index(_c(x), "#", -1)


def readable(x: Col) -> Column:
    """The decoded fragment of an IRI."""
    return uri_decode(after_hash(x))


# ------------------------------------------------------------------ normal forms

def entity_key(x: Col) -> Column:
    """Lower case, trimmed, without one trailing 's'."""
    return F.regexp_replace(F.trim(F.lower(_c(x))), "s$", "")


def name_key(x: Col, ascii_only: bool = False) -> Column:
    """Without non-word characters and underscores, lower case; Unicode-aware unless ``ascii_only``."""
    return F.lower(F.regexp_replace(_c(x), r"[\W_]+" if ascii_only else r"(?U)[\W_]+", ""))


def letter_tokens(x: Col) -> Column:
    """ASCII letter runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z]+"), F.lit(0))


def squash(x: Col) -> Column:
    """Lower case, trimmed, white space runs to one blank."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"\s+", " "))


def grader_key(x: Col) -> Column:
    """Lower case, other characters than ASCII letters, digits and blanks to blanks, runs to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by blanks; an empty list if there are fewer."""
    idx = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def ngrams_upto(x: Col, most: int = 4) -> Column:
    """All runs of 1 to ``most`` tokens of the squashed text."""
    t = F.filter(F.split(squash(x), " "), lambda w: w != "")
    return F.flatten(F.array(*[ngrams(t, n) for n in range(1, most + 1)]))


def token_count(x: Col) -> Column:
    """Number of runs of characters other than white space; 0 for empty, null for null."""
    return F.regexp_count(_c(x), F.lit(r"\S+"))


def words(x: Col) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"\S+"), F.lit(0))


# ------------------------------------------------------------------ markdown lines

def line_feeds(x: Col) -> Column:
    return F.replace(F.replace(_c(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def tidy_blanks(x: Col) -> Column:
    """One kind of line end; blanks and tabs collapsed and trimmed in each line; at most one empty line in a
    run; the whole trimmed."""
    t = F.regexp_replace(line_feeds(x), r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)^ | $", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.btrim(t, F.lit("\n "))


def strip_tags(x: Col) -> Column:
    return F.regexp_replace(_c(x), r"<[^>]+>", "")


def list_numbers(x: Col) -> Column:
    """Numbered list items, '1)' or '1.', to '1. '."""
    return F.regexp_replace(_c(x), r"(?m)^[ \t]*(\d+)[\.)][ \t]+(.*?)[ \t]*$", r"$1. $2")


#: Notices that are no content (fixed values).
NOISE = (
    r"We are currently updating our support articles and some info may be outdated\.?",
    r"Read release notes here\.?",
)


def _noise() -> str:
    return "(?i)" + "|".join(NOISE)


def has_noise(x: Col) -> Column:
    return F.regexp_like(_c(x), F.lit(_noise()))


def drop_noise(x: Col) -> Column:
    """Notices cut out of each line, blanks collapsed, blanks and ' .:-' stripped from both ends; lines that
    become empty go, lines that were blank stay."""
    def one(line: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(line, _noise(), ""), r"\s{2,}", " ")
        return F.when(F.trim(line) == "", F.lit("")).otherwise(F.nullif(F.btrim(cut, F.lit(" .:-")), F.lit("")))

    return F.array_join(F.filter(F.transform(F.split(line_feeds(x), "\n"), one), lambda v: v.isNotNull()), "\n")


def blocks(x: Col) -> Column:
    """Non-empty blocks between blank lines, trailing blanks of lines removed."""
    t = F.regexp_replace(line_feeds(x), r"(?m)[ \t]+$", "")
    return F.filter(F.transform(F.split(t, r"\n(?:[ \t]*\n)+"), lambda b: F.btrim(b, F.lit("\n \t"))), lambda b: b != "")


def heading_level(line: Col) -> Column:
    """1 to 6 for a heading line, else null."""
    h = F.regexp_extract(F.trim(_c(line)), r"^(#{1,6})\s+(.*)$", 1)
    return F.when(h != "", F.length(h))


def heading_title(line: Col) -> Column:
    return F.regexp_extract(F.trim(_c(line)), r"^(#{1,6})\s+(.*)$", 2)


def cut_words(x: Col, limit: int) -> Column:
    """The text itself within ``limit`` words, else pieces of ``limit`` words."""
    w = words(x)
    at = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / limit).cast("int"))
    many = F.transform(at, lambda i: F.array_join(F.slice(w, i * limit + 1, limit), " "))
    return F.when(F.size(w) <= limit, F.array(_c(x))).otherwise(many)


def residue_flags(x: Col) -> Column:
    """``struct(has_html_residue, has_shortcode_residue)``."""
    return F.struct(
        F.regexp_like(_c(x), F.lit(r"<[^>]+>")).alias("has_html_residue"),
        (F.contains(_c(x), F.lit("{{<")) | F.contains(_c(x), F.lit(">}}"))).alias("has_shortcode_residue"),
    )


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All named and numeric entities; in Arrow batches, as the JVM has no table of them."""
    return s.map(lambda t: None if t is None else html.unescape(t))


# ------------------------------------------------------------------ page attributes

def page_language(path: Col) -> Column:
    p = _c(path)
    return F.when(F.endswith(p, F.lit(".en.md")), "en").when(F.endswith(p, F.lit(".da.md")), "da").otherwise("unknown")


def page_kind(path: Col) -> Column:
    f = F.substring_index(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(F.startswith(f, F.lit("_index")), "section_index").when(F.startswith(f, F.lit("index")), "leaf_page").otherwise("content_page")


def page_type(path: Col, layout: Col | None = None) -> Column:
    """Section of the site by path, then by the layout of the front matter."""
    p = F.lower(F.replace(_c(path), F.lit("\\"), F.lit("/")))
    lay = F.lower(F.trim(F.coalesce(_c(layout), F.lit("")))) if layout is not None else F.lit("")
    return (
        F.when(F.contains(p, F.lit("/news/")), "publication").when(F.contains(p, F.lit("/support/")), "support")
        .when(lay == "custom", "marketing").when(lay == "simple", "support").otherwise("general")
    )


def page_id(path: Col) -> Column:
    return F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), r"\.md$", "")


def page_slug(path: Col) -> Column:
    """The folder's name for index pages, else the file's name without its last ending."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    name = F.substring_index(p, "/", -1)
    folder = F.substring_index(F.substring_index(p, "/", -2), "/", 1)
    return F.when(F.startswith(name, F.lit("index")), folder).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def section_path(path: Col) -> Column:
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(".")


# ------------------------------------------------------------------ assembly

def replace_in_order(text: Col, pairs: Column) -> Column:
    """Chained replacements by ``pairs`` (array of struct(old, new)), each on the result of the last."""
    return F.aggregate(pairs, _c(text), lambda acc, p: F.replace(acc, p["old"], p["new"]))


def prompt(system: Col, user: Col, family: str) -> Column:
    """The chat template of a model family: 'phi' or 'chatml'."""
    if family == "phi":
        return F.concat(F.lit("<|system|>\n"), _c(system), F.lit("<|end|>\n<|user|>\n"), _c(user), F.lit("<|end|>\n<|assistant|>\n"))
    if family == "chatml":
        return F.concat(F.lit("<|im_start|>system\n"), _c(system), F.lit("<|im_end|>\n<|im_start|>user\n"), _c(user), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    raise ValueError(f"no chat template for {family!r}")


def repaired_json(x: Col) -> Column:
    """A JSON text or, if it is cut off, its longest prefix that can be closed: to the last brace as it is,
    as a list, as an object; null if nothing can be read."""
    t = F.trim(_c(x))
    head = F.substring(t, F.lit(1), F.length(t) - F.locate("}", F.reverse(t)) + 1)
    head = F.when(F.contains(t, F.lit("}")), head)
    tries = [t, head, F.concat(head, F.lit("]")), F.concat(head, F.lit("}")), F.concat(head, F.lit("]}"))]
    return F.coalesce(*[F.when(F.try_parse_json(c).isNotNull(), c) for c in tries])
