"""Turtle files: a reader into triples and a writer grouped by subject."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import COLUMNS, RDF_TYPE, XSD

#: Prefixes that the writer declares.
PREFIXES = {
    "ex": "http://kb.example/ontology#", "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD,
}
TRIPLES = "s string, p string, o string, o_kind string, o_dtype string"

_TOKENS = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)
    |(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>\s]*>)
    |(?P<dir>@prefix|@base|PREFIX\b|BASE\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[-+]?(?:\d+\.\d+(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d+)(?=[\s;,.\])]|$))
    |(?P<name>(?:[A-Za-z][\w-]*|_)?:(?:[\w\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]|:|\.(?=[\w%\\:.-]))*)
    |(?P<word>a|true|false)(?=[\s;,.<"']|$)
    |(?P<punct>[.;,\[\]()])''',
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _plain(s: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s)


def parse_turtle(text: str) -> Iterator[tuple[str, str, str, str, str | None]]:
    """Triples of one Turtle document: prefixes, ';' and ',' lists, typed, tagged and bare literals.

    Blank nodes by label are kept as '_:label'; anonymous nodes and collections are not supported and,
    like other syntax errors, raise a ValueError with the place.
    """
    prefixes, base, pos = dict[str, str](), "", 0
    items: list[tuple[str, str]] = []
    while pos < len(text):
        m = _TOKENS.match(text, pos)
        if not m or not m.group():
            raise ValueError(f"Turtle syntax at character {pos}: {text[pos:pos + 40]!r}")
        if m.lastgroup != "skip":
            items.append((m.lastgroup, m.group()))
        pos = m.end()
    at = 0

    def resource(kind: str, tok: str) -> str:
        if kind == "iri":
            iri = _plain(tok[1:-1])
            return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else base + iri
        if kind == "word" and tok == "a":
            return RDF_TYPE
        if kind == "name":
            head, _, local = tok.partition(":")
            if head == "_":
                return tok
            if head not in prefixes:
                raise ValueError(f"unknown prefix {head!r}")
            return prefixes[head] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"a resource was expected, not {tok!r}")

    while at < len(items):
        kind, tok = items[at]
        if kind == "dir":
            if "prefix" in tok.lower():
                prefixes[items[at + 1][1].rstrip(":")] = resource("iri", items[at + 2][1])
                at += 3
            else:
                base = items[at + 1][1][1:-1]
                at += 2
            if at < len(items) and items[at] == ("punct", "."):
                at += 1
            continue
        s = resource(kind, tok)
        at += 1
        while True:
            p = resource(*items[at])
            at += 1
            while True:
                kind, tok = items[at]
                at += 1
                if kind == "text":
                    quote = 3 if tok[:3] in ('"""', "'''") else 1
                    value, dtype = _plain(tok[quote:-quote]), None
                    if at < len(items) and items[at][0] == "type":
                        dtype = resource(*items[at + 1])
                        at += 2
                    elif at < len(items) and items[at][0] == "lang":
                        at += 1
                    yield s, p, value, "literal", dtype
                elif kind == "number":
                    name = "double" if "e" in tok.lower() else "decimal" if "." in tok else "integer"
                    yield s, p, tok, "literal", XSD + name
                elif kind == "word" and tok != "a":
                    yield s, p, tok, "literal", XSD + "boolean"
                else:
                    yield s, p, resource(kind, tok), "iri", None
                if items[at] != ("punct", ","):
                    break
                at += 1
            if items[at] == ("punct", ";"):
                while items[at] == ("punct", ";"):
                    at += 1
                if items[at] == ("punct", "."):
                    at += 1
                    break
                continue
            if items[at] != ("punct", "."):
                raise ValueError(f"'.' was expected, not {items[at][1]!r}")
            at += 1
            break


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Distinct triples of all Turtle files under ``path``; each file is parsed whole by one task."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ttl").text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                rows = list(parse_turtle(text))
                for k in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[k : k + 50_000], columns=list(COLUMNS))

    return files.mapInPandas(run, TRIPLES).distinct()


def latest_file(spark: SparkSession, folder: str, ending: str = ".ttl") -> str:
    """The last file of a folder in the order of names; FileNotFoundError if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(ending)) if fs.exists(p) else []
    if not found:
        raise FileNotFoundError(f"no {ending} file in {folder}")
    return found[-1]


def turtle_blocks(t: DataFrame) -> DataFrame:
    """One text per subject, ``(s, block)``; statements in the order of predicate and object.

    A subject's statements are gathered in one row; subjects are entities, whose statements are few.
    """
    def short(x):
        out = F.concat(F.lit("<"), x, F.lit(">"))
        for name, ns in PREFIXES.items():
            local = F.substring(x, F.lit(len(ns) + 1), F.length(x))
            ok = F.startswith(x, F.lit(ns)) & F.regexp_like(local, F.lit(r"^(?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2})(?:[A-Za-z0-9_-]|%[0-9A-Fa-f]{2})*$"))
            out = F.when(ok, F.concat(F.lit(f"{name}:"), local)).otherwise(out)
        return out

    esc = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    lit = F.concat(F.lit('"'), esc, F.lit('"'), F.coalesce(F.concat(F.lit("^^"), short(F.col("o_dtype"))), F.lit("")))
    rows = t.select("s", "p", F.when(F.col("o_kind") == "iri", short(F.col("o"))).otherwise(lit).alias("x"), F.when(F.col("p") == RDF_TYPE, F.lit("a")).otherwise(short(F.col("p"))).alias("q"))
    grouped = rows.groupBy("s").agg(F.array_sort(F.collect_set(F.struct("q", "x"))).alias("w"))
    body = F.array_join(F.transform("w", lambda w: F.concat(w["q"], F.lit(" "), w["x"])), " ;\n    ")
    return grouped.select("s", F.concat(short(F.col("s")), F.lit(" "), body, F.lit(" .\n")).alias("block"))


def write_turtle(t: DataFrame, path: str) -> None:
    """Write triples as Turtle, sorted by subject; each part file starts with the prefixes and is whole."""
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            if first and len(batch):
                yield pd.DataFrame({"value": [head]})
                first = False
            yield pd.DataFrame({"value": batch["block"]})

    turtle_blocks(t).orderBy("s").select("block").mapInPandas(run, "value string").write.option("lineSep", "\n").text(path)
