"""Grounding: which elements of a context an answer speaks of."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams_upto, squash

FACETS = ("types", "superclasses", "equivalent_classes", "properties", "annotations", "members", "chunk_id")
MAPPING = ", ".join(f"{f} array<string>" for f in FACETS) + ", property_values map<string,string>"


def exact_mentions(rows: DataFrame, answer: str, names: str) -> Column:
    """Names of an array that equal a run of one to four words of the answer, sorted; native."""
    keys = ngrams_upto(F.col(answer))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.array_contains(keys, squash(n)))))


def _words(text: str) -> list[str]:
    return text.lower().split()


def _runs(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def close(a: str, b: str, least: float) -> bool:
    """Whether the matching-block ratio reaches ``least``; cheap bounds first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def _mentioned(names: list[str], chunks: list[str]) -> set[str]:
    known = set(chunks)
    out = set()
    for name in names:
        key = " ".join(_words(name))
        if key in known or any(close(c, key, 0.85) for c in chunks):
            out.add(name)
    return out


def _described(descriptions: dict[str, str | None], names: set[str], chunks: list[str]) -> set[str]:
    long = [c for c in chunks if c]
    out = set()
    for name, text in descriptions.items():
        if name in names and text and any(close(d, c, 0.9) for d in _runs(_words(text), 4) for c in long):
            out.add(name)
    return out


def _holds(part: str, whole: str, compat: bool) -> bool:
    """``part`` within ``whole``; at word boundaries unless ``compat``."""
    if not part:
        return False
    at = whole.find(part)
    while at >= 0:
        if compat or ((at == 0 or not whole[at - 1].isalnum()) and (at + len(part) == len(whole) or not whole[at + len(part)].isalnum())):
            return True
        at = whole.find(part, at + 1)
    return False


def _texts(x: object) -> list[str]:
    """The texts of a list, a lone text as a list; other shapes give none."""
    return [v if isinstance(v, str) else str(v) for v in (x if isinstance(x, list) else [x]) if v is not None and not isinstance(v, (list, dict))]


def _fields(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _statements(ctx: dict) -> Iterator[tuple[str, str]]:
    """Property and value of every statement below the types of a context."""
    for sides in _fields(ctx.get("properties_by_type")).values():
        for side, field in (("outgoing_object_properties", "object"), ("outgoing_data_properties", "value"), ("incoming_object_properties", "subject")):
            rows = _fields(sides).get(side)
            for row in rows if isinstance(rows, list) else [rows]:
                name = _fields(row).get("property")
                if isinstance(name, str):
                    yield name, " ".join(_texts(row.get(field)))


def ground_one(answer: str | None, ctx: dict, compat: bool = False) -> dict | None:
    """The mapping of one answer to one context; None for an empty answer.

    Types, superclasses and equivalent classes: named in the answer, exactly or nearly (ratio 0.85), or a run
    of four words of their description nearly (0.9) stands there. Properties: value or name stands in the
    answer, or nearly is the answer. Annotations: the label whose comment shares a run. Members and chunks:
    stand in the answer with their case. ``compat`` lets short values match inside words.
    """
    if not answer:
        return None
    words = _words(answer)
    text = " ".join(words)
    chunks = [c for n in range(1, 5) for c in _runs(words, n)]
    desc = {k: v for k, v in _fields(ctx.get("class_descriptions")).items() if v is None or isinstance(v, str)}
    above = ctx.get("superclasses")
    supers = [x for v in above.values() for x in _texts(v)] if isinstance(above, dict) else _texts(above)
    out: dict = {}
    for facet, names in (("types", _texts(ctx.get("types"))), ("superclasses", supers), ("equivalent_classes", _texts(ctx.get("equivalent_classes")))):
        out[facet] = sorted(_mentioned(names, chunks) | _described(desc, set(names), chunks))
    values: dict[str, str] = {}
    for name, raw in _statements(ctx):
        value, key = " ".join(_words(raw)), " ".join(_words(name))
        near = (len(value) > 5 and close(text, value, 0.85)) or (len(key) >= 5 and close(text, key, 0.85))
        if _holds(value, text, compat) or _holds(key, text, compat) or near:
            values[name] = value
    if "collection" in text:  # 'part of a collection' is no statement about parts
        values.pop("isPartOf", None)
    notes = _fields(ctx.get("annotations"))
    label, comment = (" ".join(_texts(notes.get(k))) for k in ("label", "comment"))
    out["annotations"] = sorted(_described({label: comment}, {label}, chunks))
    out["properties"] = sorted(values)
    out["property_values"] = values
    out["members"] = sorted({m for m in _texts(ctx.get("members")) if _holds(m, answer, compat)})
    out["chunk_id"] = sorted({c for c in _texts(ctx.get("chunk_id")) if _holds(c, answer, compat)})
    return out


def ground(rows: DataFrame, key: str, answer: str, context: str, compat: bool = False) -> DataFrame:
    """``(key, mapping fields)`` for rows with an answer and a context struct, or its JSON, in Arrow batches.

    Null and empty answers and null contexts give rows of nulls.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, a, c in zip(batch["k"], batch["a"], batch["c"]):
                m = ground_one(a, _plain(c), compat) if c is not None else None
                out.append({"k": k, **(m or {})})
            frame = pd.DataFrame(out, columns=["k", *FACETS, "property_values"]).astype(object)
            yield frame.where(frame.notna(), None)

    picked = rows.select(F.col(key).alias("k"), F.col(answer).alias("a"), F.col(context).alias("c"))
    # a struct column becomes a pandas frame in Arrow batches, so the context travels as JSON
    picked = picked if dict(picked.dtypes)["c"] == "string" else picked.withColumn("c", F.to_json("c"))
    return picked.mapInPandas(run, f"k {kind}, {MAPPING}").withColumnRenamed("k", key)


def _plain(c: str) -> dict:
    import json

    return json.loads(c)


def merge_mappings(first: str = "r", second: str = "a") -> list[Column]:
    """Fields of two mapping structs merged: lists by sorted union, values with the second winning."""
    none = F.array().cast("array<string>")
    out = [F.array_sort(F.array_union(F.coalesce(F.col(f"{first}.{f}"), none), F.coalesce(F.col(f"{second}.{f}"), none))).alias(f) for f in FACETS]
    empty = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce(F.col(f"{first}.property_values"), empty), F.coalesce(F.col(f"{second}.property_values"), empty), lambda _, x, y: F.coalesce(y, x))
    return [*out, both.alias("property_values")]


def mapping_triples(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """``(key, entity, relation, object)``: classes as 'be', property values by their name; empty ones go."""
    be = F.transform(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("types", "superclasses", "equivalent_classes")])), lambda c: F.struct(F.lit("be").alias("relation"), c.alias("object")))
    pv = F.transform(F.map_entries(F.coalesce("property_values", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("relation"), e["value"].alias("object")))
    out = rows.select(key, F.col(entity).alias("entity"), F.inline(F.concat(be, pv)))
    return out.where("object is not null and object <> ''")
