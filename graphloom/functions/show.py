"""Readable texts of triples, mappings and contexts, and canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import readable


def triple_text(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("  ", readable(s), readable(p), readable(o))


def list_text(name: str, values: Column) -> Column:
    """'name: a, b'; nothing for an empty or null list."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", ")))


def map_text(name: str, values: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit(" = "), F.coalesce(e["value"], F.lit("-"))))
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(pairs, "; ")))


def mapping_text(m: str) -> Column:
    """The facets of a mapping struct that hold something, one line each."""
    names = ("types", "superclasses", "equivalent_classes", "properties", "annotations", "members", "chunk_id")
    return F.concat_ws("\n", *[list_text(n, F.col(f"{m}.{n}")) for n in names], map_text("property_values", F.col(f"{m}.property_values")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with keys in order; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _once(x: object) -> object:
    if isinstance(x, dict):
        return {k: _once(v) for k, v in x.items()}
    if isinstance(x, list):
        first: dict[str, object] = {}
        for v in map(_once, x):
            first.setdefault(json.dumps(v, sort_keys=True, ensure_ascii=False), v)
        return list(first.values())
    return x


@F.pandas_udf(T.StringType())
def deduped_json(s: pd.Series) -> pd.Series:
    """Nested JSON in which each item of a list stands once, the first of those that are equal as canonical JSON; in
    Arrow batches, as the depth is not known. Null for what is no JSON."""
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(_once(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)
