"""Deeply nested JSON records into related flat tables, in one pass.

A depth-first visitor walks each record once and emits, for every node that a ``Rule`` names, one row
``(tag, pk, parent_pk, pos, payload)``. The emission is written partitioned by ``tag``; each flat table
is then one partition of it, read with its own schema. Keys are made of the record's key and the
positions on the way down, so a child's ``parent_pk`` is its parent's ``pk`` without a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import scratch_path
from ..ddl import schema

EMITTED = "tag string, record_id string, pk string, parent_pk string, path array<int>, payload string"


@dataclass(frozen=True)
class Rule:
    """One flat table: the nodes found under ``name`` of the parent node.

    columns   fields of the node that become the payload (others are visited only if a child rule names them)
    scalar_as the column that holds the node's value if a text stands in place of the object, None: no node then
    key_as    the column that takes the names if the value is an object whose fields are the nodes, such as a map
              from type to properties; positions then count its fields
    """

    tag: str
    name: str
    columns: tuple[str, ...]
    scalar_as: str | None = None
    children: tuple[Rule, ...] = field(default=())
    key_as: str | None = None


#: Rows that a task holds before it hands them on.
ROWS_HELD = 10_000


def read_record(text: str | None) -> dict | None:
    """The record in ``text`` however it is wrapped: byte-order mark, blanks, JSON within a JSON string,
    a list of one. Null for null, blank and cut-off texts and for anything that is not one object."""
    value: object = text
    while isinstance(value, (str, list)):
        if isinstance(value, list):
            if len(value) != 1:
                return None
            value = value[0]
            continue
        try:
            value = json.loads(value.strip().lstrip("﻿").strip())
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def visit(rules: tuple[Rule, ...], node: dict, record: str, pk: str, at: tuple[int, ...]) -> Iterator[tuple]:
    """Rows of all nodes below ``node``, depth first. A value without its list stands at position 0;
    positions count null members."""
    for rule in rules:
        value = node.get(rule.name)
        if value is None:
            continue
        if rule.key_as:
            found = list(value.items()) if isinstance(value, dict) else []
        else:
            found = [(None, x) for x in (value if isinstance(value, list) else [value])]
        for pos, (name, item) in enumerate(found):
            if isinstance(item, str) and rule.scalar_as:
                item = {rule.scalar_as: item}
            if not isinstance(item, dict):
                continue
            own, path = f"{pk}/{rule.tag}:{pos}", (*at, pos)
            payload = {c: name if rule.key_as and c == rule.key_as else _scalar(item.get(c)) for c in rule.columns}
            yield rule.tag, record, own, pk, list(path), json.dumps(payload, ensure_ascii=False)
            yield from visit(rule.children, item, record, own, path)


def emit(df: DataFrame, key: str, payload: str, root: Rule) -> DataFrame:
    """One pass over ``df``: rows for the record itself (``root.tag``) and all nodes below it.

    Rows with a null key and payloads that cannot be read whole give no rows. Other columns of ``df``
    are not read. Repeated rows give equal emissions, which ``read_tag`` removes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tag", "record_id", "pk", "parent_pk", "path", "payload"]
        rows = (row for batch in batches for record, text in zip(batch["k"], batch["p"]) for row in of_record(record, text))
        while held := list(islice(rows, ROWS_HELD)):
            yield pd.DataFrame(held, columns=names)

    def of_record(record: str | None, text: str | None) -> Iterator[tuple]:
        node = read_record(text) if record is not None else None
        if node is not None:
            head = {c: _scalar(node.get(c)) for c in root.columns}
            yield root.tag, record, record, None, [], json.dumps(head, ensure_ascii=False)
            yield from visit(root.children, node, record, record, ())

    return df.select(F.col(key).cast("string").alias("k"), F.col(payload).cast("string").alias("p")).mapInPandas(run, EMITTED)


def write_tagged(emitted: DataFrame, path: str | None = None) -> str:
    """Write the emission partitioned by tag; gives the path (a scratch path by default)."""
    path = path or scratch_path(emitted.sparkSession, "tagged")
    emitted.write.partitionBy("tag").parquet(path)
    return path


def read_tag(spark: SparkSession, path: str, tag: str, columns: dict[str, str], payload: bool = True) -> DataFrame:
    """The flat table of one tag: keys, positions and the payload's fields with their types.

    ``columns`` gives the Spark type of each field; a value that does not fit its type is null. A decimal
    comma in a number is read as a point. Each key comes once, however often its record was delivered.
    """
    layout = schema("record_id string, pk string, parent_pk string, path array<int>, payload string, tag string")
    rows = spark.read.schema(layout).parquet(path).where(F.col("tag") == tag)
    if not payload:
        return rows.select("record_id", "pk", "parent_pk", "path").dropDuplicates(["pk"])
    fields = F.from_json("payload", T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rows = rows.dropDuplicates(["pk"]).withColumn("f", fields)
    typed = []
    for c, kind in columns.items():
        text = F.col("f").getField(c)
        if kind in ("double", "float"):
            text = F.regexp_replace(F.trim(text), r"^([-+]?\d+),(\d+)$", "$1.$2")
        typed.append((text if kind == "string" else text.try_cast(kind)).alias(c))
    return rows.select("record_id", "pk", "parent_pk", "path", *typed)
