"""Schemas from short texts, without a running session (the built-in parser needs one)."""

from __future__ import annotations

from pyspark.sql import types as T

_ATOMS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _split(s: str) -> list[str]:
    """Parts between commas outside angle brackets."""
    out, depth, cur = [], 0, ""
    for c in s:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [p.strip() for p in [*out, cur] if p.strip()]


def data_type(s: str) -> T.DataType:
    s = s.strip()
    head, _, rest = s.partition("<")
    inner = rest[:-1]
    match head:
        case "array":
            return T.ArrayType(data_type(inner))
        case "map":
            return T.MapType(*map(data_type, _split(inner)))
        case "struct":
            return T.StructType([T.StructField(n.strip(), data_type(t)) for n, _, t in (p.partition(":") for p in _split(inner))])
        case _:
            return _ATOMS[s]


def schema(s: str) -> T.StructType:
    """'a int, b array<string>' as a schema."""
    return T.StructType([T.StructField(n, data_type(t)) for n, _, t in (p.partition(" ") for p in _split(s))])
