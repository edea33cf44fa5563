"""Schemas from short strings, without a session: workers need them too."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import types as T

_PLAIN = {
    "bigint": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(),
}


def _split(text: str) -> list[str]:
    """Parts between commas that lie outside all angle brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in (*parts, text[start:]) if p.strip()]


def data_type(text: str) -> T.DataType:
    """``array<...>``, ``map<...,...>``, ``struct<name:type,...>`` or a plain type."""
    text = text.strip()
    if text in _PLAIN:
        return _PLAIN[text]
    kind, _, inner = text.partition("<")
    if not inner.endswith(">"):
        raise ValueError(f"unknown type {text!r}")
    inner = inner[:-1]
    if kind == "array":
        return T.ArrayType(data_type(inner))
    if kind == "map":
        return T.MapType(*map(data_type, _split(inner)))
    if kind == "struct":
        return T.StructType([T.StructField(name.strip(), data_type(rest)) for name, _, rest in (p.partition(":") for p in _split(inner))])
    raise ValueError(f"unknown type {text!r}")


@lru_cache(maxsize=256)
def columns(text: str) -> T.StructType:
    """``name type, name type, ...``."""
    return T.StructType([T.StructField(name, data_type(rest)) for name, _, rest in (p.partition(" ") for p in _split(text))])
