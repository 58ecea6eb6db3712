"""Columns from a JSON Schema: what the JSON codec reads of objects that it describes."""

from __future__ import annotations

import json

from pyspark.sql import types as T

SIMPLE = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
#: Noted on columns that hold JSON text.
JSON_TEXT = {"json": True}


def columns_of(schema: str, scalar: bool = False) -> T.StructType:
    """The properties in their order: integers, numbers, truth values, base64 content as bytes, objects and arrays as JSON text, the rest as text.

    A property is nullable unless it is required, or if ``null`` is among its types; of several other types the first
    counts. ``$ref`` is followed within the document. With ``scalar`` the whole schema is of one column, ``value``.
    """
    try:
        root = json.loads(schema)
    except json.JSONDecodeError as e:
        raise ValueError(f"not a JSON Schema: {e}") from None
    if not isinstance(root, dict):
        raise ValueError("not a JSON Schema: no object")
    if scalar:
        return T.StructType([_column("value", root, False, root)])
    properties = root.get("properties")
    if not isinstance(properties, dict):
        raise ValueError("the schema of an object has properties")
    required = root.get("required")
    needed = {n for n in required if isinstance(n, str)} if isinstance(required, list) else set()
    return T.StructType([_column(name, p, name not in needed, root) for name, p in properties.items()])


def json_columns(schema: T.StructType) -> tuple[str, ...]:
    """Those that hold JSON text, which the codec embeds as it is."""
    return tuple(f.name for f in schema.fields if f.metadata.get("json"))


def _column(name: str, declared, nullable: bool, root: dict) -> T.StructField:
    found = _followed(name, declared, root)
    kinds = found.get("type")
    if isinstance(kinds, list):
        nullable = nullable or "null" in kinds
        kinds = next((k for k in kinds if k != "null"), None)
    if kinds in SIMPLE:
        return T.StructField(name, SIMPLE[kinds], nullable)
    if kinds in ("object", "array"):
        return T.StructField(name, T.StringType(), nullable, JSON_TEXT)
    return T.StructField(name, T.BinaryType() if found.get("contentEncoding") == "base64" else T.StringType(), nullable)


def _followed(name: str, declared, root: dict) -> dict:
    """What a declaration, or the last of a chain of references, says."""
    seen = set()
    while isinstance(declared, dict) and "$ref" in declared:
        where = declared["$ref"]
        if not isinstance(where, str) or not where.startswith("#/") or where in seen:
            raise ValueError(f"property {name}: can't follow {where}")
        seen.add(where)
        declared = root
        for step in where[2:].split("/"):
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(declared, dict) or step not in declared:
                raise ValueError(f"property {name}: there is no {where}")
            declared = declared[step]
    if not isinstance(declared, dict):
        raise ValueError(f"property {name} isn't declared by an object")
    return declared
