"""Schema-framed Avro values and typed columns. Spark deals the records; each value is read by small functions built from its schema."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brookframe.sources.topics import payload_names

PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
#: Which written types a reader of another type accepts.
PROMOTED = {"long": {"int"}, "float": {"int", "long"}, "double": {"int", "long", "float"}, "string": {"bytes"}, "bytes": {"string"}}


def _nullable(schema) -> tuple[object, bool]:
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1 or len(schema) > 2:
            raise ValueError("a union is null and one other type")
        return rest[0], "null" in schema
    return schema, False


def spark_type(schema) -> T.DataType:
    """The column type of an Avro schema (parsed JSON): plain types, records, arrays, maps, enums, fixed, nullable unions."""
    inner, _ = _nullable(schema)
    kind = inner["type"] if isinstance(inner, dict) else inner
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    if kind in PLAIN:
        return PLAIN[kind]
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"]), _nullable(f["type"])[1]) for f in inner["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(inner["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(inner["values"]))
    if kind in ("enum", "fixed"):
        return T.StringType() if kind == "enum" else T.BinaryType()
    raise ValueError(f"no column type for Avro {kind}")


def _read_long(data: io.BytesIO) -> int:
    shift = value = 0
    while True:
        b = data.read(1)[0]
        value |= (b & 127) << shift
        if b < 128:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _write_long(out: io.BytesIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 127:
        out.write(bytes([n & 127 | 128]))
        n >>= 7
    out.write(bytes([n]))


def _read_bytes(data: io.BytesIO) -> bytes:
    return data.read(_read_long(data))


def _items(data: io.BytesIO, one: Callable) -> list:
    out = []
    while n := _read_long(data):
        if n < 0:
            n = -n
            _read_long(data)
        out += [one(data) for _ in range(n)]
    return out


_READ = {
    "null": lambda d: None, "boolean": lambda d: d.read(1) == b"\1", "int": _read_long, "long": _read_long, "float": lambda d: struct.unpack("<f", d.read(4))[0],
    "double": lambda d: struct.unpack("<d", d.read(8))[0], "bytes": _read_bytes, "string": lambda d: _read_bytes(d).decode(),
}


def reader(writer, target=None) -> Callable[[io.BytesIO], object]:
    """A function that reads values of ``writer``; with ``target``, as that schema sees them: fields by name, defaults for missing ones, promoted numbers."""
    if isinstance(writer, list):
        branches = [reader(w, target) if w != "null" else _READ["null"] for w in writer]
        return lambda d: branches[_read_long(d)](d)
    target = writer if target is None else _nullable(target)[0]
    kind, wanted = (s["type"] if isinstance(s, dict) else s for s in (writer, target))
    if isinstance(kind, (dict, list)):
        return reader(kind, wanted)
    if kind != wanted and kind not in PROMOTED.get(wanted, ()):
        raise ValueError(f"{wanted} can't be read from {kind}")
    if kind == "record":
        own = {f["name"]: f for f in target["fields"]}
        steps = [(f["name"], reader(f["type"], own[f["name"]]["type"] if f["name"] in own else None)) for f in writer["fields"]]
        missing = [f for f in target["fields"] if f["name"] not in dict(steps)]
        if bad := [f["name"] for f in missing if "default" not in f]:
            raise ValueError(f"no value for {', '.join(bad)}")
        defaults = {f["name"]: f["default"] for f in missing}

        def record(d):
            read = {name: step(d) for name, step in steps}
            return {name: read[name] if name in read else defaults[name] for name in own}

        return record
    if kind == "array":
        one = reader(writer["items"], target["items"])
        return lambda d: _items(d, one)
    if kind == "map":
        value = reader(writer["values"], target["values"])
        return lambda d: list(_items(d, lambda x: (_READ["string"](x), value(x))))
    if kind == "enum":
        return lambda d: writer["symbols"][_read_long(d)]
    if kind == "fixed":
        return lambda d: d.read(writer["size"])
    if kind != wanted and wanted in ("string", "bytes"):
        return (lambda d: _read_bytes(d).decode()) if wanted == "string" else _read_bytes
    return (lambda d: float(_read_long(d))) if wanted in ("float", "double") and kind in ("int", "long") else _READ[kind]


def write(schema, value, out: io.BytesIO) -> None:
    """Writes a value of a schema."""
    if isinstance(schema, list):
        at = schema.index("null") if value is None else next(i for i, s in enumerate(schema) if s != "null")
        _write_long(out, at)
        return None if value is None else write(schema[at], value, out)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if value is None:
        raise ValueError(f"null where {kind} is required")
    if isinstance(kind, (dict, list)):
        write(kind, value, out)
    elif kind == "record":
        for f in schema["fields"]:
            write(f["type"], value[f["name"]], out)
    elif kind in ("int", "long"):
        _write_long(out, value)
    elif kind in ("string", "bytes"):
        data = value.encode() if kind == "string" else value
        _write_long(out, len(data))
        out.write(data)
    elif kind == "boolean":
        out.write(b"\1" if value else b"\0")
    elif kind in ("float", "double"):
        out.write(struct.pack("<f" if kind == "float" else "<d", value))
    elif kind == "enum":
        _write_long(out, schema["symbols"].index(value))
    elif kind == "fixed":
        if len(value) != schema["size"]:
            raise ValueError(f"not {schema['size']} bytes")
        out.write(value)
    else:
        entries = list(value)
        if entries:
            _write_long(out, len(entries))
        for x in entries:
            if kind == "map":
                write("string", x[0], out)
            write(schema["values"], x[1], out) if kind == "map" else write(schema["items"], x, out)
        _write_long(out, 0)


def avro_encode(rows: DataFrame, schema: str, schema_id: int) -> DataFrame:
    """Payload columns as framed Avro in ``value``; all other columns stay."""
    spec, names = json.loads(schema), payload_names(rows)
    rest = [c for c in rows.columns if c not in names]
    head = b"\0" + schema_id.to_bytes(4, "big")

    def run(batches):
        for batch in batches:
            values = []
            for row in batch.select(names).to_pylist():
                out = io.BytesIO()
                write(spec, row, out)
                values.append(head + out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), *(batch.column(c) for c in rest)], ["value", *rest])

    return rows.mapInArrow(run, T.StructType([T.StructField("value", T.BinaryType()), *(rows.schema[c] for c in rest)]))


def avro_decode(records: DataFrame, schema: str, writers: dict[int, str]) -> DataFrame:
    """Columns of the reader's ``schema`` from framed values of any of ``writers`` (id to schema); an unknown id raises."""
    target, rest = json.loads(schema), [c for c in records.columns if c != "value"]
    columns = spark_type(target)
    arrow = to_arrow_schema(columns)

    def run(batches):
        readers: dict[int, Callable] = {}
        for batch in batches:
            found = []
            for value in batch.column("value").to_pylist():
                if not value or value[0] != 0 or len(value) < 5:
                    raise ValueError("not a framed value")
                number = int.from_bytes(value[1:5], "big")
                if number not in readers:
                    if number not in writers:
                        raise LookupError(f"schema {number} is not known")
                    readers[number] = reader(json.loads(writers[number]), target)
                found.append(readers[number](io.BytesIO(value[5:])))
            rows = [pa.array([r[f.name] for r in found], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*rows, *(batch.column(c) for c in rest)], [*arrow.names, *rest])

    return records.mapInArrow(run, T.StructType([*columns.fields, *(records.schema[c] for c in rest)]))


def compatible(new: str, old: str, mode: str = "backward") -> bool:
    """Whether values of ``old`` can be read by ``new`` (backward), the other way round (forward), or both (full)."""

    def reads(target: str, writer: str) -> bool:
        try:
            reader(json.loads(writer), json.loads(target))
        except (ValueError, KeyError):
            return False
        return True

    checks = {"backward": [(new, old)], "forward": [(old, new)], "full": [(new, old), (old, new)]}
    if mode not in checks:
        raise ValueError(f"unknown mode {mode}")
    return all(reads(*pair) for pair in checks[mode])
