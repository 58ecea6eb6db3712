"""Decoders that never raise: each adds what went wrong with a record as a column, so that the run decides about it.

``__error`` is null, or a class, a message, and whether trying again later could help. Decoders can follow one
another; the first error of a record stays, and what they decode of a record with an error is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brookframe.functions import binary
from brookframe.operators.codecs import is_object, json_text, text_schema
from brookframe.plans.cuts import parsed_cut

ERROR = "__error"
ERROR_TYPE = T.StructType([T.StructField("class", T.StringType()), T.StructField("message", T.StringType()), T.StructField("retriable", T.BooleanType())])
EMPTY, MALFORMED, MISSING, PENDING = "EmptyValue", "MalformedValue", "MissingField", "SchemaPending"
_CORRUPT = "__corrupt"


def failure(kind: str, message: Column | str, retriable: bool = False) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(kind).alias("class"), message.alias("message"), F.lit(retriable).alias("retriable")).cast(ERROR_TYPE)


def with_error(records: DataFrame, error: Column) -> DataFrame:
    """Adds ``error`` where a record has none yet."""
    return records.withColumn(ERROR, F.coalesce(ERROR, error) if ERROR in records.columns else error)


def _decoded(records: DataFrame, error: Column, columns: dict[str, Column]) -> DataFrame:
    marked = with_error(records, error)
    return marked.withColumns({name: F.when(F.col(ERROR).isNull(), column) for name, column in columns.items()})


def try_json(records: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The fields of a JSON object as columns in place of ``value``. No value, a value that isn't an object of these types, and a null in a required field are errors."""
    text = json_text(F.col(value), schema)
    permissive = T.StructType([*text_schema(schema).fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(text, permissive, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rest = [c for c in records.columns if c != value]
    rows = records.select(*(F.col(f"`{c}`") for c in rest), F.col(value).cast("string").alias("_text"), text.alias("_object"), parsed.alias("_json"))
    shown = F.concat(F.lit("not JSON of the schema: "), F.substring("_text", 1, 64))
    error = F.when(~F.coalesce(F.col("_text").rlike(r"\S"), F.lit(False)), failure(EMPTY, "a value has no bytes"))
    error = error.when(~is_object(F.col("_object")) | F.col("_json").isNull() | F.col(f"_json.{_CORRUPT}").isNotNull(), failure(MALFORMED, shown))
    for f in schema.fields:
        if not f.nullable:
            error = error.when(F.col("_json")[f.name].isNull(), failure(MISSING, f"{f.name} is required"))

    def read(f: T.StructField) -> Column:
        return F.unbase64(F.col("_json")[f.name]) if isinstance(f.dataType, T.BinaryType) else F.col("_json")[f.name]

    return _decoded(rows, error, {f.name: read(f) for f in schema.fields}).drop("_text", "_object", "_json")


def try_headers(records: DataFrame, packed: str = "__headers", to: str = "headers") -> DataFrame:
    """Packed headers as an array of (key, value)."""
    rows = records.withColumn("_parsed", binary.parsed_headers(F.col(packed)))
    error = F.when(F.col(packed).isNotNull() & F.col("_parsed").isNull(), failure(MALFORMED, "not packed headers"))
    return _decoded(rows, error, {to: F.col("_parsed")}).drop("_parsed")


def try_frame(records: DataFrame, known: list[int] | DataFrame, value: str = "value") -> DataFrame:
    """``schema_id`` and the body in place of a framed ``value``. An id that isn't ``known`` yet, as a list or a column ``schema_id``, can be tried again."""
    framed = binary.is_framed(F.col(value))
    id_ = F.when(framed, binary.read_int32(F.col(value), 2).cast("int"))
    rows = records.withColumn("schema_id", id_)
    if isinstance(known, DataFrame):
        rows = rows.join(known.select("schema_id", F.lit(True).alias("_known")).distinct(), "schema_id", "left")
    else:
        rows = rows.withColumn("_known", F.when(F.col("schema_id").isin(*known), True) if known else F.lit(None).cast("boolean"))
    error = F.when(~framed, failure(MALFORMED, "not a framed value")).when(F.col("_known").isNull(), failure(PENDING, F.concat(F.lit("no schema yet with id "), F.col("schema_id").cast("string")), True))
    body = F.substring(F.col(value), F.lit(6), F.length(value))
    return _decoded(rows, error, {"schema_id": F.col("schema_id"), value: body}).drop("_known")


def try_cut(records: DataFrame, key: str = "key", value: str = "value", to: str = "cut") -> DataFrame:
    """A record of the manifest as its cut; null, without an error, for records that carry none."""
    rows = records.withColumn("_parsed", parsed_cut(F.col(key), F.col(value)))
    error = F.when(F.col("_parsed.wrong").isNotNull(), failure(MALFORMED, F.col("_parsed.wrong")))
    return _decoded(rows, error, {to: F.col("_parsed.cut")}).drop("_parsed")


def try_ipc(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of each ``value``, an Arrow stream, in place of it; a record that is none, or one of another schema, is one row with its error. A record that has an error already isn't read."""
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    target = to_arrow_schema(nullable)
    meta = [c for c in records.columns if c not in ("value", ERROR)]
    out = T.StructType([*nullable.fields, *(records.schema[c] for c in meta), T.StructField(ERROR, ERROR_TYPE)])
    error_type = to_arrow_schema(T.StructType([T.StructField(ERROR, ERROR_TYPE)])).field(0).type

    def read(value: pa.Scalar) -> tuple[pa.Table, dict | None]:
        none = pa.table([pa.nulls(1, f.type) for f in target], schema=target)
        if not value.is_valid or not len(value.as_buffer()):
            return none, {"class": EMPTY, "message": "a value has no bytes", "retriable": False}
        try:
            rows = pa.ipc.open_stream(value.as_buffer()).read_all()
            if rows.schema.names != target.names:
                return none, {"class": MALFORMED, "message": f"a stream has columns {rows.schema.names}", "retriable": False}
            return rows if rows.schema.equals(target) else rows.cast(target), None
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
            return none, {"class": MALFORMED, "message": f"no Arrow stream: {e}"[:200], "retriable": False}

    def run(batches):
        for batch in batches:
            before = batch.column(ERROR).to_pylist() if ERROR in batch.schema.names else [None] * batch.num_rows
            none = pa.table([pa.nulls(1, f.type) for f in target], schema=target)
            found = [(none, e) if e else read(v) for v, e in zip(batch.column("value"), before)]
            if found:
                counts = [t.num_rows for t, _ in found]
                at = pa.array(np.repeat(np.arange(len(counts)), counts))
                whole = pa.concat_tables([t for t, _ in found]).combine_chunks()
                errors = pa.array([e for _, e in found], error_type).take(at)
                yield from pa.Table.from_arrays([*whole.columns, *(batch.column(c).take(at) for c in meta), errors], [*target.names, *meta, ERROR]).to_batches()

    return records.mapInArrow(run, out)
