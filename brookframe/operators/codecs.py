"""Codecs between record values and payload columns. Spark deals the rows; only the byte formats are left to Arrow and gzip."""

from __future__ import annotations

import gzip
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brookframe.functions.exact import require
from brookframe.sources.topics import BATCH, RESERVED, payload_names, to_payload

MOST_RECORD, MOST_GUNZIPPED = 900 * 1024, 16 << 20
NESTED = (T.StructType, T.ArrayType, T.MapType)


def text_schema(schema: T.StructType) -> T.StructType:
    """JSON holds binary as base64 and nested values as JSON text."""
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.BinaryType, *NESTED)) else f.dataType, True) for f in schema.fields])


def is_object(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*\{"), F.lit(False))


def json_text(value: Column, schema: T.StructType) -> Column:
    """The object that a value is; with a schema of one column named ``value``, anything else is that column."""
    text = value.cast("string")
    return F.when(is_object(text), text).otherwise(F.concat(F.lit('{"value":'), text, F.lit("}"))) if schema.names == ["value"] else text


def json_decode(records: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """One row per record: an object's fields as columns. A value that isn't such an object, or a null in a field that is required, raises.

    With a schema of one column named ``value``, a number, text, truth value or array stands for itself (an array as JSON text).
    """
    parsed = F.from_json(json_text(F.col(value), schema), text_schema(schema), {"mode": "FAILFAST"})
    rest = [c for c in records.columns if c != value]
    rows = records.select(*rest, parsed.alias("_json"))

    def read(f: T.StructField) -> Column:
        column = F.col("_json")[f.name]
        if isinstance(f.dataType, T.BinaryType):
            column = F.unbase64(column)
        if not f.nullable:
            column = F.when(column.isNull(), F.raise_error(F.lit(f"{f.name} is required"))).otherwise(column)
        return column.alias(f.name)

    return rows.select(*(read(f) for f in schema.fields), *rest)


def json_encode(rows: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """A ``value`` column with the payload as JSON; texts in ``json_columns`` are JSON already and are embedded; a single column named ``value`` is written without its name. Metadata stays beside it."""
    payload = to_payload(rows)

    def written(c: str, f: T.StructField) -> Column:
        if f.name in json_columns:
            return F.parse_json(F.col(f"`{c}`")).alias(f.name)
        return (F.base64(F.col(f"`{c}`")) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{c}`")).alias(f.name)

    body = F.to_json(F.struct(*(written(c, f) for c, f in zip(payload_names(rows), payload.schema.fields))))
    if payload_names(rows) == ["value"]:
        body = F.coalesce(F.nullif(F.regexp_extract(body, r'(?s)^\{"value":(.*)\}$', 1), F.lit("")), F.lit("null"))
    return rows.select(body.alias("value"), *(c for c in (*RESERVED, BATCH) if c in rows.columns))


def pinned_schema(records: DataFrame, value: str = "value") -> T.StructType:
    """Infers the schema once, from the first value that is not null, by partition and offset where records have them; the caller keeps it. Without any value there is nothing to pin."""
    order = [c for c in ("__partition", "__offset") if c in records.columns]
    values = records.filter(F.col(value).isNotNull())
    texts = (values.orderBy(*order) if order else values).select(F.col(value).cast("string").alias("t"))
    if not (first := texts.head(1)):
        raise ValueError("no values to infer a schema from")
    sample = F.lit(first[0].t)
    return records.sparkSession.range(1).select(F.from_json(sample, F.schema_of_json(sample)).alias("v")).schema["v"].dataType


def _ipc(batch: pa.RecordBatch | pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write(batch)
    return out.getvalue()


def _plain(schema: T.StructType) -> pa.Schema:
    """The columns of a stream, without what Spark notes about them."""
    return pa.schema([pa.field(f.name, f.type, f.nullable) for f in to_arrow_schema(schema)])


def stream_bytes(schema: T.StructType, rows: list[tuple]) -> int:
    """The bytes of an Arrow stream of these rows."""
    target = _plain(schema)
    return len(_ipc(pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)))


def ipc_decode(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Each ``value`` is an Arrow stream of any number of rows; they get their record's metadata. A stream of another schema raises."""
    target = to_arrow_schema(schema)
    meta = [c for c in records.columns if c != "value"]
    out = T.StructType([*schema.fields, *(records.schema[c] for c in meta)])

    def run(batches):
        for batch in batches:
            streams, counts = [], []
            for value in batch.column("value"):
                if not value.is_valid:
                    raise ValueError("a null value is no Arrow stream")
                rows = pa.ipc.open_stream(value.as_buffer()).read_all()
                if rows.schema.names != target.names:
                    raise ValueError(f"a stream has columns {rows.schema.names}, expected {target.names}")
                streams.append(rows if rows.schema.equals(target) else rows.cast(target))
                counts.append(rows.num_rows)
            if streams:
                at = pa.array(np.repeat(np.arange(len(counts)), counts))
                whole = pa.concat_tables(streams).combine_chunks()  # else each stream stays a batch of its own
                yield from pa.Table.from_arrays([*whole.columns, *(batch.column(c).take(at) for c in meta)], [*target.names, *meta]).to_batches()

    return records.mapInArrow(run, out)


def _longest(part: pa.RecordBatch, most: int) -> tuple[bytes, int]:
    """The most of the first rows whose stream has at most ``most`` bytes, by halving what is left to choose from.

    What can't fit by the bytes of its values alone isn't written out, so no try is much larger than a record.
    """
    best, low, high = (b"", 0), 1, part.num_rows
    probe = min(high, max(1, most * high // max(part.nbytes, 1)))
    while low <= high:
        tried = part.slice(0, probe).take(pa.array(np.arange(probe)))  # a copy, as a slice drags along some of what is beside it
        bitmaps = len(part.schema.names) * (probe // 8 + 64)  # they may be left out
        data = _ipc(tried) if tried.nbytes - bitmaps <= most else b""
        if data and len(data) <= most:
            best, low = (data, probe), probe + 1
        else:
            high = probe - 1
        probe = (low + high) // 2
    if not best[1]:
        raise ValueError(f"one row takes {len(_ipc(part.slice(0, 1)))} bytes, over {most}")
    return best


RUN = ("__partition", BATCH, "__key", "__timestamp", "__headers")


def _starts(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row begins a run: it differs from the row before (null equals null); the first is compared with the last of ``before``."""
    starts = np.zeros(batch.num_rows, bool)
    starts[0] = before is None or any(batch.column(c)[0].as_py() != before.column(c)[before.num_rows - 1].as_py() for c in RUN)
    for c in RUN:
        own, prior = batch.column(c)[1:], batch.column(c)[:-1]
        same = pc.or_(pc.fill_null(pc.equal(own, prior), False), pc.and_(own.is_null(), prior.is_null()))
        starts[1:] |= ~same.to_numpy(zero_copy_only=False)
    return starts


def blob_encode(rows: DataFrame, most: int = MOST_RECORD) -> DataFrame:
    """Packs runs of rows as Arrow streams of at most ``most`` bytes each; each takes as many of a run's next rows as fit, and one row over it raises.

    A run is consecutive rows of a poll that share key, timestamp and headers. A poll of a partition is one unit of
    work: its rows are sorted by offset in one task, which cuts the runs as the rows come by and holds one at a time.
    """
    names = payload_names(rows)
    target = _plain(rows.select(*(F.col(f"`{c}`") for c in names)).schema)
    keep = ("__key", "__timestamp", "__headers", "__partition")
    # by number, so that packing, which takes longer than its few bytes tell, isn't put together in few tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*names, *keep, BATCH, "__offset").repartition(tasks, "__partition", BATCH).sortWithinPartitions("__partition", BATCH, "__offset").drop("__offset")

    def plain(part: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
        whole = pa.Table.from_arrays([part.column(c) for c in names], schema=target).combine_chunks()
        return whole.to_batches()[0]

    def split(part: pa.RecordBatch) -> list[tuple[bytes, int]]:
        out, at = [], 0
        while at < part.num_rows:
            data, n = _longest(part.slice(at), most)
            out.append((data, n))
            at += n
        return out

    def packed(run: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = run[0] if len(run) == 1 else pa.Table.from_batches(run)
        found = split(plain(part))
        meta = run[0].select(keep).take(pa.array(np.zeros(len(found), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), *meta.columns, pa.array([n for _, n in found], pa.int32())], ["value", *keep, "n_rows"])

    def cut(batches):
        run: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.flatnonzero(_starts(batch, run[-1] if run else None))
            ends = np.append(at, batch.num_rows)
            if run and (not len(at) or at[0]):
                run.append(batch.slice(0, int(ends[0])))
            if run and len(at):
                yield packed(run)
            whole, payload = at[:-1], plain(batch)
            found = [split(payload.slice(int(a), int(b - a))) for a, b in zip(whole, ends[1:-1])]
            meta = batch.select(keep).take(pa.array(np.repeat(whole, [len(x) for x in found]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([v for x in found for v, _ in x], pa.binary()), *meta.columns, pa.array([n for x in found for _, n in x], pa.int32())], ["value", *keep, "n_rows"])
            if len(at):
                run = [batch.slice(int(at[-1]))]
        if run:
            yield packed(run)

    return ordered.mapInArrow(cut, "value binary, __key binary, __timestamp long, __headers binary, __partition int, n_rows int")


def gzip_values(records: DataFrame) -> DataFrame:
    """Each value compressed; nulls stay null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("value")
            packed = [None if v.as_py() is None else gzip.compress(v.as_py(), mtime=0) for v in batch.column(at)]
            yield batch.set_column(at, "value", pa.array(packed, pa.binary()))

    return records.mapInArrow(run, records.schema)


def gunzip_values(records: DataFrame, most: int = MOST_GUNZIPPED) -> DataFrame:
    """Each value decompressed; one of over ``most`` bytes raises before it is whole in memory."""

    def run(batches):
        for batch in batches:
            at, out = batch.schema.get_field_index("value"), []
            for v in batch.column(at):
                data = None if v.as_py() is None else gzip.GzipFile(fileobj=io.BytesIO(v.as_py())).read(most + 1)
                if data is not None and len(data) > most:
                    raise ValueError(f"a value has over {most} bytes when decompressed")
                out.append(data)
            yield batch.set_column(at, "value", pa.array(out, pa.binary()))

    return records.mapInArrow(run, records.schema)


def checked_length(value: Column, most: int = MOST_RECORD) -> Column:
    return require(value, F.length(value) <= most, f"a record has over {most} bytes")
