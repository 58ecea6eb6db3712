"""Topics as DataFrames: payload columns, then where each row came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The metadata columns of a decoded record, in order.
RESERVED = {"__key": T.BinaryType(), "__timestamp": T.LongType(), "__partition": T.IntegerType(), "__offset": T.LongType(), "__headers": T.BinaryType()}
BATCH = "__batch"
ESCAPED = "__payload_"
_ORIGINAL = "payload.name"


def payload_column(name: str) -> str:
    """The name under which a payload column is found: one named like metadata is escaped."""
    return ESCAPED + name if name in RESERVED else name


def escape(payload: DataFrame) -> DataFrame:
    """Renames payload columns that are named like metadata and notes the name they had."""
    return payload.select(*(F.col(f"`{c}`").alias(payload_column(c), metadata={_ORIGINAL: c}) if c in RESERVED else F.col(f"`{c}`") for c in payload.columns))


def payload_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED and c != BATCH]


def original_name(df: DataFrame, name: str) -> str:
    return df.schema[name].metadata.get(_ORIGINAL, name)


def to_payload(df: DataFrame) -> DataFrame:
    """What a sink writes: the payload with the names it came with."""
    return df.select(*(F.col(f"`{c}`").alias(original_name(df, c)) for c in payload_names(df)))


def as_topic(payload: DataFrame, *, key: Column | None = None, timestamp_ms: Column, partition: Column, offset: Column, headers: Column | None = None, batch: Column | None = None) -> DataFrame:
    """Payload rows with metadata columns; ``batch`` says which poll a row belongs to (default: one for all)."""
    named = escape(payload)
    values = {"__key": key if key is not None else F.lit(None), "__timestamp": timestamp_ms, "__partition": partition, "__offset": offset, "__headers": headers if headers is not None else F.lit(None)}
    source = payload.select(*(F.col(f"`{c}`").alias(payload_column(c)) for c in payload.columns), *(v.cast(RESERVED[c]).alias(c) for c, v in values.items()), (batch if batch is not None else F.lit(0)).cast("long").alias(BATCH))
    return source.select(*(F.col(f"`{c}`").alias(c, metadata=named.schema[c].metadata) if c in named.columns else F.col(c) for c in source.columns))


def read_topics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several topic tables of one schema as one, in the order of their names."""
    if not paths:
        raise ValueError("a source has at least one topic")
    return merge(*(spark.read.parquet(p) for p in sorted(paths)))


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs, whose schemas must be the same; an input given twice counts twice."""
    if len(frames) < 2 and not frames:
        raise ValueError("nothing to merge")
    first = [(f.name, f.dataType) for f in frames[0].schema.fields]
    for other in frames[1:]:
        if [(f.name, f.dataType) for f in other.schema.fields] != first:
            raise ValueError(f"schemas differ: {frames[0].schema.simpleString()} and {other.schema.simpleString()}")
    return reduce(DataFrame.union, frames)


def normalise_tombstones(records: DataFrame, drop: bool = False) -> DataFrame:
    """Null values become empty ones, or are dropped."""
    return records.filter("value is not null") if drop else records.withColumn("value", F.coalesce("value", F.lit(b"")))


def pass_through(records: DataFrame, topic: str) -> DataFrame:
    """Undecoded records for another topic: key, value, timestamp and headers untouched."""
    return records.select(F.lit(topic).alias("topic"), "key", "value", "timestamp", "headers")
