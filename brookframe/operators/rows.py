"""Row operators: filter, projection, derived columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions.exact import exact_cast
from brookframe.sources.topics import BATCH, RESERVED


@dataclass(frozen=True)
class Derived:
    """A column by expression, coerced to ``kind`` exactly."""

    name: str
    value: Column
    kind: T.DataType

    def __post_init__(self):
        if self.name in RESERVED or self.name == BATCH:
            raise ValueError(f"{self.name} is reserved")


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; it may use metadata columns."""
    return df.filter(predicate)


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named payload columns in order, each once, then the metadata columns that are there."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    kept = [*dict.fromkeys(names), *(c for c in (*RESERVED, BATCH) if c in df.columns and c not in names)]
    return df.select(*(F.col(f"`{c}`") for c in kept))


def with_derived(df: DataFrame, *derived: Derived) -> DataFrame:
    """New columns after all others; a name that exists is replaced in place. All expressions read the input, and of equal names the last counts."""
    last = {d.name: d for d in derived}
    kinds = df.select(*(d.value.alias(f"v{i}") for i, d in enumerate(last.values()))).schema.fields
    return df.withColumns({d.name: exact_cast(d.value, k.dataType, d.kind) for d, k in zip(last.values(), kinds)})
