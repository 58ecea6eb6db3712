"""Grouped aggregation, per logical partition, with exact sums; cumulative by batch; in event-time windows.

State belongs to a logical partition, so one key in two partitions is two groups. With ``by_batch`` each batch emits
every group that is retained, as a running aggregate; without it all rows are one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions.exact import INTEGRAL, RAW_TIME, WIDE, exact_cast, floor_to, from_raw, raw, require
from brookframe.functions.tagged import tagged_column
from brookframe.sources.topics import BATCH

COUNT, SUM, MIN, MAX = "count", "sum", "min", "max"
START, END = "__window_start", "__window_end"
PARTITION, TIME = "__partition", "__timestamp"


@dataclass(frozen=True)
class Agg:
    """One aggregate: count (all rows, nulls too), sum, min or max of a column; ``kind`` overrides the output type (default: the input's, for a count long)."""

    how: str
    column: str
    name: str
    kind: T.DataType | None = None

    def __post_init__(self):
        if self.how not in (COUNT, SUM, MIN, MAX):
            raise ValueError(f"unknown aggregate {self.how}")

    def source(self, df: DataFrame) -> T.DataType:
        if self.column not in df.columns:
            raise ValueError(f"no column {self.column}")
        return df.schema[self.column].dataType

    def partial(self, df: DataFrame) -> Column:
        """Exact in any order of rows: integers (and texts of digits) sum as decimal(38,0)."""
        kind, value = self.source(df), F.col(f"`{self.column}`")
        if self.how == COUNT:
            return F.count(F.lit(1))
        if self.how in (MIN, MAX):
            return (F.min if self.how == MIN else F.max)(value)
        if isinstance(kind, T.BooleanType):
            if self.kind is None:
                raise TypeError("a sum of booleans needs a numeric output type")
            return F.sum(value.cast("int").cast(WIDE))
        if isinstance(kind, T.StringType):
            return F.sum(exact_cast(value, kind, T.LongType()).cast(WIDE))
        if isinstance(kind, INTEGRAL + RAW_TIME):
            return F.sum(raw(value, kind).cast(WIDE))
        return F.sum(value.cast("double") if isinstance(kind, T.FloatType) else value)

    def merged(self, partial: Column) -> Column:
        return {COUNT: F.sum, SUM: F.sum, MIN: F.min, MAX: F.max}[self.how](partial)

    def final(self, df: DataFrame, value: Column) -> Column:
        """Range-checked cast of the merged value to the output type."""
        kind = self.source(df)
        if self.how == COUNT:
            return value.cast(self.kind or T.LongType())
        if self.how in (MIN, MAX):
            return value if self.kind is None else exact_cast(value, kind, self.kind)
        out = self.kind or kind
        if isinstance(out, RAW_TIME):
            return from_raw(value, out)
        if isinstance(kind, T.DecimalType) and isinstance(out, INTEGRAL):
            return exact_cast(value, kind, out)
        return value.cast(out)


def check_groups(df: DataFrame, keys: list[str], windowed: bool) -> None:
    if not keys:
        raise ValueError("grouping needs at least one key")
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    if windowed and (clash := {START, END} & set(df.columns)):
        raise ValueError(f"the input has {', '.join(sorted(clash))} already")
    if windowed and TIME not in df.columns:
        raise ValueError(f"windows need {TIME}")


def _emit(df: DataFrame, partials: DataFrame, by: list[str], aggs: list[Agg], clock: DataFrame, kept: DataFrame) -> DataFrame:
    """Running aggregates of the groups at each batch of their partition from their first on, while retained.

    ``kept`` says how many of its partition's batches, from the first of all, retain a group. A row stands for the
    batches from its own up to its group's next or the end of retention. They are laid out last and not shuffled, so
    disk goes by the partial aggregates, however many batches emit them again. The clock is broadcast.
    """
    numbered = clock.select(PARTITION, BATCH, (F.row_number().over(Window.partitionBy(PARTITION).orderBy(BATCH)) - 1).alias("__place"))
    placed = partials.join(F.broadcast(numbered), [PARTITION, BATCH]).join(kept, [c for c in kept.columns if c != "__kept"]).filter(F.col("__place") < F.col("__kept"))
    # by number, as tasks of few bytes, which would be put together, can lay out many rows
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = Window.partitionBy(*by).orderBy("__place")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    running = placed.repartition(tasks, *by).select(
        *by, "__place", F.least(F.lead("__place").over(along), F.col("__kept")).alias("__until"), *(a.final(df, a.merged(F.col(a.name)).over(so_far)).alias(a.name) for a in aggs)
    )
    laid = running.withColumn("__place", F.explode(F.sequence("__place", F.col("__until") - 1)))
    return laid.join(F.broadcast(numbered), [PARTITION, "__place"]).select(*by, BATCH, *(a.name for a in aggs))


def stream_clock(df: DataFrame) -> DataFrame:
    """Per partition and batch, the greatest timestamp up to and with that batch: one row for each pair, so a small table."""
    each = df.groupBy(PARTITION, BATCH).agg(F.max(TIME).alias("t"))
    return each.select(PARTITION, BATCH, F.max("t").over(Window.partitionBy(PARTITION).orderBy(BATCH).rowsBetween(Window.unboundedPreceding, 0)).alias("stream_time"))


def group_by_tag(df: DataFrame, keys: list[str], aggs: list[Agg], unsigned: tuple[str, ...] = ()) -> DataFrame:
    """:func:`group_by` with keys that are one only if their tagged bytes are: -0.0 and 0.0 are two groups, decimals are one by value."""
    check_groups(df, keys, False)
    tags = {f"_tag{i}": tagged_column(df, k, unsigned) for i, k in enumerate(keys)}
    grouped = df.withColumns(tags).groupBy(PARTITION, *tags).agg(*(F.any_value(F.col(f"`{k}`")).alias(f"_key{i}") for i, k in enumerate(keys)), *(a.partial(df).alias(a.name) for a in aggs))
    return grouped.select(*(F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)), *(a.final(df, F.col(a.name)).alias(a.name) for a in aggs))


def group_by(df: DataFrame, keys: list[str], aggs: list[Agg], by_batch: bool = False) -> DataFrame:
    """Groups of ``keys`` within each partition; the partition itself is only in the result if it is a key."""
    check_groups(df, keys, False)
    by = list(dict.fromkeys([PARTITION, *keys]))
    out = [*keys, *(a.name for a in aggs)]
    if by_batch:
        partials = df.groupBy(*by, BATCH).agg(*(a.partial(df).alias(a.name) for a in aggs))
        clock = df.select(PARTITION, BATCH).distinct()
        kept = F.broadcast(clock.groupBy(PARTITION).agg(F.count("*").cast("int").alias("__kept")))
        return _emit(df, partials, by, aggs, clock, kept).select(BATCH, *out)
    grouped = df.groupBy(*by).agg(*(a.partial(df).alias(a.name) for a in aggs))
    return grouped.select(*keys, *(a.final(df, F.col(a.name)).alias(a.name) for a in aggs))


def first_appearance(df: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """:func:`group_by` with ``__first``, the least offset at which a group appears in its partition; sort by it where the order of groups is seen."""
    by = list(dict.fromkeys([PARTITION, *keys]))
    grouped = df.groupBy(*by).agg(*(a.partial(df).alias(a.name) for a in aggs), F.min("__offset").alias("__first"))
    return grouped.select(*keys, "__first", *(a.final(df, F.col(a.name)).alias(a.name) for a in aggs))


def with_window(df: DataFrame, size: int) -> DataFrame:
    """Adds the bounds of the tumbling window of each row; a null timestamp raises."""
    ts = require(F.coalesce(TIME, F.lit(0)), F.col(TIME).isNotNull(), "a row has no timestamp")
    return df.withColumn(START, floor_to(ts, size)).withColumn(END, F.col(START) + size)


def windowed_group_by(df: DataFrame, keys: list[str], size: int, aggs: list[Agg], retention: int | None = None, by_batch: bool = False) -> DataFrame:
    """Groups per epoch-aligned tumbling window of ``size`` ms. A window is retained while its end is not under the
    partition's stream time less ``retention`` (default: size); rows of windows already dropped are left out."""
    retention = size if retention is None else retention
    if size < 1 or retention < size:
        raise ValueError("a window has at least 1 ms, and retention at least its size")
    check_groups(df, keys, True)
    by = list(dict.fromkeys([PARTITION, *keys])) + [START, END]
    out = [*keys, START, END, *(a.name for a in aggs)]
    rows = with_window(df, size)
    if not by_batch:
        last = df.groupBy(PARTITION).agg(F.max(TIME).alias("stream_time"))
        grouped = rows.groupBy(*by).agg(*(a.partial(df).alias(a.name) for a in aggs))
        kept = grouped.join(last, PARTITION).filter(F.col(END) >= F.col("stream_time") - retention)
        return kept.select(*keys, START, END, *(a.final(df, F.col(a.name)).alias(a.name) for a in aggs))
    clock = stream_clock(df)
    partials = rows.groupBy(*by, BATCH).agg(*(a.partial(df).alias(a.name) for a in aggs))
    # stream time never falls, so the batches that retain a window are the first ones, as many as have their cutoff up to its end
    cutoffs = clock.select(PARTITION, (F.col("stream_time") - retention).alias("at"), F.lit(None).cast("long").alias(END))
    ends = rows.select(PARTITION, F.col(END).alias("at"), END).distinct()
    up_to = Window.partitionBy(PARTITION).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = cutoffs.unionByName(ends).withColumn("__kept", F.count_if(F.col(END).isNull()).over(up_to).cast("int")).filter(F.col(END).isNotNull()).select(PARTITION, END, "__kept")
    return _emit(df, partials, by, aggs, clock, kept).select(BATCH, *out)
