"""Inner join of two topics on a key within an event-time window, per logical partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookframe.functions.exact import distance, family, raw
from brookframe.functions.tagged import tagged_column
from brookframe.operators.groups import PARTITION, TIME
from brookframe.sources.topics import BATCH, RESERVED, original_name, payload_names


def _meta(prefix: str, name: str) -> str:
    """Where a side's metadata is kept meanwhile; apart from a payload column that is named like metadata."""
    return f"meta of {prefix}{name}"


def _sided(df: DataFrame, prefix: str, key: str, by_tag: bool) -> DataFrame:
    names = {c: prefix + original_name(df, c) for c in payload_names(df)}
    meta = [c for c in (*RESERVED, BATCH) if c in df.columns]
    own = F.col(f"`{key}`")
    return df.select((F.when(own.isNotNull(), tagged_column(df, key)) if by_tag else raw(own, df.schema[key].dataType)).alias("k"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(F.col(c).alias(_meta(prefix, c)) for c in meta))


def shown_names(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str) -> list[str]:
    return [f"{left_prefix}{original_name(left, c)}" for c in payload_names(left)] + [f"{right_prefix}{original_name(right, c)}" for c in payload_names(right)]


def check_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, left_prefix: str, right_prefix: str) -> None:
    if window < 0:
        raise ValueError("a window is not negative")
    if left is right:
        raise ValueError("a node is not joined with itself")
    for df, key in ((left, left_key), (right, right_key)):
        if key not in df.columns:
            raise ValueError(f"no column {key}")
    shown = shown_names(left, right, left_prefix, right_prefix)
    if len(set(shown)) < len(shown):
        raise ValueError("both sides give a column of one name; choose other prefixes")


def windowed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, left_prefix: str = "left_", right_prefix: str = "right_", by_batch: bool = False, by_tag: bool = False) -> DataFrame:
    """Pairs of one partition and key whose timestamps differ by at most ``window`` ms.

    Columns: the left payload, the right payload (both prefixed), then the left row's metadata. Null keys and null
    timestamps match nothing; keys of different type families are never equal. With ``by_batch`` a pair comes out in
    the later of its two batches, unless the earlier row's batch had been dropped by then: its greatest timestamp
    was under the stream time of both sides less the window.

    Rows meet by partition, key and time slice (each left row looks into its own slice and the two beside it), so a
    hot key is split along time instead of pairing all its rows. With ``by_tag`` keys meet by their tagged bytes.
    """
    check_join(left, right, left_key, right_key, window, left_prefix, right_prefix)
    a, b = (_sided(df, prefix, key, by_tag) for df, prefix, key in ((left, left_prefix, left_key), (right, right_prefix, right_key)))
    shown = shown_names(left, right, left_prefix, right_prefix)
    meta = [c for c in RESERVED if c in left.columns]
    lt, rt, lp, rp = _meta(left_prefix, TIME), _meta(right_prefix, TIME), _meta(left_prefix, PARTITION), _meta(right_prefix, PARTITION)
    slice_ = max(window, 1)
    if not by_tag and family(left.schema[left_key].dataType) != family(right.schema[right_key].dataType):
        a = a.filter(F.lit(False))
    beside = [-1, 0, 1] if window else [0]
    at = F.floor(F.col(lt) / slice_) if window else F.col(lt)
    a = a.withColumn("slice", F.explode(F.array(*(at + i for i in beside))))
    b = b.withColumn("slice", F.floor(F.col(rt) / slice_) if window else F.col(rt)).withColumnRenamed("k", "rk")
    on = (F.col("k") == F.col("rk")) & (F.col(lp) == F.col(rp)) & (a["slice"] == b["slice"]) & (distance(F.col(lt), F.col(rt)) <= window)
    pairs = a.join(b, on)
    if by_batch:
        lb, rb = _meta(left_prefix, BATCH), _meta(right_prefix, BATCH)
        both = left.select(PARTITION, BATCH, TIME, F.lit(True).alias("l")).unionByName(right.select(PARTITION, BATCH, TIME, F.lit(False).alias("l")))
        tops = both.groupBy(PARTITION, BATCH).agg(F.max(TIME).alias("t"), F.max(F.when(F.col("l"), F.col(TIME))).alias("lmax"), F.max(F.when(~F.col("l"), F.col(TIME))).alias("rmax"))
        clock = tops.withColumn("stream_time", F.max("t").over(Window.partitionBy(PARTITION).orderBy(BATCH).rowsBetween(Window.unboundedPreceding, 0)))
        when = F.greatest(lb, rb)
        old = clock.select(F.col(PARTITION).alias("op"), F.col(BATCH).alias("ob"), "lmax", "rmax")
        now = clock.select(F.col(PARTITION).alias("np"), F.col(BATCH).alias("nb"), "stream_time")
        pairs = pairs.join(old, (F.col(lp) == F.col("op")) & (F.least(lb, rb) == F.col("ob"))).join(now, (F.col(lp) == F.col("np")) & (when == F.col("nb")))
        older = F.when(F.col(lb) < F.col(rb), F.col("lmax")).otherwise(F.col("rmax"))
        pairs = pairs.filter((F.col(lb) == F.col(rb)) | (older >= F.col("stream_time") - window))
        return pairs.select(*shown, *(F.col(_meta(left_prefix, c)).alias(c) for c in meta), when.alias(BATCH))
    return pairs.select(*shown, *(F.col(_meta(left_prefix, c)).alias(c) for c in meta))
