"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookframe.llm.scratch import cut

#: So many links at most go through rounds in one partition, without shuffles; more are dealt over all tasks.
LINKS = 1 << 15


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """The edges and each node's least neighbour or itself. A sum by key: what a hub has is combined before the shuffle."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(F.broadcast(least) if few else least, "u")


def _size(edges: DataFrame) -> tuple:
    """Of the set of edges: how many, and two independent 64-bit sums over them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the least id it is linked with, directly or not) for each id other than its component's least.

    Each round is a few shuffles of the links that are left, or one task where these are at most ``LINKS``; nothing is
    gathered on the driver but three numbers.
    Null ends and self links are ignored; without links the result is empty.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    size = _size(edges)
    if 0 < size[0] <= LINKS:
        edges = cut(edges.coalesce(1))
    while size[0]:
        few = size[0] <= LINKS
        if few:
            edges = edges.coalesce(1)
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = _with_least(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _with_least(large, few).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.filter("u <> v").distinct())
        now = _size(edges)
        if now == size:
            break
        size = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
