"""Confirms candidate pairs of texts on their full shingle sets and joins what is linked, without comparing all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookframe.llm.components import components
from brookframe.llm.scratch import Scratch
from brookframe.llm.words import Words, blocks


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in blocks(text):
        hashes, bounds = Words(data, offsets).shingles(k)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(hashes[a:b])


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose texts have 100 * |intersection| >= percent * |union| of their k-word shingle sets.

    ``texts`` has ``id, text``. Each pair's two texts meet by joins on the ids; an id is in a bounded number of the
    pairs that a round asks about, or the join's skewed keys are split.
    """

    def judge(batches):
        for batch in batches:
            left = shingle_sets(batch.column(2), k)
            right = shingle_sets(batch.column(3), k)
            sizes = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array([100 * n >= percent * (total - n) and total > 0 for n, total in sizes], pa.bool_()))

    first = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(judge, "a long, b long")


def _renamed(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs with the components ``x < y`` of their ends; those within one component are gone."""
    for end, to in (("a", "ca"), ("b", "cb")):
        pairs = pairs.join(named.select(F.col("id").alias(end), F.col("component").alias(to)), end, "left")
    pairs = pairs.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")
    return pairs.select("a", "b", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))


def as_links(named: DataFrame) -> DataFrame:
    return named.select(F.col("id").alias("a"), F.col("component").alias("b"))


def linked(scratch: Scratch, pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, component`` of the texts that candidate pairs ``a < b`` link, ``component`` being the least id.

    Only the components matter, so a pair is confirmed unless its ends are already joined by confirmed links: first
    each text's least partner, then one pair for each two components that are left, then all pairs still between
    different components. The result equals confirming every candidate. ``texts`` is a table ``id, text`` that is cheap to
    read again, with those of the pairs and few others. It grows with the corpus, so it is never broadcast.
    """
    asked = scratch.save(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = scratch.save(confirm(asked, texts, k, percent))
    named = components(links)
    left = scratch.save(_renamed(pairs.join(asked, ["a", "b"], "left_anti"), named))
    if left.isEmpty():
        return named
    again = left.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    more = scratch.save(confirm(again, texts, k, percent))
    named = components(as_links(named).unionByName(more))
    rest = scratch.save(_renamed(left.select("a", "b").join(again, ["a", "b"], "left_anti"), named))
    if rest.isEmpty():
        return named
    return components(as_links(named).unionByName(confirm(rest, texts, k, percent)))

