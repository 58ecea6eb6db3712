"""MinHash near-duplicates by an LSH forest.

Each text's shingle set gets a label of ``depth`` MinHash values in each of ``trees`` trees; texts whose labels in a
tree share the first ``shallowest`` values are a region of it. All texts of a region are compared:

- in regions of up to ``SMALL`` texts, each with each;
- in larger ones first with the ``reach`` rows before it in the sorted order of the labels (where many share a prefix
  these share the deepest, so the depth follows the data), which joins most of a group of copies;
- then larger regions that still hold texts of different components are split into blocks of about ``SIDE`` texts, and
  the first 1, 4, 16, ... blocks are compared with all others, until a region is one component or all of it is compared.

Links are confirmed on full shingle sets. Two linked texts at similarity 0.8 share a region in at least one tree with
probability 1 - (1 - 0.8 ** shallowest) ** trees (0.99997 by default), and links of a group join through each other.
A crowd of n texts that share much but aren't linked costs about n * n / 2 comparisons in each tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookframe.llm.components import components
from brookframe.llm.linking import as_links, linked, shingle_sets
from brookframe.llm.scratch import Scratch, cut, free_name

TREES, DEPTH, SHALLOWEST, REACH = 20, 10, 4, 5
#: Texts of a region that are compared each with each at once, and of a block of larger regions.
SMALL, SIDE = 8, 512
_ROWS, _COLUMNS = 4096, 2048


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = None
    for i in range(0, len(low), _ROWS):
        part = (low[i : i + _ROWS, None] * a + b).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(">u2").tobytes()


def signatures(docs: DataFrame, k: int, trees: int, depth: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n, f1, f2, signature``: the set's size, a 128-bit fingerprint of it, and all labels in a row."""
    carried = [docs.schema[c] for c in ("doc_id", *keep)]

    def run(batches):
        a, b = _functions(trees * depth)
        for batch in batches:
            sizes, f1, f2, labels = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int((s * (s >> np.uint64(17) | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)))
                labels.append(_signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(labels, pa.binary())], [*(f.name for f in carried), "n", "f1", "f2", "signature"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return docs.select(*(f.name for f in carried), "text").mapInArrow(run, f"{kinds}, n long, f1 long, f2 long, signature binary")


def regions(rows: DataFrame, trees: int, depth: int, shallowest: int) -> DataFrame:
    """``bucket, label, id, n`` of the ``id, signature`` in regions of ``n`` > 1 texts."""
    width = 2 * depth
    dealt = rows.select("id", "signature", F.explode(F.array([F.lit(t) for t in range(trees)])).alias("tree"))
    label = F.expr(f"substring(signature, tree * {width} + 1, {width})")
    dealt = dealt.select(F.xxhash64("tree", F.substring(label, 1, 2 * shallowest)).alias("bucket"), label.alias("label"), "id")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return dealt.join(sizes.hint("merge"), "bucket")


def forest_pairs(members: DataFrame, reach: int) -> DataFrame:
    """Distinct candidate pairs ``a < b``: all of small regions, and neighbours in the order of the labels of larger ones."""

    def walk(batches):
        tail: list[tuple] = []
        for batch in batches:
            a_out, b_out = [], []
            for bucket, id_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for other, oid in tail:
                    if other == bucket:
                        a_out.append(min(id_, oid))
                        b_out.append(max(id_, oid))
                tail.append((bucket, id_))
                if len(tail) > reach:
                    del tail[0]
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    n = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    small, large = members.filter(F.col("n") <= SMALL), members.filter(F.col("n") > SMALL)
    each = small.select("bucket", F.col("id").alias("a")).join(small.select("bucket", F.col("id").alias("b")).hint("merge"), "bucket").filter("a < b").select("a", "b")
    near = large.repartitionByRange(n, "bucket", "label", "id").sortWithinPartitions("bucket", "label", "id").select("bucket", "id").mapInArrow(walk, "a long, b long")
    return each.unionByName(near.filter("a < b")).distinct()


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets ``left`` shares with each of ``right``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = n[at] > 1
    row, at = row[twice], (np.cumsum(n > 1) - 1)[at[twice]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for base in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        a, b = np.searchsorted(at, (base, base + _COLUMNS))
        holds = np.zeros((len(sets), _COLUMNS), np.float32)
        holds[row[a:b], at[a:b] - base] = 1
        out += holds[left] @ holds[right].T
    return out


def block_links(rows: DataFrame, texts: DataFrame, first: int, to: int, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` of different components between the blocks ``first`` to ``to - 1`` of each bucket and those from them on.

    ``rows`` has ``bucket, id, c, block, blocks``, c being the component. Each two blocks meet in a group of their own.
    """
    schema = "a long, b long"

    def judge(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, c, ids = (table.column(x).to_numpy() for x in ("block", "c", "id"))
        sets = list(shingle_sets(table.column("text"), k))
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a_out, b_out = ids[:0], ids[:0]
        if len(left) and len(right):
            n, total = _shared(sets, left, right).astype(np.int64), size[left][:, None] + size[right]
            x, y = np.nonzero((100 * n >= percent * (total - n)) & (c[left][:, None] != c[right]))
            a_out, b_out = ids[left[x]], ids[right[y]]
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    as_right = F.when(F.col("block") >= first, F.transform(F.sequence(F.lit(first), F.least(F.lit(to - 1), F.col("block"))), lambda i: F.struct(i.cast("int").alias("i"), F.col("block").cast("int").alias("j"))))
    as_left = F.when((F.col("block") < to) & (F.col("block") + 1 < F.col("blocks")), F.transform(F.sequence(F.col("block") + 1, F.col("blocks") - 1), lambda j: F.struct(F.col("block").cast("int").alias("i"), j.cast("int").alias("j"))))
    none = F.array().cast("array<struct<i:int,j:int>>")
    met = rows.withColumn("m", F.explode(F.concat(F.coalesce(as_right, none), F.coalesce(as_left, none)))).select("bucket", "m.i", "m.j", "block", "c", "id")
    return met.join(texts.hint("merge"), "id").groupBy("bucket", "i", "j").applyInArrow(judge, schema)


def exhausted(scratch: Scratch, members: DataFrame, named: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``named`` (``id, component``) after every two texts of a large region were compared or joined through others."""
    rows = members.filter(F.col("n") > SMALL).select("bucket", "id", F.ceil(F.col("n") / SIDE).cast("int").alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), "blocks").cast("int"))
    done, to = 0, 1
    while True:
        at = rows.filter(F.col("block") >= done).join(named.hint("merge"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"), "block", "blocks")
        open_ = at.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("bucket")
        at = scratch.save(at.join(open_.hint("merge"), "bucket", "left_semi"))
        if at.isEmpty():
            return named
        if not done:  # later rounds ask for some of the first one's texts
            texts = scratch.save(texts.join(at.select("id").distinct().hint("merge"), "id", "left_semi"))
        named = components(as_links(named).unionByName(block_links(at, texts, done, to, k, percent)))
        rows, done, to = at.select("bucket", "id", "blocks", "block"), to, 4 * to


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, shallowest: int = SHALLOWEST, reach: int = REACH, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (``doc_id``, ``text``; of more columns those in ``keep`` follow, none named like these).

    Words are lower-cased by A-Z only. Texts with 1 to k - 1 words have one shingle; null, empty and blank texts
    have none and are linked with nothing. Texts with equal sets are one class from the start. Rows of one
    ``doc_id`` count as one document if their sets agree, else each as one of its own. Rows with a null doc_id are
    kept, each by itself. An empty table gives an empty result; texts of any length are read whole.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        # a class is named by a number of its own, as several can have one least doc_id
        said = free_name(docs, "_said")
        docs = docs.withColumn(said, F.xxhash64("text"))
        sets = scratch.save(signatures(docs, k, trees, depth, (*keep, said)))
        key = ["n", "f1", "f2"]
        least = sets.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", said)).alias("least"), F.any_value("signature").alias("signature"))
        classes = scratch.save(least.select(*key, "least.doc_id", f"least.{said}", F.monotonically_increasing_id().alias("id"), "signature"))
        members = scratch.save(regions(classes, trees, depth, shallowest))
        pairs = scratch.save(forest_pairs(members, reach))
        # where the texts stand is looked up first, so texts are dealt out once
        wanted = classes.join(members.select("id").distinct().hint("merge"), "id", "left_semi").select("doc_id", said, "id")
        found = docs.select("doc_id", said, "text").join(wanted.hint("merge"), ["doc_id", said])
        texts = scratch.save(found.groupBy("doc_id", said, "id").agg(F.any_value("text").alias("text")).select("id", "text"))
        named = exhausted(scratch, members, linked(scratch, pairs, texts, k, percent), texts, k, percent)
        of_class = classes.join(named, "id", "left").select(*key, "doc_id", F.coalesce("component", "id").alias("c"))
        first = of_class.groupBy("c").agg(F.min("doc_id").alias("component"))
        of_class = scratch.save(of_class.join(first, "c").select(*key, "component"))
        out = sets.select("doc_id", *keep, *key).join(of_class, key, "left")
        component = F.coalesce("component", "doc_id")
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), *keep))
