"""Substring dedup: repeated passages inside texts and near-copies of whole paragraphs.

Two kinds of units come from each text. Paragraphs are its lines; those of at least ``LONG`` words get MinHash bands
(tuned for recall at the similarity asked for), paragraphs that collide in a band are joined as in the LSH forest (each
with each in small buckets; in crowded ones first with their neighbours in the order of an independent band, then in
blocks until a bucket is one component or wholly compared), confirmed by exact Jaccard similarity of their shingle sets
and clustered by connected components. Passages are the paragraphs' pieces, cut where a word's hash is the least of its
neighbours', so a repeat is cut alike wherever it stands, also inside a line. A piece is too short for bands of its own:
equal pieces are one cluster. Of each cluster that lies in two or more documents the first occurrence stays and the
others are removals. Touching pieces are merged, and the ends are moved out word by word as far as the text equals
that of the first occurrence. Spans of fewer than ``least_words`` words are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookframe.llm.linking import linked
from brookframe.llm.lsh_forest import REACH as NEIGHBOURS
from brookframe.llm.lsh_forest import exhausted, forest_pairs
from brookframe.llm.scratch import Scratch, cut
from brookframe.llm.words import Words, _BACK, _BASE, _power, blocks, mix

REACH, LONGEST_PIECE, LONG, LEAST_WORDS = 3, 64, 20, 20
SHINGLE, PERCENT, RECALL, MOST_BANDS = 5, 80, 0.995, 12
LEFT, RIGHT = 0, 1


def tune(similarity: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance collisions) with which ``most`` bands at most reach ``recall``."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands > most:
            break
        best = (bands, rows)
    return best


def _runs(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of word sequences."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * _power(_BASE, len(h), "up"), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BACK, max(len(h), 1), "down")[starts] + (ends - starts).astype(np.uint64))


def _passages(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First words of passages; where no cut comes for long (one word over and over), one is made every ``LONGEST_PIECE`` words."""
    n = len(h)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    opens = np.ones(n, bool)
    for j in range(1, REACH + 1):
        near = doc[j:] == doc[:-j]
        opens[j:] &= ~near | (h[j:] < h[:-j])
        opens[:-j] &= ~near | (h[:-j] <= h[j:])
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, n))
    for at in np.flatnonzero(size > LONGEST_PIECE):
        opens[first[at] : first[at] + size[at] : LONGEST_PIECE] = True
    return np.flatnonzero(opens)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of lines."""
    if not len(w.hash):
        return np.zeros(0, int), np.zeros(0, int)
    line = np.cumsum(w.data == 10)[w.start]
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))))
    return first, np.append(first[1:], len(w.hash))


def _signatures(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of the shingles of each word sequence, one column for each function."""
    n = len(h) - SHINGLE + 1
    shingles = sum((mix(h[i : n + i] + np.uint64(i * 0x51_7CC1 + 1)) for i in range(SHINGLE)), np.zeros(n, np.uint64))
    counts = ends - starts - SHINGLE + 1
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.arange(counts.sum()) + np.repeat(starts - first, counts)
    low = (mix(shingles[at]) >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(low * x + y, first) for x, y in zip(a, b)], axis=1)


def units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, start, n, before, after, unit, bands``: words of each passage and paragraph, its name, for passages how
    far the ends can move out at most, and for long paragraphs the band keys."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            for row, to, data, offsets in blocks(batch.column(1)):
                w = Words(data, offsets)
                if not len(w.hash):
                    continue
                h, doc = w.hash, np.repeat(np.arange(row, to), np.diff(w.bounds))
                first = _passages(h, w.bounds)
                end = np.append(first[1:], len(h))
                size = (end - first).astype(np.int32)
                inner = doc[first[1:]] == doc[first[:-1]]
                before, after = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
                before[1:], after[:-1] = np.where(inner, size[:-1] + REACH, 0), np.where(inner, size[1:] + REACH, 0)
                s, e = _lines(w)
                s, e = s[e - s >= LONG], e[e - s >= LONG]
                keys = np.zeros((0, bands), np.uint64)
                if len(s):
                    values = _signatures(h, s, e, a, b).astype(np.uint64)
                    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(s), 1))
                    for r in range(rows):
                        keys = mix(keys + values[:, r::rows])
                start, stop = np.concatenate((first, s)), np.concatenate((end, e))
                none = np.zeros(len(s), np.int32)
                each = np.concatenate((np.zeros(len(first) + 1, np.int32), np.cumsum(np.full(len(s), bands, np.int32), dtype=np.int32)))
                plain = pa.array(np.arange(len(start)) < len(first))
                of = doc[start]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(of)), pa.array((start - w.bounds[of - row]).astype(np.int32)), pa.array((stop - start).astype(np.int32)),
                    pa.array(np.concatenate((before, none))), pa.array(np.concatenate((after, none))), pa.array(_runs(h, start, stop).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(each), pa.array(keys.view(np.int64).ravel()), mask=plain),
                ], ["doc_id", "start", "n", "before", "after", "unit", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, n int, before int, after int, unit long, bands array<long>")


def _paragraph_texts(docs: DataFrame) -> DataFrame:
    """``id, text`` of long paragraphs."""

    def run(batches):
        for batch in batches:
            for row, to, data, offsets in blocks(batch.column(0)):
                w = Words(data, offsets)
                s, e = _lines(w)
                s, e = s[e - s >= LONG], e[e - s >= LONG]
                texts = [data[w.start[x] : w.end[y - 1]].tobytes().decode() for x, y in zip(s, e)]
                yield pa.RecordBatch.from_arrays([pa.array(_runs(w.hash, s, e).view(np.int64)), pa.array(texts, pa.string())], ["id", "text"])

    return docs.select("text").mapInArrow(run, "id long, text string")


def band_components(docs: DataFrame, long: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``id, component`` of the paragraphs ``long`` (``unit, doc_id, bands``) that bands bring together and that are confirmed as similar."""
    one = scratch.save(long.groupBy("unit").agg(F.min(F.struct("doc_id", "bands")).alias("u")).select("unit", "u.doc_id", "u.bands"))
    each = one.select(F.explode("bands").alias("bucket"), F.col("unit").alias("id"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.save(each.join(sizes.hint("merge"), "bucket"))
    ids = scratch.save(shared.select("id").distinct())
    later = F.get("bands", F.array_position("bands", F.col("bucket")).cast("int") % F.size("bands"))
    members = scratch.save(shared.join(one.select(F.col("unit").alias("id"), "bands").hint("merge"), "id").select("bucket", later.alias("label"), "id", "n"))
    holders = one.join(ids.select(F.col("id").alias("unit")).hint("merge"), "unit", "left_semi").select("doc_id").distinct()
    texts = _paragraph_texts(docs.join(holders.hint("merge"), "doc_id", "left_semi"))
    texts = scratch.save(texts.join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    pairs = scratch.save(forest_pairs(members, NEIGHBOURS))
    return exhausted(scratch, members, linked(scratch, pairs, texts, SHINGLE, percent), texts, SHINGLE, percent)


def _in_two_documents(kind: DataFrame, scratch: Scratch) -> DataFrame:
    """``kind`` with ``kept_doc``, ``kept_start`` and ``removed``, less the units of one document only."""
    clusters = kind.groupBy("unit").agg(F.min("doc_id").alias("kept_doc"), F.max("doc_id").alias("last")).filter("kept_doc <> last").select("unit", "kept_doc")
    hits = scratch.save(kind.join(clusters.hint("merge"), "unit"))
    first = hits.filter("doc_id = kept_doc").groupBy("unit").agg(F.min("start").alias("kept_start"))
    return hits.join(first.hint("merge"), "unit").withColumn("removed", (F.col("doc_id") != F.col("kept_doc")) | (F.col("start") != F.col("kept_start")))


def _chained(spans: DataFrame) -> DataFrame:
    """Adds ``chain``: the same number for spans of one document and ``removed`` that touch."""
    rows = Window.partitionBy("doc_id", "removed").orderBy("start", "n")
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("start") <= F.max(F.col("start") + F.col("n")).over(before), 0).otherwise(1)
    marked = spans.withColumn("opens", opens)
    return marked.withColumn("chain", F.sum("opens").over(rows.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds ``words`` to ``asked`` (``doc_id, at, side, reach, ...``): hashes of up to ``reach`` words before the word ``at`` (the nearest first) or from it on."""
    rest = [f for f in asked.schema.fields if f.name not in ("doc_id", "at", "side", "reach")]
    asks = asked.groupBy("doc_id").agg(F.collect_list(F.struct("at", "side", "reach", *(f.name for f in rest))).alias("asks"))

    def run(batches):
        for batch in batches:
            asks = batch.column(2)
            flat, ends = asks.flatten(), np.concatenate(([0], np.cumsum(np.diff(asks.offsets.to_numpy()))))
            at, side, reach = (flat.field(i).to_numpy() for i in range(3))
            for row, to, data, offsets in blocks(batch.column(1)):
                w = Words(data, offsets)
                i = np.arange(ends[row], ends[to])
                if not len(i):
                    continue
                of = np.repeat(np.arange(row, to), np.diff(ends[row : to + 1]))
                low, high = w.bounds[of - row], w.bounds[of - row + 1]
                place = np.minimum(low + at[i], high)
                n = np.maximum(np.minimum(reach[i], np.where(side[i] == LEFT, place - low, high - place)), 0)
                first = np.concatenate(([0], np.cumsum(n)))
                step = np.arange(first[-1]) - np.repeat(first[:-1], n)
                words = w.hash[np.where(np.repeat(side[i], n) == LEFT, np.repeat(place, n) - 1 - step, np.repeat(place, n) + step)]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64)))
                some = flat.slice(ends[row], len(i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(side[i]), *(some.field(3 + k) for k in range(len(rest))), lists], ["doc_id", "side", *(f.name for f in rest), "words"])

    kind = asked.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "side int", *(f"{f.name} {f.dataType.simpleString()}" for f in rest), "words array<long>"])
    return docs.select("doc_id", "text").join(asks.hint("merge"), "doc_id").mapInArrow(run, schema)


def _moved_out(docs: DataFrame, hits: DataFrame, scratch: Scratch, least_words: int) -> DataFrame:
    """``doc_id, start, n, kept_doc, removed`` of chains of passages, their ends moved out while the words equal those beside the first occurrence."""
    rows = Window.partitionBy("doc_id", "removed", "chain").orderBy("start")
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chained = _chained(hits).withColumn("left", F.row_number().over(rows) == 1).withColumn("right", F.lead("start").over(rows).isNull())
    begin, end = F.min("start").over(whole), F.max(F.col("start") + F.col("n")).over(whole)
    room = F.first("before").over(whole) + F.last("after").over(whole)
    chained = chained.withColumn("begin", begin).withColumn("end", end).withColumn("possible", end - begin + room >= least_words)
    chained = scratch.save(chained.filter("possible and (left or right)"))
    sides = [(LEFT, "left", F.lit(0), "before"), (RIGHT, "right", F.col("n"), "after")]
    edges = None
    for side, flag, past, reach in sides:
        some = chained.filter(flag).select("doc_id", "removed", "chain", "unit", "kept_doc", F.lit(side).alias("side"), (F.col("start") + past).alias("at"), F.col(reach).alias("reach"), (F.col("kept_start") + past).alias("kept_at"))
        edges = some if edges is None else edges.unionByName(some)
    edges = scratch.save(edges)
    moving = edges.filter("removed and reach > 0")
    own = moving.select("doc_id", "at", "side", "reach", "unit", "chain", F.lit(False).alias("is_first"))
    firsts = moving.groupBy("unit", "side", F.col("kept_doc").alias("doc_id"), F.col("kept_at").alias("at")).agg(F.max("reach").alias("reach"))
    firsts = firsts.select("doc_id", "at", "side", "reach", "unit", F.lit(0).cast("long").alias("chain"), F.lit(True).alias("is_first"))
    read = scratch.save(contexts(docs, own.unionByName(firsts)))
    first = read.filter("is_first").groupBy("unit", "side").agg(F.min("words").alias("first"))
    same = F.array_position(F.transform(F.zip_with("words", "first", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x.cast("int")), 0)
    length = F.when(same > 0, same - 1).otherwise(F.size("words")).cast("int").alias("more")
    moved = scratch.save(read.filter("not is_first").join(first.hint("merge"), ["unit", "side"]).select("doc_id", "chain", "unit", "side", length))
    by_chain = moved.groupBy("doc_id", "chain").agg(*(F.max(F.when(F.col("side") == side, F.col("more"))).alias(f"more_{flag}") for side, flag, *_ in sides))
    by_unit = moved.groupBy("unit", "side").agg(F.max("more").alias("more"))
    of_kept = edges.filter("not removed").join(by_unit.hint("merge"), ["unit", "side"]).groupBy("doc_id", "chain").agg(*(F.max(F.when(F.col("side") == side, F.col("more"))).alias(f"more_{flag}") for side, flag, *_ in sides))
    more = by_chain.withColumn("removed", F.lit(True)).unionByName(of_kept.withColumn("removed", F.lit(False)))
    chains = chained.groupBy("doc_id", "removed", "chain").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("kept_doc").alias("kept_doc"))
    out = chains.join(more.hint("merge"), ["doc_id", "removed", "chain"], "left")
    start = F.col("begin") - F.coalesce("more_left", F.lit(0))
    return out.select("doc_id", start.alias("start"), (F.col("end") + F.coalesce("more_right", F.lit(0)) - start).alias("n"), "kept_doc", "removed")


def repeated_spans(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, start, n_words, kept_doc, removed, by_bands``: each span of words that also stands in another document.

    ``start`` counts words; ``kept_doc`` is the document with the first occurrence, whose span has ``removed`` false;
    ``by_bands`` says whether a paragraph of the span was joined with another by bands (else passages alone were equal).
    Null, empty and short texts have no spans, and so has an empty table; texts of any length are read whole; rows with
    a null doc_id are ignored, rows of one doc_id are one document; other columns are ignored.
    """
    bands, rows = tune(percent / 100)
    with Scratch(docs.sparkSession) as scratch:
        every = scratch.save(units(docs, bands, rows))
        long = every.filter("bands is not null")
        named = band_components(docs, long.select("unit", "doc_id", "bands"), scratch, percent)
        near = long.select("doc_id", "start", "n", "unit").join(named.select(F.col("id").alias("unit"), "component").hint("merge"), "unit", "left")
        near = _in_two_documents(near.select("doc_id", "start", "n", F.coalesce("component", "unit").alias("unit")), scratch)
        plain = _in_two_documents(every.filter("bands is null").drop("bands"), scratch)
        found = _moved_out(docs, plain, scratch, least_words).withColumn("by_bands", F.lit(False))
        found = found.unionByName(near.select("doc_id", "start", "n", "kept_doc", "removed", F.lit(True).alias("by_bands")))
        spans = _chained(found).groupBy("doc_id", "removed", "chain").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.min("kept_doc").alias("kept_doc"), F.max("by_bands").alias("by_bands"))
        n = (F.col("end") - F.col("start")).alias("n_words")
        return cut(spans.select("doc_id", "start", n, "kept_doc", "removed", "by_bands").filter(F.col("n_words") >= least_words))
