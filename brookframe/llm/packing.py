"""Packs tokenized documents into sequences of a fixed length by exact-complement hashing, then best fit.

Only the histogram of piece lengths (at most ``limit`` numbers) reaches the driver. There a plan is made: recipes of
lengths and how often each is used. The longest length with pieces left looks up its gap among the single lengths,
then the sums of two, then of three lengths that are still available, and the combination is used as often as
counts allow; what finds no exact complement is placed by best fit, longest first. On the cluster each piece gets
its rank among the pieces of its length and takes the place that the plan has for that rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookframe.llm.byte_bpe import byte_bpe
from brookframe.llm.scratch import cut

#: Pieces of one length are ranked in groups of about this many.
GROUP = 20_000
Recipes = list[tuple[tuple[int, ...], int]]


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids and end id; only documents of over ``limit`` ids are cut, so that all pieces but the first are full. A null text is empty: its one id is the end."""

    def run(batches):
        bpe, end = byte_bpe(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(bpe.ids(text.as_py() or "") + end)
                n = len(ids) // 4
                at, to = 0, n % limit or min(n, limit)
                for i in range(-(-n // limit)):
                    doc.append(d)
                    piece.append(i)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, to = to, to + limit
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc, piece, start, length, crc), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _sums(counts: np.ndarray, gap: int, most: int, terms: int):
    """Available lengths, each at most ``most`` and none over the one before, that sum to ``gap``; the longest first."""
    if terms == 1:
        if gap <= most and counts[gap] > 0:
            yield (gap,)
    elif terms == 2:
        first = np.arange(min(most, gap - 1), (gap - 1) // 2, -1)
        for b in first[(counts[first] > 0) & (counts[gap - first] > 0)]:
            yield int(b), gap - int(b)
    else:
        for b in range(min(most, gap - 2), (gap - 1) // 3, -1):
            if counts[b] > 0:
                for rest in _sums(counts, gap - b, b, 2):
                    yield b, *rest


def exact_recipes(counts: np.ndarray, limit: int) -> Recipes:
    """Uses up ``counts`` (by length) on combinations that fill ``limit`` exactly."""
    out: Recipes = []

    def use(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(counts[x]) // n for x, n in need.items())
        if times:
            out.append((lengths, times))
            for x, n in need.items():
                counts[x] -= n * times

    use((limit,))
    for a in range(limit - 1, 0, -1):
        for terms in (1, 2, 3):
            if counts[a] and limit - a >= terms:
                for rest in _sums(counts, limit - a, limit - 1 if terms == 1 else a, terms):
                    use((a, *rest))
                    if not counts[a]:
                        break
    return out


def best_fit(counts: np.ndarray, limit: int) -> Recipes:
    """Best fit of what is left, longest first; equal open sequences are one group with a count."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            fits = min((r for r in room if r >= length), default=None)
            if fits is None:
                each = min(limit // length, left)
                lengths, times = (length,) * each, left // each
                left -= each * times
                room.setdefault(limit - each * length, []).append((lengths, times))
                continue
            lengths, times = room[fits].pop()
            if not room[fits]:
                del room[fits]
            used = min(times, left)
            left -= used
            room.setdefault(fits - length, []).append(((*lengths, length), used))
            if times > used:
                room.setdefault(fits, []).append((lengths, times - used))
    counts[:] = 0
    return [x for group in room.values() for x in group]


def _places(recipes: Recipes) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of ranks."""
    runs: dict[int, list[list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in recipes:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append([used.get(x, 0), sequence, offset])
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(r, np.int64).T) for x, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``. Columns other than doc_id and text are ignored; an empty table gives an empty result; equal rows are packed as often as they are there."""
    cuts = cut(pieces(docs, tokenizer, limit, end_id))
    buckets = -(-cuts.count() // GROUP) or 1
    cuts = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    each = cut(cuts.groupBy("length", "bucket").count())
    counts = np.zeros(limit + 1, np.int64)
    for row in each.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[row.length] = row.n
    places = _places(exact_recipes(counts, limit) + best_fit(counts, limit))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cuts.withColumn("own", own).join(each.select("length", "bucket", before.alias("before")), ["length", "bucket"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, off = places[int(x)]
                run = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = base[run] + rank[at] - first[run]
                offset[at] = off[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema.fields if f.name in columns)
    return ranked.select(*columns, (F.col("before") + F.col("own") - 1).alias("rank")).mapInArrow(place, f"{kinds}, sequence_id long, offset long")
