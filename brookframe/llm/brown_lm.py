"""Class-based bigram model of texts: exchange clustering of words, class transitions and word emissions.

Tokens are lower-cased words (A-Z only) and one end per text, which also stands before the first word. Words of at
least ``LEAST`` occurrences and ``KNOWN`` of all training tokens (so at most 1 / KNOWN, half a million) are clustered
one by one; rarer ones are clustered by the last two bytes they end on, which any word shows by itself. Spark gathers the
bigrams of the corpus once, as a row of neighbours for each unit. In each round of the exchange tasks add up from it how
often each unit stands beside each class, and find for each unit the class whose exchange raises the likelihood of the
corpus most, by its exact change if that unit alone moved. Half of the units move at once; if that doesn't raise the likelihood, the round is undone and half as many move.
Only tables of a proven size reach the driver: units with their classes, and the known words, whose counts every task
knows while it scores. Counts of rarer words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookframe.llm.scratch import Scratch, cut
from brookframe.llm.words import Words, blocks

CLASSES, ROUNDS = 64, 6
LEAST, KNOWN = 3, 2e-6
ENDINGS = 512
SMOOTH = 0.1
#: Shares of the units over which bigrams are summed, tokens whose bigrams a task counts at once, and units whose moves it weighs at once.
PARTS, HELD, SOME = 256, 1 << 22, 64
#: In a key of a pair: the other unit precedes.
_BEFORE = 1 << 23
END = np.uint64(0x5EED0E17D0C0FFEE)
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def _tokens(text: pa.Array):
    """For each block of texts: (from row, to row, token hashes with an end after each text, endings' units, text of each token)."""
    for row, to, data, offsets in blocks(text):
        w = Words(data, offsets)
        counts = np.diff(w.bounds)
        of = np.repeat(np.arange(to - row), counts + 1)
        at = np.arange(len(w.hash)) + np.repeat(np.arange(to - row), counts)
        hashes = np.full(len(of), END, np.uint64)
        hashes[at] = w.hash
        last, before = _FOLD[data[w.end - 1]] if len(at) else np.zeros(0, int), np.zeros(len(at), int)
        long = w.end - w.start > 1
        before[long] = _FOLD[data[w.end[long] - 2]]
        units = np.full(len(of), ENDINGS, np.int64)
        units[at] = (last * 7919 + before * 104729 + (last * before) % 251) % ENDINGS
        yield row, to, hashes, units, of


class _Units:
    """Clustering units: 0 to ENDINGS - 1 are endings, ENDINGS is the end of a text, and more are frequent words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return endings
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where((self.words[at] == hashes) & (hashes != END), ENDINGS + 1 + at, endings)

    def __len__(self) -> int:
        return ENDINGS + 1 + len(self.words)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, ending, c`` of all tokens of ``docs``."""

    def run(batches):
        for batch in batches:
            seen, unit = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for *_, hashes, units, _ in _tokens(batch.column(0)):
                seen.append(hashes)
                unit.append(units)
            word, at, c = np.unique(np.concatenate(seen), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.concatenate(unit)[at].astype(np.int32)), pa.array(c.astype(np.int64))], ["word", "ending", "c"])

    return docs.select("text").mapInArrow(run, "word long, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A row of bytes for what lies between each two ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of bytes of a column, and each row's bounds in them."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, bounds[-1]) if data is not None and bounds[-1] else np.zeros(0, kind)
    return values[bounds[0] :], bounds - bounds[0]


def unit_bigrams(docs: DataFrame, units: _Units) -> DataFrame:
    """``unit, after, n_after, before, n_before``: which units follow and precede each unit within a text, ascending (4 bytes each), and how often (8 bytes each), the end standing before the first word.

    Tasks count before the shuffle and deal out their pairs as one row of bytes for each of ``PARTS`` shares of the
    units. So of a frequent unit a task deals out at most two pairs for each unit there is, and a row of the result is
    no longer than that.
    """
    parts, most = PARTS, HELD

    def dealt(keys):
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        bounds = np.searchsorted(key, np.arange(parts + 1) << 48)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), _cut(key, bounds), _cut(n.astype(np.int32), bounds)], ["part", "key", "n"])

    def count(batches):
        keys, held = [], 0
        for batch in batches:
            for *_, hashes, endings, _ in _tokens(batch.column(0)):
                v = units.of(hashes, endings)
                u = np.concatenate(([ENDINGS], v[:-1]))
                keys += [u % parts << 48 | u << 24 | v, v % parts << 48 | v << 24 | _BEFORE | u]
                held += len(v)
                if held >= most:
                    yield dealt(keys)
                    keys, held = [], 0
        if held:
            yield dealt(keys)

    def summed(keys, counts):
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(counts), minlength=len(key)).astype(np.int64)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, once = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
        for batch in batches:
            key, _ = _values(batch.column(1), np.int64)
            n, _ = _values(batch.column(2), np.int32)
            keys.append(key.copy())
            counts.append(n.astype(np.int64))
            held += len(key)
            if held >= most + 2 * once:
                key, n = summed(keys, counts)
                keys, counts, held, once = [key], [n], len(key), len(key)
        key, n = summed(keys, counts)
        unit = key >> 24 & 0xFFFFFF
        other = (key & (_BEFORE - 1)).astype(np.int32)
        start = np.flatnonzero(np.diff(unit, prepend=-1))
        half = np.searchsorted(key, key[start] >> 24 << 24 | _BEFORE)
        end = np.append(start[1:], len(key))
        for i in range(0, len(start), SOME):
            at = slice(i, i + SOME)
            sides = [pa.array([x[a:b].tobytes() for a, b in zip(*side)], pa.binary()) for side in ((start[at], half[at]), (half[at], end[at])) for x in (other, n)]
            yield pa.RecordBatch.from_arrays([pa.array(unit[start[at]].astype(np.int32)), *sides], ["unit", "after", "n_after", "before", "n_before"])

    pairs = docs.select("text").mapInArrow(count, "part int, key binary, n binary")
    return pairs.groupBy("part").applyInArrow(joined, "unit int, after binary, n_after binary, before binary, n_before binary")


def _class_bigrams(bigrams: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            v, bounds = _values(batch.column(1), np.int32)
            n, _ = _values(batch.column(2), np.int64)
            u = np.repeat(batch.column(0).to_numpy(), np.diff(bounds))
            total += np.bincount(of[u] * k + of[v], n, minlength=k * k).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at])], ["a", "b", "n"])

    out = np.zeros((k, k))
    for row in bigrams.select("unit", "after", "n_after").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[row.a, row.b] = row.n
    return out


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_gains(m: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """For each unit and class, the exact change of the likelihood if that unit alone moves to that class.

    ``m`` counts class bigrams, ``own`` are the units' classes; ``right`` and ``left`` [units, classes] count how often
    a unit stands before and after each class, both with the bigrams of the unit with itself, which ``twice`` counts.
    """
    n, k = right.shape
    each, classes = np.arange(n), np.arange(k)
    right, left = right.copy(), left.copy()
    right[each, own] -= twice
    left[each, own] -= twice
    without = np.repeat(m[None], n, axis=0)
    without[each, own] -= right
    without[each, :, own] -= left
    without[each, own, own] -= twice
    base = _g(without)
    rows = _g(without + right[:, None, :]) - base  # [unit, class it moves to, class after it]
    columns = _g(without + left[:, :, None]) - base  # [unit, class before it, class it moves to]
    corner = _g(without[:, classes, classes] + right + left + twice[:, None]) - base[:, classes, classes]
    inner = rows.sum(axis=2) - rows[:, classes, classes] + columns.sum(axis=1) - columns[:, classes, classes] + corner
    after, before = without.sum(axis=2) + left, without.sum(axis=1) + right  # of the other words, which the unit stands beside in any class
    n_after, n_before = (right.sum(axis=1) + twice)[:, None], (left.sum(axis=1) + twice)[:, None]
    value = inner - (_g(after + n_after) - _g(after)) - (_g(before + n_before) - _g(before))
    return value - value[each, own][:, None]


def _moves(bigrams: DataFrame, of: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that gain by a move, and the class to which they gain most. All that a unit stands beside is in its row, so nothing is shuffled."""
    k = len(m)

    def best(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SOME):
                some = batch.slice(start, SOME)
                unit, sides = some.column(0).to_numpy(), []
                for at in (3, 1):
                    v, bounds = _values(some.column(at), np.int32)
                    n, _ = _values(some.column(at + 1), np.int64)
                    row = np.repeat(np.arange(len(unit)), np.diff(bounds))
                    sides.append(np.bincount(row * k + of[v], n, minlength=len(unit) * k).reshape(-1, k))
                left, right = sides
                itself = v == unit[row]
                gain = exchange_gains(m, of[unit], right, left, np.bincount(row[itself], n[itself], minlength=len(unit)))
                gain[:, 0] = -np.inf  # the end's own class
                to = gain.argmax(axis=1)
                moves = gain[np.arange(len(to)), to] > 1e-9
                yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(moves)), pa.array(to[moves].astype(np.int32))], ["unit", "class"])

    found = bigrams.mapInArrow(best, "unit int, class int").toArrow()
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def _likelihood(m: np.ndarray) -> float:
    """Log-likelihood of the classes up to what no clustering changes."""
    def h(x):
        return float((x * np.log(np.maximum(x, 1))).sum())

    return h(m) - h(m.sum(axis=1)) - h(m.sum(axis=0))


def exchange(bigrams: DataFrame, totals: np.ndarray, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the units, their class bigrams, and the likelihood after each round that raised it. The end keeps a class of its own."""
    of = np.zeros(len(totals), np.int64)
    of[np.argsort(-totals, kind="stable")] = np.arange(len(totals)) % (k - 1) + 1
    of[ENDINGS] = 0
    m = _class_bigrams(bigrams, of, k)
    history, share = [_likelihood(m)], 2
    for step in range(rounds):
        unit, best = _moves(bigrams, of, m)
        free = ((unit.astype(np.int64) * 2654435761 // 7 + step) % share == 0) & (unit != ENDINGS)
        moved = of.copy()
        moved[unit[free]] = best[free]
        counts = _class_bigrams(bigrams, moved, k)
        if (value := _likelihood(counts)) > history[-1]:
            of, m = moved, counts
            history.append(value)
        else:
            share *= 2
    return of, m, history


def score_texts(docs: DataFrame, training: DataFrame, k: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``, learning from ``training`` (both with ``doc_id``, ``text``).

    ``base_score`` is that of smoothed word counts, ``score`` that of the class model, both log10. A null or empty
    text is one end. Without training rows all words are unknown. Other columns are ignored; each of equal rows is
    scored by itself, an empty table stays empty, and texts of any length are scored whole.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counts = scratch.save(word_counts(training))
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        is_end = int(END.astype(np.int64))
        known = counts.filter(F.col("c") >= KNOWN * total).toArrow().sort_by("word")
        word, c = known.column("word").to_numpy().view(np.uint64), known.column("c").to_numpy().astype(float)
        order = np.argsort(word)
        word, c = word[order], c[order]
        units = _Units(word[(c >= LEAST) & (word != END)])
        bigrams = scratch.save(unit_bigrams(training, units))
        frequent = (F.col("c") >= KNOWN * total) & (F.col("c") >= LEAST)
        rare_units = counts.filter(~frequent & (F.col("word") != is_end)).groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
        n_of, v_of = np.zeros(len(units)), np.zeros(len(units))
        for row in rare_units:
            n_of[row.ending], v_of[row.ending] = row.n, row.v
        at = np.searchsorted(word, units.words)
        n_of[ENDINGS + 1 :], v_of[ENDINGS + 1 :] = c[at], 1
        # the end is rare where texts are few and long, so it may not be among the known words
        n_of[ENDINGS], v_of[ENDINGS] = counts.filter(F.col("word") == is_end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0], 1
        of, m, _ = exchange(bigrams, n_of, k, rounds)
        size = np.bincount(of, n_of, minlength=k) + SMOOTH * (np.bincount(of, v_of, minlength=k) + 1)
        move = np.log10((m + SMOOTH) / (m.sum(axis=1, keepdims=True) + SMOOTH * k))
        flat = np.log10(total + SMOOTH * (distinct + 1))
        shared = spark.sparkContext.broadcast((word, np.log10(c + SMOOTH), units, of, move, np.log10(size)))

        def run(batches):
            word, seen, units, of, move, size = shared.value
            for batch in batches:
                parts = []
                for row, to, hashes, endings, text in _tokens(batch.column(2)):
                    n = to - row
                    cls = of[units.of(hashes, endings)]
                    before = np.concatenate(([of[ENDINGS]], cls[:-1]))
                    if len(word):
                        at = np.minimum(np.searchsorted(word, hashes), len(word) - 1)
                        hit = word[at] == hashes
                        value = np.where(hit, seen[at], 0.0)
                    else:
                        hit, value = np.zeros(len(hashes), bool), np.zeros(len(hashes))
                    tokens = np.bincount(text, minlength=n)
                    rest = hashes[~hit].view(np.int64)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(text[~hit], minlength=n)))).astype(np.int32)
                    parts.append(pa.RecordBatch.from_arrays([
                        batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(tokens.astype(np.int64)), pa.array(np.bincount(text, hit, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(text, value, minlength=n) - flat * tokens), pa.array(np.bincount(text, value - size[cls] + move[before, cls], minlength=n)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(rest)),
                    ], ["row", "doc_id", "n_tokens", "known", "base", "own", "rest"]))
                yield from parts

        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"row long, doc_id {kind}, n_tokens long, known long, base double, own double, rest array<long>"
        rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema))
        rare = counts.filter(F.col("c") < KNOWN * total).select("word", "c")
        value = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
        late = rows.select("row", F.explode("rest").alias("word")).join(rare, "word", "left").groupBy("row").agg(F.sum(value).alias("late"), F.count("c").alias("more"))
        out = rows.drop("rest").join(late, "row", "left")
        later = F.coalesce("late", F.lit(0.0))
        return cut(out.select(
            "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + later).alias("base_score"), (F.col("own") + later).alias("score"),
        ))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))
