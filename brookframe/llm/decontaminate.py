"""Benchmark decontamination by spaced seeds, all in DataFrame functions.

Tokens are lower-cased runs of letters and digits. A seed looks at the tokens where its mask has a 1 and ignores the
others, so a substituted token spoils only the windows in which it counts. Windows of the benchmark and of the
documents meet by hash; each different way to lay an item on a document that follows from a meeting is then compared
token by token, once.

The masks look at four tokens each. By simulation, an item of 12, 15 or 38 tokens of which 60 percent agree in random
places has a common seed in 0.99, 0.98 and 1.00 of cases, of 8 tokens with 70 percent in 1.00; an item of which every
third, every fourth, or any two of each five tokens are replaced always has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookframe.llm.scratch import Scratch, cut

MASKS = ("1111", "11011", "110101", "111001")
#: An item is found if this share of its tokens agrees in one alignment (and at least ``LEAST`` of them, or all of fewer) ...
SHARE, LEAST = 0.6, 8
#: ... or if all tokens but one agree in a window of this many.
WINDOW = 13
#: Benchmark windows (``KEY_BYTES`` each: hash, item, place) are broadcast only up to this size; more are joined by shuffling.
BROADCAST_BYTES, KEY_BYTES = 32 << 20, 32


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(words: Column, masks: tuple[str, ...]) -> Column:
    """Places where the shortest mask fits."""
    return F.greatest(F.size(words) - min(map(len, masks)) + 1, F.lit(0))


def seeds(words: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """Hashes of every window, mask after mask, so a hash's place modulo the number of windows is its window's; null where a longer mask doesn't fit."""
    if any(m[0] != "1" or m[-1] != "1" for m in masks):
        raise ValueError("masks start and end with 1")

    def of(number: int, mask: str) -> Column:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        hashes = F.transform(words, lambda w, i: F.when(i < F.size(words) - ones[-1], F.xxhash64(F.lit(number), w, *(F.get(words, i + o) for o in ones[1:]))))
        return F.slice(hashes, F.lit(1), _windows(words, masks))

    return F.concat(*(of(k, m) for k, m in enumerate(masks)))


def _placed(rows: DataFrame, key: str, words: str, masks: tuple[str, ...], at: str) -> DataFrame:
    """``key``, ``hash`` and the place ``at`` of each window. The explode is an outer one, as before any other Spark filters texts by a second computation of their windows."""
    listed = rows.select(key, seeds(F.col(words), masks).alias("_seeds"), _windows(F.col(words), masks).alias("_each"))
    each = listed.select(key, "_each", F.posexplode_outer("_seeds").alias("_pos", "hash"))
    return each.filter("hash is not null").select(key, "hash", (F.col("_pos") % F.col("_each")).alias(at))


def agreement(words: Column, item: Column, shift: Column) -> Column:
    """A struct of ``matched`` (tokens of the item that agree when it starts at ``shift``) and ``densest`` (most in any window)."""
    same = F.transform(item, lambda t, i: F.when((i + shift >= 0) & F.coalesce(F.get(words, i + shift) == t, F.lit(False)), 1).otherwise(0))

    def measure(s: Column) -> Column:
        matched = F.aggregate(s, F.lit(0), lambda a, x: a + x)
        spans = F.sequence(F.lit(1), F.greatest(F.size(s) - WINDOW + 1, F.lit(1)))
        densest = F.array_max(F.transform(spans, lambda i: F.aggregate(F.slice(s, i, F.lit(WINDOW)), F.lit(0), lambda a, x: a + x)))
        return F.struct(matched.alias("matched"), densest.alias("densest"))

    return F.get(F.transform(F.array(same), measure), F.lit(0))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, share: float = SHARE, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, item_id, start, matched, densest, n_tokens``: documents that hold an item of the benchmark, each pair once by its best alignment.

    ``start`` is the document token that the item's first token lies on. Items with fewer tokens than the shortest
    mask are too short to tell from chance and match nothing, and so do null or empty texts on either side; items of
    fewer than ``least`` tokens must agree in all. Rows of the same doc_id count as one document, also those with a
    null one; items of the same item_id as one item. An empty table on either side gives no rows. Texts of any length
    are read whole; other columns are ignored. How the windows are joined depends on the benchmark's size, the result
    doesn't.
    """
    with Scratch(docs.sparkSession) as scratch:
        items = benchmark.select("item_id", tokens(F.col("text")).alias("item_words")).filter(F.size("item_words") >= min(map(len, masks)))
        items = scratch.save(items.select("item_id", F.xxhash64("item_id", "item_words").alias("item"), "item_words").dropDuplicates(["item"]))
        keys = scratch.save(_placed(items, "item", "item_words", masks, "in_item").distinct())
        key = F.xxhash64("doc_id", "text").alias("key")
        placed = _placed(docs.select(key, tokens(F.col("text")).alias("words")), "key", "words", masks, "at")
        small = keys.count() * KEY_BYTES <= broadcast_bytes
        met = placed.join(keys.hint("broadcast" if small else "merge"), "hash")
        met = scratch.save(met.select("key", "item", (F.col("at") - F.col("in_item")).alias("start")).distinct())
        # the text is tokenized once for each document that has a meeting, whatever the number of its alignments
        read = docs.select(key, "doc_id", "text").join(met.select("key").distinct(), "key", "left_semi").select("key", "doc_id", tokens(F.col("text")).alias("words"))
        laid = met.join(items, "item").join(read, "key")
        found = laid.select("doc_id", "item_id", "start", F.size("item_words").alias("n_tokens"), agreement(F.col("words"), F.col("item_words"), F.col("start")).alias("a"))
        best = F.max(F.struct("a.matched", "a.densest", (-F.col("start")).alias("back"), "n_tokens")).alias("b")
        pairs = found.groupBy("doc_id", "item_id").agg(best, F.max("a.densest").alias("densest"))
        enough = (F.col("b.matched") >= F.greatest(F.col("b.n_tokens") * share, F.least(F.lit(least), F.col("b.n_tokens")))) | (F.col("densest") >= WINDOW - 1)
        return cut(pairs.filter(enough).select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.matched", "densest", "b.n_tokens"))
