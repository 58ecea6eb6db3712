"""Secrets in texts: fixed patterns, and a battery of randomness tests for tokens that no pattern knows.

All in DataFrame functions. A candidate of the battery is a run of letters, digits and ``+ / _ - =``. Its encoding
(hex, base 32, letters and digits, base 64) gives the alphabet, and three tests ask whether its symbols could be
drawn evenly from that: chi-squared of the counts, runs above and below the alphabet's middle, and the correlation
of neighbours. The place of the smallest of the three p-values among those of random tokens of its length is its
p-value for being random.

True random tokens have even p-values, written text has p-values near 0. So within a band of lengths and an
encoding, 4/3 of the count above one quarter estimates how many random tokens there are, and the candidates with p of
at least t hold an estimated share 1 - random * (1 - t) / count of others. The least t with a share of at most
``rate``, up to the estimate's standard error, is the band's threshold: short tokens, for which the tests are weak, get a higher one. The table of counts
by band and p has a fixed size, and all candidates of the corpus are in it.
"""

from __future__ import annotations

import functools
import json
import math
import string
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookframe.llm.scratch import cut

#: Kind, pattern, group whose length counts, least length; the order of kinds is that of ties. A run of
#: hex digits or an access key is taken whole or not at all, so the least length of these is part of the pattern; a
#: short assignment takes its place in the scan before it is dropped.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
]
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "alnum": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
}
BANDS = (32, 48, 80)
BLOCK = 128
BINS = 100
#: Lengths for which the battery's null distribution is simulated, each with so many tokens; others use the longest that is no longer.
LENGTHS, SIMULATED = (20, 22, 24, 28, 32, 40, 48, 64, 96, 160), 4000
#: From this bin on all candidates count as random tokens in the estimate of their number.
EVEN = 25
RATE = 0.05
SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of int, what the ones before it come to by ``merge``, from 0. In blocks, so that arrays grow by few elements at a time and the work stays near linear."""

    def scan(start: Column, own: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(own, none, lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def by_block(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), merge))
        return F.get(F.transform(F.array(scan(F.lit(0), totals)), lambda starts: F.flatten(F.zip_with(starts, blocks, scan))), F.lit(0))

    each = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(each), by_block), F.lit(0))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int = 0, kind: int = 0) -> Column:
    """All matches from left to right as structs of start, kind, end (code points) and the group's text.

    Matches and what lies between them come from the same scan order, so their lengths add up to the places.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("token"))

    def spans(p: Column) -> Column:
        sizes = F.zip_with(F.slice(p["between"], F.lit(1), F.size(p["whole"])), p["whole"], lambda b, w: F.char_length(b) + F.char_length(w))

        def placed(before: Column) -> Column:
            def one(at: Column, i: Column) -> Column:
                start = at + F.char_length(F.get(p["between"], i))
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(F.get(p["whole"], i))).alias("end"), F.get(p["token"], i).alias("token"))

            return F.transform(before, one)

        found = F.get(F.transform(F.array(running(sizes, lambda a, x: a + x)), placed), F.lit(0))
        return F.when(F.size(p["whole"]) > 0, found).otherwise(F.array().cast(SPAN))

    return F.get(F.transform(F.array(parts), spans), F.lit(0))


def apart(free: Column, base: Column) -> Column:
    """The spans of ``free`` (disjoint, by start) that touch no span of ``base``, by one pass over both in the order of their starts."""
    own = len(KINDS)

    def judge(events: Column) -> Column:
        ends = F.transform(events, lambda e: F.when(e["kind"] < own, e["end"]).otherwise(0))

        def clear(reached: Column) -> Column:
            def alone(e: Column, i: Column) -> Column:
                after = F.get(events, i + 1)
                met = (F.get(reached, i) > e["start"]) | F.coalesce((after["kind"] < own) & (after["start"] < e["end"]), F.lit(False))
                return (e["kind"] == own) & ~met

            return F.filter(events, alone)

        return F.get(F.transform(F.array(running(ends, lambda a, x: F.greatest(a, x))), clear), F.lit(0))

    return F.when(F.size(base) == 0, free).when(F.size(free) == 0, free).otherwise(F.get(F.transform(F.array(F.array_sort(F.concat(base, free))), judge), F.lit(0)))


def base_spans(text: Column, kind: int) -> Column:
    """Spans of one of ``KINDS``; a match whose group is too short is dropped after it took its place in the scan."""
    _, pattern, group, least = KINDS[kind]
    found = F.filter(matches(text, pattern, group, kind), lambda s: F.char_length(s["token"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, to about 1e-4."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


@functools.cache
def null_quantiles(k: int) -> dict[int, list[float]]:
    """For each of ``LENGTHS`` the quantiles of the battery's smallest p-value over random tokens of ``k`` symbols.

    The normal approximations behind the three p-values are rough for short tokens, and the three depend on each
    other; places among these quantiles are even for random tokens of any length.
    """
    rng, found = np.random.default_rng(k), {}
    middle, spread = (k - 1) / 2, (k * k - 1) / 12

    def tail(z: np.ndarray) -> np.ndarray:
        z = np.clip(z, -8, 8)
        return 1 / (1 + np.exp(1.5976 * z + 0.070565992 * z**3))

    for n in LENGTHS:
        v = rng.integers(0, k, (SIMULATED, n))
        counts = np.bincount((np.arange(SIMULATED)[:, None] * k + v).ravel(), minlength=SIMULATED * k).reshape(SIMULATED, k)
        chi = ((counts**2).sum(axis=1) * k / n - n - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
        high = v > middle
        ones, turns = high.sum(axis=1), 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
        mean = 2 * ones * (n - ones) / n + 1
        scale = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 0))
        runs = np.divide(turns - mean, scale, out=np.full(SIMULATED, 8.0), where=scale > 0)
        serial = ((v[:, 1:] - middle) * (v[:, :-1] - middle)).sum(axis=1) / (spread * np.sqrt(n - 1))
        least = np.minimum(np.minimum(tail(chi), 2 * tail(np.abs(runs))), 2 * tail(np.abs(serial)))
        found[n] = np.quantile(least, (np.arange(BINS) + 0.5) / BINS).tolist()
    return found


def randomness(token: Column) -> Column:
    """A struct of ``encoding``, ``n`` and ``p`` of a token."""
    core = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    encoding = F.when(core.rlike("^[0-9a-f]+$"), "hex").when(core.rlike("^[0-9A-F]+$"), "HEX").when(core.rlike("^[A-Z2-7]+$"), "base32").when(core.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")

    of = F.create_map(*(F.lit(x) for item in ALPHABETS.items() for x in item))
    tables = {f"{len(a)}:{n}": q for a in ALPHABETS.values() for n, q in null_quantiles(len(a)).items()}
    table = F.from_json(F.lit(json.dumps(tables)), "map<string,array<double>>")

    def tests(t: Column) -> Column:
        v, k = t["v"], t["k"]
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = F.transform(v, lambda x: F.when(x > middle, 1).otherwise(0))
        ones = F.aggregate(high, F.lit(0.0), lambda s, x: s + x)
        turns = F.aggregate(F.transform(v, lambda x, i: F.when((i > 0) & ((x > middle) != (F.get(v, i - 1) > middle)), 1.0).otherwise(0.0)), F.lit(1.0), lambda s, x: s + x)
        mean = 2 * ones * (n - ones) / n + 1
        runs = F.coalesce(F.try_divide(turns - mean, F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0)))), F.lit(8.0))
        products = F.transform(v, lambda x, i: F.when(i > 0, (x - middle) * (F.get(v, i - 1) - middle)).otherwise(0.0))
        serial = F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / (spread * F.sqrt(n - 1))
        least = F.least(_upper_tail(chi), 2 * _upper_tail(F.abs(runs)), 2 * _upper_tail(F.abs(serial)))
        longest = F.lit(LENGTHS[0])
        for x in LENGTHS[1:]:
            longest = F.when(n >= x, F.lit(x)).otherwise(longest)
        return F.struct(least.alias("least"), F.concat_ws(":", k.cast("int").cast("string"), longest.cast("string")).alias("key"))

    def values(e: Column) -> Column:
        alphabet = F.element_at(of, e)
        return F.struct(F.transform(F.split(core, ""), lambda c: F.instr(alphabet, c) - 1).alias("v"), F.char_length(alphabet).cast("double").alias("k"))

    at = F.transform(F.transform(F.transform(F.array(encoding), values), tests), lambda t: F.size(F.filter(F.element_at(table, t["key"]), lambda x: x <= t["least"])) / F.lit(BINS))
    n = F.char_length(core)
    return F.struct(encoding.alias("encoding"), n.alias("n"), F.when(n > 2, F.get(at, F.lit(0))).otherwise(F.lit(0.0)).alias("p"))


def _band(n: Column, encoding: Column) -> Column:
    return F.concat_ws(":", encoding, sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(0)).cast("string"))


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[str, float]:
    """The threshold of each band that has one, from ``band, p`` of all candidates. At most bands times bins numbers are gathered."""
    counts: dict[str, list[int]] = {}
    for row in candidates.groupBy("band", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect():
        counts.setdefault(row.band, [0] * BINS)[row.bin] = row["count"]
    found = {}
    for band, c in counts.items():
        random = sum(c[EVEN:]) * BINS / (BINS - EVEN)
        for i in range(BINS):
            here = sum(c[i:])
            true = random * (1 - i / BINS)
            if true and here - true - math.sqrt(true) <= rate * here:
                found[band] = i / BINS
                break
    return found


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``base`` and ``extra``, arrays of spans (start, kind, end, token) by start and kind.

    A null or empty text has no spans. Kinds are numbered as in ``KINDS``; ``extra`` has the battery's spans (kind
    ``len(KINDS)``) that touch no base span. Other columns are ignored; equal rows get equal answers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = len(KINDS)
    base = F.array_sort(F.concat(*(base_spans(text, k) for k in range(own))))
    free = F.when(text.rlike(CANDIDATE), matches(text, CANDIDATE, 0, own)).otherwise(F.array().cast(SPAN))
    found = docs.select("doc_id", base.alias("base"), free.alias("free"))
    found = found.withColumn("free", apart(F.col("free"), F.col("base")))
    tested = F.transform("free", lambda s: F.struct(s.alias("span"), randomness(s["token"]).alias("test")))
    found = cut(found.select("doc_id", "base", tested.alias("free")))
    tests = found.select(F.explode("free.test").alias("t")).select(_band(F.col("t.n"), F.col("t.encoding")).alias("band"), "t.p")
    least = thresholds(tests, rate)
    table = F.create_map(*(F.lit(x) for item in least.items() for x in item)) if least else F.create_map().cast("map<string,double>")
    extra = F.filter("free", lambda c: F.coalesce(c["test"]["p"] >= F.element_at(table, _band(c["test"]["n"], c["test"]["encoding"])), F.lit(False)))
    return found.select("doc_id", "base", F.transform(extra, lambda c: c["span"]).alias("extra"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("random"))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:  # a lambda of two parameters would get the element's place as the second
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind][0]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "extra"))).alias("spans"))
