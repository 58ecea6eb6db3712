"""Quality of texts by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Each passage becomes a vector of what kinds of characters follow
each other, how long its words are and how often they repeat. A small network encodes the passages, gated attention
weighs them, and the weighted mean gives the document's score; encoder, attention and output are learned together
from document labels alone.

Only the fit sees a sample: at most ``most`` labelled documents, chosen by a hash of their id, and of these, in the
same order, as many whole documents as have at most ``most_passages`` passages together. Every document is scored on
its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookframe.llm.scratch import cut
from brookframe.llm.words import Words, blocks

WORDS = 64
#: Bounds of the sample for the fit; 200,000 passages are about 60 MB on the driver.
MOST, MOST_PASSAGES = 3000, 200_000
_HIDDEN, _GATE = 16, 8
_KINDS = 12
_KIND = np.full(256, 10, np.uint8)
_KIND[128:] = 0
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
for _i, _set in enumerate((b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"|", b"#*$%&<>", b"'\"()-")):
    _KIND[list(_set)] = 3 + _i if _i < 7 else 11
FEATURES = _KINDS * _KINDS + 4


def bags(text: pa.Array):
    """For each text the feature rows of its passages, at least one; a text without words has one row of zeros."""
    for row, to, data, offsets in blocks(text):
        w = Words(data, offsets)
        counts = np.diff(w.bounds)
        each = np.maximum(-(-counts // WORDS), 1)
        first = np.concatenate(([0], np.cumsum(each)))
        n = int(first[-1])
        doc = np.repeat(np.arange(to - row), counts)
        of_word = first[doc] + (np.arange(len(w.hash)) - w.bounds[doc]) // WORDS
        x = np.zeros((n, FEATURES), np.float32)
        if len(w.hash):
            size = np.bincount(of_word, minlength=n).astype(np.float32)
            at = np.full(len(data), -1, np.int64)
            opens = np.concatenate(([True], of_word[1:] != of_word[:-1]))
            at[offsets[:-1][counts > 0]] = first[:-1][counts > 0]
            at[w.start[opens]] = of_word[opens]
            of_byte = np.maximum(np.maximum.accumulate(at), 0)
            kind = _KIND[data].astype(np.int64)
            pairs = of_byte[1:] * (_KINDS * _KINDS) + kind[:-1] * _KINDS + kind[1:]
            grid = np.bincount(pairs, minlength=n * _KINDS * _KINDS).reshape(n, -1)[:n]
            x[:, :-4] = np.sqrt(grid / np.maximum(grid.sum(axis=1, keepdims=True), 1))
            long = np.bincount(of_word, w.end - w.start, minlength=n)
            _, one = np.unique(w.hash + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
            different = np.bincount(of_word[one], minlength=n)
            same = np.bincount(of_word[1:], (w.hash[1:] == w.hash[:-1]) & ~opens[1:], minlength=n)
            full = np.maximum(size, 1)
            x[:, -4:] = np.stack([long / full / 10, different / full, same / full, np.minimum(size / WORDS, 1)], axis=1)
        for a, b in zip(first[:-1], first[1:]):
            yield x[a:b]


class AttentionModel:
    """Gated attention over passages; parameters are a dict of arrays."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fit(cls, xs: list[np.ndarray], y: np.ndarray, steps: int = 300, rate: float = 0.03) -> AttentionModel:
        rng = np.random.default_rng(5)
        every = np.concatenate(xs)
        p = {"mean": every.mean(axis=0), "scale": every.std(axis=0) + 0.05}
        p |= {"w": rng.normal(0, 0.08, (FEATURES, _HIDDEN)), "c": np.zeros(_HIDDEN), "v": rng.normal(0, 0.2, (_HIDDEN, _GATE)), "u": rng.normal(0, 0.2, (_HIDDEN, _GATE)), "a": rng.normal(0, 0.2, _GATE), "o": rng.normal(0, 0.2, _HIDDEN), "b": np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])}
        if len(set(y.tolist())) < 2:
            p["o"][:] = 0
            return cls(p)
        bag = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
        x = (every - p["mean"]) / p["scale"]
        names = ["w", "c", "v", "u", "a", "o", "b"]
        m, s = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
        for step in range(1, steps + 1):
            g = cls(p)._gradient(x, bag, y)
            for k in names:
                g[k] = g[k] + 1e-4 * p[k] * (k in "wvuao")
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return cls(p)

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["w"] + p["c"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = np.exp(np.clip((t * g) @ p["a"], -30, 30))
        weight = e / np.bincount(bag, e, minlength=n)[bag]
        starts = np.searchsorted(bag, np.arange(n))
        z = np.add.reduceat(h * weight[:, None], starts, axis=0)
        return h, t, g, weight, z, 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"][0], -30, 30)))

    def _gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, g, weight, z, q = self._forward(x, bag, len(y))
        d = (q - y) / len(y)
        dz = d[:, None] * p["o"]
        dh = weight[:, None] * dz[bag]
        dw = (h * dz[bag]).sum(axis=1)
        de = weight * (dw - np.bincount(bag, weight * dw, minlength=len(y))[bag])
        dt, dg = de[:, None] * p["a"] * g * (1 - t**2), de[:, None] * p["a"] * t * g * (1 - g)
        dh = dh + dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - h**2)
        return {"w": x.T @ dx, "c": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "o": z.T @ d, "b": np.array([d.sum()])}

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        if not xs:
            return np.zeros(0)
        bag = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
        return self._forward((np.concatenate(xs) - self.p["mean"]) / self.p["scale"], bag, len(xs))[-1]


def training_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents whose crc32(doc_id) mod 3 is not 1, chosen by a hash of the id."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, most_passages: int = MOST_PASSAGES) -> AttentionModel | None:
    """Learns from a bounded sample; None if no document has a label."""

    def run(batches):
        for batch in batches:
            found = [x.astype(np.float16).tobytes() for x in bags(batch.column("text"))]
            sizes = [len(x) // (2 * FEATURES) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "quality", "n", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(training_sample(docs, labels, most).mapInArrow(run, f"doc_id {kind}, quality int, n long, x binary"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("doc_id", "n").withColumn("total", F.sum("n").over(order)).filter(F.col("total") <= most_passages).select("doc_id", "n").distinct()
    rows = rows.join(F.broadcast(within), ["doc_id", "n"], "left_semi").select("doc_id", "quality", "x").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    xs = [np.frombuffer(x.as_py(), np.float16).reshape(-1, FEATURES).astype(np.float32) for x in rows.column("x")]
    return AttentionModel.fit(xs, rows.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` with ``score`` (double; 0.5 if nothing is labelled); equal rows get equal scores, an empty table stays empty, and texts of any length are read whole. Only texts are inputs of a score; null texts count as empty, and empty ones get what the network says of an empty passage. A column named score is replaced."""
    model = fit(docs, labels, most)
    docs = docs.drop("score")

    def run(batches):
        for batch in batches:
            found, pending, size = [], [], 0
            for x in bags(batch.column("text")):
                pending.append(x)
                size += len(x)
                if size > 4096:
                    found.append(model.scores(pending))
                    pending, size = [], 0
            found.append(model.scores(pending))
            out = pa.array(np.concatenate(found), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "score"])

    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
