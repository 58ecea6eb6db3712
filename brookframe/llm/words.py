"""Words of Arrow text columns as arrays: spans, 64-bit hashes and shingles of a whole block at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D; with ``lower`` A-Z count as a-z. Hashes are those of whole
words (a random 64-bit value per byte, summed with powers of an odd base, then mixed), so two texts share a hash
when they share the word, up to 64-bit collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK * 2), base, np.uint64)
        full[0] = 1
        have = _powers[name] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of consecutive texts: ``start``/``end`` bytes, ``hash`` and the ``bounds`` of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = SPACE[data]
        first = np.ones(n + 1, bool)
        first[1:n] = space[:-1]
        first[offsets] = True
        last = np.ones(n + 1, bool)
        last[: n - 1] = space[1:]
        last[offsets[offsets > 0] - 1] = True
        word = ~space
        self.start = np.flatnonzero(word & first[:n])
        self.end = np.flatnonzero(word & last[:n]) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _TABLE)[data] * _power(_BASE, n, "up"), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _power(_BACK, n, "down")[self.start] if n else np.zeros(0, np.uint64)
        self.hash = mix(h)
        self.bounds = np.searchsorted(self.start, offsets)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` words in a row within a text, and each text's bounds in them. A text of 1 to k - 1 words gives one for all of its words."""
        h, n = self.hash, len(self.hash)
        counts = np.diff(self.bounds)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out[: n - i] += mix(h[i:] + np.uint64(i * 0x51_7CC1 + 1)) if n > i else 0
        keep = np.ones(n, bool)
        ends = self.bounds[1:]
        for i in range(1, k):
            at = ends - i
            keep[at[(counts >= i) & (counts > 0)]] = False
        short = np.flatnonzero((counts > 0) & (counts < k))
        for s in short:
            a, b = self.bounds[s], self.bounds[s + 1]
            out[a] = mix(h[a:b] + np.arange(b - a, dtype=np.uint64) * np.uint64(0x51_7CC1) + np.uint64(1)).sum(dtype=np.uint64) ^ np.uint64(b - a)
            keep[a] = True
        total = np.concatenate(([0], np.cumsum(keep)))
        return mix(out[keep]), total[self.bounds]


def blocks(text: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole texts of about ``size`` bytes: (from row, to row, bytes, offsets). Null counts as empty."""
    text = pc.fill_null(text, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if len(text) == 0:
        return
    large = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if large else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
