"""Exact token counts of every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

The tokens of a prefix are those of a shorter prefix and one more: the only vocabulary entry that ends there and
stays a token beside the last one before it. So one pass over a text's bytes gives the count at each place, and
questions about truncation and budgets are answered from the stored counts, without encoding anything again.

Counts are those of the ``tokenizers`` library for the text cut there: a string of a special token is that token
once it is whole and ordinary text before, white space at the cut is one run, and a contraction that isn't whole yet
is an apostrophe and a letter. A null text counts as empty and has no prefixes; texts of any length are read whole,
and all rows and columns stay as they are. Counts are per character (code point), of the first 1, 2, ... characters.
"""

from __future__ import annotations

import functools
import json
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.llm.byte_bpe import PATTERN, ByteBpe, _bytes_by_character

#: White space as the vocabulary's own library sees it.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
_SPACE = regex.compile(f"[{SPACES}]")
_IRREGULAR = regex.compile(rf"[{SPACES}]{{2}}|(?![ \n])[{SPACES}]")
#: Words that a worker remembers, about 250 MB; a quarter of them for other pieces; and their longest.
_WORDS, _REMEMBERED, _LONGEST_REMEMBERED = 1_000_000, 250_000, 64
#: Characters of text in one Arrow batch of results, unless one text alone has more.
_BATCH = 1 << 20


class _Memory(dict):
    def __init__(self, make, most: int = _REMEMBERED):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if isinstance(key, int) or len(key) <= _LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class PrefixCounts:
    """The counts of one vocabulary file; each worker remembers words and pairs of tokens, both in bounded number."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no byte-level BPE vocabulary")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        of, ranks = _bytes_by_character(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(of[c] for c in t) for t, i in ranks.items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # ids follow the order of merges (ByteBpe checks it), so the id that a pair merges to is also its rank
        self.merged = {(ranks[a], ranks[b]): ranks[a + b] for a, b in merges}
        self.halves = {i: (i, i) for i in self.bytes_of} | {ranks[a + b]: (ranks[a], ranks[b]) for a, b in merges}
        encode = ByteBpe(path).encode_bytes
        # an entry that its own merges don't arrive at is never a token
        self.ids = {b: i for i, b in self.bytes_of.items() if encode(b) == [i]}
        beginnings = sorted({data[:i] for data in self.ids for i in range(len(data) + 1)}, key=len)
        #: The beginnings of entries by number, and the entries that each of them ends with as (bytes, id), the longest first.
        self.beginnings, self.number = beginnings, {data: i for i, data in enumerate(beginnings)}
        self.entries = [[(len(data) - i, self.ids[data[i:]]) for i in range(len(data)) if data[i:] in self.ids] for data in beginnings]
        self.after = _Memory(self._after, 4 * _REMEMBERED)
        self.beside = _Memory(lambda pair: self._stays(pair >> 32, pair & 0xFFFFFFFF), 2 * _REMEMBERED)
        self.piece = _Memory(self._of_piece)
        self.first = _Memory(self._of_word)
        self.later = _Memory(lambda word: self._of_word(" " + word), _WORDS)

    def _stays(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens in a row are encoded as these two: no merge across their border comes before the merges inside that close it.

        The merges of both tokens are taken back, the latest first; a pair that then touches at the border must not
        merge earlier than what was just taken back.
        """
        before = 1 << 62
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            inner_left, inner_right = self.halves[left], self.halves[right]
            whole_left, whole_right = inner_left[0] == left, inner_right[0] == right
            if whole_left and whole_right:
                return True
            # of equal merges the left one is done first, so one at the border still comes before an equal one on the right
            if whole_right or (not whole_left and left > right):
                before, left = left, inner_left[1]
            else:
                before, right = right + 1, inner_right[0]

    def _after(self, step: int) -> int:
        """The longest beginning of an entry that the bytes of another one (``step >> 8``) and a byte more end with."""
        data = self.beginnings[step >> 8] + bytes([step & 0xFF])
        while data not in self.number:
            data = data[1:]
        return self.number[data]

    def _of_bytes(self, data: bytes) -> list[int]:
        """The number of tokens of the first 0, 1, 2, ... bytes of a piece.

        Of all entries that end at a place exactly one fits; the longest is tried first. All of them are ends of the
        longest beginning of an entry that ends there, which follows from the one at the place before.
        """
        after, entries, beside, here = self.after, self.entries, self.beside, 0
        counts, last, end = [0] * (len(data) + 1), [-1] * (len(data) + 1), 0
        for byte in data:
            end += 1
            here = after[here << 8 | byte]
            for size, token in entries[here]:
                if (before := last[end - size]) < 0 or beside[before << 32 | token]:
                    counts[end] = counts[end - size] + 1
                    last[end] = token
                    break
        return counts

    def _of_piece(self, piece: str) -> bytes:
        """How the count changes with each character of a text that the pattern doesn't cut, in signed bytes: a character adds at most four tokens, and the token that it completes replaces fewer than its bytes."""
        data = piece.encode("utf-8", "surrogatepass")
        counts = self._of_bytes(data)
        if len(data) > len(piece):
            counts = [n for n, b in zip(counts, [*data, 0]) if b & 0xC0 != 0x80]
        if len(piece) == 3 and piece[0] == "'" and PIECE.match(piece[:2]).end() == 1:
            counts[2] = 2  # 'r of 're: an apostrophe and a letter
        return array("b", map(sub, counts[1:], counts)).tobytes()

    def _of_word(self, word: str) -> bytes:
        if word.isascii() and word.lstrip(" ").isalpha():
            return self._of_piece(word)
        return b"".join([self.piece[p] for p in PIECE.findall(word)])

    def of(self, text: str) -> np.ndarray:
        """The count of each prefix of 1, 2, ... characters."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self._plain(text)
        parts, base, at = [], 0, 0
        for m in found:
            counts = self._plain(text[at : m.end() - 1])
            parts.append(counts + base)
            base += (int(counts[m.start() - at - 1]) if m.start() > at else 0) + 1
            parts.append(np.array([base]))
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:]) + base]).astype(np.int32)

    def _plain(self, text: str) -> np.ndarray:
        """Counts of a text without strings of special tokens. White space that is regular cuts it into words before the pattern does."""
        if _IRREGULAR.search(text):
            return self._irregular(text)
        units: list[bytes] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                units.append(self.first["\n"])
            head, *rest = line.split(" ")
            if head:
                units.append(self.first[head])
            units.extend(map(self.later.__getitem__, rest))
        return np.cumsum(np.frombuffer(b"".join(units), np.int8), dtype=np.int32)

    def _irregular(self, text: str) -> np.ndarray:
        pieces = PIECE.findall(text)
        out = np.cumsum(np.frombuffer(b"".join([self.piece[p] for p in pieces]), np.int8), dtype=np.int32)
        at = base = 0
        for p, following in zip(pieces, [*pieces[1:], ""]):
            at += len(p)
            if _SPACE.match(p[-1]) and _SPACE.match(following):
                out[at] = base + sum(array("b", self.piece[p + following[0]]))  # cut here, the white space is one run
            base = int(out[at - 1])
        return out


@functools.cache
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def with_prefix_counts(docs: DataFrame, tokenizer: str, text: str = "text", to: str = "prefix_tokens") -> DataFrame:
    """``docs`` with ``to``, an array of the token counts of all prefixes of ``text``; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != to]

    def run(batches):
        counter = prefix_counts(tokenizer)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            start, size, found = 0, 0, []
            for i, value in enumerate(batch.column(at)):
                found.append(counter.of(value.as_py() or ""))
                size += len(found[-1])
                if size >= _BATCH or i + 1 == batch.num_rows:
                    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(found)).columns, lists], [*batch.schema.names, to])
                    start, size, found = i + 1, 0, []

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField(to, T.ArrayType(T.IntegerType(), False))]))


def tokens_before(counts: Column, characters: Column | int) -> Column:
    """Tokens of the text cut after so many characters (all of them, if it has fewer)."""
    at = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(counts))
    return F.when(at > 0, F.get(counts, at - 1)).otherwise(0)


def n_tokens(counts: Column) -> Column:
    """Tokens of the whole text."""
    return tokens_before(counts, F.size(counts))


def characters_within(counts: Column, budget: Column | int) -> Column:
    """The length of the longest prefix of at most ``budget`` tokens. A longer prefix can have fewer tokens, so all are looked at."""
    return F.coalesce(F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i + 1))), F.lit(0))


def truncated(text: Column, counts: Column, budget: Column | int) -> Column:
    """The longest prefix of ``text`` of at most ``budget`` tokens."""
    return F.substring(text, F.lit(1), characters_within(counts, budget))
