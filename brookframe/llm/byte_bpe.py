"""Ids of a byte-level BPE vocabulary file of the ``tokenizers`` library, with each worker remembering its words.

The file's vocabulary runs on ``tiktoken``'s merge loop, which gives the same ids several times as fast. A string of a
special token in a text is that token, as the library has it, and cuts the text.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

#: How this family of vocabularies cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than a space or a line feed.
_RARE = re.compile(r"[^\S \n]")
_REMEMBERED = 300_000


def _bytes_by_character() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memory(dict):
    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        ids = self[word] = array("I", self.encode(self.prefix + word)).tobytes()
        return ids


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {s: array("I", [i]).tobytes() for s, i in special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        of = _bytes_by_character()
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        for at, merge in enumerate(spec["model"]["merges"]):
            if vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)] != 256 + at:
                raise ValueError(f"{path}: ids don't follow the order of merges")
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(of[c] for c in t): i for t, i in vocab.items()}, special_tokens={})
        self.encode, self.encode_bytes = encoding.encode_ordinary, encoding._encode_single_piece
        self.first, self.later = _Memory(self.encode, ""), _Memory(self.encode, " ")

    def ids(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if any(s in text for s in self.special):
            return b"".join(self.special[part] if part in self.special else self._plain(part) for part in self.at_special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """Where single spaces and line feeds are the only white space, the pattern cuts before each and after each line feed, so words can be encoded one by one."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _RARE.search(text):
            return array("I", self.encode(text)).tobytes()
        out = []
        for i, line in enumerate(text.split("\n")):
            head, *rest = line.split(" ")
            if i:
                out.append(self.first["\n"])
            out.append(self.first[head])
            out.extend(map(self.later.__getitem__, rest))
        return b"".join(out)


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
