"""Counts at every prefix against the library that the vocabulary is for."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brookframe.llm import queries
from brookframe.llm.token_prefixes import characters_within, n_tokens, prefix_counts, tokens_before, truncated, with_prefix_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "e", "th", "ing", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "'", "'re", "'ll", "'ve", "'s", "don't", "1", "23", "é", "漢", "字", "😀", "!", "?..",
    "<|", "|>", "<|endoftext", "<|endoftext|>", " and", "Word", " -- ", "​", "²",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_library(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_of_odd_texts(library):
    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert prefix_counts(PATH).of(text).tolist() == [by_library(library, text[:i]) for i in range(1, len(text) + 1)], text


def test_long_runs(library):
    for text in ("a" * 30_000, "ab é" * 9_000, " " * 5_000 + "x", "<|endoftext|>" * 2_000, "=-" * 20_000):
        assert int(prefix_counts(PATH).of(text)[-1]) == by_library(library, text)


def test_whole_table_against_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_prefix_counts(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        n = by_library(library, texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_budgets_and_edges(spark, library):
    texts = [None, "", " ", "plain words in a row", "I'll see <|endoftext|> é 漢字\n\n  x", "we're"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(1, "", 7), (None, "x y", 7)], "doc_id long, text string, prefix_tokens int")
    counted = with_prefix_counts(docs, PATH)
    assert counted.columns == ["doc_id", "text", "prefix_tokens"] and counted.count() == len(texts) + 2
    counts = F.col("prefix_tokens")
    out = counted.select("text", n_tokens(counts).alias("n"), tokens_before(counts, 3).alias("three"), tokens_before(counts, -1).alias("none"), characters_within(counts, 2).alias("fit"), truncated(F.col("text"), counts, 2).alias("cut")).collect()
    for r in out:
        t = r.text or ""
        assert (r.n, r.three, r.none) == (by_library(library, t), by_library(library, t[:3]), 0)
        assert r.fit == max(i for i in range(len(t) + 1) if by_library(library, t[:i]) <= 2)
        assert (r.cut or "") == t[: r.fit]
    assert not with_prefix_counts(docs.limit(0), PATH).collect()
    with pytest.raises(ValueError):
        prefix_counts(public_tokenizers.path("word_bpe_49k.json"))


def test_candidates_are_all_entries_that_end_at_a_place():
    """Each byte costs one step of the automaton, and what it lists there is what a search among all entries finds."""
    counter, rng = prefix_counts(PATH), random.Random(12)
    longest = max(map(len, counter.ids))
    for _ in range(300):
        data = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))).encode()
        here = 0
        for end, byte in enumerate(data, 1):
            here = counter.after[here << 8 | byte]
            found = [(end - i, counter.ids[data[i:end]]) for i in range(max(0, end - longest), end) if data[i:end] in counter.ids]
            assert counter.entries[here] == found, data[:end]
