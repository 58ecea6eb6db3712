"""Near words against deletion of every character of every word, and the bound that the gram lists rest on."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brookframe.llm import queries, spelling


def brute_near(words):
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1 :]].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def brute(words):
    near, form = brute_near(words), {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def vocabulary(rng, n):
    parts = ["tion", "er", "an", "the", "st", "ing", "é", "aa", "b", "ou"]
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeztÿ") + w[i:], w[:i] + rng.choice("aeztÿ") + w[i + 1 :]]) or "x"
        if len(w) >= 2:
            out[w] = int(3 / rng.random() ** 1.5)
    return out


@pytest.mark.parametrize("longest", [2, 3, 4, 6])
def test_near_words_share_a_list_whatever_the_dictionary(longest):
    """Only by the lists, without Spark: every near pair has a common one."""
    rng = random.Random(longest)
    words = vocabulary(rng, 1500)
    counts = defaultdict(int)
    for w in words:
        for size in range(2, longest + 1):
            for i in range(len(w) + 3 - size):
                counts[f"^{w}$"[i : i + size]] += 1
    dictionary = spelling.GramDictionary({g: n for g, n in counts.items() if n > 20}, longest)
    lists = {w: set(dictionary.lists(w)) for w in words}
    for a, others in brute_near(words).items():
        for b in others:
            if len(a) == len(b):
                assert lists[a] & lists[b], (a, b)
            elif len(a) < len(b):
                assert lists[a] & (lists[b] | {(k, i - 1, g) for k, i, g in lists[b]}), (a, b)


def test_variants_against_brute_force(spark):
    words = vocabulary(random.Random(1), 2500)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling.spelling_variants(df).collect()} == brute(words)


def test_whole_table_against_sql(spark, sf, con):
    got = queries.op13_gram_variants(spark, sf)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert got.columns == columns
    assert {tuple(r) for r in got.collect()} == set(con.execute(spelling.SQL).df()[columns].astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None))


def test_edges(spark):
    long = "ab" * 20_000
    rows = [(None, 5, 1), ("", 3, 1), ("x", 9, 1), ("y", 9, 1), ("ab", 4, 1), ("abc", 9, 1), ("abc", 1, 1), (long, 3, 1), (long + "c", 6, 1), ("a$^b", 1, 1)]
    df = spark.createDataFrame(rows, "word string, n long, form int")
    out = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(df).collect()}
    assert out["abc"] == (None, "abc", 10, 1, None) and out["ab"] == ("abc", "abc", 4, 1, 10)
    assert out[""] == (None, "", 3, 0, None) and out["x"] == (None, "x", 9, 0, None) and None not in out
    assert out[long] == (long + "c", long + "c", 3, 1, 6)
    assert not spelling.spelling_variants(df.limit(0)).collect()


def test_counting_words(spark):
    docs = spark.createDataFrame([(1, "Aaaaa aaaaa, AAAAA bb-Ébbbb"), (None, None), (None, ""), (2, "Ébbbb×x ébbbb Ébbbb 1Ébbbb")], "doc_id long, text string").withColumn("word", F.lit(1))
    assert {tuple(r) for r in spelling.damaged_words(docs, one_in=10**12).collect()} == {("aaaaa", 3), ("Ébbbb", 3)}
    assert not spelling.damaged_words(docs.limit(0)).collect()
