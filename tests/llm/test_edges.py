"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns: each has a defined result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brookframe.llm import brown_lm, decontaminate, line_rules, line_templates, lsh_forest, mil_quality, packing, paragraphs, secrets, url_lm

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
#: doc_id, text, lang, source, n_chars; then columns whose names the operators use inside
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, LONG, None, "a", len(LONG)), (5, TEXT, "en", "a", 9),
    (5, TEXT, "en", "a", 9), (6, TEXT, "en", "a", 9), (7, "a", "en", "a", 1), (None, TEXT, "en", "a", 9), (None, None, None, None, None), (8, "é ü 漢字\u00a0x\n\n\n", "en", "a", 9),
]
EXTRA = ["id", "component", "score", "kept", "key", "at", "row", "word", "c", "n", "gone", "_key", "_words", "bucket", "length", "rank", "hash", "cleaned", "n_lines"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(7).alias(c) for c in EXTRA))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None, 1), (2, "", 1), (3, TEXT, 1), (3, TEXT, 1), (None, "x y", 1)], "item_id long, text string, doc_id int")


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))


ALL = ids([type("R", (), {"doc_id": r[0]}) for r in ROWS])


def test_spaced_seeds(docs, benchmark):
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.start) for r in found} == {(d, 3, 16, 0) for d in (5, 6, None)}
    by_shuffle = decontaminate.contaminated(docs, benchmark, broadcast_bytes=0).collect()
    assert {tuple(r) for r in by_shuffle} == {tuple(r) for r in found}
    assert not decontaminate.contaminated(docs.limit(0), benchmark).collect()
    assert not decontaminate.contaminated(docs, benchmark.limit(0)).collect()


def test_line_templates(docs):
    out = line_templates.drop_recurring_lines(docs)
    rows = out.collect()
    assert ids(rows) == ALL and set(out.columns) == set(docs.columns) | {"n_dropped"} and rows[0].gone == 7
    assert all(r.n_dropped == 0 for r in rows)
    assert [r.n_lines for r in rows if r.doc_id == 1] == [0] and [r.text for r in rows if r.doc_id == 1] == [None]
    assert not line_templates.drop_recurring_lines(docs.limit(0)).collect()


def test_brown_lm(docs):
    rows = brown_lm.score_texts(docs, docs, rounds=1).collect()
    assert ids(rows) == ALL
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3)) and all(r.n_known == r.n_tokens for r in rows)
    untrained = brown_lm.score_texts(docs, docs.limit(0), rounds=1).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)
    assert not brown_lm.score_texts(docs.limit(0), docs, rounds=1).collect()


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net", "x://org/fr/1?q", "http://b.example.com/de/2#f", "http://c.example.net/en/3", "http://c.example.net/en/3", "http://é.io/" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, text int")
    rows = {r.page_id: r for r in url_lm.judge_urls(pages).collect()}
    assert len(rows) == len(urls) and all(r.verdict in ("allow", "block") for r in rows.values())
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(9)] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.net", "/x", "net/"), ("net", "", None), ("org", "/fr/1", "org/fr/"), ("b.example.com", "/de/2", "example.com/de/"), ("c.example.net", "/en/3", "example.net/en/"),
    ]
    assert {r.verdict for r in url_lm.judge_urls(pages.filter("page_id < 4")).collect()} == {"allow"}
    assert not url_lm.judge_urls(pages.limit(0)).collect()


def test_paragraphs(docs):
    rows = paragraphs.repeated_spans(docs, least_words=16).collect()
    assert {(r.doc_id, r.n_words, r.kept_doc, r.removed) for r in rows if r.doc_id in (5, 6)} == {(5, 16, 5, False), (6, 16, 5, True)}
    assert {r.doc_id for r in rows} == {5, 6}
    assert not paragraphs.repeated_spans(docs.limit(0)).collect()


def test_mil_quality(docs, labels):
    rows = mil_quality.score(docs, labels).collect()
    assert ids(rows) == ALL and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in mil_quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert not mil_quality.score(docs.limit(0), labels).collect()


def test_packing(docs):
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in rows} == set(ALL) and [r.length for r in rows if r.doc_id == 1] == [1]
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 4)
    assert all(n == 1024 for _, _, n in long[1:]) and all(s + n == t for (_, s, n), (_, t, _) in zip(long, long[1:]))
    assert not packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect()


def test_secrets(docs):
    rows = secrets.digest(secrets.find_secrets(docs)).collect()
    assert ids(rows) == ALL and all(r.spans == "" for r in rows)
    assert not secrets.find_secrets(docs.limit(0)).collect()


def test_lsh_forest(docs):
    rows = lsh_forest.near_duplicates(docs).collect()
    assert ids(rows) == ALL
    of = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 12, 5, True), (6, 12, 5, False), (7, 1, 7, True)} <= of
    assert not lsh_forest.near_duplicates(docs.limit(0)).collect()


def test_line_rules(docs):
    rows = line_rules.judge(docs).collect()
    assert ids(rows) == ALL
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.kept for r in rows if r.doc_id in (5, 6))
    assert not line_rules.judge(docs.limit(0)).collect()


def test_line_rules_reject_short_documents_without_words_left(spark):
    bar = "Home | News | Sport | Weather | Shop | Help | About | Jobs"
    rows = [(1, bar), (2, f"{bar}\nonly four words stay"), (3, f"All rights reserved, see the terms\n{TEXT[:60]} and more"), (4, TEXT)]
    out = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in out.values()) and all(r.n_removed_chars < 100 for r in out.values())
    assert {d: r.kept for d, r in out.items()} == {1: False, 2: False, 3: True, 4: True}


def test_urls_are_judged_by_query_and_fragment_too(spark):
    urls = [f"http://a.net/p{i % 3}?casino=win{i % 4}" for i in range(40)] + [f"http://a.example.net/en/p{i % 3}?page=doc{i % 4}" for i in range(40)]
    urls += ["http://a.example.net/en/p1?casino=win1"]  # between the classes, so that the cut is
    urls += ["http://b.io/p1?casino=win1", "http://b.io/p1?page=doc1", "casino=win2", "page=doc2", "http://b.io/p1#casino=win3", "http://b.io/p1#page=doc3"]
    rows = {r.page_id: r for r in url_lm.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [rows[i].verdict for i in range(81, 85)] == ["block", "allow"] * 2
    assert rows[85].score == rows[86].score and rows[85].url_score < rows[86].url_score


def test_pipeline_stages(spark, sf, docs, tmp_path):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (table, table.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf)
            at.write.parquet(path := f"{tmp_path}/{name}{start is table}")
            at = spark.read.schema(at.schema).parquet(path)
            if name != "packing":
                assert at.columns == table.columns
    assert at.count() == 0


def test_near_dedup_and_decontamination_judge_rows_of_one_id_by_their_own_texts(spark, sf):
    """Also rows without an id, and rows that repeat both id and text, of which one stays."""
    a, b = TEXT, " ".join(f"b{i}" for i in range(30))
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, a), (5, b), (5, a), (6, leak), (6, "quite other words " * 5), (7, b + " end"), (8, "x y z"), (8, "x y z"), (None, b), (None, leak)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    left = [(r.doc_id, r.text) for r in stages["near_dedup"](spark, docs, sf).collect()]
    assert sorted(left, key=repr) == sorted([(1, a), (5, b), (6, leak), (6, "quite other words " * 5), (8, "x y z"), (None, b), (None, leak)], key=repr)
    left = [(r.doc_id, r.text) for r in stages["decontaminate"](spark, docs, sf).collect()]
    assert sorted(left, key=repr) == sorted([x for x in rows if x[1] != leak], key=repr)


def test_classes_that_share_their_least_id_stay_apart(spark, sf):
    """A near copy of one text of an id doesn't take the id's other texts along."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, f"{a} more"), (5, a), (5, b), (9, c), (5, a), (7, f"{c} more"), (7, f"{b} more")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs).collect())
    assert out == sorted([(1, 57, 1, True), (5, 56, 1, False), (5, 56, 5, True), (9, 56, 7, False), (5, 56, 1, False), (7, 57, 7, True), (7, 57, 5, False)])
    left = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).collect()]
    assert sorted(left) == sorted([(1, f"{a} more"), (5, b), (7, f"{c} more")])


def test_packing_reads_special_tokens_as_the_library_does(spark):
    import zlib
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a  <|endoftext|>\n<|endoftext|"]
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect():
        ids = [*Tokenizer.from_file(path).encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def test_links_are_those_of_the_plain_pattern_in_linear_time(spark):
    import random
    import re

    plain = r"(?:https?://|www\.)[^\x20\x09-\x0D]+|[^\x20\x09-\x0D]+@[^\x20\x09-\x0D]+\.[^\x20\x09-\x0D]+"
    rng = random.Random(6)
    for _ in range(20_000):
        line = "".join(rng.choices(["a", "@", ".", " ", "www.", "http://", "b\t"], [5, 3, 3, 1, 1, 1, 1], k=rng.randint(0, 12)))
        assert [m.span() for m in re.finditer(plain, line)] == [m.span() for m in re.finditer(line_rules.LINKS, line)], line
    texts = ["@ " + "x" * 1_000_000, "@" * 300_000, "a@" * 200_000, "a@." * 100_000, "www." * 100_000]
    rows = line_rules.judge(spark.createDataFrame([(i, f"{TEXT}\n{t}") for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(rows) == len(texts)


def test_the_end_of_few_long_texts_has_a_probability(spark):
    """One end in 600,000 words is under the share of known words; the model still gives it one, of at most 1."""
    training = spark.createDataFrame([(1, "one two three four five six " * 100_000)], "doc_id long, text string")
    row = brown_lm.score_texts(spark.createDataFrame([(2, "")], "doc_id long, text string"), training, rounds=1).first()
    assert row.n_tokens == row.n_known == 1 and row.score <= 0


def test_line_rules_share_the_work_of_phrases_and_words(spark):
    """Phrases are found as by one alternative each, words are counted as by a search, and no word is hashed once a window."""
    plain = line_rules.BOILERPLATE.index("(?:")
    apart = line_rules.BOILERPLATE[:plain] + "(?:" + "|".join(line_rules.PHRASES) + r")(?!\p{L})"
    assert apart != line_rules.BOILERPLATE
    texts = [x for p in line_rules.PHRASES for q in (p.replace("[sc]", "s").replace(" ?", "").replace("(?:use|service)", "use").replace("(?:this|on)", "on"),) for x in (q, q.upper(), f"x{q}", f"{q}x", f"-{q}, {q}.", q[:-1])]
    texts += ["", " ", "\n\t", " a  b\x0b", "\x1fa\u00a0b c", "a \r\n b", "copyriGHT \u017fign up", "#*$%&|<> !!", "a a a a a a\r", "a a a a", "b aa a a a a a"] + [" ".join("w" * n) for n in (9, 10, 11)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = F.col("text")
    counted = line_rules.clean_lines(line_rules.text_counts(df)).select(
        "*", F.regexp_count(t, F.lit(line_rules.BOILERPLATE)).alias("found"), F.regexp_count(t, F.lit(apart)).alias("apart"),
        F.regexp_count(t, F.lit(line_rules.WORD)).alias("words"), (F.regexp_count("cleaned", F.lit(line_rules.WORD)) >= 10).alias("enough"), line_rules._count(t, line_rules.SYMBOLS).alias("symbols"),
    )
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(slice(" not in plan
    rows = counted.collect()
    assert len(rows) == len(texts) and sum(r.found for r in rows) > 4 * len(line_rules.PHRASES)
    for r in rows:
        assert r.found == r.apart and r._n_words == r.words and r._word_chars == len("".join(x for x in r.text if x not in " \t\n\x0b\x0c\r")), r.text
        assert r.symbols == r._n_symbols == sum(c in line_rules.SYMBOLS for c in r.text) and r._passed == (r.enough and r._lost <= 0.5), r.text
