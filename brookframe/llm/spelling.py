"""Words that differ by one character, found with a variable-length gram index, and the most frequent spelling of each.

Words get a mark at either end. A gram dictionary is grown level by level: grams of two characters, and longer ones
whose beginning is still frequent, so that lists of common grams are broken up while rare grams stay short. A word
is decomposed into the longest dictionary gram at each place, without grams that lie inside the one before. One
edit spoils only so many of a word's grams: those that hold the edited place, and those that a longer gram reaching
to that place could swallow. This bound is known for each word, so of any two near words one of the first (bound + 1)
grams of each, in one order of all grams with the rarest first, is common to both at places that fit. Only these
lists are merged, by word length and place, and what meets is verified by its edit distance. Words whose bound is
as large as their number of grams also go by their grams of two characters, of which one edit spoils two.

Longer grams make rarer lists but larger bounds: with grams of up to 4 characters and lists of 64, the 92,281 words of
0.1 sf meet 101 others each (of up to 6: 436, as 81 words of 100 then also go by pairs; of 2 alone: 448).

Only the frequent grams reach the driver and the tasks, at most ``most`` of each length. Null words and words under
two characters are near nothing; of rows that repeat a word the counts add up; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookframe.llm import checksums
from brookframe.llm.scratch import Scratch, cut

RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task counts before it passes the counts on.
_COUNTED = 200_000


def damaged_words(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """``word, n`` of the letter runs of all texts, A-Z lower-cased, with a character deleted from each run whose checksum with the document's id ``one_in`` divides.

    Texts are read whole; a null text has no words, and a null id counts as the text ``null``. Equal runs of one
    document share their checksum, so they are counted first.
    """

    def run(batches):
        found: Counter[str] = Counter()

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if not h % one_in:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        found[word] += n
                if len(found) >= _COUNTED:
                    yield counted()
                    found.clear()
        if found:
            yield counted()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


@dataclass(frozen=True)
class GramDictionary:
    """The frequent grams and how often they are; any gram of two characters, and any frequent gram with a character more, is in the dictionary."""

    frequent: dict[str, int]
    longest: int

    @functools.cached_property
    def before(self) -> dict[str, int]:
        """By gram, the most characters that a frequent gram has in front of it."""
        out: dict[str, int] = {}
        for gram in self.frequent:
            for start in range(1, len(gram)):
                for end in range(start + 1, len(gram) + 1):
                    part = gram[start:end]
                    out[part] = max(out.get(part, 0), start)
        return out

    @functools.cached_property
    def before_end(self) -> dict[str, int]:
        """The same for grams that a frequent gram ends with."""
        out: dict[str, int] = {}
        for gram in self.frequent:
            if len(gram) < self.longest:
                for start in range(1, len(gram)):
                    out[gram[start:]] = max(out.get(gram[start:], 0), start)
        return out

    def reach(self, gram: str) -> int:
        """How many characters in front of ``gram`` a dictionary gram that swallows it can have."""
        return max(self.before.get(gram, 0), self.before_end.get(gram[:-1], 0))

    def decompose(self, marked: str) -> list[tuple[int, str]]:
        out, covered = [], 0
        for start in range(len(marked) - 1):
            end = start + 2
            while end < len(marked) and end - start < self.longest and marked[start:end] in self.frequent:
                end += 1
            if end > covered:
                out.append((start, marked[start:end]))
                covered = end
        return out

    def bound(self, marked: str, grams: list[tuple[int, str]]) -> int:
        """The most grams that one edit can spoil."""
        change = [0] * (len(marked) + 1)
        for start, gram in grams:
            change[max(start - self.reach(gram), 0)] += 1
            change[start + len(gram)] -= 1
        most = now = 0
        for i, x in enumerate(change):
            now += x
            if i:  # nothing is edited at the first mark
                most = max(most, now)
        return most

    def rarest(self, grams: list[tuple[int, str]], n: int) -> list[tuple[int, str]]:
        return sorted(grams, key=lambda g: (self.frequent.get(g[1], 0), -len(g[1]), g[1], g[0]))[:n]

    def lists(self, word: str) -> list[tuple[str, int, str]]:
        """Kind, place and gram of the lists that a word has to be in."""
        marked = f"^{word}$"
        grams = self.decompose(marked)
        bound = self.bound(marked, grams)
        out = [("v", *g) for g in self.rarest(grams, bound + 1)]
        if len(grams) <= bound:
            pairs = [(i, marked[i : i + 2]) for i in range(len(marked) - 1)]
            out += [("2", *g) for g in self.rarest(pairs, 3)]
        return out


def gram_dictionary(words: DataFrame, most: int = 1 << 15, least: int = 64, longest: int = 4) -> GramDictionary:
    """Grams of over ``least`` occurrences in the words and over one in ``most`` of all, so at most ``most`` of each length."""
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("m"))
    total = marked.agg(F.coalesce(F.sum(F.char_length("m")), F.lit(0))).first()[0]
    frequent: dict[str, int] = {}
    before = None
    for size in range(2, longest + 1):
        places = F.when(F.char_length("m") >= size, F.sequence(F.lit(1), F.char_length("m") - size + 1)).otherwise(F.array().cast("array<int>"))
        grams = marked.select(F.explode(F.transform(places, lambda i: F.substring("m", i, F.lit(size)))).alias("gram"))
        if before is not None:
            grams = grams.join(F.broadcast(before), F.substring("gram", 1, size - 1) == F.col("start"), "left_semi")
        rows = grams.groupBy("gram").count().filter(F.col("count") > max(least, total // most)).collect()
        if not rows:
            break
        frequent |= {r.gram: r["count"] for r in rows}
        before = words.sparkSession.createDataFrame([(r.gram,) for r in rows], "start string")
    return GramDictionary(frequent, longest)


def near_pairs(words: DataFrame, dictionary: GramDictionary) -> DataFrame:
    """``a, b, na, nb`` of the words that differ by one character, each pair once; ``words`` has distinct ``word`` and its ``n``.

    A list is of one gram at one place of words of one length. A word stands in the lists of its own length, and as
    the longer one of two in those of words a character shorter, where its grams are at their own place or, behind
    the edit, one further on.
    """

    def run(batches):
        for batch in batches:
            row, keys, longer = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                size = len(word)
                for kind, at, gram in dictionary.lists(word):
                    keys += [f"{kind}{size}:{at}:{gram}", f"{kind}{size - 1}:{at}:{gram}", f"{kind}{size - 1}:{at - 1}:{gram}"]
                    longer += [False, True, True]
                    row += [i, i, i]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row, pa.int64())).columns, pa.array(keys, pa.string()), pa.array(longer, pa.bool_())], ["word", "n", "key", "longer"])

    lists = words.filter(F.char_length("word") >= 2).select("word", "n").mapInArrow(run, "word string, n long, key string, longer boolean")
    lists = lists.select(F.xxhash64("key").alias("key"), "word", "n", "longer")
    a = lists.filter(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = lists.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), "longer")
    # the words themselves are the condition of the join, so what only shares a list never becomes a row
    found = a.hint("merge").join(b, (a["key"] == b["key"]) & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b", "na", "nb").dropDuplicates(["a", "b"])


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """``word, root``: where ``word, form`` lead to in the end. Each round doubles how far a word sees; the chain of forms at least doubles the count at each step, so it is short."""
    seen = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = scratch.save(seen.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        seen = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return seen


def spelling_variants(words: DataFrame, times: int = 2, most: int = 1 << 15) -> DataFrame:
    """Each word with ``form, root, n, n_near, form_n``: its near word of the largest count, if that is at least ``times`` its own, and where forms lead to.

    ``words`` has ``word`` and ``n``; other columns are left out.
    """
    with Scratch(words.sparkSession) as scratch:
        words = scratch.save(words.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        pairs = near_pairs(words, gram_dictionary(words, most))
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.struct((-F.col("nb")).alias("n"), F.col("b").alias("form")).alias("near")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.struct((-F.col("na")).alias("n"), F.col("a").alias("form")).alias("near")))).alias("p")).select("p.*")
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"), F.first("n").alias("own"))
        better = -F.col("near.n") >= times * F.col("own")
        best = scratch.save(best.select("word", "n_near", F.when(better, F.col("near.form")).alias("form"), F.when(better, -F.col("near.n")).alias("form_n")))
        ends = roots(scratch, best.filter("form is not null"))
        out = words.join(best, "word", "left").join(ends, "word", "left")
        return cut(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


#: What the query returns, by deleting each character of each word.
SQL = f"""WITH RECURSIVE {checksums.TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS c, hex(coalesce(doc_id::VARCHAR, 'null') || ':' || run) AS x FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, {checksums.crc32("x")} AS h FROM each, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
w AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w), d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM less),
near AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(near.other, (-o.n, near.other)) AS other, max(o.n) AS top FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN other END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word JOIN f e ON e.word = chain.at AND e.form IS NULL"""
