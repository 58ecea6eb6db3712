"""Line-first cleaning, all in DataFrame functions.

Every line is judged alone (symbols and shouts for punctuation, no end mark, navigation, links, boilerplate, one word
over and over); lines that fail are removed, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Phrases of licence, consent and navigation lines.
PHRASES = (
    "all rights reserved", "licen[sc]ed under", "released under the", "general public license", "cookie policy", "privacy policy", "terms of (?:use|service)", "subscribe to",
    "sign up", "log ?in", "click here", "read more", "share (?:this|on)", "back to top", "copyright", "skip to content",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "weiterlesen", "nach oben", "anmelden",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "lire la suite", "se connecter",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "leer más", "iniciar sesión",
)


def _any_of(patterns: tuple[str, ...], depth: int = 2) -> str:
    """An alternation in which patterns with equal first characters (plain ones, up to ``depth``) share them, so that most places fail after one."""
    tails: dict[str, list[str]] = {}
    for p in patterns:
        tails.setdefault(p[0], []).append(p[1:])
    return "|".join(a + (t[0] if len(t) == 1 else "(?:" + (_any_of(tuple(t), depth - 1) if depth > 1 else "|".join(t)) + ")") for a, t in tails.items())


#: No phrase begins with another one, so their order doesn't matter.
BOILERPLATE = r"(?iu)(?<!\p{L})(?:" + _any_of(PHRASES) + r")(?!\p{L})"
#: An address is looked for at the start of a word only, by its first @ and the first dot after it, so a long word is read once.
LINKS = r"(?:https?://|www\.)[^\x20\x09-\x0D]+|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D][^@\x20\x09-\x0D]*+@[^\x20\x09-\x0D][^.\x20\x09-\x0D]*+\.[^\x20\x09-\x0D]+"
END_MARK = "[.!?:;…。！？]"
#: In a text with end marks, a line of at least this many words has one somewhere.
UNMARKED = 6
#: A phrase of ``PHRASES`` for each so many words, or more of them, makes a line boilerplate.
PER_PHRASE = 16
#: A document keeps at least this share of its characters, or it is rejected.
KEPT_SHARE = 0.5


def word_list(text: Column) -> Column:
    """Words of a text; none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _covered(h: Column, window: int) -> Column:
    """How many words stand in windows (``h``: their 64-bit hashes by position) that occur twice or more.

    Sorted windows are compared with their neighbours, so the work stays near linear however often windows repeat.
    """
    ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def positions(o: Column) -> Column:
        same = F.filter(o, lambda s, k: (F.get(o, k - 1)["h"] == s["h"]) | (F.get(o, k + 1)["h"] == s["h"]))
        return F.array_sort(F.transform(same, lambda s: s["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))), F.lit(0).cast("long"), lambda s, x: s + x)

    # a one-element array binds a value once for the functions that use it several times
    return F.get(F.transform(F.array(ordered), lambda o: F.get(F.transform(F.array(positions(o)), total), F.lit(0))), F.lit(0))


def text_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """Adds ``_n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words``; null texts count as without words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", word_list(F.col("text"))).withColumn("_n_words", F.size("_words").cast("long"))
    words, n = F.col("_words"), F.col("_n_words")
    out = out.withColumn("_w", F.when(n > window, F.transform(words, lambda w: F.xxhash64(w))))  # each word is hashed once, windows by these
    following = [lambda i, k=k: F.get("_w", i + k) for k in range(1, window)]
    hashes = F.transform(F.slice("_w", F.lit(1), F.greatest(n - window + 1, F.lit(0)).cast("int")), lambda w, i: F.xxhash64(w, *(at(i) for at in following)))
    out = out.withColumn("_h", hashes)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    return out.select(
        *docs.columns,
        "_n_words",
        F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)).alias("_word_chars"),
        _count(text, SYMBOLS).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.when(repeats, _covered(F.col("_h"), window)).otherwise(F.lit(0)).cast("long").alias("_n_repeat_words"),
    )


def _count(text: Column, characters: str) -> Column:
    """How many of the text's characters are of these, none of which has a meaning in a character class."""
    if len(characters) == 1:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit(characters)))
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def failed_line(line: Column, marked: Column) -> Column:
    """Whether a line breaks a rule by itself. A blank line breaks none; the rule of end marks is for texts that have any (``marked``)."""

    def rules(n: Column) -> Column:
        words, symbols = n["words"], n["symbols"]
        bars = F.regexp_count(line, F.lit(r"\x20\|\x20"))
        return (
            (symbols * 10 > words * 3)  # symbols for punctuation
            | (n["shouts"] * 10 > words * 3)
            | ((symbols >= 2) & (bars >= 2) & (bars * 2 >= words - bars - 2))  # navigation: items between bars
            | ((words >= 5) & line.rlike(r"(?<![^\x20])([^\x20]++)(?:\x20\1){4,}(?:\x20|$)"))  # one word over and over
            | (marked & (words >= UNMARKED) & ~line.rlike(END_MARK))
            | ((line.contains("www") | line.contains("http") | line.contains("@")) & (2 * F.char_length(F.regexp_replace(line, LINKS, "")) < F.char_length(line)))  # mostly links
            | (line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * PER_PHRASE >= words))
        )

    counts = F.struct(F.regexp_count(line, F.lit(WORD)).alias("words"), _count(line, SYMBOLS).alias("symbols"), _count(line, "!").alias("shouts"))
    return F.get(F.transform(F.array(counts), lambda n: (n["words"] > 0) & rules(n)), F.lit(0))


def clean_lines(docs: DataFrame, share: float = KEPT_SHARE, least_words: int = 10) -> DataFrame:
    """Adds ``cleaned`` (the text without lines that fail), ``_lost`` (share of characters removed) and ``_passed``.

    A document of which fewer than ``least_words`` words are left doesn't pass, however little it lost. A null text
    counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_marked", text.rlike(END_MARK))
    out = out.withColumn("_kept_lines", F.filter(F.split(text, "\n"), lambda x: ~failed_line(x, F.col("_marked"))))
    out = out.withColumn("cleaned", F.array_join("_kept_lines", "\n")).drop("_kept_lines", "_marked")
    size, left = F.char_length(text), F.char_length("cleaned")
    out = out.withColumn("_lost", F.when(size > 0, 1 - left / size).otherwise(F.lit(0.0)))
    # the pattern stops at the last word that is needed
    enough = F.col("cleaned").rlike(rf"^(?:[\x20\x09-\x0D]*+{WORD}+){{{least_words}}}") if 0 < least_words <= 100 else F.regexp_count("cleaned", F.lit(WORD)) >= least_words
    return out.withColumn("_passed", enough & (F.col("_lost") <= 1 - share))


def judge(docs: DataFrame, share: float = KEPT_SHARE, least_words: int = 10, most_repeats: int = 20, window: int = 5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``n_removed_chars`` of each row of ``docs``.

    Null, empty and blank texts have no words and fail; an empty table stays empty; texts of any length are judged
    whole; equal rows get equal answers; other columns are ignored.
    """
    counted = clean_lines(text_counts(docs.select("doc_id", "text"), window), share, least_words)
    n = F.col("_n_words")
    failed = (n < least_words) | (100 * F.col("_n_repeat_words") > most_repeats * n)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    removed = F.char_length(F.coalesce(F.col("text"), F.lit(""))) - F.char_length("cleaned")
    return counted.select("doc_id", *(F.col(f"_{x}").alias(x) for x in names), failed.alias("base_failed"), (~failed & F.col("_passed")).alias("kept"), removed.cast("long").alias("n_removed_chars"))
