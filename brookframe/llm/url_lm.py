"""URL filter: rules first, then the likelihood ratio of two character models, all in DataFrame functions.

The URLs that rules allow and block train one variable-order Markov model each: the probability of a character after
its last ``ORDER`` characters is interpolated down to shorter contexts, each order weighing in by how many different
characters followed its context (Witten-Bell). A URL without a rule is judged by the difference of the two
log-likelihoods over its whole length, query and fragment too, against a cut. The cut is the one that separates held-out
training URLs (a fifth, by a hash of the URL) best by models that haven't seen them; only if these lack a class is it
found on all training URLs.

Counts are kept by distinct gram, so what is joined grows with the number of different grams, not with the URLs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookframe.llm.scratch import cut

#: Verdict and rule (host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
ORDER = 4
#: One training URL of so many, by a hash, is held out for the cut.
FOLDS = 5
CLASSES = ("allow", "block", "allow_fit", "block_fit")
#: Characters of the models: lower-case letters, 0 for any digit, a few signs, ~ for all else, and the end.
ALPHABET = string.ascii_lowercase + "0./-_?=&%:+~$"
_STEP, _FAR = 0.01, 8.0


def _lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (lower-cased) and ``path``; both are empty for a null URL or one without ``://``."""
    url, pattern = F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumn("host", _lower(F.regexp_extract(url, pattern, 1))).withColumn("path", F.regexp_extract(url, pattern, 2))


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` (the longest that fits, or null) and ``ruled``, its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return pages.withColumn("rule", name).withColumn("ruled", verdict)


def _grams(text: Column) -> Column:
    """Each character with the ``ORDER`` characters before it; starts are padded, and the end is a character."""
    plain = F.regexp_replace(F.regexp_replace(_lower(text), "[0-9]", "0"), "[^a-z0./_?=&%:+-]", "~")
    padded = F.concat(F.lit("^" * ORDER), plain, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.char_length(padded) - ORDER), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def _model(grams: DataFrame) -> DataFrame:
    """``gram, ratio, ratio_fit`` from ``gram`` and training counts (``CLASSES``): log10 of the two models' probabilities' ratio, learned from all and from what isn't held out."""
    out = grams
    p = {c: F.lit(1 / len(ALPHABET)) for c in CLASSES}
    for m in range(ORDER + 1):
        key, context = F.substring("gram", ORDER - m + 1, m + 1), F.substring("gram", ORDER - m + 1, m)
        keys = grams.groupBy(key.alias(f"k{m}"), context.alias(f"c{m}")).agg(*(F.sum(c).alias(f"{c}{m}") for c in p))
        totals = keys.groupBy(f"c{m}").agg(*(F.sum(f"{c}{m}").alias(f"{c}_n{m}") for c in p), *(F.count_if(F.col(f"{c}{m}") > 0).alias(f"{c}_d{m}") for c in p))
        out = out.withColumn(f"k{m}", key).withColumn(f"c{m}", context).join(keys.drop(f"c{m}"), f"k{m}").join(totals, f"c{m}")
        for c in p:
            seen, different = F.col(f"{c}_n{m}"), F.col(f"{c}_d{m}")
            p[c] = F.when(seen > 0, (F.col(f"{c}{m}") + different * p[c]) / (seen + different)).otherwise(p[c])
        out = out.select("gram", *(v.alias(f"p_{c}") for c, v in p.items()))
        p = {c: F.col(f"p_{c}") for c in p}
    return out.select("gram", F.log10(F.col("p_allow") / F.col("p_block")).alias("ratio"), F.log10(F.col("p_allow_fit") / F.col("p_block_fit")).alias("ratio_fit"))


def calibrated(scores: DataFrame) -> float | None:
    """The cut with the best mean of both training classes' accuracy, from counts by score bin; None unless there are both classes."""
    bins = scores.filter("ruled is not null").groupBy("ruled", F.floor(F.greatest(F.least("score", F.lit(_FAR)), F.lit(-_FAR)) / _STEP).alias("bin"))
    counts: dict[str, dict[int, int]] = {"allow": {}, "block": {}}
    for row in bins.agg(F.sum("n").alias("n")).collect():
        counts[row.ruled][row.bin] = row.n
    all_of = {c: sum(v.values()) for c, v in counts.items()}
    if not all(all_of.values()):
        return None
    best, at = -1.0, 0.0
    for cut_bin in sorted({b for v in counts.values() for b in v}):
        right = sum(n for b, n in counts["allow"].items() if b >= cut_bin) / all_of["allow"] + sum(n for b, n in counts["block"].items() if b < cut_bin) / all_of["block"]
        if right > best:
            best, at = right, cut_bin * _STEP
    return at


def ratios(rows: DataFrame) -> tuple[DataFrame, float | None]:
    """``text, score`` of each different text of ``rows`` (``text``, ``ruled``) by the models of the ruled ones, and the calibrated cut."""
    held = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(FOLDS)) == 0
    texts = cut(rows.groupBy("text", "ruled").agg(F.count("*").alias("n")).withColumn("held", held))
    # a text becomes many grams, so texts are dealt over all tasks by number, not by their own few bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = texts.repartition(parts, "text").select("text", "ruled", "held", "n", F.explode(_grams(F.col("text"))).alias("gram"))

    def counted(c: str) -> Column:
        of, fit = c.partition("_")[::2]
        return F.sum(F.when((F.col("ruled") == of) & ~(F.lit(bool(fit)) & F.col("held")), F.col("n")).otherwise(0)).alias(c)

    model = cut(_model(cut(each.groupBy("gram").agg(*map(counted, CLASSES)))))
    grams = texts.select("text").distinct().repartition(parts, "text").select("text", F.explode(_grams(F.col("text"))).alias("gram"))
    scores = cut(grams.join(model, "gram").groupBy("text").agg(F.avg("ratio").alias("score"), F.avg("ratio_fit").alias("score_fit")))
    judged = texts.join(scores, "text").filter("ruled is not null")
    at = calibrated(judged.filter("held").select("ruled", "n", F.col("score_fit").alias("score")))
    return scores.drop("score_fit"), calibrated(judged) if at is None else at


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, url_score`` of each row of ``pages`` (``page_id``, ``url``; more columns are ignored).

    Where no rule fits, a ``url_score`` (over the whole URL, query and fragment too; a null one is empty) of at least
    the calibrated cut allows; if the rules give only one class or none, there is nothing to compare and all such URLs
    are allowed. ``score`` is the same ratio over host and path alone and decides nothing. Equal URLs get equal answers,
    an empty table an empty one, and URLs of any length are judged whole.
    """
    rows = ruled(parsed(pages.select("page_id", "url")), rules)
    rows = rows.withColumn("site", F.concat("host", "path")).withColumn("whole", F.coalesce("url", F.lit("")))
    site, _ = ratios(rows.select(F.col("site").alias("text"), "ruled"))
    whole, at = ratios(rows.select(F.col("whole").alias("text"), "ruled"))
    own = F.lit("allow") if at is None else F.when(F.col("url_score") >= at, "allow").otherwise("block")
    out = rows.join(site.withColumnRenamed("text", "site"), "site").join(whole.select(F.col("text").alias("whole"), F.col("score").alias("url_score")), "whole")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score", "url_score")
