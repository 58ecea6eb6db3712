"""The queries of this subpackage over the given tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.lsh_forest import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from brookframe.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.line_rules import judge

    return judge(_table(spark, sf_dir, "documents"))


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.secrets import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op4_url_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.url_lm import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op6_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.mil_quality import held_out, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.line_templates import LONGEST, drop_recurring_lines

    left = drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), longest=LONGEST)
    return left.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.brown_lm import held_out, score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, docs.filter(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.paragraphs import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"))


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from brookframe.llm.token_prefixes import n_tokens, with_prefix_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = with_prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    tokens = n_tokens(F.col("prefix_tokens")).cast("long")
    return counted.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > 512).alias("over_limit"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.turn_repair import repair_digest

    return repair_digest(_table(spark, sf_dir, "conversations"))


def op13_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookframe.llm.spelling import damaged_words, spelling_variants

    return spelling_variants(damaged_words(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from brookframe.llm import line_templates, spelling, turn_repair

    return {"op2_line_templates": line_templates.SQL, "op12_turn_repair": turn_repair.SQL, "op13_gram_variants": spelling.SQL}
