"""From documents to packed training sequences: each stage works on all that the stage before kept.

In all stages a null text counts as empty, texts of any length are read whole, other columns pass unchanged, and an
empty table gives an empty one. Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are
judged each by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brookframe.llm.decontaminate import contaminated
from brookframe.llm.line_templates import drop_recurring_lines
from brookframe.llm.lsh_forest import near_duplicates
from brookframe.llm.mil_quality import score
from brookframe.llm.packing import pack
from brookframe.llm.scratch import Scratch, free_name

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; equal texts get equal scores."""
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("score >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts, and with them documents that had nothing else."""
    left = drop_recurring_lines(docs).filter(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, and of rows equal in id and text one; rows without an id stay."""
    row, place = free_name(docs, "_row"), free_name(docs, "_place")
    docs_by_row = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    gone = near_duplicates(docs_by_row, k=5, percent=80, keep=(row,)).filter("not kept").select(row)
    left = docs_by_row.join(gone.hint("merge"), row, "left_anti")
    return left.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(row))).filter((F.col(place) == 1) | F.col("doc_id").isNull()).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, each row by its own text."""
    row = free_name(docs, "_row")
    docs_by_row = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = contaminated(docs_by_row.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(row)).distinct()
    return docs_by_row.join(found, row, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The classifier and the forest aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
