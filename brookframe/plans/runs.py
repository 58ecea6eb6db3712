"""What a run over polls of records leaves behind: good and dead letters, metrics, next offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookframe.operators.attempts import ERROR, ERROR_TYPE, failure
from brookframe.sources.topics import BATCH

FAILURE = "__failure"

POLICIES = FAIL, SKIP, DEAD_LETTER = "fail", "skip", "dead_letter"


def decided(records: DataFrame, policy: str = FAIL, error: str = ERROR) -> DataFrame:
    """``records`` with ``__failure`` in place of ``__error``: what their poll of a partition failed with, which is the error of its first bad record.

    A poll fails whole, as its state is rolled back. An error that trying again could help fails the run under every
    policy, and any error does under policy fail, when the records are read. Only the few failed polls are joined to
    the records; the records themselves are not shuffled for it, as long as those polls are few.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    first = F.min(F.struct("__offset", error))
    polls = records.filter(F.col(error).isNotNull()).groupBy("__partition", BATCH).agg(first.alias("_first"))
    failed = F.col(f"_first.{error}")
    said = F.concat_ws(" ", failed["class"], F.lit("in partition"), F.col("__partition").cast("string"), F.lit("at offset"), F.col("_first.__offset").cast("string"), F.concat(F.lit("("), failed["message"], F.lit(")")))
    raised = failed["retriable"] if policy != FAIL else F.lit(True)
    polls = polls.select("__partition", BATCH, F.when(raised, F.raise_error(said).cast(ERROR_TYPE)).otherwise(failed).alias(FAILURE))
    return records.drop(error).join(polls, ["__partition", BATCH], "left").select(*(c for c in records.columns if c != error), FAILURE)


def outcome(records: DataFrame, policy: str = FAIL, error: str = ERROR) -> tuple[DataFrame, DataFrame]:
    """Good records, and those given up with ``__failure``; with skip none are given up for dead letters."""
    every = decided(records, policy, error)
    given_up = every.filter(F.col(FAILURE).isNotNull())
    return every.filter(F.col(FAILURE).isNull()).drop(FAILURE), given_up if policy == DEAD_LETTER else given_up.limit(0)


def split_failures(records: DataFrame, failed: Column, policy: str = FAIL) -> tuple[DataFrame, DataFrame]:
    """:func:`outcome` of records of which a condition says whether they are bad."""
    marked = records.withColumn(ERROR, F.when(failed, failure("ValueError", "a record failed")))
    good, given_up = outcome(marked, policy)
    return good, given_up.drop(FAILURE)


def dead_letters(given_up: DataFrame, topic: str, error_class: str | Column | None = None, message: str | Column | None = None, headers: str = "headers") -> DataFrame:
    """Records with headers that say what failed and where they came from, after those that they had. Class and message are those of ``__failure`` unless given."""
    said = {"class": error_class, "message": message}
    told = {k: F.col(FAILURE)[k] if v is None else F.lit(v) if isinstance(v, str) else v for k, v in said.items()}
    own = {"error.class": told["class"], "error.message": told["message"], "source.topic": F.lit(topic), "source.partition": F.col("__partition").cast("string"), "source.offset": F.col("__offset").cast("string")}
    more = F.array(*(F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")) for k, v in own.items()))
    kept = F.col(headers) if headers in given_up.columns else F.array()
    return given_up.withColumn(headers, F.concat(F.coalesce(kept, F.array()).cast("array<struct<key:string,value:binary>>"), more)).drop(FAILURE)


def next_offsets(records: DataFrame) -> DataFrame:
    """Where each partition is read on."""
    return records.groupBy("__partition").agg((F.max("__offset") + 1).alias("next_offset"))


def metrics(records: DataFrame, failed: Column, outputs: DataFrame) -> DataFrame:
    """Polls, records in and out, polls that failed and records given up, by partition."""
    polls = records.groupBy("__partition", BATCH).agg(F.count("*").alias("n"), F.max(F.coalesce(failed, F.lit(False))).alias("bad"))
    each = polls.groupBy("__partition").agg(F.count("*").alias("batches"), F.sum("n").alias("input"), F.count_if("bad").alias("failures"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("dead_letters"))
    produced = outputs.groupBy("__partition").agg(F.count("*").alias("output"))
    return each.join(produced, "__partition", "left").select("__partition", "batches", "input", F.coalesce("output", F.lit(0)).alias("output"), "failures", "dead_letters")
