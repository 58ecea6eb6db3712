"""A topology's step over a stream of polls, with a policy for bad records, and metrics that cost no further job."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brookframe.operators.attempts import ERROR, ERROR_TYPE
from brookframe.plans.runs import DEAD_LETTER, FAIL, FAILURE, POLICIES, dead_letters
from brookframe.sources.topics import BATCH


@dataclass
class Metrics:
    """Totals of a run. A batch is a poll of one partition; a micro-batch that is tried again counts when it succeeds."""

    batches: int = 0
    input_records: int = 0
    output_records: int = 0
    failures: int = 0
    dead_letter_records: int = 0
    processing_nanos: int = 0
    _lock: Lock = field(default_factory=Lock, repr=False, compare=False)

    def add(self, **more: int) -> None:
        with self._lock:
            for name, n in more.items():
                setattr(self, name, getattr(self, name) + n)

    def snapshot(self) -> dict[str, int]:
        with self._lock:
            return {k: v for k, v in self.__dict__.items() if k != "_lock"}


class RunFailed(RuntimeError):
    """What a poll failed with, under policy fail or when it could be tried again."""


def run_polls(
    stream: DataFrame, decode: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame], DataFrame], output: str, checkpoint: str,
    policy: str = FAIL, dead: str | None = None, topic: str = "", metrics: Metrics | None = None,
) -> StreamingQuery:
    """Decodes each micro-batch without raising, decides about its polls, writes ``step`` of the good ones to ``output``, and those given up to ``dead``.

    One small row for each poll (partition and ``__batch``) comes to the driver: how many records it has and its first
    error. From these the polls are kept or given up, and the metrics are their sums; what is written is counted as
    it is written. Both folders have a table for each micro-batch, which replaces itself when it is tried again.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if (policy == DEAD_LETTER) != (dead is not None):
        raise ValueError("dead letters go somewhere under policy dead_letter, and only then")
    metrics = metrics if metrics is not None else Metrics()

    def write(df: DataFrame, folder: str, number: int) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/micro_batch={number}")
        return seen.get["n"]

    def each(batch: DataFrame, number: int) -> None:
        start = time.perf_counter_ns()
        tried = decode(batch).persist()
        try:
            first = F.min(F.when(F.col(ERROR).isNotNull(), F.struct("__offset", ERROR)))
            polls = tried.groupBy("__partition", BATCH).agg(F.count("*").alias("n"), first.alias("first")).collect()
            bad = [p for p in polls if p.first]
            for p in bad:
                error = p.first[ERROR]
                if policy == FAIL or error.retriable:
                    raise RunFailed(f"{error['class']} in partition {p['__partition']} at offset {p.first['__offset']} ({error.message})")
            failed = batch.sparkSession.createDataFrame([(p["__partition"], p[BATCH], p.first[ERROR]) for p in bad], tried.select("__partition", BATCH, F.lit(None).cast(ERROR_TYPE).alias(FAILURE)).schema)
            every = tried.drop(ERROR).join(failed, ["__partition", BATCH], "left").select(*(c for c in tried.columns if c != ERROR), FAILURE)
            written = write(step(every.filter(F.col(FAILURE).isNull()).drop(FAILURE)), output, number)
            lost = write(dead_letters(every.filter(F.col(FAILURE).isNotNull()), topic), dead, number) if bad and dead else 0
        finally:
            tried.unpersist()
        metrics.add(batches=len(polls), input_records=sum(p.n for p in polls), output_records=written, failures=len(bad), dead_letter_records=lost, processing_nanos=time.perf_counter_ns() - start)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
