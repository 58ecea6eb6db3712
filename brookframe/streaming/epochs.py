"""Streams: topic tables as streams, fan-out by micro-batch, and grouped state kept as one table per epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brookframe.operators.groups import END, PARTITION, START, TIME, Agg, with_window
from brookframe.sources.topics import BATCH


def stream_topic(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as an unbounded topic."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(stream: DataFrame, outputs: dict[str, tuple[Callable[[DataFrame], DataFrame], str]], checkpoint: str) -> StreamingQuery:
    """Runs all that has arrived; each output is a function of the micro-batch and a folder.

    The micro-batch is computed once and written to every output under its number, which is overwritten if the batch
    is tried again, so that each batch counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for step, folder in outputs.values():
                step(batch).write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_stream(stream: DataFrame, keys: list[str], size: int, aggs: list[Agg], retention: int | None = None) -> DataFrame:
    """Tumbling windows with Spark's own watermark, which follows all partitions together and lags a batch.

    The watermark's delay has one ms more than the retention, as a window is kept while its end is not under the
    stream time less the retention.
    """
    retention = size if retention is None else retention
    timed = stream.withColumn("_at", F.timestamp_millis(TIME)).withWatermark("_at", f"{retention + 1} milliseconds")
    window = F.window("_at", f"{size} milliseconds")
    grouped = timed.groupBy(PARTITION, *(k for k in keys if k != PARTITION), window.alias("w")).agg(*(a.partial(stream).alias(a.name) for a in aggs))
    return grouped.select(*keys, F.unix_millis("w.start").alias(START), F.unix_millis("w.end").alias(END), *(a.final(stream, F.col(a.name)).alias(a.name) for a in aggs))


def joined_stream(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int) -> DataFrame:
    """Stream-stream join on partition and key within ``window`` ms, its state bounded by watermarks on both sides."""
    delay = f"{window + 1} milliseconds"
    a = left.select(*(F.col(c).alias(f"left_{c}") for c in left.columns), F.timestamp_millis(TIME).alias("lt")).withWatermark("lt", delay)
    b = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns), F.timestamp_millis(TIME).alias("rt")).withWatermark("rt", delay)
    reach = F.expr(f"interval {window * 1000} microseconds")
    near = (F.col("lt") >= F.col("rt") - reach) & (F.col("lt") <= F.col("rt") + reach)
    return a.join(b, (F.col(f"left_{left_key}") == F.col(f"right_{right_key}")) & (F.col(f"left_{PARTITION}") == F.col(f"right_{PARTITION}")) & near)


class GroupState:
    """Grouped state per partition as one Parquet table per epoch, with the rules of the bounded operators.

    ``advance`` merges a micro-batch into the last epoch's partial aggregates, writes the new epoch and returns what
    is emitted: every group retained. Stream time is per partition and counts the batch itself. An epoch written
    again replaces itself, and any epoch can be restored from.
    """

    def __init__(self, folder: str, keys: list[str], aggs: list[Agg], size: int | None = None, retention: int | None = None):
        self.folder, self.aggs, self.size = folder, aggs, size
        self.retention = retention if retention is not None else size
        self.keys = keys
        self.by = list(dict.fromkeys([PARTITION, *keys])) + ([START, END] if size else [])

    def read(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/epoch={epoch}")

    def advance(self, batch: DataFrame, epoch: int, before: int | None) -> DataFrame:
        spark = batch.sparkSession
        rows = with_window(batch, self.size) if self.size else batch
        # each group remembers its partition's stream time, so the state is one table
        fresh = rows.groupBy(*self.by).agg(*(a.partial(batch).alias(a.name) for a in self.aggs), F.max(TIME).alias("seen"))
        old = None if before is None else self.read(spark, before)
        both = fresh if old is None else old.unionByName(fresh)
        merged = both.groupBy(*self.by).agg(*(a.merged(F.col(a.name)).alias(a.name) for a in self.aggs), F.max("seen").alias("seen"))
        if self.size:
            time = both.groupBy(PARTITION).agg(F.max("seen").alias("t"))
            alive = merged.join(time, PARTITION).filter(F.col(END) >= F.col("t") - self.retention)
            # a late row can't bring a dropped window back: its end is under the cutoff, which never falls
            alive = alive.drop("seen").withColumnRenamed("t", "seen")
            merged = alive.select(*merged.columns)
        merged.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")
        state = self.read(spark, epoch)
        out = [*self.keys, *([START, END] if self.size else [])]
        return state.select(*out, *(a.final(batch, F.col(a.name)).alias(a.name) for a in self.aggs))
