"""Joins by stream time whose polls are many, or go on in the next micro-batch."""

import random
import time

from pyspark.sql import functions as F

from brookframe.operators.joins import windowed_join
from brookframe.sources.topic_log import append_log, stream_log
from brookframe.streaming.folders import arrived
from brookframe.streaming.stream_time import joined_by_stream_time, stateful

SCHEMA = "i long, __partition int, __batch long, __timestamp long, side string, k string"


def sides(rows):
    return (rows().filter(F.col("side") == s).select("i", "k", "__partition", "__batch", "__timestamp") for s in ("l", "r"))


def streamed(spark, tmp_path, runs, window):
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    for rows in runs:
        append_log(spark.createDataFrame(rows, SCHEMA), path, "i")
        with stateful(spark):
            query = joined_by_stream_time(*sides(lambda: stream_log(spark, path)), "k", "k", window).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows")
        arrived(query)
    return spark.read.parquet(f"{out}/rows")


def bounded(spark, runs, window):
    df = spark.createDataFrame([r for rows in runs for r in rows], SCHEMA)
    return windowed_join(*sides(lambda: df), "k", "k", window, by_batch=True)


def pairs(df):
    return sorted((r.left_i, r.right_i, r["__batch"]) for r in df.collect())


def test_a_poll_goes_on_in_the_next_micro_batch(spark, tmp_path):
    runs = [[(0, 0, 0, 5, "l", "a"), (1, 0, 0, 100, "r", "b")], [(2, 0, 0, 6, "r", "a"), (3, 0, 0, 4, "r", None), (4, 0, 1, 101, "l", "b"), (5, 0, 1, 7, "l", "a")]]
    got = pairs(streamed(spark, tmp_path, runs, 3))
    assert got == pairs(bounded(spark, runs, 3)) == [(0, 2, 0), (4, 1, 1), (5, 2, 1)]


def test_many_polls_that_are_all_retained(spark, tmp_path):
    """Polls of copies of the same days: each is retained while the others come. One by one against each other they take minutes."""
    dice = random.Random(7)
    rows = [(i, i % 2, i // 8, dice.choice([2_000, 900]) + dice.randint(0, 90), dice.choice("lr"), dice.choice(["a", "b", "c", None])) for i in range(2_400)]
    runs = [rows[:1_200], rows[1_200:]]
    began = time.time()
    got = pairs(streamed(spark, tmp_path, runs, 50))
    assert time.time() - began < 100
    assert got == pairs(bounded(spark, runs, 50)) and len(got) > 1_000


def test_times_at_the_ends_of_longs(spark, tmp_path):
    low, high = -(2**63), 2**63 - 1
    runs = [[(0, 0, 0, high, "l", "a"), (1, 0, 0, high - 2, "r", "a"), (2, 0, 0, low, "l", "a"), (3, 0, 0, low + 3, "r", "a"), (4, 0, 0, low + 4, "r", "a")]]
    assert pairs(streamed(spark, tmp_path, runs, 3)) == [(0, 1, 0), (2, 3, 0)]
