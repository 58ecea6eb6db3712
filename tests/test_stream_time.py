"""State per partition: types of values and keys, restarts, and what is kept of a join."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from brookframe.operators.groups import COUNT, MAX, MIN, SUM, Agg, group_by, windowed_group_by
from brookframe.operators.joins import windowed_join
from brookframe.sources.topic_log import append_log, stream_log
from brookframe.streaming.folders import arrived
from brookframe.streaming.stream_time import grouped_by_stream_time, joined_by_stream_time, stateful

BIG = 2**63 - 1
NAN = float("nan")
D, N = Decimal, None
#: partition, poll, time, key, long, double, decimal, text, date
ROWS = [
    (0, 0, 5, "a", BIG, 1.5, D("1.10"), "x", datetime.date(2024, 1, 2)), (0, 0, 6, "a", BIG, NAN, D("2.25"), "é", N), (0, 0, 7, N, N, N, N, N, N), (1, 0, 5, "a", -BIG - 1, -0.5, D("-3.00"), "", datetime.date(1969, 1, 1)),
    (0, 1, 31, "a", 1, 2.5, D("99999999999999.99"), "zz", datetime.date(2030, 1, 1)), (0, 1, 8, N, 3, N, N, "b", N), (1, 2, 100, "c", N, N, N, N, N), (1, 2, 9, "a", 4, 4.0, N, "q", N), (0, 3, 120, "a", 7, NAN, N, N, N),
]
SCHEMA = "__partition int, __batch long, __timestamp long, k string, n long, r double, d decimal(16,2), t string, day date"
AGGS = [Agg(COUNT, "n", "c"), Agg(SUM, "n", "wide", DecimalType(38, 0)), Agg(MIN, "n", "low"), Agg(MAX, "n", "high"), Agg(MAX, "r", "top"), Agg(MIN, "r", "bottom"), Agg(SUM, "d", "sum_d", DecimalType(30, 2)), Agg(MAX, "d", "max_d"), Agg(MIN, "t", "first"), Agg(MAX, "t", "last"), Agg(MAX, "day", "latest")]


def streamed(spark, tmp_path, polls, made):
    """Feeds each set of polls in a run of its own."""
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], f"i long, {SCHEMA}")
    for some in polls:
        append_log(df.filter(F.col("__batch").isin(some)), path, "i")
        with stateful(spark):
            query = made(lambda: stream_log(spark, path)).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows")
        arrived(query)
    return df, spark.read.parquet(f"{out}/rows")


def same(a, b):
    assert [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("polls", [[[0], [1], [2, 3]], [[0, 1, 2, 3]]])
def test_windows_and_groups_equal_the_bounded_ones(spark, tmp_path, polls):
    df, got = streamed(spark, tmp_path / "w", polls, lambda s: grouped_by_stream_time(s(), ["k", "day"], AGGS, 10, 20))
    same(got, windowed_group_by(df, ["k", "day"], 10, AGGS, 20, by_batch=True))
    df, got = streamed(spark, tmp_path / "g", polls, lambda s: grouped_by_stream_time(s(), ["__partition", "k"], AGGS))
    same(got, group_by(df, ["__partition", "k"], AGGS, by_batch=True))


@pytest.mark.parametrize("window", [0, 3, 40])
def test_joins_equal_the_bounded_ones(spark, tmp_path, window, monkeypatch):
    from brookframe.streaming import stream_time

    monkeypatch.setattr(stream_time, "PIECE", 1)

    def sides(rows):
        return rows().select("k", "r", "day", "d", "__partition", "__batch", "__timestamp"), rows().select("k", "n", "t", "__partition", "__batch", "__timestamp")

    df, got = streamed(spark, tmp_path, [[0], [1, 2], [3]], lambda s: joined_by_stream_time(*sides(s), "k", "k", window))
    want = windowed_join(*sides(lambda: df), "k", "k", window, by_batch=True)
    same(got.select(*want.columns), want)


def test_keys_of_other_families_meet_nothing(spark, tmp_path):
    _, got = streamed(spark, tmp_path, [[0, 1]], lambda s: joined_by_stream_time(s().select("n", "__partition", "__batch", "__timestamp"), s().select("t", "__partition", "__batch", "__timestamp"), "n", "t", 100))
    assert not got.collect()


def test_what_is_wrong_is_said_at_once(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for wrong in (lambda: grouped_by_stream_time(df, [], AGGS), lambda: grouped_by_stream_time(df, ["k"], AGGS, 10, 5), lambda: grouped_by_stream_time(df, ["nope"], AGGS), lambda: joined_by_stream_time(df, df, "k", "k", 1), lambda: joined_by_stream_time(df, df.select("*"), "k", "k", -1)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        grouped_by_stream_time(df.withColumn("yes", F.lit(True)), ["k"], [Agg(SUM, "yes", "s")])
