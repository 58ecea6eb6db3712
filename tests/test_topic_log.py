"""A topic as a data source: ranges, pruning, streams that go on, and appends that count once."""

import ast

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brookframe.sources.topic_log import FilteredReader, Log, StreamReader, StreamWriter, Written, append_log, read_log, stream_log


def rows(spark, first, n):
    return spark.range(first, first + n, 1, 3).select("id", F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 2).cast("int").alias("__partition"))


def append(df, path, **options):
    append_log(df, path, "id", **options)


read = read_log


def test_appends_give_offsets_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    append(rows(spark, 0, 20), path, maxRecordsPerFile=4)
    append(rows(spark, 20, 6), path)
    got = read(spark, path)
    assert got.columns == ["id", "v", "__partition", "__offset"]
    assert sorted((r["__partition"], r["__offset"], r.id, r.v) for r in got.collect()) == sorted((i % 2, i // 2, i, f"v{i}") for i in range(26))
    assert Log(path).ends() == {0: (0, 13), 1: (0, 13)}
    with pytest.raises(PySparkException, match="the topic has"):
        append(rows(spark, 0, 2).drop("v"), path)
    assert Log(path).ends() == {0: (0, 13), 1: (0, 13)}
    with pytest.raises(PySparkException, match="no topic"):
        read(spark, f"{path}x").collect()
    with pytest.raises(PySparkException, match="__partition"):
        append_log(spark.range(1), path)


def test_ranges_and_filters_leave_files_out(spark, tmp_path):
    path = str(tmp_path / "t")
    append(rows(spark, 0, 80), path, maxRecordsPerFile=10)
    ranged = read(spark, path, startingOffsets='{"0": 12, "1": 35}', endingOffsets='{"0": 28, "1": 99}')
    assert sorted((r["__partition"], r["__offset"]) for r in ranged.collect()) == [(0, o) for o in range(12, 28)] + [(1, o) for o in range(35, 40)]
    whole = read(spark, path).rdd.getNumPartitions()
    assert ranged.rdd.getNumPartitions() < whole
    schema = read(spark, path).schema
    reader = FilteredReader({"path": path}, schema)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    filters = [EqualTo(("__partition",), 1), GreaterThanOrEqual(("__offset",), 5), LessThan(("__offset",), 8)]
    assert list(reader.pushFilters(filters)) == filters
    assert {(s.partition, s.start, s.end) for s in reader.partitions()} == {(1, 5, 8)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = read(spark, path).filter("__partition = 1 and __offset >= 5 and __offset < 8")
        assert sorted(r.id for r in few.collect()) == [11, 13, 15] and few.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert read(spark, path, partitions="[1]").count() == 40 and read(spark, path, startingOffsets='{"0": 40, "1": 40}').count() == 0


def started(spark, path, out, **options):
    return stream_log(spark, path, **options).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows")


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    append(rows(spark, 0, 40), path, maxRecordsPerFile=6)
    for n in (0, 1):
        if n:
            append(rows(spark, 40, 20), path)
        query = started(spark, path, out, startingOffsets='{"0": 3}', maxOffsetsPerTrigger=7)
        query.processAllAvailable()
        steps = [ast.literal_eval(p.sources[0].endOffset) for p in query.recentProgress if p.numInputRows]
        query.stop()
        assert steps == ([{"0": 10, "1": 7}, {"0": 17, "1": 14}, {"0": 20, "1": 20}] if not n else [{"0": 27, "1": 27}, {"0": 30, "1": 30}])
    got = sorted((r["__partition"], r["__offset"], r.id) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == sorted((i % 2, i // 2, i) for i in range(6, 60) if i % 2 == 0) + sorted((1, i // 2, i) for i in range(1, 60, 2))


def test_a_stream_appends_each_micro_batch_once(spark, tmp_path):
    path, to = str(tmp_path / "t"), str(tmp_path / "to")
    append(rows(spark, 0, 20), path)
    stream = stream_log(spark, path).withColumn("v", F.upper("v"))
    query = stream.writeStream.format("topic").option("path", to).option("queryName", "copy").option("checkpointLocation", f"{to}-checkpoint").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["__partition"], r["__offset"], r.v) for r in read(spark, to).collect()) == sorted((i % 2, i // 2, f"V{i}") for i in range(20))
    log = Log(to)
    schema = read(spark, to).schema
    writer = StreamWriter({"path": to, "queryName": "copy"}, schema)
    hidden = f"{log.folder(0)}/.again.parquet"
    log.fs.copy_file(f"{log.folder(0)}/{log.segments(0)[0][2]}", hidden)
    writer.commit([Written(0, [(0, hidden, 10)]), None], 0)
    assert log.ends() == {0: (0, 10), 1: (0, 10)}
    writer.abort([Written(0, [(0, hidden, 10)]), None], 1)


def test_new_partitions_begin_at_their_first_offset(spark, tmp_path):
    path = str(tmp_path / "t")
    append(rows(spark, 0, 10).filter("__partition = 0"), path)
    schema = read(spark, path).schema
    reader = StreamReader({"path": path, "maxOffsetsPerTrigger": "4"}, schema)
    assert reader.initialOffset() == {"0": 0} and reader.latestOffset() == {"0": 4}
    assert [(s.start, s.end) for s in reader.partitions({"0": 0}, {"0": 4})] == [(0, 4)]
    append(rows(spark, 0, 10).filter("__partition = 1"), path)
    assert reader.latestOffset() == {"0": 5, "1": 4}
    assert [(s.partition, s.start, s.end) for s in reader.partitions({"0": 4}, {"0": 5, "1": 4})] == [(0, 4, 5), (1, 0, 4)]
