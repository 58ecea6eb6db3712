"""Frames with message indexes byte by byte, and runs over polls with their metrics."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions import binary
from brookframe.operators.attempts import failure, try_json, with_error
from brookframe.plans import polls, runs
from brookframe.sources.topic_log import append_log, stream_log
from brookframe.streaming.folders import arrived


def varint(n):
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def test_zigzag_numbers(spark):
    values = [0, -1, 1, 63, 64, -64, -65, 8191, 8192, 2**31 - 1, -(2**31), 2**62, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", F.concat(F.lit(b"xx"), binary.zigzag(F.col("v")), F.lit(b"\x05")))
    for r in df.select("v", "b", binary.read_zigzag(F.col("b"), F.lit(3)).alias("r")).collect():
        assert bytes(r.b) == b"xx" + varint(r.v) + b"\x05" and (r.r.value, r.r.at) == (r.v, 3 + len(varint(r.v)))


def test_message_frames(spark):
    head = bytes([0, 0, 0, 0, 7])
    made = spark.range(1).select(*(binary.protobuf_frame(F.lit(7), F.array(*map(F.lit, i)), F.lit(b"pb")).alias(f"f{n}") for n, i in enumerate(([0], [1, 0], [0, 0], [-1])))).first()
    assert [bytes(x) for x in made] == [head + b"\0pb", head + b"\x04\x02\0pb", head + b"\x04\0\0pb", head + b"\x02\x01pb"]
    good = [(head + b"\0pb", [0], b"pb"), (head + varint(2) + varint(1) + varint(0) + b"\3", [1, 0], b"\3"), (head + b"\0", [0], b""), (head + varint(1) + varint(-(2**31)), [-(2**31)], b""), (head + varint(300) + varint(5) * 300 + b"z", [5] * 300, b"z")]
    bad = [b"", b"\0\0\0", b"\1" + head[1:] + b"\0", head, head + varint(-1), head + varint(2) + varint(1), head + b"\x80", head + varint(1) + varint(2**31), head + b"\xff" * 10, head + varint(2**40), head + varint(2) + b"\x80"]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([g[0] for g in good] + bad)] + [(99, None)], "i int, d binary")
    got = [r.p and (r.p.schema_id, r.p.indexes, bytes(r.p.body)) for r in df.select("i", binary.parsed_protobuf_frame(F.col("d")).alias("p")).orderBy("i").collect()]
    assert got == [(7, i, b) for _, i, b in good] + [None] * (len(bad) + 1)
    assert df.filter("i = 99").select(binary.unpack_protobuf_frame(F.col("d")).alias("p")).first().p is None
    with pytest.raises(PySparkException, match="not a frame"):
        df.filter(f"i = {len(good)}").select(binary.unpack_protobuf_frame(F.col("d"))).collect()
    with pytest.raises(PySparkException, match="at least one index"):
        spark.range(1).select(binary.protobuf_frame(F.lit(7), F.array().cast("array<int>"), F.lit(b""))).collect()


SCHEMA = T.StructType([T.StructField("k", T.LongType())])


def started(spark, tmp_path, rows, decode=lambda df: try_json(df, SCHEMA), step=lambda df: df.filter("k > 1"), **options):
    path = str(tmp_path / "t")
    append_log(spark.createDataFrame(rows, "i long, value string, __batch long, __partition int").repartition(1), path, "i")
    return polls.run_polls(stream_log(spark, path), decode, step, f"{tmp_path}/good", f"{tmp_path}/checkpoint", topic="t", **options)


ROWS = [(0, '{"k":1}', 0, 0), (1, '{"k":2}', 0, 0), (2, '{"k"', 1, 0), (3, '{"k":4}', 1, 0), (4, '{"k":5}', 1, 1)]


def test_polls_are_counted_as_they_go(spark, tmp_path):
    metrics = polls.Metrics()
    arrived(started(spark, tmp_path, ROWS, policy=runs.DEAD_LETTER, dead=f"{tmp_path}/dead", metrics=metrics))
    got = metrics.snapshot()
    assert got.pop("processing_nanos") > 0 and got == {"batches": 3, "input_records": 5, "output_records": 2, "failures": 1, "dead_letter_records": 2}
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/good").collect()) == [2, 5]
    dead = spark.read.parquet(f"{tmp_path}/dead").collect()
    assert sorted(bytes(r.headers[-1].value) for r in dead) == [b"2", b"3"] and {bytes(r.headers[0].value) for r in dead} == {b"MalformedValue"}
    arrived(started(spark, tmp_path, [(9, '{"k":9}', 2, 0)], policy=runs.DEAD_LETTER, dead=f"{tmp_path}/dead", metrics=metrics))
    assert (metrics.batches, metrics.input_records, metrics.output_records, metrics.failures) == (4, 6, 3, 1)


def test_skipped_polls_leave_nothing(spark, tmp_path):
    metrics = polls.Metrics()
    arrived(started(spark, tmp_path, ROWS, policy=runs.SKIP, metrics=metrics))
    assert (metrics.failures, metrics.dead_letter_records, metrics.output_records) == (1, 0, 2)


@pytest.mark.parametrize("policy", [runs.FAIL, runs.SKIP])
def test_what_fails_a_run(spark, tmp_path, policy):
    metrics = polls.Metrics()
    later = lambda df: with_error(try_json(df, SCHEMA), F.when(F.col("k") == 5, failure("SchemaPending", "no schema yet", True)))
    with pytest.raises(PySparkException, match="RunFailed: (MalformedValue in partition 0 at offset 2|SchemaPending in partition 1 at offset 0)"):
        arrived(started(spark, tmp_path, ROWS, decode=later, policy=policy, metrics=metrics))
    assert metrics.batches == 0


def test_policies_say_where_dead_letters_go(spark, tmp_path):
    for options in ({"policy": "never"}, {"policy": runs.DEAD_LETTER}, {"policy": runs.SKIP, "dead": "x"}):
        with pytest.raises(ValueError):
            polls.run_polls(spark.range(1), None, None, "x", "y", **options)
