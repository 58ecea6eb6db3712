"""Bad records as rows: what each decoder says of them, and what a run does about it."""

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions import binary
from brookframe.operators import attempts
from brookframe.operators.attempts import ERROR, failure, try_cut, try_frame, try_headers, try_ipc, try_json
from brookframe.plans import cuts, runs

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("data", T.BinaryType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def told(df, *columns):
    return [(*(r[c] for c in columns), r[ERROR] and (r[ERROR]["class"], r[ERROR].retriable)) for r in df.orderBy("__offset").collect()]


def values(spark, *data):
    return spark.createDataFrame([(i, bytearray(v) if v is not None else None) for i, v in enumerate(data)], "__offset long, value binary")


def test_json(spark):
    rows = values(spark, b'{"id": 1, "data": "aGk=", "tags": ["x", 2]}', b'{"id": 2', b"[1]", b"7", b"", None, b"{}", b'{"id": "x"}', b'{"id": 3, "more": {}}', b" \n")
    bad, none = (attempts.MALFORMED, False), (attempts.EMPTY, False)
    assert told(try_json(rows, SCHEMA), "id", "data", "tags") == [
        (1, b"hi", '["x",2]', None), *[(None, None, None, e) for e in (bad, bad, bad, none, none, (attempts.MISSING, False), bad)], (3, None, None, None), (None, None, None, none),
    ]
    scalar = T.StructType([T.StructField("value", T.LongType())])
    assert told(try_json(values(spark, b"7", b"x", b"null"), scalar), "value") == [(7, None), (None, bad), (None, None)]


def test_the_first_error_of_several_decoders_stays(spark):
    packed = spark.range(1).select(binary.pack_headers(F.array(F.struct(F.lit("a").alias("key"), F.lit(b"b").alias("value")))).alias("h")).first().h
    rows = spark.createDataFrame([(0, bytearray(b"{"), bytearray(packed)), (1, bytearray(b'{"id": 1}'), bytearray(packed[:-1])), (2, bytearray(b"{"), bytearray(b"")), (3, bytearray(b'{"id": 1}'), None)], "__offset long, value binary, __headers binary")
    out = try_headers(try_json(rows, SCHEMA)).orderBy("__offset").collect()
    assert [r[ERROR] and r[ERROR].message for r in out] == ["not JSON of the schema: {", "not packed headers", "not JSON of the schema: {", None]
    assert [r.headers for r in out] == [None, None, None, None] and [r.id for r in out] == [None, 1, None, 1]


@pytest.mark.parametrize("as_table", [False, True])
def test_frames(spark, as_table):
    framed = [bytes([0, 0, 0, 0, i]) + b"body" for i in (7, 8)]
    known = spark.createDataFrame([(7,), (7,)], "schema_id int") if as_table else [7]
    out = try_frame(values(spark, framed[0], framed[1], b"\1\0\0\0\7x", b"\0\0", None), known)
    assert told(out, "schema_id", "value") == [(7, b"body", None), (None, None, (attempts.PENDING, True)), *[(None, None, (attempts.MALFORMED, False))] * 3]


def test_cuts(spark):
    key, value = cuts.encode_cut(F.lit("g"), F.lit(7), F.lit(1), F.lit(2), F.lit(0), F.lit("t"), F.array(F.struct(F.lit(0).alias("partition"), F.lit(5).alias("cut_offset"))))
    k, v = spark.range(1).select(key.alias("k"), value.alias("v")).first()
    rows = spark.createDataFrame([(0, k, v), (1, k, v[:-1]), (2, k[:-1], v), (3, k, None), (4, k, bytearray(b""))], "__offset long, key binary, value binary")
    out = try_cut(rows).orderBy("__offset").collect()
    assert [r.cut and r.cut.epoch for r in out] == [7, None, None, None, None]
    assert [r[ERROR] and r[ERROR].message for r in out] == [None, "not the value of a cut", "not the key of a manifest record", None, None]


def test_ipc(spark):
    def stream(table):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as w:
            w.write_table(table)
        return out.getvalue().to_pybytes()

    good = stream(pa.table({"a": pa.array([1, 2], pa.int64())}))
    rows = values(spark, good, good[: len(good) // 2], b"xyz", None, stream(pa.table({"b": [1]})), stream(pa.table({"a": pa.array(["x"])})), stream(pa.table({"a": pa.array([], pa.int64())})))
    out = told(try_ipc(rows, T.StructType([T.StructField("a", T.LongType(), False)])), "__offset", "a")
    bad = (attempts.MALFORMED, False)
    assert out == [(0, 1, None), (0, 2, None), (1, None, bad), (2, None, bad), (3, None, (attempts.EMPTY, False)), (4, None, bad), (5, None, bad)]


def polls(spark):
    rows = [(p, b, 10 * b + i) for p in (0, 1) for b in (0, 1) for i in range(3)]
    error = F.when((F.col("__partition") == 0) & (F.col("__offset") == 1), failure("B", "second")).when((F.col("__partition") == 0) & (F.col("__offset") == 2), failure("C", "third", True))
    return spark.createDataFrame(rows, "__partition int, __batch long, __offset long").withColumn(ERROR, error)


def test_a_poll_fails_with_its_first_error(spark):
    good, lost = runs.outcome(polls(spark), runs.DEAD_LETTER)
    assert {(r["__partition"], r["__batch"]) for r in good.collect()} == {(0, 1), (1, 0), (1, 1)}
    letters = runs.dead_letters(lost, "t").orderBy("__offset").collect()
    assert [[bytes(h.value).decode() for h in r.headers] for r in letters] == [["B", "second", "t", "0", str(i)] for i in range(3)]
    assert letters[0].asDict().keys() == {"__partition", "__batch", "__offset", "headers"}
    assert not runs.outcome(polls(spark), runs.SKIP)[1].collect() and runs.outcome(polls(spark), runs.SKIP)[0].count() == 9


@pytest.mark.parametrize("policy", [runs.FAIL, runs.SKIP, runs.DEAD_LETTER])
def test_what_can_be_tried_again_fails_under_every_policy(spark, policy):
    later = polls(spark).withColumn(ERROR, F.when(F.col("__offset") == 12, failure("SchemaPending", "no schema yet", True)))
    for part in runs.outcome(later, policy)[: 2 if policy == runs.DEAD_LETTER else 1]:
        with pytest.raises(PySparkException, match="SchemaPending in partition . at offset 12"):
            part.collect()


def test_any_error_fails_under_policy_fail(spark):
    with pytest.raises(PySparkException, match="B in partition 0 at offset 1"):
        runs.outcome(polls(spark))[0].collect()
    with pytest.raises(ValueError):
        runs.outcome(polls(spark), "never")
