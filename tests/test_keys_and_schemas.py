"""Tagged bytes against Python's own packing, columns from JSON Schemas, and processors in offset order."""

import datetime
import random
import struct
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions.tagged import tagged, tagged_column
from brookframe.operators import codecs
from brookframe.operators.groups import COUNT, Agg, group_by_tag
from brookframe.operators.json_schema import columns_of, json_columns
from brookframe.operators.process import Processor, process_in_order


def sized(tag, data):
    return tag + struct.pack(">I", len(data)) + data


def packed(spark, kind, values, unsigned=False):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", kind)]))
    return [bytes(r.b) for r in df.select("i", tagged(F.col("v"), kind, unsigned).alias("b")).orderBy("i").collect()]


def test_doubles_to_the_bit(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.5, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 2.0**1023, 1 - 2.0**-53, 2.0**52 + 1]
    values += [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)] + [s * (2.0**e) * f for e in range(-1070, 1020, 7) for s in (1, -1) for f in (1, 1 + 2.0**-52, 2 - 2.0**-51)]
    values = [v for v in values if v == v]
    assert packed(spark, T.DoubleType(), [*values, None]) == [b"f" + struct.pack(">d", v) for v in values] + [b"n"]
    assert packed(spark, T.DoubleType(), [float("nan")]) == [b"f\x7f\xf8" + bytes(6)]
    assert packed(spark, T.FloatType(), [0.1, -0.0]) == [b"g" + struct.pack(">d", struct.unpack(">f", struct.pack(">f", v))[0]) for v in (0.1, -0.0)]


def test_other_kinds(spark):
    assert packed(spark, T.LongType(), [0, -1, 2**63 - 1, -(2**63)]) == [b"i" + struct.pack(">q", v) for v in (0, -1, 2**63 - 1, -(2**63))]
    assert packed(spark, T.ByteType(), [-7]) == packed(spark, T.LongType(), [-7]) and packed(spark, T.DateType(), [datetime.date(1970, 1, 3)]) == [b"i" + struct.pack(">q", 2)]
    assert packed(spark, T.DecimalType(20, 0), [Decimal(2**64 - 1), Decimal(5)], True) == [b"u" + b"\xff" * 8, b"u" + struct.pack(">Q", 5)]
    assert packed(spark, T.BooleanType(), [True, False, None]) == [b"t", b"F", b"n"]
    assert packed(spark, T.StringType(), ["", "é"]) == [sized(b"s", b""), sized(b"s", "é".encode())] and packed(spark, T.BinaryType(), [bytearray(b"\0x")]) == [sized(b"b", b"\0x")]
    amounts = [Decimal(x) for x in ("0.000", "1.500", "-2.250", "3.000", "0.001", "99999999.125", "-100.000")]
    want = [str(Fraction(x)) for x in amounts]
    assert packed(spark, T.DecimalType(20, 3), amounts) == [sized(b"R", w.encode()) for w in want]
    assert packed(spark, T.DecimalType(20, 3), amounts[1:2]) == packed(spark, T.DecimalType(30, 10), [Decimal("1.5")])
    array = T.ArrayType(T.LongType())
    assert packed(spark, array, [[1, None], []]) == [b"L" + struct.pack(">I", 2) + b"i" + struct.pack(">q", 1) + b"n", b"L" + bytes(4)]
    row = T.StructType([T.StructField("z", T.BooleanType()), T.StructField("a", T.LongType())])
    one = b"i" + struct.pack(">q", 1)
    assert packed(spark, row, [(True, 1)]) == [b"M" + struct.pack(">I", 2) + sized(b"", b"a") + one + sized(b"", b"z") + b"t"]
    assert packed(spark, T.MapType(T.StringType(), T.LongType()), [{"b": 1, "a": None}]) == [b"M" + struct.pack(">I", 2) + sized(b"", b"a") + b"n" + sized(b"", b"b") + one]
    for kind, unsigned in ((T.DecimalType(38, 38), False), (T.DecimalType(19, 0), True), (T.MapType(T.LongType(), T.LongType()), False)):
        with pytest.raises(TypeError):
            tagged(F.lit(None).cast(kind), kind, unsigned)


def test_groups_by_tag(spark):
    df = spark.createDataFrame([(0, 0.0), (0, -0.0), (0, None), (0, None), (1, 0.0)], "__partition int, x double")
    assert sorted(map(repr, group_by_tag(df, ["x"], [Agg(COUNT, "x", "n")]).collect())) == ["Row(x=-0.0, n=1)", "Row(x=0.0, n=1)", "Row(x=0.0, n=1)", "Row(x=None, n=2)"]
    same = df.select("__partition", F.col("x").cast("decimal(5,2)").alias("x"))
    assert group_by_tag(same, ["x"], [Agg(COUNT, "x", "n")]).count() == 3 and tagged_column(same, "x") is not None


ORDER = '{"type":"object","properties":{"id":{"type":"string"},"amount":{"type":["null","integer"]},"raw":{"type":"string","contentEncoding":"base64"},"tags":{"$ref":"#/definitions/a~1b"},"free":{}},"required":["id","amount",7],"definitions":{"a/b":{"$ref":"#/definitions/list"},"list":{"type":"array"}}}'


def test_columns_of_a_json_schema(spark):
    schema = columns_of(ORDER)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields] == [("id", "string", False), ("amount", "bigint", True), ("raw", "binary", True), ("tags", "string", True), ("free", "string", True)]
    assert json_columns(schema) == ("tags",)
    values = spark.createDataFrame([('{"id":"a","amount":5,"raw":"aGk=","tags":["new",{"x":1}]}',), ('{"id":"b"}',)], "value string")
    rows = codecs.json_decode(values, schema)
    assert [tuple(r) for r in rows.collect()] == [("a", 5, b"hi", '["new",{"x":1}]', None), ("b", None, None, None, None)]
    assert codecs.json_encode(rows, json_columns(schema)).first().value == '{"id":"a","amount":5,"raw":"aGk=","tags":["new",{"x":1}]}'
    with pytest.raises(PySparkException, match="id is required"):
        codecs.json_decode(spark.createDataFrame([('{"id":null}',)], "value string"), schema).collect()
    assert columns_of('{"type":"number"}', scalar=True) == T.StructType([T.StructField("value", T.DoubleType(), False)])
    wrong = ["{", "[]", "{}", '{"properties":{"a":7}}', '{"properties":{"a":{"$ref":"#/x"}}}', '{"properties":{"a":{"$ref":"other.json"}}}', '{"properties":{"a":{"$ref":"#/b"}},"b":{"$ref":"#/b"}}']
    for text in wrong:
        with pytest.raises(ValueError):
            columns_of(text)


def steps():
    """Made here so that it travels to the workers, which don't have this module."""

    class Steps(Processor):
        def __init__(self, partition):
            self.partition, self.before, self.n = partition, None, 0

        def process(self, batch):
            self.n += batch.num_rows
            steps = []
            for o in batch.column("__offset").to_pylist():
                steps.append(o - (o if self.before is None else self.before))
                self.before = o
            yield pa.RecordBatch.from_arrays([pa.array([self.partition] * len(steps), pa.int32()), pa.array(steps, pa.int64())], ["p", "step"])

        def close(self):
            yield pa.RecordBatch.from_arrays([pa.array([self.partition], pa.int32()), pa.array([-self.n], pa.int64())], ["p", "step"])

    return Steps


@pytest.mark.parametrize("size", ["7", "10000"])
def test_processors_see_their_partition_in_order(spark, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = [(p, o) for o in range(50) for p in (0, 1, 2, 5)]
        random.Random(1).shuffle(rows)
        df = spark.createDataFrame(rows, "__partition int, __offset long").repartition(6)
        got = [tuple(r) for r in process_in_order(df, steps(), "p int, step long").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for p in (0, 1, 2, 5):
        assert [s for q, s in got if q == p] == [0] + [1] * 49 + [-50]
    assert not process_in_order(df.limit(0), steps(), "p int, step long").collect()
    with pytest.raises(PySparkException, match="no __partition"):
        process_in_order(df.withColumn("__partition", F.lit(None).cast("int")), steps(), "p int, step long").collect()


def test_times_of_day(spark):
    """As raw microseconds in casts, sums and keys."""
    from brookframe.functions.exact import exact_cast, family
    from brookframe.operators.groups import MAX, SUM, group_by
    from brookframe.operators.joins import windowed_join

    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        at = datetime.time(13, 30, 5, 123456)
        micros = 48_605_123_456
        df = spark.createDataFrame([(0, 0, 5, at), (0, 0, 5, datetime.time(0, 0, 1)), (0, 0, 5, None)], "__partition int, __batch long, __timestamp long, t time")
        kind = df.schema["t"].dataType
        casts = df.select(exact_cast(F.col("t"), kind, T.LongType()).alias("n"), exact_cast(F.col("t"), kind, T.StringType()).alias("s"), exact_cast(exact_cast(F.col("t"), kind, T.LongType()), T.LongType(), kind).alias("back")).collect()
        assert [tuple(r) for r in casts] == [(micros, "13:30:05.123456", at), (1_000_000, "00:00:01", datetime.time(0, 0, 1)), (None, None, None)]
        assert [tuple(r) for r in group_by(df, ["__partition"], [Agg(SUM, "t", "total"), Agg(MAX, "t", "last"), Agg(COUNT, "t", "n")]).collect()] == [(0, datetime.time(13, 30, 6, 123456), at, 3)]
        with pytest.raises(PySparkException, match="not a time of day"):
            group_by(df.union(df), ["__partition"], [Agg(SUM, "t", "total")]).collect()
        assert family(kind) == "integer" and bytes(df.select(tagged(F.col("t"), kind).alias("b")).first().b) == b"i" + struct.pack(">q", micros)
        right = df.select(exact_cast(F.col("t"), kind, T.LongType()).alias("u"), "__partition", "__batch", "__timestamp")
        assert windowed_join(df, right, "t", "u", 0).count() == 2
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")
