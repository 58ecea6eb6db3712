"""Packed headers: what they come from is computed once, and lengths of any size are judged."""

import pytest
from pyspark.sql import functions as F

from brookframe.functions import binary
from brookframe.operators.attempts import ERROR, try_headers


@pytest.mark.parametrize("read", [binary.unpack_headers, binary.parsed_headers])
def test_what_is_unpacked_stands_once_in_the_expression(spark, read):
    assert str(read(F.col("whence"))).count("whence") == 1


def test_lengths_up_to_the_greatest_are_no_headers(spark):
    data = [b"\0\0\0\1" + key + b"a" + b"\0\0\0\0" for key in (b"\x7f\xff\xff\xff", b"\x80\0\0\0", b"\0\0\0\2")] + [b"\0\0\0\1\0\0\0\1a\x7f\xff\xff\xff"]
    rows = spark.createDataFrame([(bytearray(x),) for x in data], "__headers binary")
    assert [r[ERROR].message for r in try_headers(rows).collect()] == ["not packed headers"] * 4


def test_integers_of_four_bytes(spark):
    numbers = [0, 1, -1, 2**31 - 1, -(2**31), 256]
    df = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", binary.int32(F.col("n")).alias("b"))
    got = df.select("n", "b", binary.read_int32(F.col("b"), 1).alias("m")).collect()
    assert [bytes(r.b) for r in got] == [n.to_bytes(4, "big", signed=True) for n in numbers] and [r.m for r in got] == numbers
