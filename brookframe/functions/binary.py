"""Binary layouts of records as Column expressions: packed headers, schema frames, and the hash that deals keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brookframe.functions.exact import require

HEADER = "struct<key:string,value:binary>"


def int32(value: Column) -> Column:
    """Four bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))


def read_int32(data: Column, start: Column | int) -> Column:
    """The signed integer at a 1-based place."""
    number = F.conv(F.hex(F.substring(data, start, 4)), 16, 10).cast("long")
    return F.pmod(number + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def pack_headers(headers: Column) -> Column:
    """An array of (key, value) in order: count, then length and bytes of each key and value; length -1 is a null value."""
    def one(h: Column) -> Column:
        key = F.encode(h["key"], "UTF-8")
        value = F.when(h["value"].isNull(), int32(F.lit(-1))).otherwise(F.concat(int32(F.length(h["value"])), h["value"]))
        return F.concat(int32(F.length(key)), key, value)

    headers = F.coalesce(headers, F.array().cast(f"array<{HEADER}>"))
    return F.concat(int32(F.size(headers)), F.aggregate(F.transform(headers, one), F.lit(b""), lambda a, x: F.concat(a, x)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; as an expression it would be computed wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unpack_headers(data: Column) -> Column:
    """The array of (key, value) that :func:`pack_headers` packed; null stays null, and bytes that aren't such headers raise."""
    return _once(data, lambda d: F.when(d.isNotNull(), F.coalesce(_parsed_headers(d), F.raise_error(F.lit("not packed headers")))))


def parsed_headers(data: Column) -> Column:
    """The array that :func:`pack_headers` packed; null for null and for bytes that aren't such headers."""
    return _once(data, _parsed_headers)


def _parsed_headers(data: Column) -> Column:
    size = F.length(data)

    def step(acc: Column, _: Column) -> Column:
        def with_value(key: Column, value: Column) -> Column:
            start = acc["at"] + 8 + key.cast("int")
            after = start + F.greatest(value, F.lit(0)).cast("int")
            found = F.struct(F.decode(F.substring(data, acc["at"] + 4, key.cast("int")), "UTF-8").alias("key"), F.when(value >= 0, F.substring(data, start, value.cast("int"))).alias("value"))
            more = F.struct(after.alias("at"), F.lit(True).alias("right"), F.concat(acc["out"], F.array(found)).alias("out"))
            # a length is null past the end, and one that no headers have is not added to a place
            return F.when(F.coalesce(value.between(-1, size), F.lit(False)) & (after <= size + 1), more).otherwise(wrong)

        def with_key(key: Column) -> Column:
            value = F.when(key.between(0, size), read_int32(data, acc["at"] + 4 + key.cast("int")))
            return _once(value, lambda v: with_value(key, v))

        wrong = F.struct(acc["at"].alias("at"), F.lit(False).alias("right"), acc["out"].alias("out"))
        return F.when(acc["right"], _once(read_int32(data, acc["at"]), with_key)).otherwise(wrong)

    def walked(n: Column) -> Column:
        none = F.struct(F.lit(5).alias("at"), F.lit(True).alias("right"), F.array().cast(f"array<{HEADER}>").alias("out"))
        walk = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), none, step)
        counted = F.coalesce((size >= 4) & (n >= 0) & (n <= F.floor((size - 4) / 8) + 1), F.lit(False))
        return _once(F.when(counted, walk), lambda w: F.when(w["right"] & (w["at"] == size + 1), w["out"]))

    return _once(read_int32(data, 1), walked)


def frame(schema_id: Column, body: Column) -> Column:
    """A zero byte, the schema's id in four bytes, the body."""
    return F.concat(F.lit(b"\0"), int32(schema_id), body)


def is_framed(data: Column) -> Column:
    return F.coalesce((F.length(data) >= 5) & (F.substring(data, 1, 1) == F.lit(b"\0")), F.lit(False))


def _framed(data: Column) -> Column:
    return require(data, is_framed(data), "not a framed value")


def schema_id(data: Column) -> Column:
    return read_int32(_framed(data), 2).cast("int")


def body(data: Column) -> Column:
    return F.substring(_framed(data), F.lit(6), F.length(data))


def zigzag(value: Column) -> Column:
    """A long in as few bytes as it needs: seven bits a byte, the lowest first, the sign in the lowest bit; every byte but the last has its high bit set."""
    mixed = F.shiftleft(value.cast("long"), 1).bitwiseXOR(F.shiftright(value.cast("long"), 63))

    def byte(i: int) -> Column:
        rest = F.shiftrightunsigned(mixed, 7 * i)
        low, more = rest.bitwiseAND(F.lit(0x7F)), F.shiftrightunsigned(rest, 7) != 0
        data = F.unhex(F.lpad(F.hex(F.when(more, low + 0x80).otherwise(low)), 2, "0"))
        return data if i == 0 else F.when(rest != 0, data).otherwise(F.lit(b""))

    return F.concat(*(byte(i) for i in range(10)))


def read_zigzag(data: Column, start: Column) -> Column:
    """``value`` and ``at``, the place after it, of the :func:`zigzag` number at a 1-based place; both null if it isn't whole, or over ten bytes long."""
    none = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(None).cast("int").alias("at"), F.lit(True).alias("more"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, start + i, F.lit(1))), 16, 10).cast("long")
        bits = acc["bits"].bitwiseOR(F.call_function("shiftleft", byte.bitwiseAND(F.lit(0x7F)), i * 7))
        last = byte < 0x80  # null past the end, which stays so
        return F.when(acc["more"], F.struct(bits.alias("bits"), F.when(last, start + i + 1).cast("int").alias("at"), F.coalesce(~last, F.lit(False)).alias("more"))).otherwise(acc)

    def whole(acc: Column) -> Column:
        sign = F.when(acc["bits"].bitwiseAND(F.lit(1)) == 1, F.lit(-1)).otherwise(F.lit(0)).cast("long")
        value = F.shiftrightunsigned(acc["bits"], 1).bitwiseXOR(sign)
        return F.struct(F.when(acc["at"].isNotNull(), value).alias("value"), acc["at"].alias("at"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(9)), none, step, whole)


def protobuf_frame(schema_id: Column, indexes: Column, body: Column) -> Column:
    """A frame whose body follows the place of its message in the schema: how many indexes, then each; for the first message of all, a zero alone."""
    each = F.aggregate(F.transform(indexes, zigzag), F.lit(b""), lambda a, x: F.concat(a, x))
    place = F.when(F.size(indexes) < 1, F.raise_error(F.lit("a message has at least one index")).cast("binary")).when(indexes == F.array(F.lit(0)), F.lit(b"\0")).otherwise(F.concat(zigzag(F.size(indexes)), each))
    return frame(schema_id, F.concat(place, body))


def parsed_protobuf_frame(data: Column) -> Column:
    """``schema_id, indexes, body`` of a :func:`protobuf_frame`; null for null and for bytes that aren't such a frame."""
    size = F.length(data)

    def step(acc: Column, _: Column) -> Column:
        read = F.transform(F.array(read_zigzag(data, acc["at"])), lambda r: F.struct(r["at"].alias("at"), F.when(r["value"].between(-(1 << 31), (1 << 31) - 1), F.concat(acc["out"], F.array(r["value"].cast("int")))).alias("out")))
        return F.when(acc["at"].isNotNull() & acc["out"].isNotNull(), F.get(read, F.lit(0))).otherwise(F.struct(F.lit(None).cast("int").alias("at"), acc["out"].alias("out")))

    def listed(count: Column) -> Column:
        none = F.struct(count["at"].alias("at"), F.array().cast("array<int>").alias("out"))
        n = count["value"]
        several = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), none, step)
        first = F.struct(count["at"].alias("at"), F.array(F.lit(0)).alias("out"))
        # an index takes a byte at least, so there aren't more of them than bytes
        return F.when(n == 0, first).when((n > 0) & (n <= size), several)

    def whole(found: Column) -> Column:
        right = found["at"].isNotNull() & found["out"].isNotNull()
        return F.when(right, F.struct(read_int32(data, 2).cast("int").alias("schema_id"), found["out"].alias("indexes"), F.substring(data, found["at"], size).alias("body")))

    found = F.transform(F.transform(F.array(F.when(is_framed(data), read_zigzag(data, F.lit(6)))), listed), whole)
    return F.get(found, F.lit(0))


def unpack_protobuf_frame(data: Column) -> Column:
    """:func:`parsed_protobuf_frame`, which raises for bytes that aren't such a frame."""
    return F.when(data.isNotNull(), F.coalesce(parsed_protobuf_frame(data), F.raise_error(F.lit("not a frame with message indexes"))))


def _murmur2(keys: pd.Series) -> np.ndarray:
    """32-bit murmur2 of byte strings, as topics deal keys. Keys of about one length are hashed together, so a long key doesn't widen all others."""
    data = np.array([k if k is not None else b"" for k in keys], object)
    kinds = np.array([(len(k) + 3).bit_length() for k in data], np.int64)
    out = np.zeros(len(data), np.int32)
    for kind in np.unique(kinds):
        out[kinds == kind] = _murmur2_of(data[kinds == kind])
    return out


def _murmur2_of(data: np.ndarray) -> np.ndarray:
    """All keys advance four bytes at a time, padded to the longest."""
    length = np.array([len(k) for k in data], np.int64)
    width = -(-max(int(length.max(initial=0)), 1) // 4) * 4
    rows = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in data), np.uint8).reshape(len(data), width).astype(np.uint32)
    m = np.uint32(0x5BD1E995)
    h = np.uint32(0x9747B28C) ^ length.astype(np.uint32)
    for i in range(0, width, 4):
        word = rows[:, i] | rows[:, i + 1] << np.uint32(8) | rows[:, i + 2] << np.uint32(16) | rows[:, i + 3] << np.uint32(24)
        k = word * m
        k ^= k >> np.uint32(24)
        full, rest = length >= i + 4, (length > i) & (length < i + 4)
        h = np.where(full, (h * m) ^ (k * m), np.where(rest, (h ^ word) * m, h))
    h ^= h >> np.uint32(13)
    h *= m
    return (h ^ (h >> np.uint32(15))).view(np.int32)


def key_partition(key: Column, partitions: int) -> Column:
    """The partition of a topic that a binary key is dealt to."""

    @F.pandas_udf("int")
    def dealt(keys: pd.Series) -> pd.Series:
        return pd.Series((_murmur2(keys) & 0x7FFFFFFF) % partitions).where(keys.notna(), None).astype("Int32")

    return dealt(key)
