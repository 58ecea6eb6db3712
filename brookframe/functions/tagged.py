"""Values as bytes that tell their kind: keys that are equal only if kind and value are, down to the sign of zero.

A tag, then the value, all numbers most significant byte first. Fixed values, which other readers of such keys rely on:

    n null    t true    F false    s text    b bytes    i integers of up to 64 bits, dates and times    u unsigned 64 bits
    g float (as a double)    f double    R decimal, as a reduced fraction in text    L list    M struct or map, by names in order

Texts and bytes have their length in four bytes before them, lists and maps their size. A NaN is always the quiet one.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions.binary import int32
from brookframe.functions.exact import INTEGRAL, RAW_TIME, WIDE, raw

UNSIGNED = T.DecimalType(20, 0)


def int64(value: Column) -> Column:
    """Eight bytes of a long."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def double_bits(value: Column) -> Column:
    """The 64 bits of a double as a long, put together from sign, exponent and fraction; each step is exact in doubles."""
    size = F.abs(value)
    guess = F.floor(F.log2(F.when(size > 0, size))).cast("int")
    exponent = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("long")
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction
    small = (size * float(1 << 537) * float(1 << 537)).cast("long")  # under the least exponent the fraction stands alone
    bits = F.when(F.isnan(value), F.lit(0x7FF8 << 48)).when(size == float("inf"), F.lit(0x7FF0 << 48)).when(size < 2.0**-1022, small).otherwise(normal)
    return F.when(value.cast("string").startswith("-"), bits + F.lit(-(1 << 63))).otherwise(bits)


def _fraction(value: Column, kind: T.DecimalType) -> Column:
    """A decimal as numerator, or numerator/denominator, without common factors; those of a power of ten are 2 and 5."""
    if kind.scale > 37:
        raise TypeError(f"{kind.simpleString()} has too many decimals for a key")
    if not kind.scale:
        return value.cast("string")
    digits = F.regexp_replace(value.cast("string"), r"\.", "").cast(WIDE)
    start = F.struct(digits.alias("n"), F.lit(10**kind.scale).cast(WIDE).alias("d"))

    def reduced(acc: Column, by: int) -> Column:
        both = (acc["n"] % by == 0) & (acc["d"] % by == 0)
        return F.struct(F.when(both, (acc["n"] / by).cast(WIDE)).otherwise(acc["n"]).alias("n"), F.when(both, (acc["d"] / by).cast(WIDE)).otherwise(acc["d"]).alias("d"))

    steps = F.sequence(F.lit(1), F.lit(kind.scale))
    twos = F.aggregate(steps, start, lambda acc, _: reduced(acc, 2))
    return F.aggregate(steps, twos, lambda acc, _: reduced(acc, 5), lambda r: F.when(r["d"] == 1, r["n"].cast("string")).otherwise(F.concat(r["n"].cast("string"), F.lit("/"), r["d"].cast("string"))))


def _sized(tag: bytes, data: Column) -> Column:
    return F.concat(F.lit(tag), int32(F.length(data)), data)


def _joined(tag: bytes, parts: Column) -> Column:
    return F.concat(F.lit(tag), int32(F.size(parts)), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)))


def tagged(value: Column, kind: T.DataType, unsigned: bool = False) -> Column:
    """The bytes of a value; with ``unsigned`` a decimal(20,0) is an unsigned 64-bit integer."""
    if isinstance(kind, T.BooleanType):
        found = F.when(value, F.lit(b"t")).otherwise(F.lit(b"F"))
    elif isinstance(kind, T.StringType):
        found = _sized(b"s", F.encode(value, "UTF-8"))
    elif isinstance(kind, T.BinaryType):
        found = _sized(b"b", value)
    elif isinstance(kind, INTEGRAL + RAW_TIME):
        found = F.concat(F.lit(b"i"), int64(raw(value, kind)))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        found = F.concat(F.lit(b"g" if isinstance(kind, T.FloatType) else b"f"), int64(double_bits(value.cast("double"))))
    elif isinstance(kind, T.DecimalType) and unsigned:
        if kind != UNSIGNED:
            raise TypeError("an unsigned 64-bit integer lives in decimal(20,0)")
        found = F.concat(F.lit(b"u"), int64(F.when(value >= F.lit(Decimal(1 << 63)), value - F.lit(Decimal(1 << 64))).otherwise(value)))
    elif isinstance(kind, T.DecimalType):
        found = _sized(b"R", F.encode(_fraction(value, kind), "UTF-8"))
    elif isinstance(kind, T.ArrayType):
        found = _joined(b"L", F.transform(value, lambda x: tagged(x, kind.elementType)))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(int32(F.lit(len(f.name.encode()))), F.lit(f.name.encode()), tagged(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name.encode())]
        found = F.concat(F.lit(b"M"), int32(F.lit(len(parts))), *parts)
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        found = _joined(b"M", F.transform(entries, lambda e: F.concat(int32(F.length(F.encode(e["key"], "UTF-8"))), F.encode(e["key"], "UTF-8"), tagged(e["value"], kind.valueType))))
    else:
        raise TypeError(f"{kind.simpleString()} can't be a key")
    return F.when(value.isNull(), F.lit(b"n")).otherwise(found)


def tagged_column(df: DataFrame, name: str, unsigned: tuple[str, ...] = ()) -> Column:
    return tagged(F.col(f"`{name}`"), df.schema[name].dataType, name in unsigned)
