"""Casts that keep a value exactly or raise, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Times of day need a session with spark.sql.timeType.enabled.
RAW_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)
WIDE = T.DecimalType(38, 0)


def family(kind: T.DataType) -> str:
    """Types whose values can be equal as keys. Integers of all widths and raw dates and times are one family; any other type is its own."""
    if isinstance(kind, INTEGRAL + RAW_TIME):
        return "integer"
    return "decimal" if isinstance(kind, T.DecimalType) else kind.typeName()


def require(value: Column, holds: Column, message: str) -> Column:
    """``value``, or an error where ``holds`` is false; a null value passes."""
    return F.when(value.isNull() | holds, value).otherwise(F.raise_error(F.lit(message)))


def raw(value: Column, kind: T.DataType) -> Column:
    """Dates and times as the integers they are stored as (days, microseconds, of a time those of its day); other values unchanged."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value)
    if isinstance(kind, T.TimeType):
        return (value.cast("decimal(14,6)") * 1_000_000).cast("long")
    if isinstance(kind, RAW_TIME):
        return F.unix_micros(value.cast("timestamp"))
    return value


def from_raw(value: Column, kind: T.DataType) -> Column:
    """What :func:`raw` made of a date or time; microseconds that aren't within a day raise for a time of day."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(kind, T.TimeType):
        micros = require(value.cast("long"), (value >= 0) & (value < 86_400_000_000), "not a time of day")
        seconds = (F.pmod(micros, F.lit(60_000_000)).cast("decimal(16,0)") / 1_000_000).cast("decimal(16,6)")
        return F.make_time(F.floor(micros / 3_600_000_000).cast("int"), F.pmod(F.floor(micros / 60_000_000), F.lit(60)).cast("int"), seconds)
    return F.timestamp_micros(value.cast("long")).cast(kind)


def exact_cast(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """``value`` as ``target``; a fraction, extra decimals or a number out of range raise instead of being cut."""
    if source == target:
        return value
    if isinstance(target, T.BooleanType):
        raise TypeError(f"only booleans can become boolean, not {source.simpleString()}")
    if isinstance(target, T.StringType):
        if isinstance(source, T.DecimalType) and source.scale:
            return F.regexp_replace(value.cast("string"), r"\.?0+$", "")
        return value.cast("string")
    if isinstance(source, T.BooleanType):
        value, source = value.cast("int"), T.IntegerType()
    if isinstance(source, RAW_TIME):
        value, source = raw(value, source), T.LongType()
    if isinstance(target, T.TimeType):
        return from_raw(exact_cast(value, source, T.LongType()), target)
    if isinstance(target, INTEGRAL):
        if isinstance(source, T.StringType):
            value = require(value, value.rlike(r"^[+-]?[0-9]+$"), "not an integer in base 10").cast(WIDE)
        elif isinstance(source, (T.FloatType, T.DoubleType)):
            value = require(value, value == F.rint(value), "a fraction doesn't fit an integer")
        elif isinstance(source, T.DecimalType):
            value = require(value, value == F.floor(value), "a fraction doesn't fit an integer")
        return value.cast(target)
    if isinstance(target, T.DecimalType):
        if isinstance(source, (T.StringType, T.FloatType, T.DoubleType)):
            value = value.cast("string").cast(T.DecimalType(38, 18))
        return require(value.cast(target), value.cast(target) == value, f"a value has more decimals than {target.simpleString()}")
    return value.cast(target)


def unsigned(value: Column, bits: int) -> Column:
    """Checks the range of an unsigned integer of ``bits``; 64 bits live in decimal(20,0)."""
    return require(value, (value >= 0) & (value.cast(WIDE) < F.lit(1 << bits).cast(WIDE)), f"out of range of an unsigned {bits}-bit integer")


def fixed_width(value: Column, width: int) -> Column:
    return require(value, F.length(value) == width, f"not {width} bytes")


def floor_to(ts: Column, size: int) -> Column:
    """The greatest multiple of ``size`` that is not over ``ts``; right for negative times too."""
    return ts - F.pmod(ts, F.lit(size))


def distance(a: Column, b: Column) -> Column:
    """|a - b| of two longs, which never overflows."""
    wide = T.DecimalType(20, 0)
    return F.abs(a.cast(wide) - b.cast(wide))
