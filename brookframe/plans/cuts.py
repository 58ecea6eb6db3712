"""Consistent cuts: a manifest of offsets per epoch, and runs that stop at, snapshot and resume from one.

A manifest row: ``grp, epoch, kind, record_offset, tombstone, status, topic, partition, cut_offset``; kind 0 is a cut,
status 0 is complete. A record of the manifest is all rows with one record_offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookframe.functions.binary import int32

CUT, COMPLETE = 0, 0
#: Fixed values of the manifest's wire format: versions of key and value, the kind of a cut's key, and known states.
VERSION, WIRE_CUT, STATES = 0, 2, (0, 1)
OFFSETS, MISSING = "array<struct<topic:string,partition:int,cut_offset:long>>", "array<struct<topic:string,partition:int>>"


def _integer(data: Column, at: Column | int, size: int) -> Column:
    """A signed integer of ``size`` bytes, most significant first; null if nothing is there."""
    number = F.conv(F.hex(F.substring(data, at, size)), 16, -10).cast("long")
    return number if size == 8 else F.when(number >= 1 << (8 * size - 1), number - (1 << 8 * size)).otherwise(number).cast("int")


def _text(data: Column, at: Column) -> Column:
    return F.decode(F.substring(data, at + 2, _integer(data, at, 2)), "UTF-8")


def _listed(data: Column, start: Column, kind: str, entry) -> Column:
    """Counted entries from ``start`` on: where they end (null if they aren't all there) and what ``entry`` (found, end) read."""
    n, size = _integer(data, start, 4), F.length(data)
    none = F.struct((start + 4).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, _: Column) -> Column:
        found, end = entry(acc["at"])
        right = (end <= size + 1) & (_integer(data, acc["at"], 2) >= 0)
        return F.struct(F.when(right, end.cast("int")).alias("at"), F.when(right, F.concat(acc["out"], found)).alias("out"))

    return F.when((n >= 0) & (n <= size), F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), none, step))


def decode_cut(key: Column, value: Column) -> Column:
    """``grp, epoch, triggered, completed, status, offsets, missing`` of a record of the manifest; null for records that carry no cut
    (other kinds of key, and tombstones). Bytes of another layout raise."""
    return F.get(F.transform(F.array(parsed_cut(key, value)), lambda p: F.when(p["wrong"].isNull(), p["cut"]).otherwise(F.raise_error(p["wrong"]))), F.lit(0))


def parsed_cut(key: Column, value: Column) -> Column:
    """``wrong``, what is not of the layout, or null, and ``cut``, as :func:`decode_cut` returns it."""
    name = _integer(key, 5, 2)
    key_right = (_integer(key, 1, 2) == VERSION) & (name >= 0) & (F.length(key) == name + 14)
    after_topics = lambda at: at + 2 + _integer(value, at, 2)

    def topic(at: Column) -> tuple[Column, Column]:
        begin, n = after_topics(at) + 4, _integer(value, after_topics(at), 4)
        there = (n > 0) & (n <= F.length(value))
        places = F.when(there, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        entries = F.transform(places, lambda i: F.struct(_text(value, at).alias("topic"), _integer(value, begin + 12 * i, 4).alias("partition"), _integer(value, begin + 12 * i + 4, 8).alias("cut_offset")))
        return entries, F.when(n >= 0, begin + 12 * n.cast("long"))

    def partition(at: Column) -> tuple[Column, Column]:
        return F.array(F.struct(_text(value, at).alias("topic"), _integer(value, after_topics(at), 4).alias("partition"))), after_topics(at) + 4

    def read(offsets: Column) -> Column:
        def whole(missing: Column) -> Column:
            right = (_integer(value, 1, 2) == VERSION) & _integer(value, 19, 1).isin(*STATES) & (missing["at"] == F.length(value) + 1)
            cut = F.struct(
                F.decode(F.substring(key, F.lit(7), name), "UTF-8").alias("grp"), _integer(key, 7 + name, 8).alias("epoch"), _integer(value, 3, 8).alias("triggered"), _integer(value, 11, 8).alias("completed"),
                _integer(value, 19, 1).alias("status"), offsets["out"].alias("offsets"), missing["out"].alias("missing"),
            )
            return F.when(F.coalesce(right, F.lit(False)), cut)

        return F.get(F.transform(F.array(_listed(value, offsets["at"], MISSING, partition)), whole), F.lit(0))

    cut = F.get(F.transform(F.array(_listed(value, F.lit(20), OFFSETS, topic)), read), F.lit(0))
    carries = (_integer(key, 3, 2) == WIRE_CUT) & (F.coalesce(F.length(value), F.lit(0)) > 0)
    wrong = F.when(~F.coalesce(key_right, F.lit(False)), "not the key of a manifest record").when(carries & cut.isNull(), "not the value of a cut")
    return F.struct(wrong.alias("wrong"), F.when(carries, cut).alias("cut"))


def encode_cut(grp: Column, epoch: Column, triggered: Column, completed: Column, status: Column, topic: Column, offsets: Column) -> tuple[Column, Column]:
    """Key and value of a cut of one topic; ``offsets`` is an array of (partition, cut_offset)."""
    def wide(x: Column, size: int) -> Column:
        return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * size, "0"))

    def text(x: Column) -> Column:
        return F.concat(wide(F.length(F.encode(x, "UTF-8")), 2), F.encode(x, "UTF-8"))

    entries = F.aggregate(F.transform(offsets, lambda o: F.concat(int32(o["partition"]), wide(o["cut_offset"], 8))), F.lit(b""), lambda a, x: F.concat(a, x))
    key = F.concat(wide(F.lit(VERSION), 2), wide(F.lit(WIRE_CUT), 2), text(grp), wide(epoch, 8))
    value = F.concat(wide(F.lit(VERSION), 2), wide(triggered, 8), wide(completed, 8), wide(status, 1), int32(F.lit(1)), text(topic), int32(F.size(offsets)), entries, int32(F.lit(0)))
    return key, value


def latest_cuts(manifest: DataFrame) -> DataFrame:
    """The rows of each group's and epoch's last record, unless that is a tombstone; other kinds are ignored."""
    cuts = manifest.filter(F.col("kind") == CUT)
    last = cuts.groupBy("grp", "epoch").agg(F.max("record_offset").alias("record_offset"))
    return cuts.join(last, ["grp", "epoch", "record_offset"], "left_semi").filter(~F.col("tombstone"))


def complete_cuts_after(manifest: DataFrame, grp: str, epoch: int) -> DataFrame:
    return latest_cuts(manifest).filter((F.col("grp") == grp) & (F.col("status") == COMPLETE) & (F.col("epoch") > epoch)).select("epoch", "topic", "partition", "cut_offset")


def latest_complete_cut(manifest: DataFrame, grp: str) -> DataFrame:
    cuts = complete_cuts_after(manifest, grp, -1)
    return cuts.join(cuts.agg(F.max("epoch").alias("epoch")), "epoch", "left_semi")


def next_cut(manifest: DataFrame, grp: str, committed: int) -> DataFrame:
    """The oldest complete cut after the last one committed."""
    cuts = complete_cuts_after(manifest, grp, committed)
    return cuts.join(cuts.agg(F.min("epoch").alias("epoch")), "epoch", "left_semi")


def align(records: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records before the cut, and those held back; partitions that the cut doesn't name run on."""
    # rows of a cut are as many as there are partitions; Catalyst broadcasts them by their size
    joined = records.join(cut.select(F.col("partition").alias("__partition"), "cut_offset"), "__partition", "left")
    early = F.col("__offset") < F.coalesce("cut_offset", F.lit((1 << 63) - 1))
    return joined.filter(early).drop("cut_offset").select(*records.columns), joined.filter(~early).drop("cut_offset").select(*records.columns)


def fired(records: DataFrame, cut: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """One row: whether every partition of the cut that is owned has reached its offset. ``positions`` (``__partition, position``) tells of idle ones."""
    at = records.groupBy("__partition").agg((F.max("__offset") + 1).alias("position"))
    if positions is not None:
        at = at.unionByName(positions.select("__partition", "position")).groupBy("__partition").agg(F.max("position").alias("position"))
    owned = cut.join(at, F.col("partition") == F.col("__partition"))
    return owned.agg(F.count("*").alias("partitions"), F.coalesce(F.min(F.col("position") >= F.col("cut_offset")), F.lit(False)).alias("fired"))


def committed_offsets(records: DataFrame, cut: DataFrame) -> DataFrame:
    """The greater of what was read and the cut, for aligned partitions."""
    early, _ = align(records, cut)
    at = early.groupBy("__partition").agg((F.max("__offset") + 1).alias("position"))
    return cut.join(at, F.col("partition") == F.col("__partition"), "left").select("partition", F.greatest(F.coalesce("position", F.lit(0)), "cut_offset").alias("offset"))


def resume(records: DataFrame, cut: DataFrame) -> DataFrame:
    """Records from the cut on."""
    return align(records, cut)[1]
