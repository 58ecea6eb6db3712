"""Windows and joins over streams by the stream time of each partition, with the rules of the bounded operators.

Stream time is the greatest timestamp that a partition has seen, the current poll included, so a partition that is
behind keeps its windows while others go on, and a poll already counts for what it retains. A poll is the ``__batch``
column; of a micro-batch with several they are taken in their order. Spark keeps the state per partition
(``transformWithState``), so it survives restarts and lost executors; its store has to be RocksDB, which :func:`stateful`
sees to. A partition is one key of the state: it holds the groups of its retention. The rows of a join are dealt by
their keys to several shares of a partition, all of which are told its polls' times.

Values pass through pandas, which can't tell null from NaN or hold a long with nulls, so they are made into columns
without nulls, or texts, before, and into what they were after.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brookframe.functions.exact import INTEGRAL, RAW_TIME, exact_cast, family, from_raw, raw
from brookframe.operators.groups import COUNT, END, MAX, PARTITION, START, SUM, TIME, Agg, check_groups, with_window
from brookframe.operators.joins import check_join
from brookframe.sources.topics import BATCH, RESERVED, original_name, payload_names

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: JSON keeps microseconds; these are the only formats that it would shorten.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
INTEGER, REAL, TEXT = "integer", "real", "text"
LOW = (1 << 32) - 1


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within it keep their state in RocksDB; a query takes the setting with it when it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _as_text(value: Column, kind: T.DataType) -> Column:
    return F.base64(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _from_text(text: Column, kind: T.DataType) -> Column:
    return F.unbase64(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


class _Carried:
    """How an aggregate's input passes through pandas: whole numbers as two halves, reals with a flag for NaN, anything else as text; each with a flag for what isn't null."""

    def __init__(self, agg: Agg, kind: T.DataType, at: int):
        self.agg, self.kind, self.name = agg, kind, f"a{at}"
        if agg.how == SUM and isinstance(kind, T.StringType):
            self.form = INTEGER
        elif isinstance(kind, (*INTEGRAL, *RAW_TIME, T.BooleanType)):
            self.form = INTEGER
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            self.form = REAL
        elif isinstance(kind, (T.StringType, T.DecimalType)):
            self.form = TEXT
        elif agg.how == COUNT:
            self.form = INTEGER
        else:
            raise TypeError(f"a stream can't take the {agg.how} of {kind.simpleString()}")
        if agg.how == SUM and isinstance(kind, T.BooleanType) and agg.kind is None:
            raise TypeError("a sum of booleans needs a numeric output type")

    def columns(self) -> list[Column]:
        value, there = F.col(f"`{self.agg.column}`"), F.col(f"`{self.agg.column}`").isNotNull().cast("int").alias(f"{self.name}n")
        if self.agg.how == COUNT:
            return []
        if self.form == INTEGER:
            whole = exact_cast(value, self.kind, T.LongType()) if isinstance(self.kind, T.StringType) else raw(value, self.kind).cast("long")
            whole = F.coalesce(whole, F.lit(0))
            return [there, F.shiftright(whole, 32).alias(f"{self.name}h"), whole.bitwiseAND(F.lit(LOW)).alias(f"{self.name}l")]
        if self.form == REAL:
            real = value.cast("double")
            return [there, F.coalesce(F.isnan(real), F.lit(False)).cast("int").alias(f"{self.name}x"), F.when(real.isNull() | F.isnan(real), 0.0).otherwise(real).alias(f"{self.name}v")]
        return [there, F.coalesce(value.cast("string"), F.lit("")).alias(f"{self.name}v")]

    @property
    def state(self) -> T.DataType:
        return {INTEGER: T.DecimalType(38, 0), REAL: T.DoubleType(), TEXT: T.StringType()}[self.form]

    @property
    def shown(self) -> T.DataType:
        """Reals leave as text, as pandas hands NaN on as null."""
        return T.StringType() if self.form == REAL else self.state

    def show(self, value):
        return str(value) if self.form == REAL and value is not None else value

    def partials(self, rows: pd.DataFrame, groups) -> list:
        """One value for each group, None where all are null."""
        if self.agg.how == COUNT:
            return [Decimal(int(n)) for n in groups.size()]
        n = groups[f"{self.name}n"].sum().to_numpy()
        there = rows[f"{self.name}n"].to_numpy() > 0
        which = groups.ngroup().to_numpy()[there]
        if self.form == INTEGER:
            high, low = rows[f"{self.name}h"].to_numpy()[there], rows[f"{self.name}l"].to_numpy()[there]
            if self.agg.how == SUM:
                highs, lows = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                np.add.at(highs, which, high)
                np.add.at(lows, which, low)
                return [Decimal((int(h) << 32) + int(x)) if k else None for h, x, k in zip(highs, lows, n)]
            values = (high << 32) + low
            best = np.full(len(n), np.iinfo(np.int64).min if self.agg.how == MAX else np.iinfo(np.int64).max)
            (np.maximum if self.agg.how == MAX else np.minimum).at(best, which, values)
            return [Decimal(int(v)) if k else None for v, k in zip(best, n)]
        out: list = [None] * len(n)
        values = rows[f"{self.name}v"].to_numpy()[there]
        if self.form == REAL:
            values = np.where(rows[f"{self.name}x"].to_numpy()[there] > 0, np.nan, values)
        for g, v in zip(which, values.tolist()):
            out[g] = v if out[g] is None else self.merged(out[g], v)
        return out

    def merged(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if self.agg.how in (COUNT, SUM):
            return str(Decimal(a) + Decimal(b)) if self.form == TEXT else a + b
        if self.form == REAL and (a != a or b != b):  # NaN is over every number
            return float("nan") if self.agg.how == MAX else (b if a != a else a)
        return max(a, b, key=self._order) if self.agg.how == MAX else min(a, b, key=self._order)

    def _order(self, x):
        return x if self.form != TEXT else Decimal(x) if isinstance(self.kind, T.DecimalType) else x.encode()

    def final(self, df: DataFrame) -> Column:
        value, kind = F.col(self.name).cast(self.state), self.kind
        if self.agg.how != COUNT and self.agg.how != SUM:
            if isinstance(kind, RAW_TIME):
                value = from_raw(value, kind)
            else:
                value = (value.cast("int") if isinstance(kind, T.BooleanType) else value).cast(kind)
        elif isinstance(kind, T.DecimalType) and self.agg.how == SUM:
            value = value.cast(T.DecimalType(38, kind.scale))
        return self.agg.final(df, value)


class _Windows(StatefulProcessor):
    def __init__(self, keys: int, carried: list[_Carried], size: int | None, retention: int):
        self.keys, self.carried, self.size, self.retention = keys, carried, size, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = [*(f"k{i}" for i in range(self.keys)), *(("s",) if self.size else ())]
        key = T.StructType([T.StructField(n, T.LongType() if n == "s" else T.StringType()) for n in names])
        self.groups = handle.getMapState("groups", key, T.StructType([T.StructField(c.name, c.state) for c in self.carried]))
        self.time = handle.getValueState("time", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        by = [*(f"k{i}" for i in range(self.keys)), *(("s",) if self.size else ())]
        polls: dict[int, dict[tuple, list]] = defaultdict(dict)
        latest: dict[int, int] = {}
        for frame in rows:  # of the rows only their groups are kept
            for poll, part in frame.groupby("b", sort=False):
                part = part.reset_index(drop=True)
                grouped = part.groupby(by, dropna=False, sort=False)
                found = list(zip(*(c.partials(part, grouped) for c in self.carried))) if self.carried else [()] * grouped.ngroups
                names = part.loc[grouped.head(1).index, by].itertuples(index=False, name=None)
                for name, values in zip(names, found):
                    name = tuple(None if x is None or x != x else x for x in name)
                    have = polls[poll].get(name)
                    polls[poll][name] = list(values) if have is None else [c.merged(a, b) for c, a, b in zip(self.carried, have, values)]
                latest[poll] = max(latest.get(poll, -(1 << 63)), int(part["t"].max()))
        time = self.time.get()[0] if self.time.exists() else -(1 << 63)
        now = {tuple(k): tuple(v) for k, v in self.groups.iterator()}
        for poll in sorted(polls):
            time = max(time, latest[poll])
            ends = time - self.retention - (self.size or 0)
            for name in [n for n in now if self.size and n[-1] < ends]:
                del now[name]
                self.groups.removeKey(name)
            for name, values in polls[poll].items():
                if not self.size or name[-1] >= ends:
                    have = now.get(name)
                    name = (*name[:-1], int(name[-1])) if self.size else name
                    now[name] = tuple(values) if have is None else tuple(c.merged(a, b) for c, a, b in zip(self.carried, have, values))
                    self.groups.updateValue(name, now[name])
            if now:
                out = pd.DataFrame([(*n, *(c.show(x) for c, x in zip(self.carried, v))) for n, v in now.items()], columns=[*by, *(c.name for c in self.carried)], dtype=object)
                yield out.assign(p=int(key[0]), b=int(poll))
        self.time.update((int(time),))

    def close(self) -> None:
        pass


def grouped_by_stream_time(stream: DataFrame, keys: list[str], aggs: list[Agg], size: int | None = None, retention: int | None = None) -> DataFrame:
    """Of a stream, what :func:`windowed_group_by` (with a window's ``size``) or :func:`group_by` give of a bounded topic with ``by_batch``: after each poll, every group of its partition that is retained."""
    check_groups(stream, keys, size is not None)
    retention = (size or 0) if retention is None else retention
    if size is not None and (size < 1 or retention < size):
        raise ValueError("a window has at least 1 ms, and retention at least its size")
    carried = [_Carried(a, a.source(stream), i) for i, a in enumerate(aggs)]
    rows = with_window(stream, size) if size else stream
    texts = [_as_text(F.col(f"`{k}`"), stream.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)]
    batch = F.col(BATCH) if BATCH in stream.columns else F.lit(0).cast("long")
    slim = rows.select(F.col(PARTITION).alias("p"), batch.alias("b"), F.coalesce(TIME, F.lit(-(1 << 63))).alias("t"), *texts, *((F.col(START).alias("s"),) if size else ()), *(c for x in carried for c in x.columns()))
    out = T.StructType([*(T.StructField(f"k{i}", T.StringType()) for i in range(len(keys))), *((T.StructField("s", T.LongType()),) if size else ()), *(T.StructField(c.name, c.shown) for c in carried), T.StructField("p", T.IntegerType()), T.StructField("b", T.LongType())])
    found = slim.groupBy("p").transformWithStateInPandas(_Windows(len(keys), carried, size, retention), out, "Append", "None")
    back = [_from_text(F.col(f"k{i}"), stream.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
    bounds = [F.col("s").alias(START), (F.col("s") + size).alias(END)] if size else []
    return found.select(F.col("b").alias(BATCH), *back, *bounds, *(c.final(stream).alias(c.agg.name) for c in carried))


@dataclass
class _Side:
    """Rows of one side of a join: their key, time, poll and text; the greatest time of their side in their poll, the stream time of their poll, and whether they were stored before."""

    k: np.ndarray
    t: np.ndarray
    b: np.ndarray
    row: np.ndarray
    top: np.ndarray
    now: np.ndarray
    old: np.ndarray

    def only(self, which: np.ndarray) -> _Side:
        return _Side(*(getattr(self, f.name)[which] for f in fields(self)))


class _Pairs(StatefulProcessor):
    """State, of one share of a partition's keys: the rows of each side and poll, with the greatest time that the side has in the poll in all shares.

    The rows of a micro-batch meet each other and what is stored in one go, whatever their polls; of a pair its polls
    then say whether the earlier row was still there.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("b", T.LongType()), T.StructField("part", T.LongType())])
        row = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.LongType()), T.StructField("row", T.StringType())])
        self.rows = handle.getMapState("rows", key, T.StructType([T.StructField("rows", T.ArrayType(row))]))
        self.latest = handle.getMapState("latest", T.StructType(key.fields[:2]), T.StructType([T.StructField("t", T.LongType()), T.StructField("parts", T.LongType())]))
        self.time = handle.getValueState("time", "t long")

    def _less(self, t: np.ndarray) -> np.ndarray:
        """``t`` less the window, at least the least long."""
        return np.where(t >= LEAST + self.window, t - self.window, LEAST)

    def _near(self, left: _Side, right: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows of equal key near in time, about ``MOST_PAIRS`` at once. The right rows are sorted by key and time, in which those near a left row stand together."""
        if not len(left.k) or not len(right.k):
            return
        codes = pd.factorize(np.concatenate([left.k, right.k]))[0].astype(np.int64)
        times, rank = np.unique(right.t, return_inverse=True)
        codes *= len(times) + 1
        own, places = codes[: len(left.k)], codes[len(left.k) :] + rank
        order = np.argsort(places, kind="stable")
        most = np.where(left.t <= -(LEAST + 1) - self.window, left.t + self.window, -(LEAST + 1))
        first = np.searchsorted(places[order], own + np.searchsorted(times, self._less(left.t)))
        counts = np.searchsorted(places[order], own + np.searchsorted(times, most, "right")) - first
        until = np.cumsum(counts)
        a = 0
        while a < len(counts):
            z = max(a + 1, int(np.searchsorted(until, until[a] - counts[a] + MOST_PAIRS, "right")))
            n_each = counts[a:z]
            within = np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)
            yield np.repeat(np.arange(a, z), n_each), order[np.repeat(first[a:z], n_each) + within]
            a = z

    def _matched(self, left: _Side, right: _Side, p: int) -> Iterator[pd.DataFrame]:
        """Pairs come out in the later of their polls, if the earlier row's poll is retained there; what is stored came before what is fresh."""
        for i, j in self._near(left, right):
            same = left.b[i] == right.b[j]
            later = np.where(left.old[i] == right.old[j], left.b[i] >= right.b[j], right.old[j])
            top, now = np.where(later, right.top[j], left.top[i]), np.where(later, left.now[i], right.now[j])
            kept = same | (top >= self._less(now))
            if kept.any():
                yield pd.DataFrame({"l": left.row[i[kept]], "r": right.row[j[kept]], "p": p, "b": np.where(later, left.b[i], right.b[j])[kept]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: list[pd.DataFrame] = []
        tops: dict[tuple[int, int], int] = {}
        for frame in rows:
            told = (frame["k"] == CLOCK).to_numpy()
            for side, b, t in frame.loc[told, ["side", "b", "t"]].itertuples(index=False, name=None):
                tops[int(side), int(b)] = max(int(t), tops.get((int(side), int(b)), LEAST))
            if not told.all():
                fresh.append(frame.loc[~told, ["side", "b", "k", "t", "row"]])
        time = self.time.get()[0] if self.time.exists() else LEAST
        latest = {(int(k[0]), int(k[1])): (int(v[0]), int(v[1])) for k, v in self.latest.iterator()}
        now: dict[int, int] = {}
        for poll in sorted({b for _, b in tops}):
            time = now[poll] = max(time, *(tops[side, poll] for side in (0, 1) if (side, poll) in tops))
        last = max(now)
        for which, (top, parts) in latest.items():
            if which in tops and top < tops[which]:
                latest[which] = (tops[which], parts)
                self.latest.updateValue(which, latest[which])
        if fresh:
            whole = pd.concat(fresh, ignore_index=True)
            stored = [(int(k[0]), int(k[1]), v[0]) for k, v in self.rows.iterator()]
            sides = [self._side(whole[whole["side"] == i], [(b, v) for side, b, v in stored if side == i], i, latest, tops, now) for i in (0, 1)]
            came = [s.only(~s.old) for s in sides]
            yield from self._matched(came[0], sides[1], int(key[0]))
            yield from self._matched(sides[0].only(sides[0].old), came[1], int(key[0]))
        # a poll may go on in the next micro-batch, so the last one stays, and shares without rows of a poll note its times too
        cutoff = time - self.window
        for (side, b), (top, parts) in latest.items():
            if top < cutoff and b != last:
                self.latest.removeKey((side, b))
                for i in range(parts):
                    self.rows.removeKey((side, b, i))
        came_by_poll = {(int(side), int(b)): part for (side, b), part in whole.groupby(["side", "b"], sort=False)} if fresh else {}
        for which in tops:
            top, parts = latest.get(which, (tops[which], 0))
            if top >= cutoff or which[1] == last:
                part = came_by_poll.get(which, ())
                pieces = [part.iloc[i : i + PIECE] for i in range(0, len(part), PIECE)]
                for i, piece in enumerate(pieces, parts):
                    self.rows.updateValue((*which, i), (list(zip(piece["k"], map(int, piece["t"]), piece["row"])),))
                if pieces or which not in latest:
                    self.latest.updateValue(which, (top, parts + len(pieces)))
        self.time.update((int(time),))

    @staticmethod
    def _side(frame: pd.DataFrame, stored: list[tuple[int, list]], side: int, latest: dict, tops: dict, now: dict) -> _Side:
        """Rows of a side, those stored and those of the micro-batch."""
        old = [(r[0], int(r[1]), b, r[2]) for b, rows in stored for r in rows]
        k, t, b, row = (list(x) for x in zip(*old)) if old else ([], [], [], [])
        polls = np.array([*b, *frame["b"]], np.int64)
        each, at = np.unique(polls, return_inverse=True)
        top = np.array([max(latest.get((side, x), (LEAST, 0))[0], tops.get((side, x), LEAST)) for x in each.tolist()], np.int64)
        time = np.array([now.get(x, LEAST) for x in each.tolist()], np.int64)
        return _Side(np.array([*k, *frame["k"]], object), np.array([*t, *frame["t"]], np.int64), polls, np.array([*row, *frame["row"]], object), top[at], time[at], np.arange(len(polls)) < len(old))

    def close(self) -> None:
        pass


#: Rows of one value of the join's state.
PIECE = 10_000
#: Pairs that are looked at together, unless one row has more.
MOST_PAIRS = 1 << 19
#: Shares of a partition's keys, each with a state of its own; a checkpoint goes on only with as many.
SHARES = 16
LEAST = -(1 << 63)
CLOCK = ""
SLIM = "p int, u int, b long, side int, t long, k string, row string"


def _with_clock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a key, and for every share of the keys the greatest time of each partition, poll and side, by which stream time goes on in all shares."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        yield from rows.filter(pc.is_valid(rows["k"])).to_batches()
        tops = rows.group_by(["p", "b", "side"]).aggregate([("t", "max")]).rename_columns({"t_max": "t"})
        each = tops.take(pa.array(np.repeat(np.arange(tops.num_rows), SHARES)))
        own = {"u": pa.array(np.tile(np.arange(SHARES), tops.num_rows), pa.int32()), "k": pa.array([CLOCK] * len(each), batch.schema.field("k").type), "row": pa.array([CLOCK] * len(each), batch.schema.field("row").type)}
        yield from pa.Table.from_arrays([own[f.name] if f.name in own else each[f.name] for f in batch.schema], schema=batch.schema).to_batches()


def joined_by_stream_time(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, left_prefix: str = "left_", right_prefix: str = "right_") -> DataFrame:
    """Of two streams, what :func:`windowed_join` gives of bounded topics with ``by_batch``: a pair comes out in the later of its polls, unless the earlier row's poll had been dropped by then."""
    check_join(left, right, left_key, right_key, window, left_prefix, right_prefix)
    same = family(left.schema[left_key].dataType) == family(right.schema[right_key].dataType)

    def slim(df: DataFrame, key: str, side: int) -> DataFrame:
        kind = df.schema[key].dataType
        named = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
        batch = F.col(BATCH) if BATCH in df.columns else F.lit(0).cast("long")
        # a null key, or one of another family, meets nothing, but its time counts
        text = F.concat(F.lit("k"), _as_text(raw(F.col(f"`{key}`"), kind), kind)) if same else F.lit(None).cast("string")
        rows = df.filter(F.col(TIME).isNotNull()).select(F.col(PARTITION).alias("p"), batch.alias("b"), F.lit(side).alias("side"), F.col(TIME).alias("t"), text.alias("k"), F.to_json(named, EXACT).alias("row"))
        return rows.select("p", F.pmod(F.xxhash64("k"), F.lit(SHARES)).cast("int").alias("u"), "b", "side", "t", "k", "row")

    both = slim(left, left_key, 0).unionByName(slim(right, right_key, 1)).mapInArrow(_with_clock, SLIM)
    found = both.groupBy("p", "u").transformWithStateInPandas(_Pairs(window), "l string, r string, p int, b long", "Append", "None")

    def typed(df: DataFrame) -> T.StructType:
        return T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])

    rows = found.select("b", F.from_json("l", typed(left), EXACT).alias("l"), F.from_json("r", typed(right), EXACT).alias("r"))
    lc, rc = ({c: f"{side}.c{i}" for i, c in enumerate(df.columns)} for side, df in (("l", left), ("r", right)))
    payload = [F.col(lc[c]).alias(left_prefix + original_name(left, c)) for c in payload_names(left)] + [F.col(rc[c]).alias(right_prefix + original_name(right, c)) for c in payload_names(right)]
    return rows.select(*payload, *(F.col(lc[c]).alias(c) for c in RESERVED if c in left.columns), F.col("b").alias(BATCH))
