"""A topic as a data source of Spark: partitions of records in offset order, read by offset ranges, streamed and appended.

A topic is a folder with a folder for each partition, whose Parquet files are named by the offsets that they hold,
``<first>-<next>-<token>.parquet``. A record's offset is the file's first one plus its place in it, so appending needs
no offsets: they are given when the append is committed. A range of offsets is planned from names alone.

    read_log(spark, p, startingOffsets='{"0": 100}', endingOffsets='{"0": 200}')
    stream_log(spark, p, maxOffsetsPerTrigger=10_000)
    append_log(df, p)

Options of reading: ``startingOffsets`` and ``endingOffsets``, JSON of partition to offset (by default a partition's
first and last; in a stream only the start counts); ``partitions``, a JSON list of those to read; ``maxOffsetsPerTrigger``,
the most records of one partition in a micro-batch. Filters on ``__partition`` and ``__offset`` leave out files as well,
where the session has spark.sql.python.filterPushdown.enabled. Where an offset was compacted away or is past the end, what is there of
the range is read.

Writing takes ``__partition`` and any other columns; a column ``__offset`` is left out. Rows of a partition keep the order
of the tasks that write them, so a range sort by partition and order appends in that order from many tasks. Files
get their names only when all tasks have ended, the tasks' leftovers are removed when the job fails, and a
micro-batch that is committed again adds only what its first try did not. One writer at a time appends to a topic.

The folder is reached with Arrow's file systems (a path or a URI of file, hdfs, s3, gs or abfs). The path of a topic
is created with the first append, which also fixes its schema.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

PARTITION, OFFSET = "__partition", "__offset"
SCHEMA = "schema.json"
NAME = re.compile(r"(\d+)-(\d+)-(.+)\.parquet")
#: Records of a file at most; a file is read by one task.
MOST_PER_FILE = 1 << 20


@dataclass(frozen=True)
class Segment(InputPartition):
    """Records ``[start, end)`` of a partition, out of one file that begins at ``first``."""

    partition: int
    path: str
    first: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    """Hidden files of a task, in order: (partition, path, records)."""

    task: int
    files: list[tuple[int, str, int]]


class Log:
    """The files of a topic."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def _files(self, folder: str) -> list[str]:
        return [f.base_name for f in self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]

    def partitions(self) -> list[int]:
        return sorted(int(n.removeprefix("partition=")) for n in self._files(self.root) if n.startswith("partition="))

    def folder(self, partition: int) -> str:
        return posixpath.join(self.root, f"partition={partition}")

    def segments(self, partition: int) -> list[tuple[int, int, str]]:
        """(first, next, name) of each file, in order."""
        return sorted((int(m[1]), int(m[2]), n) for n in self._files(self.folder(partition)) if (m := NAME.fullmatch(n)))

    def ends(self) -> dict[int, tuple[int, int]]:
        """Each partition's first offset, and the one after its last."""
        return {p: (s[0][0], s[-1][1]) if (s := self.segments(p)) else (0, 0) for p in self.partitions()}

    def plan(self, ranges: dict[int, tuple[int, int]]) -> list[Segment]:
        return [
            Segment(p, posixpath.join(self.folder(p), name), first, max(first, start), min(after, end))
            for p, (start, end) in sorted(ranges.items()) for first, after, name in self.segments(p) if max(first, start) < min(after, end)
        ]

    def schema(self) -> StructType | None:
        where = posixpath.join(self.root, SCHEMA)
        if self.fs.get_file_info(where).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(where) as f:
            return StructType.fromJson(json.loads(f.readall()))

    def fix_schema(self, schema: StructType) -> None:
        """Notes the schema of the first append; another one later raises."""
        before = self.schema()
        if before is None:
            self.fs.create_dir(self.root)
            with self.fs.open_output_stream(posixpath.join(self.root, SCHEMA)) as f:
                f.write(schema.json().encode())
        elif [(f.name, f.dataType) for f in before.fields] != [(f.name, f.dataType) for f in schema.fields]:
            raise ValueError(f"the topic has {before.simpleString()}, not {schema.simpleString()}")

    def read(self, part: Segment, columns: StructType) -> Iterator[pa.RecordBatch]:
        """A segment's rows with their partition and offset, a batch of the file at a time."""
        target = to_arrow_schema(columns)
        with self.fs.open_input_file(part.path) as f:
            file, at = pq.ParquetFile(f), part.first
            stored = [n for n in target.names if n not in (PARTITION, OFFSET)]
            for group in range(file.num_row_groups):
                size = file.metadata.row_group(group).num_rows
                if at + size > part.start and at < part.end:
                    inside = at
                    for batch in file.iter_batches(row_groups=[group], columns=stored):
                        low, high = max(part.start - inside, 0), min(part.end - inside, batch.num_rows)
                        if low < high:
                            rows = batch.slice(low, high - low)
                            own = {PARTITION: pa.array([part.partition] * rows.num_rows, pa.int32()), OFFSET: pa.array(range(inside + low, inside + high), pa.int64())}
                            yield pa.RecordBatch.from_arrays([own[n] if n in own else rows.column(n).cast(target.field(n).type) for n in target.names], schema=target)
                        inside += batch.num_rows
                at += size

    def published(self, token: str) -> set[str]:
        """Which files of an append have their names already."""
        names = (name.removesuffix(".parquet").split("-", 2)[2] for p in self.partitions() for _, _, name in self.segments(p))
        return {n.removeprefix(f"{token}-") for n in names if n.startswith(f"{token}-")}

    def publish(self, messages: list[Written | None], token: str, again: bool = False) -> None:
        """Gives all files of an append their offsets and names, partition by partition, in the order of tasks. With ``again``, those that an earlier try has named are removed."""
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.task) for f in m.files]
        named = self.published(token) if again else set()
        ends: dict[int, int] = {}
        for n, (partition, path, count) in enumerate(files):
            if str(n) in named:
                self.fs.delete_file(path)
                continue
            if partition not in ends:
                there = self.segments(partition)
                ends[partition] = there[-1][1] if there else 0
            first = ends[partition]
            ends[partition] = first + count
            self.fs.move(path, posixpath.join(self.folder(partition), f"{first:019d}-{first + count:019d}-{token}-{n}.parquet"))

    def remove(self, messages: list[Written | None]) -> None:
        for m in messages:
            for _, path, _ in m.files if m else []:
                if self.fs.get_file_info(path).type != pafs.FileType.NotFound:
                    self.fs.delete_file(path)


def _offsets(options, name: str) -> dict[int, int]:
    return {int(p): int(o) for p, o in json.loads(options.get(name, "{}")).items()}


class _Reads:
    def __init__(self, options, schema: StructType):
        self.log, self.columns = Log(options["path"]), schema
        self.starts, self.stops = _offsets(options, "startingOffsets"), _offsets(options, "endingOffsets")
        self.chosen = json.loads(options["partitions"]) if "partitions" in options else None
        self.most = int(options["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in options else None

    def ends(self) -> dict[int, tuple[int, int]]:
        return {p: e for p, e in self.log.ends().items() if self.chosen is None or p in self.chosen}

    def read(self, partition: Segment | None) -> Iterator[pa.RecordBatch]:
        """None stands for a plan without segments."""
        if partition is not None:
            yield from self.log.read(partition, self.columns)


class Reader(_Reads, DataSourceReader):
    filters: tuple[Filter, ...] = ()

    def partitions(self) -> list[InputPartition]:
        ranges = {p: (self.starts.get(p, first), self.stops.get(p, after)) for p, (first, after) in self.ends().items()}
        for f in self.filters:
            name = getattr(f, "attribute", ())
            if name == (PARTITION,):
                ranges = {p: r for p, r in ranges.items() if _holds(f, p)}
            elif name == (OFFSET,):
                ranges = {p: _within(f, *r) for p, r in ranges.items()}
        return self.log.plan(ranges)


class FilteredReader(Reader):
    """For sessions that push filters down, which is an error elsewhere."""

    def pushFilters(self, filters: list[Filter]):
        """Remembers the filters, which leave out files and cut ranges; Spark still applies them to the rows."""
        self.filters = tuple(filters)
        yield from filters


def _holds(f: Filter, value: int) -> bool:
    test = {EqualTo: lambda x: value == x, In: lambda x: value in x, GreaterThan: lambda x: value > x, GreaterThanOrEqual: lambda x: value >= x, LessThan: lambda x: value < x, LessThanOrEqual: lambda x: value <= x}
    return test[type(f)](f.value) if type(f) in test else True


def _within(f: Filter, start: int, end: int) -> tuple[int, int]:
    if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
        start = max(start, f.value + isinstance(f, GreaterThan))
    if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
        end = min(end, f.value + (not isinstance(f, LessThan)))
    return start, end


class StreamReader(_Reads, DataSourceStreamReader):
    """Offsets of a stream are JSON of partition to next offset. A partition that appears later begins at its first offset."""

    def __init__(self, options, schema: StructType):
        super().__init__(options, schema)
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {str(p): max(first, self.starts.get(p, first)) for p, (first, _) in self.ends().items()}
        return self.at

    def latestOffset(self) -> dict:
        """Where the next micro-batch ends. A reader that hasn't been told where it is yet is at the beginning."""
        ends = self.ends()
        if self.most is None:
            return {str(p): after for p, (_, after) in ends.items()}
        at = self.initialOffset() if self.at is None else self.at
        begin = {p: at.get(str(p), first) for p, (first, _) in ends.items()}
        return {str(p): max(begin[p], min(after, begin[p] + self.most)) for p, (_, after) in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Also asked with the last offset of a query that starts again, which is how admission knows where that is."""
        self.at = end
        first = {p: e[0] for p, e in self.ends().items()}
        return self.log.plan({int(p): (start.get(p, first.get(int(p), 0)), to) for p, to in end.items()})


class _Writes:
    def __init__(self, options, schema: StructType):
        if PARTITION not in schema.names:
            raise ValueError(f"a topic's records have {PARTITION}")
        self.log, self.most = Log(options["path"]), int(options.get("maxRecordsPerFile", MOST_PER_FILE))
        self.stored = StructType([f for f in schema.fields if f.name not in (PARTITION, OFFSET)])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each run of rows of one partition goes to the file that is open for it; rows sorted by partition keep one file open."""
        target, done = to_arrow_schema(self.stored), []
        open_: tuple[int, str, pq.ParquetWriter] | None = None
        count = 0

        def close() -> None:
            if open_:
                open_[2].close()
                done.append((open_[0], open_[1], count))

        for batch in iterator:
            at, dealt = 0, batch.column(batch.schema.get_field_index(PARTITION)).to_pylist()
            rows = batch.select(target.names).cast(target) if target.names else None
            while at < len(dealt):
                if dealt[at] is None:
                    raise ValueError(f"a record has no {PARTITION}")
                to = at + 1
                while to < len(dealt) and dealt[to] == dealt[at]:
                    to += 1
                while at < to:
                    if not open_ or open_[0] != dealt[at] or count >= self.most:
                        close()
                        self.log.fs.create_dir(self.log.folder(dealt[at]))
                        path = posixpath.join(self.log.folder(dealt[at]), f".{uuid.uuid4().hex}.parquet")
                        open_, count = (dealt[at], path, pq.ParquetWriter(path, target, filesystem=self.log.fs, compression="zstd")), 0
                    n = min(to - at, self.most - count)
                    open_[2].write_batch(rows.slice(at, n))
                    at, count = at + n, count + n
        close()
        return Written(TaskContext.get().partitionId(), done)


class Writer(_Writes, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.log.fix_schema(self.stored)
        self.log.publish(messages, uuid.uuid4().hex)

    def abort(self, messages: list[Written | None]) -> None:
        self.log.remove(messages)


class StreamWriter(_Writes, DataSourceStreamArrowWriter):
    """``queryName`` in the options tells apart the streams that append to one topic; a micro-batch is appended once."""

    def __init__(self, options, schema: StructType):
        super().__init__(options, schema)
        self.name = options.get("queryName", "stream")

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.log.fix_schema(self.stored)
        self.log.publish(messages, f"{self.name}.{batchId}", again=True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.log.remove(messages)


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> StructType:
        stored = Log(self.options["path"]).schema()
        if stored is None:
            raise ValueError(f"there is no topic at {self.options['path']}")
        return StructType([*stored.fields, StructField(PARTITION, IntegerType()), StructField(OFFSET, LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredReader if self.options.get("filters") == "true" else Reader)(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a topic is only appended to")
        return Writer(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return StreamWriter(self.options, schema)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TopicLog)
    return spark


def read_log(spark: SparkSession, path: str, **options) -> DataFrame:
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return _registered(spark).read.format("topic").option("path", path).option("filters", pushed).options(**options).load()


def stream_log(spark: SparkSession, path: str, **options) -> DataFrame:
    return _registered(spark).readStream.format("topic").option("path", path).options(**options).load()


def append_log(records: DataFrame, path: str, *order: str, **options) -> None:
    """Appends records; with ``order``, each partition in that order, from as many tasks as a range sort deals them to."""
    _registered(records.sparkSession)
    rows = records.repartitionByRange(PARTITION, *order).sortWithinPartitions(PARTITION, *order) if order else records
    rows.write.format("topic").option("path", path).options(**options).mode("append").save()
