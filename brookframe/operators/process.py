"""A user's own processor with state, one for each logical partition of a bounded topic."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brookframe.operators.groups import PARTITION


class Processor:
    """Sees the records of one partition in offset order, a batch at a time, and yields any number of batches; ``close`` comes after the last."""

    def process(self, batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        raise NotImplementedError

    def close(self) -> Iterable[pa.RecordBatch]:
        return ()


def process_in_order(df: DataFrame, make: Callable[[int], Processor], schema, order: str = "__offset") -> DataFrame:
    """What the processors yield. ``make`` is given the partition; records without one raise.

    A task goes through its partitions one after another, sorted by offset on the way, and holds one batch and the
    processor's own state. Arrow's batches are cut where a partition begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, processor = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            dealt = batch.column(batch.schema.get_field_index(PARTITION))
            if dealt.null_count:
                raise ValueError(f"a record has no {PARTITION}")
            dealt = dealt.to_numpy()
            starts = [0, *(np.flatnonzero(dealt[1:] != dealt[:-1]) + 1).tolist(), len(dealt)]
            for a, b in zip(starts, starts[1:]):
                if processor is None or dealt[a] != partition:
                    if processor:
                        yield from processor.close()
                    partition = int(dealt[a])
                    processor = make(partition)
                yield from processor.process(batch.slice(a, b - a))
        if processor:
            yield from processor.close()

    return df.repartition(PARTITION).sortWithinPartitions(PARTITION, order).mapInArrow(run, schema)
