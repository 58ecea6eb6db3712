"""A user's own processor with one state per logical partition, over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from brookframe.operators.groups import PARTITION


def process_by_partition(stream: DataFrame, step: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame | None]], output: str, state: str) -> DataFrame:
    """Feeds each micro-batch of a partition to ``step`` with the partition's state (None at first).

    ``step(state, rows)`` returns the new state, a tuple as the ``state`` schema says, and the rows to emit or None.
    Rows come in Arrow batches, in no particular order; Spark keeps the state in its checkpoint.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        now = kept.get if kept.exists else None
        for rows in batches:
            now, out = step(now, rows)
            if out is not None:
                yield out
        if now is not None:
            kept.update(now)

    return stream.groupBy(PARTITION).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)
