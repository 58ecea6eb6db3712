"""Streams run until all that has arrived is through, and a folder that all executors share for what they keep."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which only a session on this machine alone can leave unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="brookframe-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def arrived(query: StreamingQuery) -> StreamingQuery:
    """Waits until the query has dealt with all that has arrived, and stops it; what failed it is raised."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
