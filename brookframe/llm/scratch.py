"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a session on this machine alone gets a temporary folder and any other raises: its executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="brookframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files go when the query ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small table by a reliable checkpoint, which Spark cleans when it is unused if spark.cleaner.referenceTracking.cleanCheckpoints is true."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


class Scratch:
    """Parquet tables that live until :meth:`close`; they survive the loss of executors.

    Used as a context manager by operators whose result no longer depends on the tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/brookframe-{uuid.uuid4().hex}", []

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        self.paths.append(path)
        with tidy(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
