"""Intermediate tables in the folder that every executor shares.

The folder is ``spark.checkpoint.dir`` of the session; only where it is unset (tests, a laptop) is one
made beside the session's warehouse. Each application has a folder of its own there. A table is deleted
with ``drop_written`` as soon as nothing reads it; what a returned frame still reads stays until
``drop_all``, which a job calls when its results are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch of rows that goes to a worker while a table is written: whole texts are many megabytes by the row count alone.
BATCH = "4m"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH`` at most for what runs inside; the session's own setting holds again after it."""
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a
    lost executor costs its tasks and no more."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def drop_written(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing lazy reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df._written)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables that this application has written on the way; its results have to be stored first."""
    _delete(spark, _folder(spark))
