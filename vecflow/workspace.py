"""Work folders that every executor can reach, and tables kept there.

The folder is the one the cluster names in spark.checkpoint.dir. Only a local master may do without;
anywhere else a missing setting is an error, as a folder of one machine would lose the others' rows.
Whatever is written is removed when the driver's JVM ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


#: Partitions for each core where rows are dealt anew.
PARTS = 4


def workdir(spark: SparkSession, name: str) -> str:
    """A new folder address (not yet created) below the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/vecflow"
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}"
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    uri = workdir(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key to PARTS partitions for each core, however few and uneven the pieces are in which their
    files can be read: for work that takes far longer than to move a row."""
    return rows.repartition(PARTS * rows.sparkSession.sparkContext.defaultParallelism, key)


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """pyarrow's file system for an address, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def parquet_files(uri: str) -> list[str]:
    """The data files of a Parquet folder, in order; none if there is no such folder."""
    from pyarrow import fs

    system, path = file_system(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.endswith(".parquet"))


def parquet_batches(uri: str, rows: int, columns: list[str] | None = None):
    """The rows of a Parquet folder in record batches of at most so many rows, one at a time; all columns, or
    those named."""
    system, _ = file_system(uri)
    for path in parquet_files(uri):
        with system.open_input_file(path) as f:
            yield from (pa.Table.from_batches([b]) for b in pq.ParquetFile(f).iter_batches(rows, columns=columns))
