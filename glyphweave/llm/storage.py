"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is
    unset and Spark runs in one JVM (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The files go when the JVM ends. A lost executor costs at most the tasks
    it was running, since the table lies outside the executors. A ``narrow``
    table (keys and numbers, no texts) gets two files a core at most, whatever
    the number of shuffle partitions that it comes from.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_folder(spark)}/glyphweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a written table that no later plan reads; a session may run for long."""
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 256, size: str = "16m") -> None:
    """Bound the Arrow batches that Python workers get, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(function: Callable) -> Callable:
    """``function`` over Arrow batches; at a task's end the worker gives the
    memory back that it no longer uses, as workers stay for later stages."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
