"""Shared helpers of the training-data operators: scratch tables and inputs."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: list[tuple[SparkSession, str]] = []
#: What a Python worker remembers between tasks of one operator: how to drop it, by name.
FORGET: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data folder, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir; a machine-local one is made
    only where that setting is missing and everything runs in one process
    (tests, local mode). On a cluster without the setting this is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage like checkpoint() does, but later readers decode only
    the columns that they need. The files outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that go to a Python worker at once.
ROWS = 2048


def release() -> None:
    """Give what a worker has freed back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own pages
        pass


def forget(keeps: str = "") -> None:
    """Drop all caches of this process but the one named `keeps`.

    A function of the module, as a nested one is sent to workers with a copy
    of the driver's FORGET instead of the worker's own.
    """
    others = [k for k in FORGET if k != keeps]
    for name in others:
        FORGET.pop(name)()
    if others:
        release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work for mapInArrow, with memory handed back before and after; only the cache named `keeps` stays.

    Batches are small where the session names no size: whole texts are wide rows.
    """
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ROWS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return work


def plain(name: str) -> Column:
    """A top-level column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


@atexit.register
def _clean() -> None:
    for spark, path in _LEFT:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; nothing is left to ask
            return
