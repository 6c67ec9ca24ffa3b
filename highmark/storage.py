"""Tables between the steps of a plan, in the folder that all executors share."""

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_noted: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The shared folders that are named meanwhile."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where that setting is missing, only a local session gets a temporary folder: the executors of a
    cluster wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "highmark-shared")
    return root.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below shared_root()."""
    path = f"{shared_root(spark)}/highmark-{uuid.uuid4().hex}"
    for folders in _noted:
        folders.append(path)
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd", folder: str | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder; later steps and lost tasks read the files."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """df, stored, with a number of its own for each row in `column`, the same however often it is read.

    A row's place in a scan isn't such a number: scans are split by the cores known at the time.
    """
    return keep(df.withColumn(column, F.monotonically_increasing_id()), "numbered")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of steps that have ended; else they stay until the driver happens to collect its garbage.

    What a first collection frees holds more, so there is a second one. Where Spark is slow to remove files, they go a little later.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


class Scratch:
    """Tables that a plan needs only while it is made, in one shared folder, which drop() removes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, shared_dir(spark), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return stored(df, f"{self.n}-{name}", folder=self.folder)

    def drop(self) -> None:
        remove(self.spark, self.folder)
