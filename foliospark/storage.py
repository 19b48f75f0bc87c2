"""The shared folder for intermediate tables: what every executor and the driver can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import StorageError

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise StorageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="foliospark-"))


#: Spark 4.1 and later: a query's shuffle files go when it ends, not when the driver's heap is next collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Writes in it leave no shuffle files. Only for writes: each is a plan of its own, whereas a frame that is collected twice reads its shuffles again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def stored(df: DataFrame, what: str, spark: SparkSession | None = None) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
