"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set (tests), a local one.

    A local folder is only right when driver and executors are one process,
    so any other master without a setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tickforge-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Paths written since the innermost ``written`` began, if any.
_open: list[list[str]] = []


@contextlib.contextmanager
def written() -> Iterator[list[str]]:
    """Collects the paths of the tables that are written inside, for ``remove``."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no DataFrame will be read from any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


#: Whether Spark deletes a query's shuffle files when it ends, rather than when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it has ended; the setting of before holds again afterwards."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and outlives executors; nothing reads the shuffles of the write again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote for tables that nothing will read any more."""
    for table in tables:
        remove(table.sparkSession, [table._written_path])
