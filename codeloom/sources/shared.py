"""The folder that the driver and all executors share, and tables written there to end a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs on this machine, a folder of it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Spark's setting by which a query deletes its shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for how much of its files a task reads.
READ_BYTES = "spark.sql.files.maxPartitionBytes"
_written: list[str] = []


@contextmanager
def _set(spark: SparkSession, key: str, value: str, *default: str) -> Iterator[None]:
    before = spark.conf.get(key, *default)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, the shuffles behind a written table are deleted once it is written."""
    return _set(spark, FREE_SHUFFLES, "true", "false")


def read_in_parts(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Within it, a task reads so many bytes of stored tables at most, as far as their row groups allow."""
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(READ_BYTES))
    return _set(spark, READ_BYTES, str(min(size, most)))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """The table, written to the shared folder (or to a path in it) and read back: computed once, safe from lost executors."""
    path = path or new_folder(df.sparkSession, name)
    _written.append(path)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str, row_group: int | None = None) -> Iterator[DataFrame]:
    """``written``, as small as it gets, and deleted at the end: what is made from the table has to be stored by then."""
    path = new_folder(df.sparkSession, name)
    try:
        yield written(df, name, path, {"compression": "zstd"} | ({"parquet.block.size": str(row_group)} if row_group else {}))
    finally:
        if path in _written:
            _written.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made in this session; results are read from them lazily, so do it once the last is stored."""
    while _written:
        _delete(spark, _written.pop())
