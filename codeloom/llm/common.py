"""What the operators share: the shared folder, lineage cuts, ranks without a single task, connected components."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the setting is unset and all runs on this machine (a local test) a folder of it is used instead.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(set_to)
    if "://" not in set_to:  # a path on the cluster's own file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(set_to)
        whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        set_to = whole if "://" in whole else whole.replace(":/", ":///", 1)
    return set_to.rstrip("/")


#: Spark's setting by which a query deletes its shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []
#: What this thread wrote since the outermost ``cut_whole`` that has not ended; None outside of one.
_inside = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    if getattr(_inside, "paths", None) is not None:
        _inside.paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard_intermediates(spark: SparkSession) -> None:
    """Delete all tables and files that operators of this session wrote to the shared folder.

    Results are read from them lazily, so this comes after the last result is written.
    """
    while _made:
        _delete(spark, _made.pop())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return it read back: its lineage ends there.

    The rows survive the loss of any executor, and are computed once however often they are read.
    The shuffles behind the table are deleted once it is written.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_whole(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``cut`` of what ``build`` returns; the tables that it wrote on the way are deleted, as nothing else reads them."""
    outer, _inside.paths = getattr(_inside, "paths", None), []
    try:
        out = cut(build(), name)
        *gone, kept = _inside.paths
    finally:
        paths, _inside.paths = _inside.paths, outer
        if outer is not None:
            outer.extend(paths)
    for path in gone:
        if path in _made:
            _made.remove(path)
        _delete(spark, path)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives its worker's free memory back when it ends, as workers are used again."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """Column names like the given ones that no taken one equals, whatever its case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def require(df: DataFrame, *columns: str) -> None:
    """A clear error for a table that lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str, weight: Column | None = None) -> DataFrame:
    """Number rows within each group from 0 without gaps, or with ``weight`` sum the weights of the rows before.

    A group is dealt over many salts, so that one that holds a third of all rows is
    no single task: each salt is ranked alone, and starts where the smaller salts end.
    The order within a group is any, but fixed by the rows; equal rows are
    interchangeable. Nulls in a key are a group of their own. Columns of ``df`` may have any
    names; one named ``rank`` is replaced. An empty table gives an empty table.
    """
    spark = df.sparkSession
    salts = max(16, 2 * partitions(spark))
    salt, n, base, inner, *met = fresh([*df.columns, rank], "salt", "n", "base", "inner", *[f"k{i}" for i in range(len(keys) + 1)])
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    one = F.lit(1).cast("long") if weight is None else weight
    by = [*keys, salt]
    totals = salted.groupBy(*by).agg(F.sum(one).alias(n))
    before = Window.partitionBy(*keys).orderBy(salt) if keys else Window.orderBy(salt)  # one row for each salt
    totals = totals.withColumn(base, F.coalesce(F.sum(n).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(m) for m, k in zip(met, by)], base)
    within = Window.partitionBy(*by).orderBy(*order)
    if weight is None:
        place = (F.row_number().over(within) - 1).cast("long")
    else:
        place = F.coalesce(F.sum(one).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = salted.withColumn(inner, place).join(totals, [F.col(k).eqNullSafe(F.col(m)) for m, k in zip(met, by)])
    return joined.withColumn(rank, F.col(base) + F.col(inner)).select(*dict.fromkeys([*df.columns, rank]))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), component being the least node reachable.

    Alternates large-star and small-star steps over the edge table; each step is one
    aggregation and one join, written to the shared folder. Only nodes with an edge
    between different nodes appear; edges may be repeated or given both ways, those with a
    null end are left out, other columns are not read, and without edges there are no rows.
    Nothing but a count of changes reaches the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u meet the least of u's neighbourhood
        large = e.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large-star")
        # small star: u and its lesser neighbours meet the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        checks = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (e, new)]
        e = new
        if checks[0] == checks[1]:
            break
    else:
        raise RuntimeError("components: no fixed point; raise rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
