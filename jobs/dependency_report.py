"""Reports, for each file of some repositories, what it holds and which files it calls and is called by.

    python -m jobs.dependency_report --tables PATH --output PATH [--config jobs/dependency_report.json]

Call sites name what they call by a symbolic target; many of them between two symbols are one relationship, the
last of which counts. They are resolved against the symbols of all repositories and summed up by file.

The symbols and call sites come from the tables below ``tables``: a nation is a file of its region's repository, customers are
its classes and suppliers its resources, and every line of an order is a call site of the customer, at the
order's date, that names the supplier.

Two tables below ``output``, partitioned by the repository of the calling file: ``files``, a row for each
file, and ``coupling``, a row for each pair of a file and one that it calls; calls of what no symbol is named are
summed up under a null file. A run replaces the partitions of the repositories that it reports and leaves the others, so
running it again gives the same tables. ``repositories`` in the config limits it to some; empty means all.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.merge import last_wins
from codeloom.operators.queries import type_counts
from codeloom.operators.resolve import module_map, resolve_targets
from jobs.common import command_line, load_config, read_or_empty

log = logging.getLogger("dependency_report")

DEFAULTS: dict[str, Any] = {"branch": "main", "repositories": [], "confidence": 0.9}
FILES = "file_id STRING, file_path STRING, classes BIGINT, resources BIGINT, functions BIGINT, calls_out BIGINT, calls_in BIGINT, files_called BIGINT, files_calling BIGINT, calls_unresolved BIGINT, repo STRING"
COUPLING = "file_id STRING, called_file_id STRING, called_repo STRING, calls BIGINT, call_sites BIGINT, confidence DOUBLE, last_seen TIMESTAMP, repo STRING"


def read_symbols(spark: SparkSession, tables: str, branch: str) -> DataFrame:
    """(id, name, type, repo, file_path, file_id, ord): files, and the definitions in them."""
    read = lambda name: spark.read.parquet(f"{tables}/{name}.parquet")
    nation, region = read("nation"), read("region")
    path = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(".py"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("repo"), path.alias("file_path"))
    places = places.withColumn("file_id", F.concat_ws(":", "repo", F.lit(branch), "file_path"))

    def held(table: str, key: str, name: str, number: str, kind: str) -> DataFrame:
        rows = read(table).select(F.col(key).alias("n_nationkey"), F.col(name).alias("name"), F.col(number).cast("bigint").alias("seq")).join(places, "n_nationkey")
        return rows.select(F.concat_ws(":", "file_id", F.coalesce("name", F.lit(""))).alias("id"), "name", F.lit(kind).alias("type"), "repo", "file_path", "file_id", F.struct(F.col("file_path").alias("path"), "seq").alias("ord"))

    files = places.select(F.col("file_id").alias("id"), F.col("file_path").alias("name"), F.lit("file").alias("type"), "repo", "file_path", "file_id", F.struct(F.col("file_path").alias("path"), F.lit(-1).cast("bigint").alias("seq")).alias("ord"))
    return files.union(held("customer", "c_nationkey", "c_name", "c_custkey", "class")).union(held("supplier", "s_nationkey", "s_name", "s_suppkey", "resource"))


def read_call_sites(spark: SparkSession, tables: str, symbols: DataFrame, confidence: float) -> DataFrame:
    """(source_id, target_id, rel_type, confidence, seen, place): a call by a class of what a name stands for."""
    read = lambda name: spark.read.parquet(f"{tables}/{name}.parquet")
    callers = symbols.where("type = 'class'").select(F.col("ord.seq").alias("o_custkey"), F.col("id").alias("source_id"))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(callers, "o_custkey")
    lines = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber").join(orders, "o_orderkey")
    called = F.concat(F.lit("module:Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    place = F.struct("o_orderdate", "o_orderkey", "l_linenumber")
    return lines.select("source_id", called.alias("target_id"), F.lit("CALLS").alias("rel_type"), F.lit(confidence).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("seen"), place.alias("place"))


def merged_calls(sites: DataFrame) -> DataFrame:
    """One relationship for all call sites of a target in a symbol: the last one's figures, and how many there are."""
    last = F.max_by(F.struct("confidence", "seen"), F.struct("place", "confidence")).alias("last")
    return sites.groupBy("source_id", "target_id", "rel_type").agg(last, F.count("*").alias("call_sites")).select("source_id", "target_id", "rel_type", "last.confidence", "last.seen", "call_sites")


def names_of(symbols: DataFrame) -> DataFrame:
    """(key, id): a definition by its own name, the last one counting, and a file by its module."""
    own = last_wins(symbols.where("type <> 'file'").select(F.col("name").alias("key"), "id", "ord"), ["key"], "ord").select("key", "id")
    return own.union(module_map(symbols.where("type = 'file'")).join(own.select("key"), "key", "left_anti"))


def coupling(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, file_id, called_file_id, called_repo, calls, call_sites, confidence, last_seen) from resolved relationships."""
    at = symbols.select(F.col("id").alias("source_id"), "file_id", "repo")
    to = symbols.select(F.col("id").alias("target_id"), F.col("file_id").alias("called_file_id"), F.col("repo").alias("called_repo"))
    met = calls.join(at, "source_id").join(to, "target_id", "left")
    sums = F.count("*").alias("calls"), F.sum("call_sites").alias("call_sites"), F.max("confidence").alias("confidence"), F.max("seen").alias("last_seen")
    return met.groupBy("repo", "file_id", "called_file_id", "called_repo").agg(*sums)


def file_rows(symbols: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each file: what it contains, and the calls of it and by it."""
    files = symbols.where("type = 'file'").select("id", "repo", "file_path")
    contains = symbols.where("id <> file_id").select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("rel_type"))
    held = type_counts(contains, symbols, files)
    found = F.col("called_file_id").isNotNull()
    out = pairs.groupBy(F.col("file_id").alias("id")).agg(F.sum("calls").alias("calls_out"), F.count_if(found).alias("files_called"), F.sum(F.when(~found, F.col("calls"))).alias("calls_unresolved"))
    into = pairs.where(found).groupBy(F.col("called_file_id").alias("id")).agg(F.sum("calls").alias("calls_in"), F.count("*").alias("files_calling"))
    whole = files.join(held, "id").join(out, "id", "left").join(into, "id", "left").na.fill(0)
    return whole.withColumnRenamed("id", "file_id")


def run(spark: SparkSession, tables: str, output: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Write the report below ``output``; numbers of symbols and call sites read and of rows written."""
    config = {**DEFAULTS, **(config or {})}
    symbols = read_symbols(spark, tables, config["branch"])
    sites = read_call_sites(spark, tables, symbols, config["confidence"])
    none = spark.createDataFrame([], "key string, id string")
    calls = resolve_targets(merged_calls(sites), names_of(symbols), none)

    def put(df: DataFrame, name: str) -> None:
        wanted = df.where(F.col("repo").isin(*config["repositories"])) if config["repositories"] else df
        # a file per repository and task; a large repository is split, small ones come together
        wanted.hint("rebalance", "repo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(f"{output}/{name}")

    # a file's callers may lie in repositories that are not reported, so all pairs are summed up, once
    pairs = coupling(calls, symbols).persist()
    try:
        put(pairs, "coupling")
        put(file_rows(symbols, pairs), "files")
        n_sites = pairs.agg(F.coalesce(F.sum("call_sites"), F.lit(0))).first()[0]
    finally:
        pairs.unpersist()
    report = {"symbols": symbols.count(), "call_sites": n_sites, "files": read_files(spark, output).count(), "coupling": read_coupling(spark, output).count()}
    log.info("read %d symbols and %d call sites from %s; %s now has %d files and %d pairs", report["symbols"], report["call_sites"], tables, output, report["files"], report["coupling"])
    return report


def read_files(spark: SparkSession, output: str) -> DataFrame:
    return read_or_empty(spark, f"{output}/files", FILES)


def read_coupling(spark: SparkSession, output: str) -> DataFrame:
    return read_or_empty(spark, f"{output}/coupling", COUPLING)


def main() -> None:
    args = command_line(__doc__.splitlines()[0], "tables", "output")
    spark = SparkSession.builder.appName("dependency_report").getOrCreate()
    try:
        run(spark, args.tables, args.output, load_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
