"""Keeps a keyword search index of a growing folder of files up to date.

    python -m jobs.refresh_search_index --documents PATH --output PATH --checkpoint PATH [--config jobs/refresh_search_index.json]

Each run takes the parquet files that came into ``documents`` (a folder, or a pattern of files or folders) since the last one (a file stream with a
checkpoint), tells by content hash which files of the repositories are new or changed, and adds a segment of
the index for these. Every batch of the stream writes only its own partition ``batch=N`` of each table and overwrites it, so
a run that is started again after a failure, or without anything new, leaves the same tables.

Tables below ``output``, all partitioned by batch: ``files`` (a row for each file version taken, with its status),
``docs``, ``postings`` and ``maxima`` (segments of the search index). A batch is in the index once its files are
written, which is done last. ``current_index`` is the index of the last versions, for codeloom.operators.search_index.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import content_hash, within_size
from codeloom.operators.incremental import classify
from codeloom.operators.merge import last_wins
from codeloom.operators.search_index import SearchIndex, count_tokens, write_index
from codeloom.sources.shared import freed, passing
from jobs.common import command_line, load_config, read_or_empty

log = logging.getLogger("refresh_search_index")

DEFAULTS: dict[str, Any] = {"id": "doc_id", "text": "text", "repo": "source", "branch": "main", "metadata": ["lang"], "max_bytes": 5 * 1024 * 1024, "max_files_per_batch": 1000}
FILES = "file_id STRING, repo STRING, content_hash STRING, status STRING, batch BIGINT"
ORDER = "STRUCT<batch BIGINT, file_id STRING>"
SEGMENTS = {
    "docs": f"id STRING, insert_ord {ORDER}, metadata MAP<STRING, STRING>, block BIGINT, n_tokens BIGINT, batch BIGINT",
    "postings": "token STRING, block BIGINT, id STRING, tf BIGINT, batch BIGINT",
    "maxima": "token STRING, block BIGINT, n BIGINT, most BIGINT, batch BIGINT",
}
#: Statuses of versions whose text is in the index.
INDEXED = ("created", "refreshed")


def versions(rows: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(file_id, repo, text, metadata, content_hash) of each file of a batch: the last version by the time, then the name, of the data file.

    A null id makes no file and is left out, as is a row whose repository is null; a null text has no hash.
    """
    repo, text = F.col(config["repo"]).cast("string"), F.col(config["text"])
    known = rows.where(F.col(config["id"]).isNotNull() & F.col(config["repo"]).isNotNull())
    named = F.array(*[F.col(name).cast("string") for name in config["metadata"]]).cast("array<string>")
    # a text is moved once, in the order by which the last version is found
    version = F.struct("_metadata.file_modification_time", "_metadata.file_path", F.coalesce(text, F.lit("")).alias("text"), text.isNotNull().alias("there"), repo.alias("repo"), named.alias("named"))
    file_id = F.concat_ws(":", repo, F.lit(config["branch"]), F.col(config["id"]).cast("string"))
    last = known.select(file_id.alias("file_id"), version.alias("last")).groupBy("file_id").agg(F.max("last").alias("last"))
    keys = [x for i, name in enumerate(config["metadata"]) for x in (F.lit(name), F.get("last.named", F.lit(i)))]
    metadata = F.map_filter(F.create_map(F.lit("repo"), F.col("last.repo"), *keys), lambda k, v: v.isNotNull())
    shaped = last.select("file_id", "last.repo", F.when(F.col("last.there"), F.col("last.text")).alias("text"), metadata.alias("metadata"))
    return shaped.withColumn("content_hash", content_hash(F.encode("text", "UTF-8")))


def last_versions(files: DataFrame) -> DataFrame:
    """Of each file the row of the last batch that changed it."""
    return last_wins(files, ["file_id"], "batch")


def with_status(taken: DataFrame, files: DataFrame, max_bytes: int) -> DataFrame:
    """Adds status: created, refreshed or up_to_date by hash against the stored ``files``; too_large, and removed for a null text.

    What is removed, or has become too large, is not in the index. A null text of a file that is not stored, or is removed, changes nothing.
    """
    stored = last_versions(files)
    marked = classify(taken, stored)
    there = marked.join(stored.select("file_id", F.col("status").alias("before")), "file_id", "left")
    gone = F.col("text").isNull()
    absent = F.coalesce(F.col("before"), F.lit("removed")) == "removed"
    large = ~within_size(F.encode("text", "UTF-8"), max_bytes)
    status = F.when(gone, F.when(absent, "up_to_date").otherwise("removed")).when(F.col("status") == "up_to_date", "up_to_date").when(large, "too_large").otherwise(F.col("status"))
    return there.withColumn("status", status).drop("before")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Take all that is new below ``documents`` and wait until it is indexed; numbers of rows read, files by status, and batches."""
    config = {**DEFAULTS, **(config or {})}
    schema = spark.read.parquet(documents).schema
    columns = dict.fromkeys([config["id"], config["repo"], config["text"], *config["metadata"]])
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(documents)
    counts = {"read": 0, "batches": 0, "created": 0, "refreshed": 0, "up_to_date": 0, "removed": 0, "too_large": 0, "postings": 0}

    def take(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        files = read_or_empty(session, f"{output}/files", FILES).where(F.col("batch") < batch)
        taken = with_status(versions(rows, config), files, config["max_bytes"])
        own = F.struct(F.lit(batch).cast("bigint").alias("batch"), "file_id").alias("insert_ord")
        texts = taken.select("file_id", "repo", "content_hash", "status", "metadata", own, F.when(F.col("status").isin(*INDEXED), F.col("text")).alias("text"))
        # texts go no further than this: what is stored on the way has their tokens, and is deleted with the batch
        with freed(session), passing(count_tokens(texts), "taken-files") as counted:
            segment = write_index(counted.where(F.col("status").isin(*INDEXED)).drop("repo", "content_hash", "status").withColumnRenamed("file_id", "id"), output, {"batch": batch})
            done = counted.where("status <> 'up_to_date'").select("file_id", "repo", "content_hash", "status", F.lit(batch).cast("bigint").alias("batch"))
            done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/files")
            found = {r["status"]: r["n"] for r in counted.groupBy("status").agg(F.count("*").alias("n")).collect()}
            found |= {"read": rows.count(), "postings": segment.postings.count(), "batches": 1}
        for name, n in found.items():
            counts[name] += n
        log.info("batch %d of %s: %s", batch, documents, ", ".join(f"{n} {name}" for name, n in found.items()))

    started = arriving.select(*columns, "_metadata").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    log.info("read %d rows from %s; wrote %d postings of %d files to %s", counts["read"], documents, counts["postings"], counts["created"] + counts["refreshed"], output)
    return counts


def current_files(spark: SparkSession, output: str) -> DataFrame:
    """The last version of each file that was taken, with its status."""
    return last_versions(read_or_empty(spark, f"{output}/files", FILES))


def current_index(spark: SparkSession, output: str) -> SearchIndex:
    """The search index of the last versions. Maxima count older versions too, so they are bounds still."""
    tables = {name: read_or_empty(spark, f"{output}/{name}", schema) for name, schema in SEGMENTS.items()}
    live = current_files(spark, output).where(F.col("status").isin(*INDEXED)).select(F.col("file_id").alias("id"), "batch")
    return SearchIndex(tables["docs"].join(live, ["id", "batch"], "left_semi"), tables["postings"], tables["maxima"])


def main() -> None:
    args = command_line(__doc__.splitlines()[0], "documents", "output", "checkpoint")
    spark = SparkSession.builder.appName("refresh_search_index").getOrCreate()
    try:
        run(spark, args.documents, args.output, args.checkpoint, load_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
