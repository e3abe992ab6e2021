"""The jobs as queries: each is run twice into one new folder, and what it then holds is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.shared import new_folder
from jobs import dependency_report, refresh_search_index


def job1_refresh_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``documents`` in the search index, with their postings."""
    at = new_folder(spark, "job1")
    documents = f"{sf_dir}/documents.parque[t]"  # one file or a folder: a stream takes a single file by a pattern only
    for _ in range(2):
        refresh_search_index.run(spark, documents, f"{at}/index", f"{at}/checkpoint")
    files = refresh_search_index.current_files(spark, f"{at}/index")
    index = refresh_search_index.current_index(spark, f"{at}/index")
    docs = index.docs.select(F.col("id").alias("file_id"), "batch", "n_tokens", F.element_at("metadata", "lang").alias("lang"))
    postings = index.postings.select(F.col("id").alias("file_id"), "batch", "token", "tf")
    # postings are far more than files: they are moved once, and neither stored in order nor gathered
    held = files.drop("batch").join(docs, "file_id", "left").hint("SHUFFLE_HASH")
    return held.join(postings, ["file_id", "batch"], "left").drop("batch")


JOB1_SQL = """
WITH f AS (SELECT source || ':main:' || doc_id AS file_id, source AS repo, lang, text, strlen(text) > 5242880 AS large FROM documents WHERE text IS NOT NULL),
t AS (SELECT file_id, token, count(*) AS tf FROM (SELECT file_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS token FROM f WHERE NOT large) GROUP BY ALL)
SELECT file_id, repo, sha256(text) AS content_hash, CASE WHEN large THEN 'too_large' ELSE 'created' END AS status, CASE WHEN NOT large THEN lang END AS lang,
  CASE WHEN NOT large THEN coalesce(sum(tf) OVER (PARTITION BY file_id), 0)::BIGINT END AS n_tokens, token, tf FROM f LEFT JOIN t USING (file_id)"""


def job2_dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all repositories, each with the files that it calls."""
    at = new_folder(spark, "job2")
    for _ in range(2):
        dependency_report.run(spark, sf_dir, at)
    return dependency_report.read_files(spark, at).join(dependency_report.read_coupling(spark, at), ["repo", "file_id"], "left")


JOB2_SQL = """
WITH f AS (SELECT n_nationkey, r_name AS repo, lower(replace(n_name, ' ', '_')) || '.py' AS file_path, r_name || ':main:' || lower(replace(n_name, ' ', '_')) || '.py' AS file_id FROM nation JOIN region ON n_regionkey = r_regionkey),
sites AS (SELECT o_custkey, l_suppkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
calls AS (SELECT o_custkey, l_suppkey, count(*) AS call_sites, max(o_orderdate) AS seen FROM sites GROUP BY ALL),
pairs AS (SELECT a.repo, a.file_id, b.file_id AS called_file_id, b.repo AS called_repo, count(*) AS calls, sum(call_sites)::BIGINT AS call_sites, max(CASE WHEN s_suppkey IS NULL THEN 0.5 ELSE 0.95 END)::DOUBLE AS confidence, max(seen)::TIMESTAMP AS last_seen
  FROM calls JOIN customer ON c_custkey = o_custkey JOIN f a ON a.n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN f b ON b.n_nationkey = s_nationkey GROUP BY ALL),
out_ AS (SELECT file_id, sum(calls) AS calls_out, count(called_file_id) AS files_called, sum(CASE WHEN called_file_id IS NULL THEN calls ELSE 0 END) AS lost FROM pairs GROUP BY file_id),
in_ AS (SELECT called_file_id AS file_id, sum(calls) AS calls_in, count(*) AS files_calling FROM pairs WHERE called_file_id IS NOT NULL GROUP BY 1)
SELECT f.repo, f.file_id, file_path, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS classes, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS resources, 0::BIGINT AS functions,
  coalesce(calls_out, 0)::BIGINT AS calls_out, coalesce(calls_in, 0)::BIGINT AS calls_in, coalesce(files_called, 0)::BIGINT AS files_called, coalesce(files_calling, 0)::BIGINT AS files_calling, coalesce(lost, 0)::BIGINT AS calls_unresolved,
  called_file_id, called_repo, calls, call_sites, confidence, last_seen
FROM f LEFT JOIN out_ USING (file_id) LEFT JOIN in_ USING (file_id) LEFT JOIN pairs ON pairs.file_id = f.file_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_refresh_search_index": job1_refresh_search_index, "job2_dependency_report": job2_dependency_report}
ORACLE_SQL = {"job1_refresh_search_index": JOB1_SQL, "job2_dependency_report": JOB2_SQL}
