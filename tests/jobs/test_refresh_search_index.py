import json
from pathlib import Path

import pytest

from codeloom.operators import retrieval, search_index
from codeloom.sources.shared import shared_folder
from jobs import common, refresh_search_index as job
from jobs.registered import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def paths(tmp_path):
    return {"documents": str(tmp_path / "documents"), "output": str(tmp_path / "index"), "checkpoint": str(tmp_path / "checkpoint")}


def arrive(spark, paths, rows):
    """One more data file."""
    spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(paths["documents"])


def held(spark, paths):
    """(file, token, tf) in force."""
    index = job.current_index(spark, paths["output"])
    met = index.postings.join(index.docs.select("id", "block"), ["id", "block"])
    return {tuple(r) for r in met.select("id", "token", "tf").collect()}


def statuses(spark, paths):
    return {r.file_id: r.status for r in job.current_files(spark, paths["output"]).collect()}


def everything(spark, paths):
    return {name: sorted(map(repr, spark.read.parquet(f"{paths['output']}/{name}").collect())) for name in ("files", *job.SEGMENTS)}


FIRST = [(1, "def run run", "en", "a"), (2, "import os", "en", "a"), (3, None, "en", "a"), (None, "lost", "en", "a"), (4, "lost too", "en", None), (1, "other repository", None, "b"), (5, "", "de", "b")]
SECOND = [(1, "def stop", "en", "a"), (2, "import os", "en", "a"), (6, "new file", "en", "a"), (6, "new file", "en", "a"), (5, None, "de", "b")]


def test_two_runs_over_growing_input(spark, paths):
    arrive(spark, paths, FIRST)
    found = job.run(spark, **paths)
    assert {k: found[k] for k in ("read", "created", "refreshed", "up_to_date", "batches")} == {"read": 7, "created": 4, "refreshed": 0, "up_to_date": 1, "batches": 1}
    assert held(spark, paths) == {("a:main:1", "def", 1), ("a:main:1", "run", 2), ("a:main:2", "import", 1), ("a:main:2", "os", 1), ("b:main:1", "other", 1), ("b:main:1", "repository", 1)}
    before = everything(spark, paths)

    arrive(spark, paths, SECOND)
    found = job.run(spark, **paths)
    assert {k: v for k, v in found.items() if v} == {"read": 5, "batches": 1, "created": 1, "refreshed": 1, "up_to_date": 1, "removed": 1, "postings": 4}
    assert held(spark, paths) == {("a:main:1", "def", 1), ("a:main:1", "stop", 1), ("a:main:2", "import", 1), ("a:main:2", "os", 1), ("a:main:6", "new", 1), ("a:main:6", "file", 1), ("b:main:1", "other", 1), ("b:main:1", "repository", 1)}
    assert statuses(spark, paths) == {"a:main:1": "refreshed", "a:main:2": "created", "a:main:6": "created", "b:main:1": "created", "b:main:5": "removed"}
    after = everything(spark, paths)
    assert all(set(before[name]) <= set(after[name]) for name in before), "what the first run wrote stays"

    assert not any(job.run(spark, **paths).values()), "nothing new"
    assert everything(spark, paths) == after

    arrive(spark, paths, [(5, "back again", "de", "b")])
    job.run(spark, **paths)
    assert statuses(spark, paths)["b:main:5"] == "refreshed" and ("b:main:5", "again", 1) in held(spark, paths)


def test_a_batch_that_is_run_again_changes_nothing(spark, paths, tmp_path):
    arrive(spark, paths, FIRST)
    job.run(spark, **paths)
    arrive(spark, paths, SECOND)
    job.run(spark, **paths)
    after = everything(spark, paths)
    for name in ("1", ".1.crc"):  # as if the run had failed before it noted that batch 1 was done
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    assert job.run(spark, **paths)["batches"] == 1
    assert everything(spark, paths) == after


def test_a_run_that_fails_before_its_end_is_made_good(spark, paths, monkeypatch):
    arrive(spark, paths, FIRST)
    whole = {**paths, "output": paths["output"] + "-whole", "checkpoint": paths["checkpoint"] + "-whole"}
    job.run(spark, **whole)

    def fail(*args):
        write(*args)
        raise RuntimeError("lost")

    write = job.write_index
    monkeypatch.setattr(job, "write_index", fail)
    with pytest.raises(Exception):
        job.run(spark, **paths)
    assert not held(spark, paths), "a batch without its files is not in the index"
    monkeypatch.undo()
    job.run(spark, **paths)
    assert everything(spark, paths) == everything(spark, whole)


def test_batches_of_few_files_give_the_same_index(spark, paths):
    for rows in (FIRST, SECOND, [(7, "last", "en", "a")]):
        arrive(spark, paths, rows)
    one = {**paths, "output": paths["output"] + "-one", "checkpoint": paths["checkpoint"] + "-one"}
    assert job.run(spark, **paths)["batches"] == 1
    assert job.run(spark, **one, config={"max_files_per_batch": 1})["batches"] >= 3
    assert held(spark, paths) == held(spark, one)


def test_large_files_are_left_out(spark, paths):
    arrive(spark, paths, [(1, "a" * 50, "en", "a"), (2, "b c", "en", "a")])
    job.run(spark, **paths, config={"max_bytes": 20})
    assert statuses(spark, paths) == {"a:main:1": "too_large", "a:main:2": "created"}
    assert {r[0] for r in held(spark, paths)} == {"a:main:2"}
    arrive(spark, paths, [(2, "b " * 30, "en", "a")])
    job.run(spark, **paths, config={"max_bytes": 20})
    assert not held(spark, paths)


def test_search_over_segments_is_search_over_the_last_versions(spark, paths, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.where("doc_id % 3 <> 0").write.parquet(paths["documents"])
    job.run(spark, **paths)
    changed = docs.where("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" changed the words"))).union(docs.where("doc_id % 3 = 0 and doc_id % 4 <> 0"))
    changed.write.mode("append").parquet(paths["documents"])
    job.run(spark, **paths)
    index = job.current_index(spark, paths["output"])
    now = docs.where("doc_id % 4 <> 0").union(docs.where("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" changed the words"))))
    id_ = F.concat_ws(":", "source", F.lit("main"), "doc_id")
    plain = now.select(id_.alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata")).join(index.docs.select("id", "insert_ord"), "id")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    for filters in (None, {"lang": "fr"}):
        got = search_index.search_index(asked, index, 5, filters).rows
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.search(asked, plain, 5, filters).collect()))


def test_config(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"repo": "lang"}))
    assert common.load_config(spark, str(file), job.DEFAULTS)["repo"] == "lang"
    file.write_text(json.dumps({"nothing": 1}))
    with pytest.raises(ValueError):
        common.load_config(spark, str(file), job.DEFAULTS)
    assert common.load_config(spark, "jobs/refresh_search_index.json", job.DEFAULTS) == job.DEFAULTS


def test_query_matches_sql(against_sql):
    against_sql(QUERIES["job1_refresh_search_index"], ORACLE_SQL["job1_refresh_search_index"])


def test_the_way_into_the_index_takes_little_disk(spark, paths, sf_dir, monkeypatch):
    """Texts are shuffled once and postings not at all; what a batch stores besides the index is gone when it ends, also when it fails."""
    documents = Path(sf_dir) / "documents.parquet"

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    shared = Path(shared_folder(spark).removeprefix("file://"))
    left, began = set(shared.iterdir()), moved()
    job.run(spark, f"{sf_dir}/documents.parque[t]", paths["output"], paths["checkpoint"])
    assert moved() - began < 4.5 * documents.stat().st_size
    assert set(shared.iterdir()) == left and not spark.sparkContext._jsc.getPersistentRDDs()
    monkeypatch.setattr(job, "write_index", lambda docs, *rest: docs.count() and 1 / 0)
    with pytest.raises(Exception):
        job.run(spark, f"{sf_dir}/documents.parque[t]", paths["output"] + "-lost", paths["checkpoint"] + "-lost")
    assert set(shared.iterdir()) == left


def test_tokens_are_counted_row_by_row(spark):
    texts = [None, "", "  !", "a", "b A b_1 b", "x" * 300 + " x1 1x", "Ünï \u212aelvin \u0130s 漢a", "same " * 50, "z y z y x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    counted = search_index.count_tokens(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    tf = {}
    for i, token, n in retrieval.term_frequencies(docs).collect():
        tf.setdefault(i, {})[token] = n
    for r in counted.collect():
        held = tf.get(r.id, {})
        assert dict(zip(r.tokens.split(), r.tfs, strict=True)) == held and r.tokens.split() == sorted(held)
        assert (r.n_tokens, r.n_distinct) == (sum(held.values()), len(held))
        assert r.kind == max(held, key=lambda t: (held[t], t), default=None)
