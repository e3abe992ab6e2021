import random
import re

import pytest

from codeloom.operators import retrieval, search_index, traverse
from codeloom.plans.driver_queries import QUERIES
from pyspark.sql import functions as F

DOCS = "id bigint, text string, metadata map<string, string>, insert_ord bigint"


def both(spark, tmp_path, docs, queries, k=3, filters=None, **more):
    table = spark.createDataFrame(docs, DOCS)
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    found = search_index.search_index(asked, search_index.write_index(table, str(tmp_path / "index")), k, filters, **more)
    assert sorted(map(tuple, found.rows.collect())) == sorted(map(tuple, retrieval.search(asked, table, k, filters).collect()))
    return found


@pytest.mark.parametrize("seed_rows", [1, 40, 10_000])
def test_rows_are_those_of_a_full_search(spark, tmp_path, seed_rows):
    rng = random.Random(seed_rows)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, draw(rng.randrange(40)), {"lang": rng.choice("xy")} if i % 5 else {}, 1000 - i) for i in range(150)]
    queries = [(i, draw(rng.randrange(1, 20))) for i in range(12)]
    for filters in (None, {"lang": "x"}, {"lang": None}):
        both(spark, tmp_path, docs, queries, 4, filters, seed_rows=seed_rows)


def test_odd_documents_and_queries(spark, tmp_path):
    docs = [(1, None, {}, 3), (2, "", {}, 2), (3, "same same", {"a": "b"}, 2), (4, "same", {"a": None}, 1), (5, "same same same", None, 1)]
    both(spark, tmp_path, docs, [(1, "same same"), (2, None), (3, ""), (4, "unknown words"), (5, "SAME other")])
    both(spark, tmp_path, [], [(1, "same")])
    both(spark, tmp_path, docs, [])


def test_far_fewer_postings_are_read(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), F.col("doc_id").alias("insert_ord"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = search_index.write_index(docs, str(tmp_path / "index"))
    all_met = index.postings.join(retrieval.term_frequencies(asked, "query_id").select("token"), "token").count()
    assert search_index.search_index(asked, index, 5, seed_rows=100).postings_read() < 0.7 * all_met


def test_blocks_bound_their_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.create_map().cast("map<string, string>").alias("metadata"), F.col("doc_id").alias("insert_ord"))
    index = search_index.write_index(docs, str(tmp_path / "index"))
    assert index.docs.groupBy("block").count().agg(F.max("count")).first()[0] <= 1 << search_index.BLOCK_BITS
    assert index.docs.count() == docs.count()
    over = index.postings.join(index.maxima, ["token", "block"]).where("tf > most")
    assert over.isEmpty() and index.postings.select("token", "block").distinct().count() == index.maxima.count()


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, t) for a, b, t in pairs], "source_id string, target_id string, rel_type string")


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 20, 10_000])
def test_first_trails_are_the_first_of_all(spark, limit):
    rng = random.Random(limit)
    edges = edges_of(spark, [(rng.choice("abcde"), rng.choice("abcde"), rng.choice(["CALLS", "IMPORTS"])) for _ in range(9)] + [("a", "b", "CALLS")])
    for reverse in (False, True):
        rows = traverse.trails(edges, "a", 4, reverse=reverse).orderBy("d", "path").limit(limit)
        got = traverse.first_trails(edges, "a", 4, limit, reverse=reverse)
        assert sorted((r.d, r.path, r.node, r.seed) for r in got.collect()) == sorted((r.d, r.path, r.node, r.seed) for r in rows.collect())


def test_trails_stop_when_the_limit_is_full(spark):
    """A node that calls 300 others, all of which call 300 more: two levels, no row beyond the limit."""
    edges = edges_of(spark, [("s", f"a{i}", "CALLS") for i in range(300)] + [(f"a{i}", f"b{j}", "CALLS") for i in range(300) for j in range(30)])
    made = []
    assert traverse.first_trails(edges, "s", 10, 320, ("CALLS",), made=made).count() == 320
    assert made == [300, 20]
    made = []
    assert len(traverse.first_trails(edges, "s", 10, 20, ("CALLS",), made=made).collect()) == 20 and made == [20]


def test_no_trails(spark):
    edges = edges_of(spark, [("a", "b", "CALLS"), (None, "a", "CALLS"), ("b", None, "CALLS")])
    assert traverse.first_trails(edges, "z", 3, 5).isEmpty()
    assert [r.path for r in traverse.first_trails(edges, "a", 9, 5, ("CALLS",)).collect() if r.node] == [["a", "b"]]
    assert traverse.first_trails(edges, "a", 9, 5, ("IMPORTS",)).isEmpty()


def test_indexing_reads_each_text_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from codeloom.operators.search_index import read_index, write_index

    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, f"a b{i} c{i % 3} a", {"k": "v"}, i) for i in range(40)], "id bigint, text string, metadata map<string, string>, insert_ord bigint")
    met = docs.withColumn("text", F.udf(read, "string")("text"))
    write_index(met, str(tmp_path / "whole"))
    assert seen.value == 40
    index = read_index(spark, str(tmp_path / "whole"))
    assert index.postings.count() == 120 and index.maxima.where("token = 'a'").agg(F.sum("n"), F.max("most")).first() == (40, 2)
    write_index(docs, str(tmp_path / "parts"), {"batch": 1})
    again = write_index(docs.limit(0), str(tmp_path / "parts"), {"batch": 1})
    assert again.postings.isEmpty() and all(t.isEmpty() for t in (read_index(spark, str(tmp_path / "parts")).docs, read_index(spark, str(tmp_path / "parts")).maxima))


def test_full_search_moves_texts_once(spark, sf_dir):
    """Neither tokens nor scores are dealt out by id again; repeated ids, with and without an order, count as one text with each of their orders."""
    docs = spark.createDataFrame([(1, "a b", {}, 3), (1, "a c", {}, None), (2, "a a b", {}, 1), (2, None, {}, 1), (None, "a b", {}, 0), (3, "z", {}, 2)], DOCS)
    asked = spark.createDataFrame([(7, "a a b"), (8, "none")], "query_id bigint, text string")
    found = retrieval.search(asked, docs, 3)
    assert sorted(map(tuple, found.collect())) == [(7, 1, 1, 3), (7, 2, 2, 3), (7, 3, 1, 3)]
    plan = QUERIES["keyword_search_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((query_id#\d+L?, id|id#\d+L?, insert_ord)", plan)


def test_edges_of_reachability_are_not_made_distinct(spark, monkeypatch):
    seen = {}
    keep = traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name: seen.setdefault(name, df) is None or keep(df, name))
    edges = edges_of(spark, [("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "a", "CALLS"), ("b", "c", "CALLS"), ("c", "d", "OTHER")])
    got = traverse.reachable(edges, spark.createDataFrame([("a",)], "id string"), types=("CALLS",))
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert "Aggregate" not in seen["edges"]._jdf.queryExecution().optimizedPlan().toString()
