"""Keyword retrieval: documents as multisets of identifiers, scored by what a query shares with them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import tokenize


def term_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, token, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokenize(F.col(text_col))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def keyword_scores(queries: DataFrame, docs_tf: DataFrame, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score): the size of the multisets' intersection, where it is above 0.

    Queries' tokens meet the documents' by token; a document's parts are summed before and
    after the shuffle.
    """
    q = term_frequencies(queries.select(F.col(query_id).alias("id"), F.col(text_col).alias("text"))).select(F.col("id").alias("query_id"), "token", F.col("tf").alias("qn"))
    return docs_tf.join(q, "token").groupBy("query_id", "id").agg(F.sum(F.least("tf", "qn")).alias("score"))


def search(queries: DataFrame, docs: DataFrame, top_k: int = 5, filters: dict[str, str | None] | None = None) -> DataFrame:
    """(query_id, rank, id, score): the best documents of each query, ties in order of insertion.

    ``docs`` has (id, text, metadata map, insert_ord). A filter is an equality with the
    metadata; a missing key equals None only.
    """
    for key, value in (filters or {}).items():
        docs = docs.where(F.element_at("metadata", key).eqNullSafe(F.lit(value)))
    # texts are dealt out by id once: tokens, scores and the best of each task are found where a text lies, and only these are moved
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.where("id is not null").select("id", "text", F.struct("insert_ord").alias("ord")).repartition(n, "id")
    dealt = dealt.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"), F.collect_set("ord").alias("ords"))
    whole = dealt.select("id", F.explode("ords.insert_ord").alias("insert_ord"), "text")
    tokens = whole.select("id", "insert_ord", F.explode(tokenize(F.col("text"))).alias("token"))
    tf = tokens.groupBy("id", "insert_ord", "token").agg(F.count("*").alias("tf"))
    q = term_frequencies(queries.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "token", F.col("tf").alias("qn"))
    scored = tf.join(q, "token").groupBy("query_id", "id", "insert_ord").agg(F.sum(F.least("tf", "qn")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "insert_ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


class VectorStore(Protocol):
    def add_document(self, id: str, text: str, metadata: dict[str, str] | None = None) -> None: ...

    def search(self, query: str, top_k: int = 5, filters: dict[str, str | None] | None = None) -> list[dict]: ...

    def close(self) -> None: ...


class MemoryStore:
    """Documents added one at a time; the last text of an id scores for all of its documents."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def add_document(self, id: str, text: str, metadata: dict[str, str] | None = None) -> None:
        self.rows.append((id, text, metadata or {}, len(self.rows)))

    def search(self, query: str, top_k: int = 5, filters: dict[str, str | None] | None = None) -> list[dict]:
        if not self.rows:
            return []
        docs = self.spark.createDataFrame(self.rows, "id string, text string, metadata map<string, string>, insert_ord bigint")
        latest = docs.groupBy("id").agg(F.max_by("text", "insert_ord").alias("scored"))
        kept = docs
        for key, value in (filters or {}).items():
            kept = kept.where(F.element_at("metadata", key).eqNullSafe(F.lit(value)))
        asked = self.spark.createDataFrame([(0, query)], "query_id bigint, text string")
        scores = keyword_scores(asked, term_frequencies(latest, "id", "scored"))
        best = kept.join(scores, "id").orderBy(F.desc("score"), "insert_ord").limit(top_k)
        return [r.asDict() for r in best.select("id", "text", "metadata", "score").collect()]

    def close(self) -> None:
        self.rows.clear()


class EmptyStore:
    """A backend that is not there: it takes documents and finds nothing."""

    def __init__(self, spark: SparkSession | None = None):
        pass

    def add_document(self, id: str, text: str, metadata: dict[str, str] | None = None) -> None: ...

    def search(self, query: str, top_k: int = 5, filters: dict[str, str | None] | None = None) -> list[dict]:
        return []

    def close(self) -> None: ...


STORES = {"memory": MemoryStore, "qdrant": EmptyStore}


def get_store(name: str, spark: SparkSession) -> VectorStore:
    if name not in STORES:
        raise ValueError(f"unknown store {name}")
    return STORES[name](spark)
