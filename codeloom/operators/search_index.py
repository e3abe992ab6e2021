"""Keyword search over a stored index, reading only the postings that can still matter.

The score of a document is the size of the intersection of its multiset of tokens with the
query's. Documents lie in blocks of similar ones, and the index knows for each token and block
the greatest frequency in it. A search makes each query a threshold, the k-th best score
among documents that hold its rarest tokens. Tokens too common to reach the threshold
together bring up no document by themselves, so their lists, by far the longest, are not gone through;
a document found by the other tokens is completed only where its block's maxima allow it to
reach the threshold. The rows are those of a search over all postings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import freed, passing, read_in_parts, written
from .retrieval import term_frequencies

#: A block has 2 to this power documents at most.
BLOCK_BITS = 4
#: Bits of a block's number below that of its segment.
SEGMENT_BIT = 42
#: Bytes of a token of ``tokenize``, others as spaces.
_SPACED = bytes(c if re.fullmatch(r"[a-z0-9_]", chr(c)) else 32 for c in range(256))
#: Bytes of stored documents whose postings are sorted by one task.
PART = 4 << 20


@dataclass
class SearchIndex:
    """docs (id, insert_ord, metadata, block, n_tokens), postings (token, block, id, tf), maxima (token, block, n, most)."""

    docs: DataFrame
    postings: DataFrame
    maxima: DataFrame


TABLES = ("docs", "postings", "maxima")


def _counted(lowered: pa.Array) -> pa.Array:
    """Of texts in lower case, as bytes: tokens are ASCII, and a byte of another character is none of theirs."""
    tokens, starts, tfs, sizes, kinds = [], [0], [], [], []
    for text in lowered:
        found = Counter((text.as_py() or b"").translate(_SPACED).split())
        ordered = sorted(found)
        if ordered and ordered[0] < b":":  # a token starts behind the digits of its word
            for word in ordered[: bisect_left(ordered, b":")]:
                found[word.lstrip(b"0123456789")] += found.pop(word)
            found.pop(b"", None)
            ordered = sorted(found)
        counts = list(map(found.__getitem__, ordered))
        tokens.append(b" ".join(ordered))
        tfs += counts
        starts.append(len(tfs))
        sizes.append(sum(counts))
        kinds.append(ordered[-1 - counts[::-1].index(max(counts))] if counts else None)
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tfs, pa.int32()))
    columns = {
        "tokens": pa.array(tokens, pa.binary()).cast(pa.string()), "tfs": lists, "n_tokens": pa.array(sizes, pa.int64()),
        "n_distinct": pa.array([b - a for a, b in pairwise(starts)], pa.int64()), "kind": pa.array(kinds, pa.binary()).cast(pa.string()),
    }
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def count_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with what the index needs of the text in its place, each row by itself, so nothing is shuffled.

    ``tokens`` has the distinct tokens in order, joined by spaces, which no token holds, and ``tfs`` their frequencies: about the size of the
    text, where a row for each token would be many times that. Then come n_tokens, n_distinct and ``kind``, the most frequent token (of several, the last). A null text has no tokens.
    """
    counted = F.arrow_udf(_counted, "tokens string, tfs array<int>, n_tokens bigint, n_distinct bigint, kind string")
    return docs.withColumn("_counted", counted(F.lower("text").cast("binary"))).drop("text").select("*", "_counted.*").drop("_counted")


def write_index(docs: DataFrame, path: str, partition: dict[str, int] | None = None) -> SearchIndex:
    """Index docs (id, text, metadata map, insert_ord), ids distinct, into three tables below ``path``.

    Instead of a text there may be what ``count_tokens`` makes of it, in a table that is stored, as it is read twice.
    With ``partition`` this is a segment: the tables are partitioned by one more column, given with its number, and only
    that partition is replaced. Segments may hold versions of one id; ``docs`` then has to be narrowed
    to those in force before a search. A null text has no tokens. Blocks follow the most frequent token, so texts of one language or
    kind come together, then the number of distinct tokens. Postings lie by documents, in order of tokens within a file.
    """
    spark = docs.sparkSession
    column, value = next(iter(partition.items())) if partition else (None, None)

    def put(table: DataFrame, name: str) -> DataFrame:
        # a segment is written to its own folder: one left by a failed run is replaced also where nothing is written now
        at = f"{path}/{name}" if column is None else f"{path}/{name}/{column}={value}"
        table.write.mode("overwrite").parquet(at)
        return spark.read.schema(table.schema).parquet(at)

    # a document stays one row until its postings are written, by the task that reads it; only rows of documents and of maxima are shuffled
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.lit((value or 0) << SEGMENT_BIT).cast("bigint") + F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    with freed(spark), ExitStack() as held:
        counted = docs if "tokens" in docs.columns else held.enter_context(passing(count_tokens(docs), "counted-tokens"))  # ranges are found from a sample, so it is read twice
        ordered = counted.repartitionByRange(n, "kind", "n_distinct", "id").sortWithinPartitions("kind", "n_distinct", "id")
        placed = held.enter_context(passing(ordered.select("id", "insert_ord", "metadata", block.alias("block"), "n_tokens", "tokens", "tfs"), "placed-documents", PART))
        listed = put(placed.select("id", "insert_ord", "metadata", "block", "n_tokens"), "docs")
        each = placed.where("n_tokens > 0").select("id", "block", "tfs", F.posexplode(F.split("tokens", " ")).alias("at", "token"))
        each = each.select("token", "block", "id", F.get("tfs", "at").cast("bigint").alias("tf"))
        # documents lie by their size, so tasks get equal bytes of them; they lie in order of blocks, which a sort by token keeps
        with read_in_parts(spark, PART):
            postings = put(each.sortWithinPartitions("token"), "postings")
        maxima = put(postings.groupBy("token", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most")), "maxima")
    return SearchIndex(listed, postings, maxima)


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each query by score, then by order of insertion.

    Partial results are cut to k on a salt first, so a query that meets a third of all documents is no single task.
    """
    order = (F.desc("score"), "insert_ord", "id")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (("query_id", "salt"), ("query_id",)):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return salted.drop("salt")


@dataclass
class Search:
    """The rows found, and the tables of postings that were gone through for the thresholds, for candidates and to complete them."""

    rows: DataFrame
    seeds: DataFrame
    candidates: DataFrame
    completed: DataFrame

    def postings_read(self) -> int:
        return sum(t.count() for t in (self.seeds, self.candidates, self.completed))


def search_index(queries: DataFrame, index: SearchIndex, top_k: int = 5, filters: dict[str, str | None] | None = None, seed_rows: int = 2000) -> Search:
    """(query_id, rank, id, score) for queries (query_id, text), query ids distinct: the best documents, ties in order of insertion.

    A filter is an equality with the metadata; a missing key equals None only. Without documents or
    queries there are no rows; a query none of whose tokens is known finds nothing. ``seed_rows`` is
    how many postings of a query's rarest tokens, by whole lists, make its threshold; it changes the work, not the rows.
    """
    docs = index.docs
    for key, value in (filters or {}).items():
        docs = docs.where(F.element_at("metadata", key).eqNullSafe(F.lit(value)))
    allowed = docs.select("id", "block", "insert_ord")
    q = term_frequencies(queries.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "token", F.col("tf").alias("qn"))
    stats = index.maxima.groupBy("token").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    rarer = Window.partitionBy("query_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    asked = q.join(stats, "token").withColumn("rarer", F.coalesce(F.sum("df").over(rarer), F.lit(0))).withColumn("gain", F.least("qn", "most"))
    asked = written(asked, "asked-tokens")

    def scored(met: DataFrame) -> DataFrame:
        return met.groupBy("query_id", "id", "block").agg(F.sum(F.least("tf", "qn")).alias("score"))

    # thresholds: the k-th best of what the rarest lists give, a lower bound of the k-th best score
    seeds = written(index.postings.join(asked.where(F.col("rarer") < seed_rows).select("query_id", "token", "qn"), "token"), "seed-postings")
    few = _best(scored(seeds).join(allowed, ["id", "block"]), top_k)
    whole = few.select("query_id", "id", "block").join(asked.select("query_id", "token", "qn"), "query_id").join(index.postings, ["token", "block", "id"])
    marks = scored(whole).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("mark")).where(F.col("n") == top_k)
    asked = asked.join(marks.select("query_id", "mark"), "query_id", "left").fillna(0, ["mark"])

    # the commonest tokens that together stay below the threshold bring up no document
    common = Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    asked = written(asked.withColumn("brings", F.sum("gain").over(common) >= F.col("mark")), "asked-tokens")
    bringing, rest = asked.where("brings"), asked.where("not brings").select("query_id", "token", "qn")
    candidates = written(index.postings.join(bringing.select("query_id", "token", "qn", "mark"), "token"), "candidates")
    partial = candidates.groupBy("query_id", "id", "block", "mark").agg(F.sum(F.least("tf", "qn")).alias("part")).join(allowed, ["id", "block"])
    partial = written(partial, "partial-scores")
    blocks = partial.select("query_id", "block").distinct()
    bounds = blocks.join(rest, "query_id").join(index.maxima, ["token", "block"]).groupBy("query_id", "block").agg(F.sum(F.least("qn", "most")).alias("bound"))
    alive = partial.join(bounds, ["query_id", "block"], "left").where(F.col("part") + F.coalesce("bound", F.lit(0)) >= F.col("mark")).drop("bound", "mark")
    alive = written(alive, "alive")
    completed = written(alive.select("query_id", "id", "block").join(rest, "query_id").join(index.postings, ["token", "block", "id"]), "completed")
    more = completed.groupBy("query_id", "id").agg(F.sum(F.least("tf", "qn")).alias("more"))
    total = alive.join(more, ["query_id", "id"], "left").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0)))
    rows = _best(total, top_k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")
    return Search(rows, seeds, candidates, completed)
