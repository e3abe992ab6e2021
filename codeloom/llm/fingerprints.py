"""Canonical exact digests of whole texts.

A text's canonical form is its NFKC normalisation, case-folded, normalised again, with
every run of white space as one space and none at the ends. The fingerprint is the
128-bit xxh3 of its UTF-8 bytes. Documents of one fingerprint form a bucket, and within a
bucket of several the bytes are compared: should two canonical forms differ there, each
form gets a number of its own after the digest, so that equal fingerprints mean equal
canonical bytes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, partitions, require
from .tokenization import slices, text_sizes


def canonical(text: str | None) -> bytes:
    """The canonical form in UTF-8; null is empty."""
    if not text:
        return b""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) per row from one pass without a shuffle; buckets are not yet compared.

    Null texts count as empty; null ids stay; repeated rows stay; other columns are not read.
    """
    require(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(text_sizes(batch.column(1)), 8_000_000):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([digest(t) for t in texts])], names=["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"doc_id {kind}, n_chars bigint, fingerprint string")


def split_collisions(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """Number the canonical forms that share a digest but not their bytes.

    ``compared`` has (doc_id, fingerprint, canonical) of every row in a bucket of several.
    Only the least and the greatest form of a bucket are gathered, map side first, so that
    a bucket of any size is cheap; forms are numbered only where these two differ.
    """
    differ = compared.groupBy("fingerprint").agg(F.min("canonical").alias("lo"), F.max("canonical").alias("hi")).where("lo <> hi").select("fingerprint")
    differ = cut(differ, "collisions")
    if differ.isEmpty():
        return rows
    forms = compared.join(differ, "fingerprint", "left_semi")
    number = F.dense_rank().over(Window.partitionBy("fingerprint").orderBy("canonical"))
    numbered = forms.groupBy("fingerprint", "canonical").count().withColumn("form", number).drop("count")
    of = forms.join(numbered, ["fingerprint", "canonical"]).groupBy("doc_id", "fingerprint").agg(F.min("form").alias("form"))
    joined = rows.join(of, ["doc_id", "fingerprint"], "left")
    return joined.withColumn("fingerprint", F.when(F.col("form") > 1, F.concat_ws("-", "fingerprint", F.col("form").cast("string"))).otherwise(F.col("fingerprint"))).select(*rows.columns)


def edit(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_FIELDS = "kind string, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string, canonical binary"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited texts, and their likeness (1.0 equal, 0.0 not).

    The edited text takes its end from the next document in descending id order; the last
    takes it from the first. Texts are range-partitioned once; each partition emits its
    first and last text aside, and these few meet across partitions afterwards. Null texts
    count as empty, null ids come last, rows with equal ids follow in an order fixed by
    their texts, a single row follows itself. An empty table gives an empty table. Ids are integers, as
    their order is part of the result; others are an error.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    one = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    prints = cut(fingerprint_documents(one).select("doc_id", "fingerprint"), "prints")
    several = cut(prints.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "several")  # a table of its own: the join may send it around, or split a hot bucket's rows
    flagged = prints.join(several, "fingerprint", "left_semi").select("doc_id", F.lit(None).cast("string").alias("text")).distinct()
    flagged = cut(flagged, "flagged")  # ids whose bytes are to be compared; a flag sorts before its documents

    def row(kind: str, part: int, doc_id, text: str, following: str | None, own: bytes | None, compare: bool) -> tuple:
        if following is None:
            return (kind, part, doc_id, len(text), None, None, None, None, text, own if compare else None)
        changed = edit(text, following)
        return (kind, part, doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(own), digest(changed), None, None, own if compare else None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flag, last, rows, size = TaskContext.get().partitionId(), object(), None, [], 0
        for batch in batches:
            for lo, hi in slices(text_sizes(batch.column(1)), 4_000_000):
                ids, texts = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
                for doc_id, text in zip(ids, texts):
                    if text is None:
                        flag = doc_id
                        continue
                    own = canonical(text)
                    if last is None:
                        rows.append(row("head", part, doc_id, text, None, own, False))
                    else:
                        done = row("doc", part, last[0], last[1], text, last[2], last[3])
                        rows.append((*done[:7], xxhash.xxh3_128_hexdigest(own), *done[8:]))
                    last = (doc_id, text, own, flag == doc_id)
                    size += len(text)
                    if size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
        if last is not None:
            rows.append(row("open", part, last[0], last[1], None, last[2], last[3]))
        if rows:
            yield batch_of(rows)

    both = one.union(flagged)
    dealt = both.repartitionByRange(partitions(spark), F.desc("doc_id"))
    ordered = dealt.sortWithinPartitions(F.desc("doc_id"), F.expr("text is null").desc(), F.xxhash64("text"))
    found = cut(ordered.mapInArrow(lean(run), _FIELDS), "edited")

    heads = found.where("kind = 'head'").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")  # one row for each partition
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(everywhere)).alias("next"))
    opens = found.where("kind = 'open'").drop("edited_sha256", "edited_fingerprint", "next_fingerprint", "fingerprint")
    met = opens.join(nexts, "part").join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following", "canonical")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                done = row("doc", 0, r["doc_id"], r["text"], r["following"], canonical(r["text"]), r["canonical"] is not None)
                rows.append((*done[:7], digest(r["following"]), *done[8:]))
            if rows:
                yield batch_of(rows)

    rows = found.where("kind = 'doc'").union(met.mapInArrow(lean(close), _FIELDS))
    compared = rows.where("canonical is not null").select("doc_id", "fingerprint", "canonical")
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    likeness = rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"))
    return split_collisions(likeness, compared)


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
