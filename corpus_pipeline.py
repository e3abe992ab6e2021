"""From documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of documents, and any others that docs has, whatever their names.
An empty table goes through all stages and gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import cut, cut_whole
from codeloom.llm.language import identify_languages, learn_languages
from codeloom.llm.ngram_join import drop_near_duplicates
from codeloom.llm.packing import best_fit_pack, tokenize_pieces
from codeloom.llm.passages import remove_passages, repeated_passages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject; it learns from their own labels.

    Null texts, empty ones and those without a letter are rejected. Where nothing can be
    learnt, because no document outside the held-out fifth has both a label and a letter,
    nothing can be rejected and all rows stay. Null labels, null sources and null ids are
    no reason to reject; repeated rows are kept or rejected alike.
    """
    model = learn_languages(docs)
    if not model.languages:
        return docs
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = identify_languages(renamed, model, renamed.columns[docs.columns.index("text")]).where(~F.col("rejected"))
    return kept.select(*renamed.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by the n-gram Jaccard join.

    Equal texts with at least one word are linked, and of a repeated row one stays. Null texts,
    wordless ones and rows with a null id are linked with nothing and stay. Of an id repeated
    with other texts each text is judged by itself.
    """
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in a document of lesser id; n_chars is set anew where a text changed.

    Null texts, texts of fewer than 50 words and rows with a null id stay as they are; a text
    that is a repeated passage as a whole becomes empty; rows with one id are cut alike.
    """
    found = cut_whole(spark, lambda: repeated_passages(docs), "repeated-passages")
    return remove_passages(docs, found, count_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences.

    A null or empty text is the end id alone; null ids stay null; repeated rows are documents
    of their own; other columns are not read.
    """
    # workers that other stages have used before hold less at a time
    pieces = tokenize_pieces(docs, cache_pieces=250_000, at_once=2_000_000).select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"))
    return best_fit_pack(pieces)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: The language model, the join's components and the packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
