"""Benchmark decontamination over a positional inverted index of the training texts.

The index is a table of postings (term, a, b, pos): word ``pos`` of the text with the key (a, b)
is ``term``. Each task writes a segment of its own texts, sorted by term, so building it
shuffles nothing and a look-up reads the row groups of its terms only. Phrases are
found from their rarest terms: the postings of the rarest, moved by its offset in the phrase,
are the candidates; each further list, moved likewise, keeps those it holds too. The
lists of the two rarest terms of each phrase come from the index over all texts; the other terms are
looked up in the texts that are left, so common words' postings are made for these alone.

Everything is DataFrame functions. A text's key is two 64-bit hashes of its id and itself.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, require

#: What stands between words; in text that is not lower-cased yet, letters A-Z are of words too.
BETWEEN, BETWEEN_CASED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms up to which their table is sent to all tasks; some 64 bytes each.
BROADCAST_TERMS = 500_000
KEY = ("a", "b")
POSTINGS = ("term", *KEY, "pos")


def _split(text: Column, between: str) -> Column:
    return F.coalesce(F.array_remove(F.split(text, between), ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """The words of a text in order: letters A-Z lower-cased, split at all other ASCII but letters and digits; a null has none."""
    return _split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def word_count(text: Column) -> Column:
    return F.size(_split(text, BETWEEN_CASED)).cast("bigint")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, a, b). Rows with one id and one text share a key, whatever their number; other columns are not read."""
    require(docs, id_col, text_col)
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(i.alias("id"), t.alias("text"), F.xxhash64(i, t).alias("a"), F.xxhash64(t, F.lit(1), i).alias("b"))


def phrases(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase): the distinct windows of ``size`` consecutive words of each item, as arrays.

    An item of fewer words, but not none, is one window. Items of one id count as one; a null text has no windows.
    """
    require(items, id_col, text_col)
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
    listed = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size(w) > 0)
    return listed.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(w, s + 1, size))).alias("phrase")).distinct()


def numbered_phrases(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pid, phrase) of the distinct phrases, and (pid, item_id)."""
    listed = cut(cut(windows.select("phrase").distinct(), "phrases").withColumn("pid", F.monotonically_increasing_id()), "numbered-phrases")
    return listed, cut(windows.join(listed, "phrase").select("pid", "item_id"), "item-phrases")


def _few(terms: DataFrame) -> bool:
    return terms.count() <= BROADCAST_TERMS


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the given terms, a table of distinct ones, occurs in all texts; those that do not are left out."""
    said = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if _few(terms):
        return said.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return said.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings of all words of (text, a, b), or of the given distinct terms, in segments sorted by term.

    A text that stands in several rows with one key has its postings once for each.
    """
    said = docs.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term")).select(*POSTINGS)
    if terms is not None:
        said = said.join(F.broadcast(terms) if _few(terms) else terms, "term", "left_semi").select(*POSTINGS)
    return cut(said.sortWithinPartitions(*POSTINGS), "postings")


def ranked_terms(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """(pid, term, offset, nth): each phrase's words from the rarest on, ties by place; phrases with a word that no text has are left out."""
    every = listed.select("pid", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term"))
    counted = every.join(counts, "term")
    order, whole = Window.partitionBy("pid"), F.count("*").over(Window.partitionBy("pid"))
    placed = counted.withColumn("nth", F.row_number().over(order.orderBy("n", "offset"))).withColumn("known", whole)
    return placed.where("known = size").select("pid", "term", "offset", "nth")


def intersect(found: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """The candidates (pid, a, b, start) for which each asked (pid, term, offset) has a posting at start + offset; with nothing asked they stay."""
    at = ["pid", *KEY, "start"]
    places = found.join(asked, "pid").select(*at, "term", (F.col("start") + F.col("offset")).alias("pos"))
    held = places.join(postings, list(POSTINGS), "left_semi").groupBy(*at).agg(F.count("*").alias("n"))
    needed = asked.groupBy("pid").agg(F.count("*").alias("needed"))
    return held.join(needed, "pid").where("n = needed").select(*at).union(found.join(needed, "pid", "left_anti").select(*at))


def phrase_matches(docs: DataFrame, listed: DataFrame, lists: int = 2) -> DataFrame:
    """(pid, a, b, start, size): every occurrence of every phrase (pid, words) in the texts (text, a, b), exactly.

    ``lists`` is the number of lists, from the rarest term on, that the index over all texts holds;
    it changes what is stored and joined, not what is found.
    """
    vocabulary = cut(listed.select(F.explode("phrase").alias("term")).distinct(), "vocabulary")
    ranked = cut(ranked_terms(listed, cut(term_counts(docs, vocabulary), "term-counts")), "ranked-terms")
    rare = ranked.where(F.col("nth") <= lists)
    postings = build_index(docs, cut(rare.select("term").distinct(), "rare-terms"))
    first = postings.join(ranked.where("nth = 1"), "term").select("pid", *KEY, (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    found = cut(intersect(cut(first, "candidates"), rare.where("nth > 1"), postings), "intersected")
    left = docs.join(cut(found.select(*KEY).distinct(), "texts-left"), list(KEY), "left_semi")
    rest = ranked.where(F.col("nth") > lists)
    exact = intersect(found, rest, build_index(left, cut(rest.select("term").distinct(), "other-terms")))
    return cut(exact.join(listed.select("pid", F.size("phrase").alias("size")), "pid"), "matches")


def proximity_matches(postings: DataFrame, listed: DataFrame, span: int) -> DataFrame:
    """(pid, a, b, start): places where ``span`` consecutive words, the first a query's, hold all words of a query, in any order.

    ``postings`` hold all words of the queries (pid, phrase). Texts come from the list of a query's
    rarest word and have to be in that of the next, then all its words are looked up in them.
    """
    at = ["pid", *KEY]
    distinct = listed.select("pid", F.array_distinct("phrase").alias("phrase"))
    counts = postings.join(distinct.select(F.explode("phrase").alias("term")).distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = cut(ranked_terms(distinct, counts), "ranked-terms")
    texts = postings.join(ranked.where("nth = 1"), "term").select(*at).distinct()
    second = ranked.where("nth = 2")
    held = postings.join(second, "term").select(*at).distinct()
    texts = texts.join(held, at, "left_semi").union(texts.join(second.select("pid"), "pid", "left_anti"))
    sizes = distinct.select("pid", F.size("phrase").alias("size"))
    places = cut(texts, "texts").join(ranked.select("pid", "term"), "pid").join(postings, ["term", *KEY]).distinct()
    ahead = Window.partitionBy(*at).orderBy("pos").rangeBetween(0, span - 1)
    return places.withColumn("held", F.size(F.collect_set("term").over(ahead))).join(sizes, "pid").where("held = size").select(*at, F.col("pos").alias("start"))


def words_covered(matches: DataFrame) -> DataFrame:
    """(a, b, n_hit): how many words of a text lie in any of its matches (a, b, start, size)."""
    spans = matches.groupBy(*KEY, "start").agg((F.col("start") + F.max("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0))
    return spans.select(*KEY, new.alias("new")).groupBy(*KEY).agg(F.sum("new").cast("bigint").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """A row for each row of ``docs``: its words, those inside occurrences of the items' windows, and the items with such windows.

    Columns: the id, n_words, n_hit, n_items, items (their ids as strings, sorted), contaminated. Null and
    wordless texts have no words and are clean; equal rows are judged alike, null ids too; an item without
    an id marks words but is no item to be named or counted. No items or no documents are no error.
    """
    rows = keyed(docs, doc_id)
    listed, of_items = numbered_phrases(phrases(items, size, item_id))
    matches = phrase_matches(rows, listed)
    named = matches.select("pid", *KEY).distinct().join(of_items.where("item_id is not null"), "pid").groupBy(*KEY).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    results = cut(words_covered(matches).join(named, list(KEY), "left"), "contamination")
    out = rows.select("id", *KEY, word_count(F.col("text")).alias("n_words")).join(results, list(KEY), "left")
    hit, found = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(doc_id), "n_words", hit.alias("n_hit"), F.size(found).cast("bigint").alias("n_items"), found.alias("items"), (hit > 0).alias("contaminated"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all ``documents`` stand in passages of ``benchmark``, and of which items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same by joining all windows of the texts, as strings, for each length that the items' windows have.
OP11_SQL = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
asked AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM asked WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM split, lengths WHERE len(w) >= n),
met AS (SELECT r, s, p.n, item_id FROM places p JOIN windows v ON v.n = p.n AND v.phrase = array_to_string(w[s:s + p.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
