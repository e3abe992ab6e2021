"""The prefix trie of conversations, built compressed: points and edges first, unary nodes last.

A conversation is a sequence of (role, text) turns; a node is a distinct prefix. Turns stay
rows all the way, so a conversation may hold a third of all of them: they are sorted by
ranges, numbered, and every prefix gets a 128-bit key, the exclusive or of its turns' hashes,
each taken with its depth. Such a key, like the sum of lengths, is a running total, and a
running total starts in a range where the ranges before it end.

Nodes with the same members lie on one compressed edge, and no two edges share both their least
member and their number of members. So the compressed tree is the table of those pairs; its
bottom ends are the branch, end and leaf points. Sums over subtrees are made on that
table by doubling: in round k a point has the sum of its subtree to depth 2^k, and adds those of
the points 2^k below, so a chain of a million nested conversations takes 20 rounds. Then the
unary nodes take their edge's figures, less what the edge has above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, require

#: So many bits of a place in the sorted ids are within a piece of text for hashing: 2048 ids at most.
PIECE_BITS = 11
KEY = ("d", "a", "b")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, part, rank, a, b, chars): the turns of each conversation numbered from 1 by turn, null first.

    Ties of turn fall by role, then by text; a null role or text is an empty one. Rows with a
    null conv_id belong to no conversation and are left out; other columns are not read.
    ``a`` and ``b`` are hashes of role and text, ``chars`` the text's code points, ``part`` the
    range of the sorted rows that the turn lies in.
    """
    require(turns, "conv_id", "turn", "role", "text")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # equal beginnings of texts go to one range, so the ranges follow the order below
    ranged = rows.repartitionByRange(partitions(turns.sparkSession), "conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    ordered = ranged.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    place = F.monotonically_increasing_id()
    hashed = ordered.select("conv_id", place.alias("place"), F.spark_partition_id().alias("part"), F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"), F.length("text").cast("bigint").alias("chars"))
    rows = cut(hashed, "turns")
    pieces = rows.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # a row for each range that a conversation lies in
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))
    return rows.join(pieces, ["conv_id", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("shift")


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, part, d, a, b, chars) by depth from 1, and (conv_id, depth) of each.

    Conversation c begins with the first h turns of conversation c - c % ``group``, h being
    crc32(c in decimal) % ``most`` (all of them if there are fewer, none if it is not there), and goes
    on with its own turns after its first h. The remainder of a negative c is SQL's, towards 0.
    """
    rows = cut(numbered_turns(turns), "numbered")
    sizes = cut(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    first = rows.where((F.col("conv_id") % group == 0) & (F.col("rank") < most)).select(F.col("conv_id").alias("base"), F.col("rank").alias("d"), "a", "b", "chars")
    begun = convs.join(first, "base").where("d <= taken").select("conv_id", F.lit(-1).alias("part"), "d", "a", "b", "chars")
    own = rows.join(convs, "conv_id").where("rank > h").select("conv_id", "part", (F.col("taken") + F.col("rank") - F.col("h")).alias("d"), "a", "b", "chars")
    return begun.union(own), convs.select("conv_id", "depth")


def members(turns: DataFrame, depths: DataFrame) -> DataFrame:
    """(conv_id, d, a, b, up_a, up_b, chars, total, ends): each conversation at each of its prefixes, the empty one too.

    (d, a, b) is the prefix's key and (d - 1, up_a, up_b) that of the one before, ``total`` the code
    points of all its texts. Rows of a conversation are summed range by range.
    """
    hashed = turns.select("conv_id", "part", "d", F.xxhash64("a", "b", "d").alias("x"), F.xxhash64("d", "b", "a").alias("y"), "chars")
    so_far = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    runs = hashed.select("*", F.bit_xor("x").over(so_far).alias("a0"), F.bit_xor("y").over(so_far).alias("b0"), F.sum("chars").over(so_far).alias("t0"))
    pieces = hashed.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("chars").alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    pieces = pieces.select("conv_id", "part", F.coalesce(F.bit_xor("x").over(earlier), none).alias("a1"), F.coalesce(F.bit_xor("y").over(earlier), none).alias("b1"), F.coalesce(F.sum("t").over(earlier), none).alias("t1"))
    a, b = F.col("a0").bitwiseXOR(F.col("a1")), F.col("b0").bitwiseXOR(F.col("b1"))
    keyed = runs.join(pieces, ["conv_id", "part"]).select("conv_id", "d", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"), "chars", (F.col("t0") + F.col("t1")).alias("total"))
    ended = keyed.join(depths, "conv_id").withColumn("ends", F.col("d") == F.col("depth")).drop("depth")
    roots = depths.select("conv_id", none.alias("d"), none.alias("a"), none.alias("b"), none.alias("up_a"), none.alias("up_b"), none.alias("chars"), none.alias("total"), (F.col("depth") == 0).alias("ends"))
    return ended.union(roots)


def compressed_edges(nodes: DataFrame) -> DataFrame:
    """(conv_id, n_convs, top, bottom, base, saved, up_conv, up_n, n_children) of each compressed edge.

    ``base`` is the total above the edge and ``saved`` the sum of the edge's own nodes;
    (up_conv, up_n) is the edge whose bottom it hangs on, null for the root's.
    """
    low, high = (lambda c: F.min_by(c, "d").alias(f"top_{c}")), (lambda c: F.max_by(c, "d").alias(f"bottom_{c}"))
    edges = nodes.groupBy("conv_id", "n_convs").agg(F.min("d").alias("top"), F.max("d").alias("bottom"), *map(low, ("up_a", "up_b", "chars", "total")), *map(high, ("a", "b", "total")))
    edges = edges.withColumn("base", F.col("top_total") - F.col("top_chars")).withColumn("saved", (F.col("n_convs") - 1) * (F.col("bottom_total") - F.col("base")))
    edges = cut(edges, "edges")
    ends = edges.select((F.col("bottom") + 1).alias("top"), F.col("bottom_a").alias("top_up_a"), F.col("bottom_b").alias("top_up_b"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    hung = edges.join(ends, ["top", "top_up_a", "top_up_b"], "left")
    hung = cut(hung.select("conv_id", "n_convs", "top", "bottom", "base", "saved", "up_conv", "up_n"), "hung-edges")
    below = hung.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("n_children"))
    return hung.join(below, ["conv_id", "n_convs"], "left").fillna(0, ["n_children"])


def subtree_sums(edges: DataFrame) -> DataFrame:
    """(conv_id, n_convs, leaves, saved) summed over all edges at and below each edge, in as many rounds as the height has bits."""
    at = ["conv_id", "n_convs"]
    state = edges.select(*at, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), "saved", F.col("up_conv").alias("to_conv"), F.col("up_n").alias("to_n"))
    while True:
        state = cut(state, "subtrees")
        moving = state.where("to_conv is not null")
        if moving.isEmpty():
            return state.drop("to_conv", "to_n")
        arriving = moving.groupBy(F.col("to_conv").alias("conv_id"), F.col("to_n").alias("n_convs")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jumps = moving.select(F.col("conv_id").alias("to_conv"), F.col("n_convs").alias("to_n"), F.col("to_conv").alias("next_conv"), F.col("to_n").alias("next_n"))
        summed = state.join(arriving, at, "left").select(*at, (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "to_conv", "to_n")
        state = summed.join(jumps, ["to_conv", "to_n"], "left").select(*at, "leaves", "saved", F.col("next_conv").alias("to_conv"), F.col("next_n").alias("to_n"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of ids in order, as one SHA-256 of each key; a key's pieces follow each other."""
    at, running = None, None
    for batch in batches:
        done = []
        for *key, ids in batch[[*KEY, "ids"]].itertuples(index=False, name=None):
            if key == at:
                running.update(b",")
            else:
                if at is not None:
                    done.append((*at, running.hexdigest()))
                at, running = key, hashlib.sha256()
            running.update(ids.encode())
        yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, running.hexdigest())], columns=[*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, a, b, ends_sha256): of the conversations that end at a node, the ids in ascending order, comma-joined.

    Ranges of the sorted ids are joined to pieces of text in parallel; only pieces meet in the task
    that hashes a node, which streams them: a digest has to be made in one go.
    """
    ranged = ends.select(*KEY, "conv_id").repartitionByRange(partitions(ends.sparkSession), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    placed = cut(ranged.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS)), "ends")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = placed.groupBy(*KEY, "piece").agg(ids.alias("ids"))
    hashed = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return hashed.mapInPandas(_digests, "d bigint, a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, depths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, one row each, from turns by depth and the depth of each conversation.

    Columns as in the query below. No conversations give no rows. Conversations without turns are
    members of the root; equal conversations are members of the same nodes.
    """
    met = cut(members(turns, depths), "members")
    same = lambda c: F.max(c).alias(c)
    nodes = met.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *map(same, ("up_a", "up_b", "chars", "total")))
    nodes = cut(nodes, "nodes")
    edges = cut(compressed_edges(nodes), "compressed-edges")
    sums = subtree_sums(edges).withColumnRenamed("saved", "saved_below")
    figures = edges.join(sums, ["conv_id", "n_convs"]).drop("saved")
    whole = nodes.join(figures, ["conv_id", "n_convs"]).join(end_digests(met.where("ends")), list(KEY), "left")
    at_top, at_bottom = F.col("d") == F.col("top"), F.col("d") == F.col("bottom")
    above = F.col("total") - F.col("chars") - F.col("base")  # code points of the edge's nodes above this one
    return whole.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(at_top, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_bottom, F.col("n_children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved_below") - (F.col("n_convs") - 1) * above).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, rebuilt to share beginnings."""
    return prefix_trie(*rebuilt_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same over whole lists. A CRC is taken bit by bit.
OP12_SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 6 AS h FROM ids),
own AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
whole AS (SELECT own.c, list_concat(coalesce(b.turns[:h], []), own.turns[h + 1:]) AS turns FROM own JOIN crc ON own.c = crc.c LEFT JOIN own b ON b.c = own.c - own.c % 100),
places AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole),
nodes AS (SELECT d, turns[:d] AS path, min(c) AS conv_id, count(*) AS n, list(c ORDER BY c) FILTER (len(turns) = d) AS ended FROM places GROUP BY ALL),
keyed AS (SELECT *, CASE WHEN d > 0 THEN path[:d - 1] END AS up, CASE WHEN d > 0 THEN (n - 1) * length(path[d].text) ELSE 0 END AS own_saved FROM nodes),
children AS (SELECT up AS path, d - 1 AS d, count(*) AS k FROM keyed WHERE d > 0 GROUP BY ALL),
joined AS (SELECT keyed.*, coalesce(k, 0) AS k FROM keyed LEFT JOIN children USING (path, d)),
above AS (SELECT path[:u] AS path, u AS d, k, own_saved FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM joined)),
sums AS (SELECT path, d, count(*) FILTER (k = 0) AS leaves, sum(own_saved) AS saved FROM above GROUP BY ALL)
SELECT j.conv_id::BIGINT AS conv_id, j.d AS depth, p.conv_id::BIGINT AS parent_conv_id, j.n AS n_convs, j.k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(array_to_string(j.ended, ','), '')) AS ends_sha256
FROM joined j JOIN sums USING (path, d) LEFT JOIN keyed p ON p.path = j.up AND p.d = j.d - 1"""
