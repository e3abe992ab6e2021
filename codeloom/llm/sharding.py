"""Sharding by balanced label propagation.

A document's label is its shard; documents are linked if they have equal texts. The links
form groups in which all documents of one label are alike, so the state is a table of
(group, shard, documents) and a step is a join of that table with itself by group: the
labels of a group's neighbours pull its documents towards the shards that hold most of
them, as far as each shard's quota leaves room. Steps repeat until nothing moves. What then
lies over a quota, and all documents without links, fill the shards to exact sizes: the
numbers of rows of any two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, rank_in_groups, require

SHARDS = 40
STEPS = 12
#: Room over its quota that a shard has while labels move.
SLACK = 1.0
ROW_BYTES = 16


def _before(df: DataFrame, shard: str, amount: str, order: list, name: str) -> DataFrame:
    """The sum of ``amount`` over the rows of the same shard that come before, over many tasks.

    Larger amounts come first, by powers of two; rows of one power are dealt over buckets by
    their order's hash. A bucket's sum is one small row.
    """
    buckets = max(16, 2 * partitions(df.sparkSession))
    power = F.lit(63) - F.floor(F.log2(F.greatest(F.col(amount), F.lit(1)))).cast("int")
    dealt = df.withColumn("_b", power * buckets + F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(shard, "_b").agg(F.sum(amount).alias("_s"))
    start = F.coalesce(F.sum("_s").over(Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(shard).alias("_t"), F.col("_b").alias("_c"), start.alias("_start"))
    inner = F.coalesce(F.sum(amount).over(Window.partitionBy(shard, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = dealt.withColumn("_inner", inner).join(sums, (F.col(shard) == F.col("_t")) & (F.col("_b") == F.col("_c")))
    return met.withColumn(name, F.col("_start") + F.col("_inner")).drop("_b", "_t", "_c", "_start", "_inner")


def _quota(total: int, shards: int):
    return F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)


def propagate(groups: DataFrame, total: int, shards: int = SHARDS, steps: int = STEPS) -> DataFrame:
    """Shards of linked documents: (grp, shard, n) from (grp, n); ``total`` counts all documents.

    Each group starts dealt over the shards from a place fixed by its hash.
    """
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("n"), F.lit(shards)) - 1))
    dealt = groups.select("grp", "n", spread.alias("i"))
    shard = F.pmod(F.xxhash64("grp") + F.col("i"), F.lit(shards)).cast("int")
    each = F.expr(f"n div {shards}") + F.when(F.col("i") < F.col("n") % shards, 1).otherwise(0)
    state = cut(dealt.select("grp", shard.alias("shard"), each.alias("n")), "labels")
    room = F.ceil(_quota(total, shards) * (1 + SLACK)).cast("bigint")
    for _ in range(steps):
        loads = state.groupBy("shard").agg(F.sum("n").alias("load"))  # a row for each shard
        free = F.broadcast(loads.select("shard", F.greatest(room - F.col("load"), F.lit(0)).alias("free"), _quota(total, shards).alias("quota")))
        seen = state.join(free, "shard")
        own = Window.partitionBy("grp")
        place = F.row_number().over(own.orderBy(F.desc("n"), "shard"))
        # neighbours wish to sit together: in the shard with most of them, and what a quota can't hold in the next
        wished = seen.withColumn("all", F.sum("n").over(own)).withColumn("place", place)
        held = F.least(F.greatest("n", "quota"), F.greatest(F.col("all") - (F.col("place") - 1) * F.col("quota"), F.lit(0)))
        wished = wished.withColumn("gain", F.greatest(held - F.col("n"), F.lit(0))).withColumn("spare", F.greatest(F.col("n") - held, F.lit(0)))
        asked = _before(wished, "shard", "gain", [F.col("grp")], "before")
        got = asked.withColumn("granted", F.least("gain", F.greatest(F.col("free") - F.col("before"), F.lit(0))))
        # the last in a group give first
        leaving = F.coalesce(F.sum("spare").over(own.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        moved = got.withColumn("total_granted", F.least(F.sum("granted").over(own), F.sum("spare").over(own))).withColumn("leaving", leaving)
        arrived = F.coalesce(F.sum("granted").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        moved = moved.withColumn("arrived", arrived)
        arriving = F.greatest(F.least("granted", F.col("total_granted") - F.col("arrived")), F.lit(0))
        going = F.greatest(F.least("spare", F.col("total_granted") - F.col("leaving")), F.lit(0))
        state = cut(moved.select("grp", "shard", (F.col("n") + arriving - going).alias("n"), (arriving > 0).alias("changed")).where("n > 0 or changed"), "labels")
        if state.where("changed").isEmpty():
            break
        state = state.where("n > 0").drop("changed")
    return state.select("grp", "shard", "n").where("n > 0")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row; row counts of shards differ by one at most.

    ``size`` is the text's UTF-8 bytes (null: none) and 16. Documents with equal texts go to
    one shard where quotas allow; null texts are one group, as empty texts are another.
    Slots are gapless from 0 in each shard. Repeated rows are documents of their own; null
    ids stay; other columns are not read; an empty table gives an empty table.
    """
    require(docs, id_col, text_col)
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.when(text.isNull(), F.lit("")).otherwise(F.sha2(text, 256)).alias("grp"),
    )
    base = cut(base, "documents")
    total = base.count()
    order = [F.col("doc_id"), F.col("grp")]
    groups = base.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    state = propagate(cut(groups, "groups"), total, shards, steps)
    # each shard keeps linked documents up to its quota, in segments of its slots
    kept = _before(state, "shard", "n", [F.col("grp")], "slot0")
    kept = kept.withColumn("n", F.least("n", F.greatest(_quota(total, shards) - F.col("slot0"), F.lit(0)))).where("n > 0")
    from_ = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = cut(kept.withColumn("from", from_), "segments")
    segments = kept.groupBy("grp").agg(F.collect_list(F.struct("from", "n", "shard", "slot0")).alias("segments"))  # as many as shards
    ranked = rank_in_groups(base.join(segments.select("grp"), "grp", "left_semi"), ["grp"], order, "r")
    placed = ranked.join(segments, "grp").withColumn("s", F.get(F.filter("segments", lambda s: (s["from"] <= F.col("r")) & (F.col("r") < s["from"] + s["n"])), F.lit(0)))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "grp", F.col("s.shard").alias("shard"), (F.col("s.slot0") + F.col("r") - F.col("s.from")).alias("slot")), "linked")
    # all other documents fill the rest of each shard
    loads = kept.groupBy("shard").agg(F.sum("n").alias("load"))
    spark = docs.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    rest = every.join(loads, "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"), (_quota(total, shards) - F.coalesce("load", F.lit(0))).alias("left"))
    starts = rest.withColumn("first", F.coalesce(F.sum("left").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each shard
    table = starts.where("left > 0").agg(F.sort_array(F.collect_list(F.struct("first", "left", "shard", "load"))).alias("table")).first()[0] or []
    others = base.join(segments.select("grp"), "grp", "left_anti").select("doc_id", "size", "text_crc32", "grp")
    others = others.union(placed.where("shard is null").select("doc_id", "size", "text_crc32", "grp"))
    numbered = rank_in_groups(others, [], order, "r")
    if table:
        literal = F.array(*[F.struct(F.lit(t["first"]).alias("first"), F.lit(t["left"]).alias("left"), F.lit(t["shard"]).alias("shard"), F.lit(t["load"]).alias("load")) for t in table])
        hit = F.get(F.filter(literal, lambda s: (s["first"] <= F.col("r")) & (F.col("r") < s["first"] + s["left"])), F.lit(0))
        filled = numbered.withColumn("s", hit).select("doc_id", "size", "text_crc32", F.col("s.shard").alias("shard"), (F.col("s.load") + F.col("r") - F.col("s.first")).alias("slot"))
    else:
        filled = numbered.select("doc_id", "size", "text_crc32", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("bigint").alias("slot")).limit(0)
    return placed.where("shard is not null").select("doc_id", "size", "text_crc32", "shard", "slot").union(filled)


def op3_balanced_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law ``rows``."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
