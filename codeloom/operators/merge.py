"""MERGE semantics on plain tables: the last row of a key wins, and replaces what was there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """Of each key the row with the greatest order, whole, nulls included.

    One aggregation with partial results before the shuffle: a key with many rows sends one
    row per task, where a window would bring all its rows to one task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def drop_dangling(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without an end among the removed ids."""
    for end in ("source_id", "target_id"):
        edges = edges.join(removed.select(F.col("id").alias(end)), end, "left_anti")
    return edges
