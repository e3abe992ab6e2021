"""Resolving symbolic targets: left joins of the relationships with what their targets may name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import module_path, qualified_name
from .merge import last_wins

#: Definitions that another module can name.
DEFINITIONS = ("function", "method", "class")


def module_keys(symbols: DataFrame) -> DataFrame:
    """(key, id, ord): a file under its module path, and a definition under its module path and qualified name."""
    module = module_path(F.col("file_path"))
    key = F.when(F.col("type") == "file", module).when(F.col("type").isin(*DEFINITIONS), F.concat_ws(".", module, qualified_name(F.col("id"))))
    return symbols.select(key.alias("key"), "id", "ord").where("key is not null")


def address_keys(symbols: DataFrame) -> DataFrame:
    """(key, id, ord) of Terraform addresses, over all directories."""
    return symbols.select(F.get_json_object("metadata", "$.tf_address").alias("key"), "id", "ord").where("key is not null")


def owners(keys: DataFrame) -> DataFrame:
    """(key, id): the last of a key by place wins; of places in several repositories that of the greatest id."""
    return last_wins(keys.withColumn("ord", F.struct("ord", "id")), ["key"], "ord").select("key", "id")


def module_map(symbols: DataFrame) -> DataFrame:
    """(key, id): what a module's name, or a name in a module, stands for."""
    return owners(module_keys(symbols))


def address_map(symbols: DataFrame) -> DataFrame:
    """(key, id): what a Terraform address stands for."""
    return owners(address_keys(symbols))


def symbolic_key(target: Column) -> tuple[Column, Column]:
    """Which map a symbolic target is looked up in, null for other targets, and its key there."""
    is_module, is_address = target.startswith("module:"), target.startswith("tfaddr:")
    return F.when(is_module, "module").when(is_address, "tfaddr"), F.when(is_module | is_address, F.substring(target, 8, 1 << 20))


def resolve_targets(rels: DataFrame, modules: DataFrame, addresses: DataFrame) -> DataFrame:
    """Retarget ``module:`` and ``tfaddr:`` relationships; adds resolution_status and resolver.

    A module that is found has confidence 0.95, one that is not 0.5; an address that is
    found 0.95, else it keeps its own. All others count as resolved, ``unresolved:``
    targets too: look at the prefix to tell them apart. The sides are planned by size.
    """
    which, key = symbolic_key(F.col("target_id"))
    maps = modules.select(F.lit("module").alias("_map"), "key", "id").union(addresses.select(F.lit("tfaddr"), "key", "id"))
    met = rels.withColumn("_map", which).withColumn("key", key).join(maps, ["_map", "key"], "left")
    hit = F.col("id").isNotNull()

    def by_kind(found_module: Column, lost_module: Column, found_address: Column, lost_address: Column, other: Column) -> Column:
        return F.when(F.col("_map") == "module", F.when(hit, found_module).otherwise(lost_module)).when(F.col("_map") == "tfaddr", F.when(hit, found_address).otherwise(lost_address)).otherwise(other)

    confidence = by_kind(F.lit(0.95), F.lit(0.5), F.lit(0.95), F.col("confidence"), F.col("confidence"))
    given = F.element_at("metadata", "resolution_status") if "metadata" in rels.columns else F.lit(None)
    status = by_kind(F.lit("module-resolved"), F.lit("unresolved"), F.lit("tf-resolved"), F.lit("unresolved"), F.coalesce(given, F.lit("resolved")))
    out = met.withColumn("target_id", F.coalesce("id", "target_id")).withColumn("confidence", confidence).withColumn("resolution_status", status).withColumn("resolver", F.lit("static"))
    return out.select(*rels.columns, "resolution_status", "resolver")
