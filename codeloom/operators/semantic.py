"""Semantic resolvers: tables in, tables out, chosen by name."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qualified_name
from .hierarchy import direct_bases, look_up, receivers
from .resolve import module_map


class SemanticResolver(Protocol):
    name: str

    def supports(self, language: str) -> bool: ...

    def resolve(self, relationships: DataFrame, symbols: DataFrame) -> DataFrame: ...


class NameResolver:
    """Resolves what is left unresolved in Python calls and bases by a name that is unique in the repository."""

    name = "names"

    def supports(self, language: str) -> bool:
        return language == "python"

    def resolve(self, relationships: DataFrame, symbols: DataFrame) -> DataFrame:
        """Retarget ``unresolved:`` calls and inheritances whose last name has one definition in the repository.

        A found one has confidence 0.7, as neither position nor type is looked at, status
        ``name-resolved``, and one more piece of evidence. Names with several definitions stay as they are.
        """
        definitions = symbols.where(F.col("type").isin("function", "method", "class") & F.col("file_path").endswith(".py"))
        unique = definitions.select("repo", F.element_at(F.split(qualified_name(F.col("id")), r"\."), -1).alias("_name"), "id").distinct().groupBy("repo", "_name").agg(F.min("id").alias("_id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        open_ = F.col("target_id").startswith("unresolved:") & F.col("rel_type").isin("CALLS", "INHERITS")
        name = F.when(open_, F.element_at(F.split(F.regexp_replace("target_id", "^unresolved:", ""), r"\."), -1))
        met = relationships.withColumn("_name", name).join(unique, ["repo", "_name"], "left")
        hit = F.col("_id").isNotNull()
        more = F.transform("evidence", lambda e: e.withField("type", F.lit("semantic")).withField("confidence", F.lit(0.7)))
        return (
            met.withColumn("evidence", F.when(hit, F.concat("evidence", F.slice(more, 1, 1))).otherwise(F.col("evidence")))
            .withColumn("target_id", F.coalesce("_id", "target_id"))
            .withColumn("confidence", F.when(hit, 0.7).otherwise(F.col("confidence")))
            .withColumn("resolution_status", F.when(hit, "name-resolved").otherwise(F.col("resolution_status")))
            .withColumn("resolver", F.when(hit, self.name).otherwise(F.col("resolver")))
            .select(*relationships.columns)
        )


class HierarchyResolver:
    """Resolves Python calls on receivers along imports and the class hierarchy, and bases by unique names."""

    name = "hierarchy"

    def supports(self, language: str) -> bool:
        return language == "python"

    def resolve(self, relationships: DataFrame, symbols: DataFrame) -> DataFrame:
        """Retarget open calls of methods to what their receiver's class has or inherits.

        First NameResolver gives open bases their class, where the name is unique; then the hierarchy is gone through from the top,
        and each call of a method looked up in it. A found one has confidence 0.9, status
        ``hierarchy-resolved`` and one more piece of evidence; others stay as they are, but calls of plain names may
        be resolved by NameResolver. Of two relations that become equal both stay; building merges them.
        """
        python = symbols.where(F.col("file_path").endswith(".py"))
        bases = NameResolver().resolve(relationships.where("rel_type = 'INHERITS'"), symbols)
        calls = receivers(relationships, python, module_map(python))
        methods = python.where("type = 'method' and parent_id is not null").select(F.col("parent_id").alias("class"), "name", "id")
        found = look_up(calls.select("class", "name", "own"), direct_bases(bases, python), methods)
        hits = calls.join(found, ["class", "name", "own"]).select("source_id", "target_id", F.col("id").alias("_id"))
        rest = relationships.where("rel_type <> 'INHERITS'").unionByName(bases)
        met = rest.join(hits.withColumn("rel_type", F.lit("CALLS")), ["source_id", "target_id", "rel_type"], "left")
        hit = F.col("_id").isNotNull()
        more = F.transform("evidence", lambda e: e.withField("type", F.lit("semantic")).withField("confidence", F.lit(0.9)))
        out = (
            met.withColumn("evidence", F.when(hit, F.concat("evidence", F.slice(more, 1, 1))).otherwise(F.col("evidence")))
            .withColumn("target_id", F.coalesce("_id", "target_id"))
            .withColumn("confidence", F.when(hit, 0.9).otherwise(F.col("confidence")))
            .withColumn("resolution_status", F.when(hit, "hierarchy-resolved").otherwise(F.col("resolution_status")))
            .withColumn("resolver", F.when(hit, self.name).otherwise(F.col("resolver")))
            .select(*relationships.columns)
        )
        plain = ~F.substring_index("target_id", ":", -1).contains(".")
        open_ = F.coalesce(F.col("target_id").startswith("unresolved:") & plain, F.lit(False))
        return out.where(~open_).unionByName(NameResolver().resolve(out.where(open_), symbols))


class IdentityResolver:
    """A backend that changes nothing."""

    def __init__(self, name: str):
        self.name = name

    def supports(self, language: str) -> bool:
        return False

    def resolve(self, relationships: DataFrame, symbols: DataFrame) -> DataFrame:
        return relationships


RESOLVERS: dict[str, SemanticResolver] = {"names": NameResolver(), "hierarchy": HierarchyResolver(), **{n: IdentityResolver(n) for n in ("scip", "lsp", "joern")}}


def get_resolver(name: str) -> SemanticResolver | None:
    return RESOLVERS.get(name)
