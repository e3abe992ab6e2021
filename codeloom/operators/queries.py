"""Lookups, neighbourhoods and explanations over the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import provided
from ..sources.shared import written

_FOUND = ("id", "name", "type", "file_path", "start_line", "end_line")


def list_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.select("name", "branch", "commit", "root_path", "indexed_at").orderBy("name", "branch")


def find_symbol(nodes: DataFrame, name: str, repo: str | None = None, branch: str | None = None, commit: str | None = None, file_path: str | None = None) -> DataFrame:
    """Nodes of exactly that name, files and placeholders too."""
    return nodes.where(F.col("name") == name).where(provided(repo=repo, branch=branch, commit=commit, file_path=file_path)).select(*_FOUND)


def list_symbols(nodes: DataFrame, type: str | None = None, repo: str | None = None, branch: str | None = None, commit: str | None = None) -> DataFrame:
    """Symbols with a type other than file; nodes without a type are left out."""
    return nodes.where(F.col("type") != "file").where(provided(type=type, repo=repo, branch=branch, commit=commit)).select(*_FOUND, "kind", "metadata")


def find_file(nodes: DataFrame, path: str, repo: str | None = None, branch: str | None = None, commit: str | None = None, repositories: DataFrame | None = None) -> DataFrame:
    """File nodes of a path: relative, or absolute below a root of ``repositories``; below none nothing is found."""
    if path.startswith("/") and repositories is not None:
        repo, path = locate(repositories, path, repo) or (repo, path)
    return nodes.where(F.array_contains("labels", "File") & (F.col("file_path") == path)).where(provided(repo=repo, branch=branch, commit=commit)).select("id", "name", "repo", "branch", "commit", "file_path", "metadata")


def list_resources(nodes: DataFrame, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """Symbols of type resource, labelled by kind or resource type."""
    label = F.coalesce(F.expr("nullif(get_json_object(metadata, '$.kind'), '')"), F.get_json_object("metadata", "$.resource_type"))
    return list_symbols(nodes, "resource", repo, branch).withColumn("label", label)


def resolve_repository(paths: DataFrame, repositories: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, name, relative): of each absolute path its repository, that with the longest root above it.

    Roots end at a slash. A path's candidate roots are its own ancestors, so the match is an
    equality join on the ancestor and never a comparison with all roots.
    """
    parts = F.split(F.col(path_col), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    exploded = paths.select(path_col).distinct().withColumn("_root", F.explode(ancestors))
    roots = repositories.select(F.regexp_replace("root_path", "/+$", "").alias("_root"), "name").where("_root <> ''").distinct()
    met = exploded.join(roots, "_root")
    best = met.groupBy(path_col).agg(F.max(F.struct(F.length("_root").alias("n"), F.col("name"), F.col("_root"))).alias("b"))
    return best.select(path_col, F.col("b.name").alias("name"), F.expr(f"substring(`{path_col}`, b.n + 2)").alias("relative"))


def hinted(repositories: DataFrame, hint: str) -> DataFrame:
    """The repositories whose name holds the hint or whose root has a part that equals it, whatever the case."""
    return repositories.where(F.lower("name").contains(hint.lower()) | F.array_contains(F.split(F.lower("root_path"), "/"), hint.lower()))


def locate(repositories: DataFrame, path: str, hint: str | None = None) -> tuple[str, str] | None:
    """The repository of one absolute path, and the path in it."""
    one = repositories.sparkSession.createDataFrame([(path,)], "path string")
    found = resolve_repository(one, hinted(repositories, hint) if hint else repositories).first()
    return (found["name"], found["relative"]) if found else None


def _neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame | str, kind: str, given: str, wanted: str) -> DataFrame:
    """Edges of a kind whose ``given`` end is among ids, with the nodes at the other end; one row per edge."""
    chosen = edges.where(F.col("rel_type") == kind)
    if isinstance(ids, str):
        chosen = chosen.where(F.col(given) == ids)
    else:
        chosen = chosen.join(ids.select(F.col(ids.columns[0]).alias(given)).distinct(), given, "left_semi")
    ends = nodes.select(F.col("id").alias(wanted), "name", "type", "file_path")
    return chosen.select("source_id", "target_id", "confidence", F.col("metadata").alias("edge_metadata")).join(ends, wanted)


def get_callers(edges: DataFrame, nodes: DataFrame, ids: DataFrame | str) -> DataFrame:
    return _neighbours(edges, nodes, ids, "CALLS", "target_id", "source_id")


def get_callees(edges: DataFrame, nodes: DataFrame, ids: DataFrame | str) -> DataFrame:
    return _neighbours(edges, nodes, ids, "CALLS", "source_id", "target_id")


def get_imports(edges: DataFrame, nodes: DataFrame, ids: DataFrame | str) -> DataFrame:
    """What files import; the ids must be files."""
    files = nodes.where(F.array_contains("labels", "File")).select(F.col("id").alias("source_id"))
    return _neighbours(edges.join(files, "source_id", "left_semi"), nodes, ids, "IMPORTS", "source_id", "target_id")


def get_importers(edges: DataFrame, nodes: DataFrame, ids: DataFrame | str) -> DataFrame:
    """Which files import something; a resolved import ends at the file itself, not at ``module:x``."""
    files = nodes.where(F.array_contains("labels", "File"))
    return _neighbours(edges, files, ids, "IMPORTS", "target_id", "source_id")


def get_inherits(edges: DataFrame, nodes: DataFrame, ids: DataFrame | str) -> DataFrame:
    return _neighbours(edges, nodes, ids, "INHERITS", "source_id", "target_id")


def _typed(edges: DataFrame, nodes: DataFrame, owner_kind: str, relation: str, kind: str | None, repo: str | None) -> DataFrame:
    owners = nodes.where(F.col("kind") == owner_kind).where(provided(repo=repo)).select(F.col("id").alias("source_id"), F.col("name"), "repo", "branch", "file_path")
    types = nodes.where(F.col("name") == kind) if kind else nodes
    types = types.select(F.col("id").alias("target_id"), F.col("name").alias("type_name"), F.col("group").alias("type_group"))
    return owners.join(edges.where(F.col("rel_type") == relation).select("source_id", "target_id"), "source_id").join(types, "target_id").withColumnRenamed("source_id", "id").orderBy("repo", "id")


def find_xrd_for_kind(edges: DataFrame, nodes: DataFrame, kind: str | None, repo: str | None = None) -> DataFrame:
    """Composite resource definitions that define a kind."""
    return _typed(edges, nodes, "CompositeResourceDefinition", "DEFINES", kind, repo)


def find_compositions_for_kind(edges: DataFrame, nodes: DataFrame, kind: str | None, repo: str | None = None) -> DataFrame:
    """Compositions of a kind, whatever its group."""
    return _typed(edges, nodes, "Composition", "COMPOSITES", kind, repo)


def get_functions_for_composition(edges: DataFrame, nodes: DataFrame, ids: DataFrame | str) -> DataFrame:
    return _neighbours(edges, nodes, ids, "USES", "source_id", "target_id")


def file_symbols(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, symbols): each file's distinct contained symbols; a file without any has one of nulls only."""
    inside = edges.where("rel_type = 'CONTAINS'").select(F.col("source_id").alias("id"), F.col("target_id").alias("s"))
    symbols = nodes.select(F.col("id").alias("s"), F.struct("id", "name", "type", "kind", "start_line", "metadata").alias("symbol"))
    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("name", "string"), ("type", "string"), ("kind", "string"), ("start_line", "int"), ("metadata", "string"))])
    return files.select("id").join(inside.join(symbols, "s"), "id", "left").groupBy("id").agg(F.collect_set(F.coalesce("symbol", empty)).alias("symbols"))


def type_counts(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, resources, classes, functions): numbers of contained symbols by type."""
    inside = edges.where("rel_type = 'CONTAINS'").select(F.col("source_id").alias("id"), F.col("target_id").alias("s"))
    typed = inside.join(nodes.select(F.col("id").alias("s"), "type"), "s")
    count = lambda test: F.count_if(F.expr(test))
    met = files.select("id").join(typed, "id", "left")
    return met.groupBy("id").agg(count("type = 'resource'").alias("resources"), count("type = 'class'").alias("classes"), count("type in ('function', 'method')").alias("functions"))


def crossplane_chain(edges: DataFrame, nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """(role, id, name, kind) for each kind: its definitions, its compositions, and the functions these use; repeats stay."""
    wanted = kinds.select(F.col(kinds.columns[0]).alias("type_name"))
    xrds = find_xrd_for_kind(edges, nodes, None).join(wanted, "type_name")
    made = find_compositions_for_kind(edges, nodes, None).join(wanted, "type_name")
    used = made.select(F.col("id").alias("source_id"), "type_name").join(edges.where("rel_type = 'USES'").select("source_id", "target_id"), "source_id").join(nodes.select(F.col("id").alias("target_id"), "name"), "target_id")
    rows = [(xrds, "xrd", "id"), (made, "composition", "id"), (used, "function", "target_id")]
    return reduce(DataFrame.unionAll, [d.select(F.lit(role).alias("role"), F.col(i).alias("id"), "name", F.col("type_name").alias("kind")) for d, role, i in rows])


def explain_file(edges: DataFrame, nodes: DataFrame, repositories: DataFrame, path: str, repo: str | None = None) -> dict:
    """All that is known of one file: its symbols, counts, Crossplane trace and Python references.

    One file's neighbourhood is small, so the result is a plain dict. Errors are
    REPOSITORY_UNKNOWN for an absolute path below no root, and FILE_NOT_INDEXED.
    """
    if path.startswith("/"):
        found = locate(repositories, path, repo)
        if not found:
            return {"error": "REPOSITORY_UNKNOWN", "file_path": path}
        repo, path = found
    file = find_file(nodes, path, repo).orderBy("repo", "branch", "id").first()
    if not file:
        return {"error": "FILE_NOT_INDEXED", "file_path": path, "repo": repo}
    this = nodes.where(F.col("id") == file["id"]).select("id")
    inside = edges.where((F.col("rel_type") == "CONTAINS") & (F.col("source_id") == file["id"])).select(F.col("target_id").alias("id"))
    symbols = nodes.join(inside, "id", "left_semi").persist()
    rows = [r.asDict(recursive=True) for r in symbols.select("id", "name", "type", "kind", "start_line", "metadata").orderBy("start_line", "id").collect()]
    counts = type_counts(edges, nodes, this).first().asDict()
    kinds = symbols.where("type = 'resource' and kind is not null").select("kind").distinct()
    chain = [r.asDict() for r in crossplane_chain(edges, nodes, kinds).collect()] if counts["resources"] else []
    out = {"file": file.asDict(), "symbols": rows, "counts": {k: counts[k] for k in ("resources", "classes", "functions")}, "crossplane": chain}
    if counts["classes"] or counts["functions"]:
        own = symbols.select("id")
        python = {"callers": get_callers(edges, nodes, own), "callees": get_callees(edges, nodes, own), "inherits": get_inherits(edges, nodes, own), "imports": get_imports(edges, nodes, file["id"])}
        out["python"] = {k: [r.asDict(recursive=True) for r in v.collect()] for k, v in python.items()}
    symbols.unpersist()
    return out


#: What a file's explanation lists, besides its counts.
SECTIONS = ("symbols", "xrds", "compositions", "functions", "callers", "callees", "inherits", "imports")


def file_facts(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, section, item) for a table of files, ids distinct: all that ``explain_file`` says of one, a row for each thing.

    An item is a struct: id and name of the other symbol, its type and kind, ``of`` the file's own symbol or kind
    that it belongs to, and the edge's confidence. Callers, callees and bases are given for files with
    classes or functions; definitions, compositions and functions of composite types for the kinds of the file's
    resources, repeats kept. Nothing is gathered by file, so one file may hold a third of all symbols.
    """
    ids = files.select("id").distinct()
    node = nodes.select("id", "name", "type", "kind")
    inside = edges.where("rel_type = 'CONTAINS'").select(F.col("source_id").alias("file"), F.col("target_id").alias("id")).join(ids.withColumnRenamed("id", "file"), "file", "left_semi").distinct()
    held = inside.join(node, "id")
    none = F.lit(None)

    def rows(df: DataFrame, section, id_="id", of=none, confidence=none) -> DataFrame:
        item = F.struct(F.col(id_).alias("id"), "name", "type", "kind", of.cast("string").alias("of"), confidence.cast("double").alias("confidence"))
        return df.select(F.col("file").alias("id"), (section if isinstance(section, Column) else F.lit(section)).alias("section"), item.alias("item"))

    kinds = held.where("type = 'resource' and kind is not null").select("file", "kind").distinct()
    chain = crossplane_chain(edges, nodes, kinds.select("kind").distinct()).withColumnRenamed("kind", "of").join(kinds.withColumnRenamed("kind", "of"), "of")
    chain = chain.withColumn("type", none.cast("string")).withColumn("kind", none.cast("string"))
    coded = held.where("type in ('class', 'function', 'method')").select("file").distinct()
    own = inside.join(coded, "file", "left_semi").withColumnRenamed("id", "own")

    def around(relation: str, mine: str, other: str) -> DataFrame:
        met = edges.where(F.col("rel_type") == relation).select(F.col(mine).alias("own"), F.col(other).alias("id"), "confidence").join(own, "own")
        return met.join(node, "id")

    imports = edges.where("rel_type = 'IMPORTS'").select(F.col("source_id").alias("file"), F.col("target_id").alias("id"), "confidence").join(coded, "file", "left_semi").join(node, "id")
    section = F.when(F.col("role") == "xrd", "xrds").when(F.col("role") == "composition", "compositions").otherwise("functions")
    parts = [
        rows(held, "symbols"),
        rows(chain, section, of=F.col("of")),
        rows(around("CALLS", "target_id", "source_id"), "callers", of=F.col("own"), confidence=F.col("confidence")),
        rows(around("CALLS", "source_id", "target_id"), "callees", of=F.col("own"), confidence=F.col("confidence")),
        rows(around("INHERITS", "source_id", "target_id"), "inherits", of=F.col("own"), confidence=F.col("confidence")),
        rows(imports, "imports", of=F.col("file"), confidence=F.col("confidence")),
    ]
    return reduce(DataFrame.union, parts)


def explain_files(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, resources, classes, functions_count, a sorted array of items for each section) for a table of files, one nested row each.

    A row holds all of its file, as a document does; ``file_facts`` has the same, a row for each thing. Files without
    symbols have empty arrays.
    """
    facts = file_facts(edges, nodes, files).groupBy("id", "section").agg(F.array_sort(F.collect_list("item")).alias("items"))
    by_section = facts.groupBy("id").pivot("section", list(SECTIONS)).agg(F.first("items"))
    counts = type_counts(edges, nodes, files.select("id").distinct()).withColumnRenamed("functions", "functions_count")
    met = counts.join(by_section, "id", "left")
    empty = F.array().cast(facts.schema["items"].dataType)
    return met.select("id", "resources", "classes", "functions_count", *[F.coalesce(F.col(f"`{s}`"), empty).alias(s) for s in SECTIONS])


def joined_in_order(rows: DataFrame, key: str, value: str, *then: str) -> DataFrame:
    """(key, value): all values of a key with commas between, by value and then by the further columns.

    Rows are dealt out by ranges and joined in runs of 4096, so no task sorts or holds a key's rows; only the finished
    string is one value.
    """
    spark, order = rows.sparkSession, (key, value, *then)
    rows = written(rows.select(*order), "listed")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    place = F.struct("at", value)
    runs = ordered.groupBy(key, F.shiftright("at", 12).alias("run")).agg(F.array_sort(F.collect_list(place)).alias("part"))
    runs = runs.select(key, "run", F.array_join(F.transform("part", lambda x: x[value]), ",").alias("part"))
    whole = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", "part"))).alias("parts"))
    return whole.select(key, F.array_join(F.transform("parts", lambda x: x["part"]), ",").alias(value))


def summarize_files(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, resources, classes, functions_count, symbols, callees, callers, different_callers, confidence) for a table of files.

    ``explain_files`` in short: names of the symbols and ids of the callees in one string each, as ordered there, and of the callers
    their number, how many are different, and the greatest confidence. It is made from the rows of ``file_facts`` and gathers no
    file's callers.
    """
    flat = file_facts(edges, nodes, files).select("id", "section", F.col("item.id").alias("other"), F.col("item.name").alias("name"), F.col("item.of").alias("of"), F.col("item.confidence").alias("confidence"))
    symbols = joined_in_order(flat.where("section = 'symbols' and name is not null"), "id", "name", "other").withColumnRenamed("name", "symbols")
    callees = joined_in_order(flat.where("section = 'callees'"), "id", "other", "of").withColumnRenamed("other", "callees")
    each = flat.where("section = 'callers'").groupBy("id", "other").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    callers = each.groupBy("id").agg(F.sum("n").alias("callers"), F.count("*").alias("different_callers"), F.max("confidence").alias("confidence"))
    counts = type_counts(edges, nodes, files.select("id").distinct()).withColumnRenamed("functions", "functions_count")
    met = counts.join(symbols, "id", "left").join(callees, "id", "left").join(callers, "id", "left")
    return met.fillna("", ["symbols", "callees"]).fillna(0, ["callers", "different_callers"])
