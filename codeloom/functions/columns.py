"""Column functions of the code graph: paths, languages, addresses, identifiers, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that are indexed, and their languages.
LANGUAGES = {
    ".py": "python",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".tf": "hcl",
    ".tfvars": "hcl",
    ".hcl": "hcl",
    ".go": "go",
    ".md": "markdown",
    ".json": "json",
}
#: Directory names that are never indexed.
IGNORED_DIRS = (".git", ".venv", "__pycache__", "node_modules", ".idea", ".vscode", "build", "dist")
#: Roots of Terraform references that name no definition.
META_ROOTS = ("self", "count", "each", "path", "terraform")
TOKEN = r"[a-z_][a-z0-9_]*"


def extension(path: Column) -> Column:
    """The lower-cased last extension; none for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^\.*[^.].*(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, null where it is not indexed."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, extension(path))


def in_ignored_dir(path: Column, names: tuple[str, ...] = IGNORED_DIRS) -> Column:
    """Whether a directory of the path has one of the names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def is_ignored(path: Column, names: tuple[str, ...] = IGNORED_DIRS) -> Column:
    """Whether any part of the path, the file's name too, has one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def within_size(content: Column, limit: int = 5 * 1024 * 1024) -> Column:
    """Whether a file is small enough to be indexed alone."""
    return F.octet_length(content) <= limit


def module_path(path: Column) -> Column:
    """The dotted module of a file: without .py, slashes as dots; other extensions stay."""
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def qualified_name(id_: Column) -> Column:
    return F.element_at(F.split(id_, ":"), -1)


def path_to_address(parts: Column) -> Column:
    """The Terraform definition that a reference's parts name; null if none."""
    root, second, third = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    size = F.size(parts)
    return (
        F.when(root.isin(*META_ROOTS), None)
        .when((root == "data") & (size >= 3), F.concat_ws(".", root, second, third))
        .when(size >= 2, F.concat_ws(".", root, second))
    )


def tokenize(text: Column) -> Column:
    """Identifiers of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def provided(**equal: str | None) -> Column:
    """All given equalities; an empty or missing value is no condition."""
    tests = [F.col(name) == value for name, value in equal.items() if value]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def stub_category(id_: Column) -> Column:
    """Category of a node known only as an edge's end."""
    return (
        F.when(id_.startswith("module:") | id_.startswith("fn:"), "external")
        .when(id_.startswith("unresolved:"), "unresolved")
        .when(id_.startswith("xrdtype:"), "placeholder")
        .otherwise("symbol_ref")
    )


def stub_type(id_: Column) -> Column:
    return (
        F.when(id_.startswith("module:"), "module")
        .when(id_.startswith("unresolved:"), "unknown")
        .when(id_.startswith("fn:"), "function_ref")
        .when(id_.startswith("xrdtype:"), "resource_type")
    )


def stub_name(id_: Column) -> Column:
    """What follows the prefix; for a composite type its last part; null for a plain reference."""
    return F.when(id_.startswith("xrdtype:"), qualified_name(id_)).when(id_.rlike("^(module|unresolved|fn):"), F.regexp_replace(id_, "^[a-z]+:", ""))
