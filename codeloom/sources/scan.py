"""Scanning source trees: which files there are, their languages, bytes and hashes."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import IGNORED_DIRS, LANGUAGES

#: Files above this size are not indexed one at a time.
MAX_FILE_BYTES = 5 * 1024 * 1024


def language_of_name(path: str, languages: dict[str, str] = LANGUAGES) -> str | None:
    return languages.get(os.path.splitext(path)[1].lower())


def walk(root: str, ignored: Sequence[str] = IGNORED_DIRS) -> Iterator[tuple[str, str, int]]:
    """(path, language, size) of every indexed file below root, in path order of each directory; unreadable ones are left out."""
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in ignored)
        for name in sorted(names):
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root).replace(os.sep, "/")
            language = language_of_name(path)
            if language:
                try:
                    yield path, language, os.stat(full).st_size
                except OSError:
                    continue


def git_info(path: str) -> dict[str, object]:
    """Repository name, root, branch, commit and whether it has changes; outside git the path itself and ``unknown``."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    root = git("rev-parse", "--show-toplevel") or os.path.abspath(path)
    return {
        "repo_name": os.path.basename(root),
        "root_path": root,
        "branch": git("rev-parse", "--abbrev-ref", "HEAD") or "unknown",
        "commit": git("rev-parse", "HEAD") or "unknown",
        "dirty": bool(git("status", "--porcelain")),
    }


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, ignored: Sequence[str], parts: int):
        self.root, self.ignored, self.parts = root, ignored, parts

    def partitions(self) -> Sequence[InputPartition]:
        """One partition per share of the top level, so that executors list large trees together."""
        top = sorted(os.listdir(self.root))
        shares = [top[i :: self.parts] for i in range(self.parts)]
        return [InputPartition(s) for s in shares if s] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.value:
            full = os.path.join(self.root, name)
            if os.path.isdir(full) and not os.path.islink(full):
                found: Iterable = () if name in self.ignored else ((f"{name}/{p}", lang, n) for p, lang, n in walk(full, self.ignored))
            else:
                language = language_of_name(name)
                found = [(name, language, os.stat(full).st_size)] if language and os.path.isfile(full) else ()
            yield from found


class SourceTree(DataSource):
    """Files of a source tree on a file system that all executors share, names with a leading _ or . too.

    Options: ``path``; ``ignored``, a comma-separated list of directory names; ``parts``.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, language string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        ignored = self.options.get("ignored")
        return _TreeReader(self.options["path"], ignored.split(",") if ignored else IGNORED_DIRS, int(self.options.get("parts", 8)))


def scan(spark: SparkSession, root: str, repo: str | None = None, branch: str | None = None, commit: str | None = None, ignored: Sequence[str] = IGNORED_DIRS) -> DataFrame:
    """The files table of a source tree, with content and hash; files are read by the executors.

    A file that cannot be read has null content.
    """
    info = git_info(root) if None in (repo, branch, commit) else {}
    repo, branch, commit = repo or info["repo_name"], branch or info["branch"], commit or info["commit"]
    spark.dataSource.register(SourceTree)
    listed = spark.read.format("source_tree").option("path", root).option("ignored", ",".join(ignored)).load()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    with open(os.path.join(root, row.column(0)[0].as_py()), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=["path", "language", "size", "content"])

    files = listed.mapInArrow(load, "path string, language string, size bigint, content binary")
    return with_identity(files, repo, branch, commit, root)


def with_identity(files: DataFrame, repo: str, branch: str, commit: str, root: str) -> DataFrame:
    """Complete (path, language, size, content) to a files table."""
    return files.select(
        F.lit(repo).alias("repo"), F.lit(branch).alias("branch"), F.lit(commit).alias("commit"), F.lit(root).alias("root_path"),
        "path", "language", "size", "content", F.sha2("content", 256).alias("content_hash"),
    )
