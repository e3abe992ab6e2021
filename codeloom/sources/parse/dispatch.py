"""Parsing files inside Spark tasks: a files table in, symbols and relationships out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schemas import EVIDENCE, RELATIONSHIPS, SYMBOLS
from .base import Source
from .go_source import parse_go
from .hcl_source import parse_hcl
from .python_source import parse_python
from .yaml_source import parse_yaml

PARSERS: dict[str, Callable[[Source, bool], None]] = {"python": parse_python, "yaml": parse_yaml, "hcl": parse_hcl, "go": parse_go}

_SYMBOL = "STRUCT<id STRING, name STRING, type STRING, kind STRING, `group` STRING, start_line INT, start_col INT, end_line INT, end_col INT, parent_id STRING, metadata STRING>"
_RELATION = f"STRUCT<source_id STRING, target_id STRING, rel_type STRING, confidence DOUBLE, evidence ARRAY<{EVIDENCE}>, metadata MAP<STRING, STRING>>"
PARSED = f"repo STRING, branch STRING, commit STRING, path STRING, seq INT, symbol {_SYMBOL}, relationship {_RELATION}, error STRING"


def register_parser(language: str, parser: Callable[[Source, bool], None]) -> None:
    PARSERS[language] = parser


def parser_for(language: str) -> Callable[[Source, bool], None]:
    if language not in PARSERS:
        raise ValueError(f"no parser for {language}")
    return PARSERS[language]


def parse_one(repo: str, branch: str, commit: str, path: str, language: str, content: bytes, strict: bool = False) -> Source:
    """Parse one file here; errors of its syntax are raised."""
    source = Source(repo, branch, commit, path, content)
    parser_for(language)(source, strict)
    return source


def parse(files: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of each file in order, symbols first: one of symbol, relationship or error is set.

    A file that does not parse gives an error row and nothing else; files in languages
    without a parser give nothing. Large files are dealt out by their hash first.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for repo, branch, commit, path, language, content in frame.itertuples(index=False):
                try:
                    s = parse_one(repo, branch, commit, path, language, bytes(content), strict)
                    found = [(x, None, None) for x in s.symbols] + [(None, x, None) for x in s.relationships]
                except Exception as e:  # one bad file must not lose the others
                    found = [(None, None, f"{type(e).__name__}: {e}"[:500])]
                if found:
                    yield pd.DataFrame([(repo, branch, commit, path, i, *x) for i, x in enumerate(found)], columns=["repo", "branch", "commit", "path", "seq", "symbol", "relationship", "error"])

    wanted = files.where(F.col("language").isin(*PARSERS) & F.col("content").isNotNull())
    return wanted.select("repo", "branch", "commit", "path", "language", "content").mapInPandas(run, PARSED)


def _file_id():
    return F.concat_ws(":", "repo", "branch", "path")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """The parsed symbols as a symbols table."""
    rows = parsed.where("symbol is not null")
    ord_ = F.struct("path", "seq")
    return rows.select(
        "symbol.id", "repo", "branch", "commit", "symbol.name", "symbol.type", "symbol.kind", "symbol.group", F.col("path").alias("file_path"),
        "symbol.start_line", "symbol.start_col", "symbol.end_line", "symbol.end_col", "symbol.parent_id", "symbol.metadata",
        _file_id().alias("file_id"), ord_.alias("ord"),
    ).to(parsed.sparkSession.createDataFrame([], SYMBOLS).schema)


def relationships_of(parsed: DataFrame) -> DataFrame:
    """The parsed relationships as a relationships table."""
    rows = parsed.where("relationship is not null")
    return rows.select(
        "relationship.source_id", "relationship.target_id", "relationship.rel_type", "repo", "branch", "commit",
        "relationship.confidence", "relationship.evidence", "relationship.metadata", F.struct("path", "seq").alias("ord"),
    ).to(parsed.sparkSession.createDataFrame([], RELATIONSHIPS).schema)


def file_symbols(files: DataFrame) -> DataFrame:
    """A symbol of type file for each file; its order precedes all others of the file."""
    metadata = F.to_json(F.struct("language", "size", "content_hash"))
    none = F.lit(None)
    return files.select(
        _file_id().alias("id"), "repo", "branch", "commit", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit("file").alias("type"),
        none.cast("string").alias("kind"), none.cast("string").alias("group"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.lit(0).alias("start_col"),
        F.lit(1).alias("end_line"), F.lit(0).alias("end_col"), none.cast("string").alias("parent_id"), metadata.alias("metadata"),
        _file_id().alias("file_id"), F.struct("path", F.lit(-1).alias("seq")).alias("ord"),
    ).to(files.sparkSession.createDataFrame([], SYMBOLS).schema)
