"""Tables of the code graph: their schemas, enumerations and identifiers."""

from __future__ import annotations

EVIDENCE = "STRUCT<type STRING, file_path STRING, start_line INT, start_col INT, end_line INT, end_col INT, confidence DOUBLE>"
#: Later rows overrule earlier ones in the order of paths, then within a file.
ORD = "STRUCT<path STRING, seq INT>"
FILES = "repo STRING, branch STRING, commit STRING, root_path STRING, path STRING, language STRING, size BIGINT, content BINARY, content_hash STRING"
SYMBOLS = (
    "id STRING, repo STRING, branch STRING, commit STRING, name STRING, type STRING, kind STRING, `group` STRING, file_path STRING, "
    f"start_line INT, start_col INT, end_line INT, end_col INT, parent_id STRING, metadata STRING, file_id STRING, ord {ORD}"
)
RELATIONSHIPS = (
    "source_id STRING, target_id STRING, rel_type STRING, repo STRING, branch STRING, commit STRING, confidence DOUBLE, "
    f"evidence ARRAY<{EVIDENCE}>, metadata MAP<STRING, STRING>, ord {ORD}"
)
REPOSITORIES = "name STRING, branch STRING, commit STRING, root_path STRING, indexed_at TIMESTAMP"
NODES = SYMBOLS + ", labels ARRAY<STRING>, category STRING"
EDGES = (
    "source_id STRING, target_id STRING, rel_type STRING, repo STRING, branch STRING, commit STRING, confidence DOUBLE, "
    f"evidence ARRAY<{EVIDENCE}>, metadata MAP<STRING, STRING>, resolution_status STRING, resolver STRING"
)
INVESTIGATIONS = "investigation_id STRING, repo STRING, query STRING, started_at TIMESTAMP, metadata STRING"
MESSAGES = "investigation_id STRING, seq BIGINT, role STRING, content STRING, created_at TIMESTAMP"
FINDINGS = "investigation_id STRING, seq BIGINT, summary STRING, confidence DOUBLE, evidence STRING, created_at TIMESTAMP"


def file_id(repo: str, branch: str, path: str) -> str:
    """A file node's id; the commit is no part of it."""
    return f"{repo}:{branch}:{path}"


def symbol_id(repo: str, branch: str, path: str, qualified: str) -> str:
    return f"{repo}:{branch}:{path}:{qualified}"
