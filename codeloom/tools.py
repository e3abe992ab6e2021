"""The engine as functions that return JSON text, for agents."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import queries, traverse
from .operators.incremental import index_file
from .plans.build import GraphStore

AUTO_INDEX = "CODELOOM_AUTO_INDEX_MISSING"


def _text(value: object) -> str:
    return json.dumps(value, default=str)


def _rows(df: DataFrame) -> list[dict]:
    return [decode_json(r.asDict(recursive=True)) for r in df.collect()]


def decode_json(row: dict) -> dict:
    """A row whose metadata and evidence columns are decoded; text that is no JSON stays."""
    out = dict(row)
    for key in ("metadata", "evidence"):
        if isinstance(out.get(key), str):
            try:
                out[key] = json.loads(out[key])
            except ValueError:
                pass
    return out


def explain_file(store: GraphStore, file_path: str, repo: str | None = None, index_if_missing: bool = True) -> dict:
    """Explain a file; first index it if it changed, where both the caller and the environment allow that.

    ``on_demand_indexing`` is what indexing it gave, ``index_status`` says that nothing had to be
    done, ``index_warning`` is the error of an indexing that failed for a file that is known.
    """
    allowed = index_if_missing and os.environ.get(AUTO_INDEX, "true").lower() in ("1", "true", "yes", "on")
    status = index_file(store, file_path, repo) if allowed else None
    graph = store.read()
    found = queries.explain_file(graph.edges, graph.nodes, graph.repositories, file_path, repo)
    if status is None:
        return found
    failed = status["status"] == "error"
    if "error" in found:
        return status if failed else found
    if failed:
        return found | {"index_warning": status}
    return found | ({"index_status": "up_to_date"} if status["status"] == "up_to_date" else {"on_demand_indexing": status})


class Tools:
    """The six tools over one store."""

    def __init__(self, store: GraphStore):
        self.store = store

    def explain_file(self, file_path: str, repo: str | None = None, index_if_missing: bool = True) -> str:
        return _text(explain_file(self.store, file_path, repo, index_if_missing))

    def find_symbol(self, name: str, repo: str | None = None, branch: str | None = None) -> str:
        return _text(_rows(queries.find_symbol(self.store.read().nodes, name, repo, branch)))

    def find_xrd(self, kind: str, repo: str | None = None) -> str:
        g = self.store.read()
        return _text(_rows(queries.find_xrd_for_kind(g.edges, g.nodes, kind, repo)))

    def find_compositions(self, kind: str, repo: str | None = None) -> str:
        g = self.store.read()
        return _text(_rows(queries.find_compositions_for_kind(g.edges, g.nodes, kind, repo)))

    def trace_execution_flow(self, symbol_id: str, depth: int = 10) -> str:
        """What a symbol calls, directly and indirectly."""
        return _text(_rows(traverse.trace_execution_flow(self.store.read().edges, symbol_id, depth, 20)))

    def list_repositories(self) -> str:
        return _text(_rows(queries.list_repositories(self.store.read().repositories).withColumn("commit", F.left("commit", F.lit(8)))))
