"""Keeping a graph up to date from a stream of files (an addition: the batch operators' semantics, run on arrivals)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import refresh
from ..operators.merge import last_wins
from ..plans.build import GraphStore


def refresh_on_arrival(files: DataFrame, store: GraphStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Put each micro-batch of a streaming files table over the stored graph.

    Of several versions of a file in one batch the one with the greatest hash counts, so a
    batch that is run again after a failure gives the same graph.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            latest = last_wins(rows, ["repo", "branch", "path"], "content_hash")
            graph, _status = refresh(store.read(), latest)
            store.write(graph)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
