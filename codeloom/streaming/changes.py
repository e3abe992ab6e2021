"""Telling new, changed and known files apart on a stream, with each file's last hash as state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATUSES = "file_id string, content_hash string, version string, status string"
#: The store that keeps such state; and no batches without data, which a stream that looks at the time would make without end.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class _LastHashes(StatefulProcessor):
    """The files of a group: one state and one frame for all of them, as a call of the store costs more than a file's work."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "files string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[str, tuple[str, str]] = {}
        for frame in rows:
            for file_id, *pair in zip(frame["file_id"], frame["version"], frame["content_hash"].fillna("")):
                latest[file_id] = max(latest.get(file_id, tuple(pair)), tuple(pair))
        now = 0 if self.keep_ms is None else timerValues.getCurrentProcessingTimeInMs()
        held = json.loads(self.last.get()[0]) if self.last.exists() else {}
        if self.keep_ms is not None:
            held = {f: v for f, v in held.items() if v[1] + self.keep_ms > now}
        out = []
        for file_id, (version, digest) in latest.items():
            known = held.get(file_id)
            out.append((file_id, digest or None, version, "created" if known is None else "up_to_date" if digest and known[0] == digest else "refreshed"))
            held[file_id] = [digest, now]
        self.last.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["file_id", "content_hash", "version", "status"])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings with which a stream with such state is started; then they are as before."""
    before = {name: spark.conf.get(name) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def classify_stream(files: DataFrame, keep_ms: int | None = None, groups: int = 4096) -> DataFrame:
    """(file_id, content_hash, version, status) for a stream of (file_id, content_hash, version): as ``classify`` says, without reading what is stored.

    Status is created for a file that is not remembered, up_to_date if its hash is that remembered, else refreshed; a file without a
    hash is always refreshed, or created. Of several versions in one batch the greatest counts, then the greatest hash, and
    gives one row. With ``keep_ms`` a file is forgotten so long after it was last seen, and is then created
    again; else it is remembered for good. Rows with a null id are left out. Files share a state by the hash of their id, in as many
    ``groups``, which a checkpoint keeps. Start it inside ``keyed_state``.
    """
    known = files.where("file_id is not null").select("file_id", "content_hash", F.coalesce(F.col("version").cast("string"), F.lit("")).alias("version"))
    grouped = known.withColumn("group", F.pmod(F.xxhash64("file_id"), F.lit(groups)))
    return grouped.groupBy("group").transformWithStateInPandas(_LastHashes(keep_ms), STATUSES, "append", "none" if keep_ms is None else "processingTime")
