"""The investigation log: investigations, their messages and findings, as appended tables."""

from __future__ import annotations

import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FINDINGS, INVESTIGATIONS, MESSAGES


def nested(investigations: DataFrame, messages: DataFrame, findings: DataFrame) -> DataFrame:
    """Investigations with their messages and findings, each in order."""
    said = messages.groupBy("investigation_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "content"))).alias("messages"))
    found = findings.groupBy("investigation_id").agg(F.sort_array(F.collect_list(F.struct("seq", "summary", "confidence", "evidence"))).alias("findings"))
    return investigations.join(said, "investigation_id", "left").join(found, "investigation_id", "left")


def recent(investigations: DataFrame, limit: int = 50) -> DataFrame:
    return investigations.orderBy(F.desc("started_at"), "investigation_id").limit(limit)


class InvestigationStore:
    """Appends to three parquet tables; ids are made here, and parents are not checked."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, table: str, ddl: str, *row: object) -> None:
        self.spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def _read(self, table: str, ddl: str) -> DataFrame:
        if not os.path.exists(f"{self.path}/{table}"):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{table}")

    def create_investigation(self, repo: str, query: str, metadata: str = "{}") -> str:
        id_ = str(uuid.uuid4())
        self._append("investigations", INVESTIGATIONS, id_, repo, query, datetime.now(UTC), metadata)
        return id_

    def add_message(self, investigation_id: str, role: str, content: str) -> None:
        now = datetime.now(UTC)
        self._append("messages", MESSAGES, investigation_id, int(now.timestamp() * 1e6), role, content, now)

    def add_finding(self, investigation_id: str, summary: str, confidence: float = 1.0, evidence: str = "{}") -> None:
        now = datetime.now(UTC)
        self._append("findings", FINDINGS, investigation_id, int(now.timestamp() * 1e6), summary, float(confidence), evidence, now)

    def get_investigation(self, investigation_id: str) -> dict | None:
        one = self._read("investigations", INVESTIGATIONS).where(F.col("investigation_id") == investigation_id)
        row = nested(one, self._read("messages", MESSAGES), self._read("findings", FINDINGS)).first()
        if row is None:
            return None
        out = row.asDict(recursive=True)
        return out | {"messages": out["messages"] or [], "findings": out["findings"] or []}

    def list_investigations(self, limit: int = 50) -> list[dict]:
        return [r.asDict() for r in recent(self._read("investigations", INVESTIGATIONS), limit).collect()]
