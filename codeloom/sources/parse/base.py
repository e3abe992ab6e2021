"""What parsers share: rows for symbols and relationships, and positions in bytes."""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field

from ...schemas import file_id, symbol_id


@dataclass
class Source:
    """One file while it is parsed; collects its rows in order."""

    repo: str
    branch: str
    commit: str
    path: str
    data: bytes
    symbols: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.file = file_id(self.repo, self.branch, self.path)
        self.lines = [0]
        at = self.data.find(b"\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = self.data.find(b"\n", at + 1)

    def id(self, qualified: str) -> str:
        return symbol_id(self.repo, self.branch, self.path, qualified)

    def point(self, at: int) -> tuple[int, int]:
        """Line from 1 and byte column from 0 of a byte offset."""
        line = bisect_right(self.lines, at) - 1
        return line + 1, at - self.lines[line]

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        return (*self.point(start), *self.point(end))

    def symbol(self, id_: str, name: str, type_: str, span: tuple[int, int, int, int], parent: str | None = None, **metadata: object) -> str:
        self.symbols.append({
            "id": id_, "name": name, "type": type_, "kind": metadata.get("kind"), "group": metadata.get("group"),
            "start_line": span[0], "start_col": span[1], "end_line": span[2], "end_col": span[3],
            "parent_id": parent, "metadata": json.dumps(metadata),
        })
        return id_

    def relate(self, source: str, target: str, kind: str, span: tuple[int, int, int, int], confidence: float = 1.0, evidence: float = 0.95, evidence_type: str = "static", columns: bool = True, **metadata: str) -> None:
        proof = {"type": evidence_type, "file_path": self.path, "start_line": span[0], "start_col": span[1] if columns else None, "end_line": span[2], "end_col": span[3] if columns else None, "confidence": evidence}
        self.relationships.append({"source_id": source, "target_id": target, "rel_type": kind, "confidence": confidence, "evidence": [proof], "metadata": metadata})
