"""What a run leaves behind: metadata, events, a summary."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path
from typing import Any


def _now() -> datetime:
    return datetime.now(UTC)


class Reporter:
    def __init__(self, runs_dir: str, command: str, run_id: str | None = None, **metadata: Any):
        self.run_id = run_id or f"{command}-{_now():%Y%m%dT%H%M%SZ}-{os.getpid()}"
        self.path = Path(runs_dir) / self.run_id
        self.path.mkdir(parents=True, exist_ok=True)
        self.write("metadata.json", {"command": command, "run_id": self.run_id, "created_at": _now().isoformat(), **metadata})

    def write(self, name: str, body: Any) -> Path:
        out = self.path / name
        out.write_text(json.dumps(body, indent=2, sort_keys=True, default=str), encoding="utf-8")
        return out

    def event(self, kind: str, **body: Any) -> None:
        with (self.path / "events.jsonl").open("a", encoding="utf-8") as f:
            f.write(json.dumps({"at": _now().isoformat(), "event": kind, **body}, sort_keys=True, default=str) + "\n")

    def started(self, stage: str) -> None:
        self.event("stage_started", stage=stage)

    def completed(self, stage: str, outcome: dict) -> None:
        self.event("stage_completed", stage=stage, outcome=outcome)

    def failed(self, stage: str, error: Exception) -> None:
        self.event("stage_failed", stage=stage, error=str(error))

    def finish(self, results: list[tuple[str, dict]], failed_stage: str | None = None, error: str | None = None) -> dict:
        body = {"run_id": self.run_id, "artifact_dir": str(self.path), "success": failed_stage is None, "failed_stage": failed_stage, "error": error, "results": [{"stage": s, "outcome": o} for s, o in results]}
        self.write("summary.json", body)
        return body


def latest_run(runs_dir: str) -> dict | None:
    found = sorted(Path(runs_dir).glob("*/summary.json"), key=lambda p: p.stat().st_mtime)
    return json.loads(found[-1].read_text(encoding="utf-8")) if found else None
