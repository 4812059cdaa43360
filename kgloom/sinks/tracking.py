"""Experiment tracking: what a run was given and what came of it, for any tracker."""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path
from typing import Protocol


class Tracker(Protocol):
    """What a run calls: ``begin`` once, ``log`` as often as there are metrics, ``end`` once, whatever happens."""

    def begin(self, name: str, config: dict) -> None: ...

    def log(self, metrics: dict, files: list[str] = ()) -> None: ...

    def end(self, failed: str | None = None) -> None: ...


class FileTracker:
    """A folder with one file of JSON lines a run: the configuration, each set of metrics with the files
    beside it, and how the run ended. Lines are whole when written, so a run that dies leaves what it
    had logged."""

    def __init__(self, folder: str):
        self.folder, self.path = Path(folder), None

    def begin(self, name: str, config: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        safe = "".join(c if c.isalnum() or c in "-_." else "_" for c in name) or "run"
        self.path = self.folder / f"{safe}-{uuid.uuid4().hex[:8]}.jsonl"
        self._write(event="begin", name=name, config=config)

    def log(self, metrics: dict, files: list[str] = ()) -> None:
        self._write(event="log", metrics=metrics, files=list(files))

    def end(self, failed: str | None = None) -> None:
        self._write(event="end", failed=failed)

    def _write(self, **row) -> None:
        if self.path is None:
            raise RuntimeError("the run has not begun")
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({**row, "time": time.time()}, ensure_ascii=False, default=str) + "\n")


class tracked:
    """Begins a run, and ends it as failed where the block raises. Without a tracker nothing happens."""

    def __init__(self, tracker: Tracker | None, name: str, config: dict):
        self.tracker, self.name, self.config = tracker, name, config

    def __enter__(self):
        if self.tracker is not None:
            self.tracker.begin(self.name, self.config)
        return self

    def log(self, metrics: dict, files: list[str] = ()) -> None:
        if self.tracker is not None:
            self.tracker.log(metrics, files)

    def __exit__(self, kind, error, trace) -> None:
        if self.tracker is not None:
            self.tracker.end(None if error is None else f"{kind.__name__}: {error}")
