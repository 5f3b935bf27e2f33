"""Experiment governance on the driver: run records, hold-out locks, job status."""

from __future__ import annotations

import json
import os
import subprocess
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantweft.sources.ledgers import append_row


def git_state(root: str | Path) -> tuple[str | None, bool]:
    """(commit, whether there are uncommitted changes); (None, False) outside a repository."""
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True, text=True, check=False)
    head = run("rev-parse", "HEAD")
    return (head.stdout.strip(), bool(run("status", "--porcelain").stdout.strip())) if head.returncode == 0 else (None, False)


class HoldOut:
    """A period that results must not touch before it is opened, once, by writing its lock."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def define(self, start: date, end: date) -> None:
        if self.path.exists():
            raise FileExistsError(f"hold-out period is defined: {self.path}")
        if end < start:
            raise ValueError("the period ends before it starts")
        self.path.write_text(json.dumps({"start": start.isoformat(), "end": end.isoformat(), "opened": None}))

    def period(self) -> tuple[date, date] | None:
        if not self.path.exists():
            return None
        d = json.loads(self.path.read_text())
        return date.fromisoformat(d["start"]), date.fromisoformat(d["end"])

    def open(self, note: str) -> None:
        d = json.loads(self.path.read_text())
        if d["opened"]:
            raise PermissionError("the hold-out period was opened before")
        tmp = self.path.with_suffix(".tmp")
        tmp.write_text(json.dumps(d | {"opened": {"at": datetime.now(UTC).isoformat(), "note": note}}))
        os.replace(tmp, self.path)

    def check(self, start: date, end: date) -> None:
        """Raises if [start, end] overlaps a period that has not been opened (both ends belong to it)."""
        p = self.period()
        if p and start <= p[1] and end >= p[0] and not json.loads(self.path.read_text())["opened"]:
            raise PermissionError(f"{start}..{end} overlaps the hold-out period")


@contextmanager
def run_record(ledger: str | Path, label: str, config: dict, root: str | Path, period: tuple[date, date] | None = None, hold_out: HoldOut | None = None, need_clean: bool = True) -> Iterator[dict]:
    """A run: checks the work tree and the hold-out period, writes a start row, yields a dict for results, writes an end row."""
    if not label.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"bad label: {label}")
    sha, dirty = git_state(root)
    if need_clean and dirty:
        raise RuntimeError("uncommitted changes")
    if hold_out and period:
        hold_out.check(*period)
    run_id, result = uuid.uuid4().hex, {}
    now = lambda: datetime.now(UTC).isoformat()
    append_row(ledger, {"run_id": run_id, "event": "start", "label": label, "config": config, "sha": sha, "ts": now()})
    try:
        yield result
    except BaseException as e:
        append_row(ledger, {"run_id": run_id, "event": "end", "status": "failed", "error": f"{type(e).__name__}: {e}", "ts": now()}, durable=True)
        raise
    append_row(ledger, {"run_id": run_id, "event": "end", "status": "ok", "result": result, "ts": now()}, durable=True)


def status_table(rows: DataFrame, days: list[str]) -> DataFrame:
    """(repo, job, a column a day): the last status of each job and day."""
    last = rows.groupBy("repo", "job", "day").agg(F.max_by("status", "ts").alias("status"))
    return last.groupBy("repo", "job").pivot("day", days).agg(F.first("status"))
