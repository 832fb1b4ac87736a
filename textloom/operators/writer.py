"""Writes rules as a transaction: a data source whose tasks stage files beside their targets, and whose commit backs up and publishes them.

Nothing that exists changes before all tasks have ended; a task that fails leaves every output as it was, and so does a commit that
breaks off: what it has published by then is put back. The driver sees paths, never contents. ``root`` must be a folder that the driver and
all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .writing import KEPT_BACKUPS

#: Where a write keeps what it stages and its result, under the root.
STAGED = ".textloom/staged"


@dataclass(frozen=True)
class Written:
    format: str
    path: str
    status: str
    backup: str | None = None


class WriteConflict(Exception):
    pass


def copied(path: Path) -> Path:
    """A copy of a file under ``name.bak``, or under a timed name if that is taken."""
    target = path.with_name(path.name + ".bak")
    if target.exists():
        target = path.with_name(f"{path.name}.{datetime.now(UTC):%Y%m%d_%H%M%S%f}.bak")
    shutil.copy2(path, target)
    target.touch()
    return target


def pruned(path: Path, keep: int = KEPT_BACKUPS) -> None:
    """All but the newest ``keep`` backups of a file go."""
    held = sorted(path.parent.glob(f"{path.name}*.bak"), key=lambda p: (p.stat().st_mtime_ns, p.name), reverse=True)
    for old in held[keep:]:
        old.unlink()


def backup(path: Path, keep: int = KEPT_BACKUPS) -> Path:
    target = copied(path)
    pruned(path, keep)
    return target


#: Answers to a conflict; with " all" after it, one of the first three holds for all files that are left.
CHOICES = ("overwrite", "skip", "merge", "quit")


def settled(planned: list[Row], ask: Callable[[str, str], str] | None = None) -> list[tuple[str, str, str]]:
    """(format, path, action) with no conflict left, before anything is paid for or written. ``ask`` (path, format) gives one of ``CHOICES``."""
    out, always = [], None
    for r in sorted(planned, key=lambda r: r["format"]):
        action = r["action"]
        if action == "ask" and ask is not None:
            answer = always or ask(r["path"], r["format"])
            action = answer.removesuffix(" all")
            if action not in CHOICES:
                raise ValueError(f"no such choice: {answer}")
            if answer.endswith(" all"):
                always = action
        if action == "quit":
            raise WriteConflict(f"stopped at {r['path']}")
        if action in ("ask", "error"):
            raise WriteConflict(f"{r['path']} exists and nobody can be asked (non-interactive): choose --on-conflict overwrite or skip")
        out.append((r["format"], r["path"], action))
    return out


@dataclass
class Staged(WriterCommitMessage):
    """(format, path, action, staged file) of the rows of a task."""

    files: list[tuple[str, str, str, str | None]]


def published(files: list[tuple[str, str, str, str | None]], root: str, keep: int = KEPT_BACKUPS) -> list[Written]:
    """Puts staged files (format, path, action, staged) in place, all or none."""
    paths = [path for _, path, action, _ in files if action != "skip"]
    if twice := {p for p in paths if paths.count(p) > 1} if len(paths) != len(set(paths)) else set():
        raise ValueError(f"more than one content for {sorted(twice)}")
    out: list[Written] = []
    done: list[tuple[Path, Path | None]] = []
    try:
        for format_, path, action, staged in sorted(files):
            if action == "skip":
                out.append(Written(format_, path, "skipped"))
                continue
            target, kept, status = Path(root) / path, None, "new"
            if target.exists():
                status = "merged" if action == "merge" else "backup"
                kept = copied(target)
            done.append((target, kept))
            target.parent.mkdir(parents=True, exist_ok=True)
            os.replace(staged, target)
            out.append(Written(format_, path, status, str(kept) if kept else None))
    except BaseException:
        for target, kept in reversed(done):
            if kept:
                os.replace(kept, target)
            elif target.is_file():
                target.unlink()
        raise
    for target, _ in done:
        pruned(target, keep)
    return out


class RulesWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.mark = options["path"], options["mark"]
        self.keep = int(options.get("keep", KEPT_BACKUPS))

    @property
    def staging(self) -> Path:
        return Path(self.root) / STAGED / self.mark

    def write(self, iterator: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        own = self.staging / f"{task.partitionId()}-{task.taskAttemptId()}"
        files = []
        for i, r in enumerate(iterator):
            path = Path(r["path"])
            if path.is_absolute() or ".." in path.parts:
                raise ValueError(f"{path} is outside of the project")
            staged = None
            if r["action"] != "skip":
                own.mkdir(exist_ok=True)  # not its parent: that is gone once the write is called off
                staged = own / str(i)
                staged.write_text(r["content"], encoding="utf-8")
            files.append((r["format"], r["path"], r["action"], str(staged) if staged else None))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        try:
            done = published([f for m in messages if m for f in m.files], self.root, self.keep)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)
        self.staging.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{self.staging}.json", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(asdict(w)) + "\n" for w in done)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class RulesTarget(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rules"

    def schema(self) -> str:
        return "format string, path string, action string, content string"

    def writer(self, schema, overwrite: bool) -> RulesWriter:  # noqa: ANN001
        return RulesWriter(dict(self.options))


def write(planned: DataFrame, root: str, keep: int = KEPT_BACKUPS) -> list[Written]:
    """Settled writes (format, path, action, content) under ``root``, in the order of formats; paths may be those of many projects. The content of a merge is
    merged already."""
    spark, mark = planned.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(RulesTarget)
    rows = planned.select("format", "path", "action", "content")
    staging, manifest = Path(root) / STAGED / mark, Path(root) / STAGED / f"{mark}.json"
    staging.mkdir(parents=True)
    try:
        rows.write.format("rules").option("path", os.path.abspath(root)).option("mark", mark).option("keep", str(keep)).mode("append").save()
        with open(manifest, encoding="utf-8") as f:
            return [Written(**json.loads(line)) for line in f]
    finally:
        shutil.rmtree(staging, ignore_errors=True)  # tasks that ended late may have left something
        manifest.unlink(missing_ok=True)
