"""A run's working folder: stage tables, the saved state, cleaning up, and keeping the folder out of version control."""

from __future__ import annotations

import logging
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from . import state

DAY = 24 * 3600
STATE = "state.json"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Cleaned:
    deleted: int = 0
    failed: int = 0
    skipped: int = 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on a single machine without one, a new folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to a table of its own in the shared folder and read back; ``options`` are the writer's."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written or collected within leaves no shuffle files behind. Otherwise they stay until the driver's JVM happens to collect their plans. A frame
    isn't to be run twice within, for its second run would miss them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where their source has less than half as many splits as there are cores: a few small files. Larger inputs
    are read as they are, without a shuffle."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if 2 * size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else rows


class Workspace:
    """``shared`` is a folder that driver and executors see: stage tables and model answers go there. State stays on the driver."""

    def __init__(self, home: str, shared: str | None = None) -> None:
        self.home, self.shared = Path(home), shared or f"{home}/stages"
        self.home.mkdir(mode=0o700, parents=True, exist_ok=True)
        #: What was observed of each staged table.
        self.metrics: dict[str, dict] = {}

    def stage(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """``df`` written as the table ``name`` and read back, so that what follows starts from rows, not from a lineage. Aggregates of its rows are
        observed while it is written, without a job of their own, and kept in ``metrics``."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}") if metrics else None
        rows = df.observe(seen, *[c.alias(m) for m, c in metrics.items()]) if seen else df
        rows.write.mode("overwrite").parquet(f"{self.shared}/{name}")
        if seen:
            self.metrics[name] = seen.get
        return self.read(df.sparkSession, name, df.schema)

    def read(self, spark: SparkSession, name: str, schema=None) -> DataFrame:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(f"{self.shared}/{name}")

    def load_state(self) -> state.State | None:
        return state.load(self.home / STATE)

    def save_state(self, value: state.State) -> None:
        state.save(value, self.home / STATE)

    def clean(self, older_than: float | None = None, now: float | None = None) -> Cleaned:
        """Deletes the folder's files, or those strictly older than so many seconds. Folders and the state stay; times that lie ahead are skipped."""
        now = time.time() if now is None else now
        deleted = failed = skipped = 0
        for p in sorted(self.home.iterdir()):
            age = now - p.stat().st_mtime
            if p.is_dir() or p.name == STATE or older_than is not None and (age < 0 or age <= older_than):
                skipped += 1
                continue
            try:
                p.unlink()
                deleted += 1
            except OSError as e:
                log.warning("%s stays: %s", p, e)
                failed += 1
        return Cleaned(deleted, failed, skipped)


#: Folders of a run's tables that no later run needs; answers of models are none of them.
SWEPT = ("stages", "requests", "calls")


def sweep(spark: SparkSession, work: str, older_than: float = DAY, now: float | None = None) -> Cleaned:
    """Deletes stage tables, requests and calls under ``work`` that are strictly older than so many seconds, on whatever file system it is; answers stay, since
    a later run may use them. Times that lie ahead are skipped."""
    now = time.time() if now is None else now
    deleted = failed = skipped = 0
    jvm = spark._jvm
    for name in SWEPT:
        home = jvm.org.apache.hadoop.fs.Path(f"{work}/{name}")
        system = home.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(home):
            continue
        for status in system.listStatus(home):
            age = now - status.getModificationTime() / 1000
            if age <= older_than:
                skipped += 1
            elif system.delete(status.getPath(), True):
                deleted += 1
            else:
                log.warning("%s stays", status.getPath())
                failed += 1
    return Cleaned(deleted, failed, skipped)


def ensure_ignored(root: str, line: str) -> bool:
    """Adds ``line`` to the project's ignore file unless a line says so already; whether it was added."""
    path = Path(root) / ".gitignore"
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    if line.strip() in (x.strip() for x in text.splitlines()):
        return False
    path.write_text(text + ("" if not text or text.endswith("\n") else "\n") + line + "\n", encoding="utf-8")
    return True


class Temporary:
    """Paths to remove when a run ends. All are tried; failures are counted and raised together."""

    def __init__(self) -> None:
        self.paths: list[Path] = []

    def add(self, *paths: str | Path) -> None:
        self.paths += map(Path, paths)

    def clear(self, remove: Callable[[Path], None] = lambda p: shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)) -> None:
        failed: Iterable[str] = []
        for p in self.paths:
            try:
                remove(p)
            except OSError as e:
                failed = [*failed, f"{p}: {e}"]
        self.paths = []
        if failed:
            raise OSError(f"{len(list(failed))} temporary paths stay: " + "; ".join(failed))
