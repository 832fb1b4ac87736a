"""Retention as a stream: of the backups of each file the newest few are kept, the others come out as expired.

A state of its own for each file holds the newest backups that have been seen; a row that pushes one out, or comes too late to get in, gives an
expired row, once. Rows of one micro-batch meet in the state whatever their order, so the kept ones are those that a batch job over all
rows would keep. Files that no backup has come for in ``idle`` are forgotten by a timer: what is kept of them stays kept, and the state doesn't grow for
ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.writing import KEPT_BACKUPS

HELD = "at long, name long"


class Newest(StatefulProcessor):
    def __init__(self, key: str, keep: int, idle_ms: int | None) -> None:
        self.key, self.keep, self.idle_ms = key, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = [(int(at), int(name)) for at, name in self.held.get()] if self.held.exists() else []
        expired: list[int] = []
        for b in rows:
            seen = sorted({*seen, *zip(b["at"].astype("int64").tolist(), b["name"].astype("int64").tolist(), strict=True)}, reverse=True)
            expired += [name for _, name in seen[self.keep :]]
            seen = seen[: self.keep]
        self.held.put(seen)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if expired:
            yield pd.DataFrame({self.key: [key[0]] * len(expired), "name": expired})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def ready(spark: SparkSession) -> None:
    """Stateful processors need the state store that holds lists and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def expired(backups: DataFrame, file: str, mtime: str, name: str, keep: int = KEPT_BACKUPS, idle_ms: int | None = None) -> DataFrame:
    """(``file``, ``name``) of backups beyond the newest ``keep`` of their file, as a stream. Of equal times the larger name is newer; a backup that comes twice
    counts once while it is kept. Rows with a null don't take part."""
    rows = backups.where(f"{file} is not null and {mtime} is not null and {name} is not null").selectExpr(f"{file} as k", f"unix_micros(cast({mtime} as timestamp)) as at", f"cast({name} as long) as name")
    kind = backups.schema[file].dataType
    out = rows.groupBy("k").transformWithStateInPandas(Newest("k", keep, idle_ms), StructType().add("k", kind).add("name", "long"), "Append", "ProcessingTime" if idle_ms is not None else "None")
    return out.selectExpr(f"k as {file}", f"name as {name}")
