"""What a run is doing: its steps, and of each the tasks that are done, from Spark's own status."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession

EVERY = 0.5


class Progress:
    """Calls ``say`` with the name of each step, and while it lasts with the tasks of its running stages whenever they have changed.

    Used as a context: a thread asks the driver's status tracker, so no job is run for it, and it ends with the block."""

    def __init__(self, spark: SparkSession, say: Callable[[str], None], every: float = EVERY) -> None:
        self.tracker, self.say, self.every = spark.sparkContext.statusTracker(), say, every
        self.step = ""
        self._ended = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def __call__(self, step: str) -> None:
        self.step = step
        self.say(step)

    def tasks(self) -> tuple[int, int]:
        """(done, all) tasks of the stages that run now."""
        found = [i for s in self.tracker.getActiveStageIds() if (i := self.tracker.getStageInfo(s))]
        return sum(i.numCompletedTasks for i in found), sum(i.numTasks for i in found)

    def _watch(self) -> None:
        last = None
        while not self._ended.wait(self.every):
            now = (self.step, *self.tasks())
            if now[2] and now != last:
                self.say(f"{now[0]}: {now[1]} of {now[2]} tasks")
            last = now

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self._ended.set()
        self._thread.join()
