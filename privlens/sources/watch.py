"""Stopping work that runs, and telling how far it is."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from privlens.sources.shared import exists


class Watch:
    """A block of work whose Spark jobs are cancelled within seconds once the file ``stop`` exists.

    The jobs of the block's thread form a job group. A second thread looks for the file and cancels the group's
    jobs; what that raises in the block ends it, and :attr:`stopped` says so. Work that was written before stays.
    ``tell(finished, started)`` hears how many tasks of the group's running jobs there are.
    """

    def __init__(self, spark: SparkSession, stop: str, tell: Callable[[int, int], None] | None = None, every: float = 0.5):
        self.spark, self.stop, self.tell, self.every = spark, stop, tell, every
        self.group, self.stopped, self._done = f"watched-{uuid.uuid4().hex}", False, threading.Event()

    def tasks(self) -> tuple[int, int]:
        """Finished tasks and all tasks of the stages that the group's jobs are at."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.group)]
        stages = [tracker.getStageInfo(s) for j in jobs if j and j.status == "RUNNING" for s in j.stageIds]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def asked(self) -> bool:
        """Whether the file is there; the block need not wait for the second thread to see it."""
        self.stopped = self.stopped or exists(self.spark, self.stop)
        return self.stopped

    def _look(self) -> None:
        while not self._done.wait(self.every):
            if self.asked():
                self.spark.sparkContext.cancelJobGroup(self.group)
            elif self.tell:
                self.tell(*self.tasks())

    def __enter__(self) -> Watch:
        self.spark.sparkContext.setJobGroup(self.group, "watched", interruptOnCancel=True)
        self._thread = threading.Thread(target=self._look, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self._done.set()
        self._thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.spark.sparkContext.setLocalProperty(name, None)
        return self.stopped and isinstance(error, Exception)
