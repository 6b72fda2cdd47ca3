"""Long runs in the background: their progress, their cancellation, and results that are there whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.stage import drop

WAITING, RUNNING, DONE, FAILED, CANCELLED = "waiting", "running", "done", "failed", "cancelled"


@dataclass(frozen=True)
class Progress:
    """How far a run is: its state, Spark jobs begun and ended, tasks of their stages in all and ended, ``error`` if it failed."""

    state: str
    jobs: int
    jobs_done: int
    tasks: int
    tasks_done: int
    error: str | None = None


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in the place of another, which goes."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.delete(path(target), True)
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def beside(path: str) -> str:
    """A new folder next to a path, hidden by a point (an underscore hides no name with an equals sign)."""
    above, _, name = path.rstrip("/").rpartition("/")
    return f"{above}/.{name}-{uuid.uuid4().hex}"


@dataclass
class Job:
    """A table that is computed and written in a thread of its own, all its Spark jobs under one tag.

    ``make`` builds the table, and may run jobs to do so; of several tables by name each is a folder of the result.  It
    is written next to ``out`` and renamed at the end, so a run that is cancelled or fails leaves ``out`` as it was.  A run
    ends once: what comes first counts.
    """

    spark: SparkSession
    make: Callable[[], DataFrame | dict[str, DataFrame]]
    out: str
    tag: str = field(default_factory=lambda: f"run-{uuid.uuid4().hex}")
    state: str = WAITING
    error: BaseException | None = None

    def __post_init__(self) -> None:
        self._lock, self._thread, self._names = Lock(), None, None

    def start(self) -> Job:
        with self._lock:
            if self.state != WAITING:
                raise ValueError(f"the run is {self.state}")
            self.state = RUNNING
        self._thread = InheritableThread(target=self._run)
        self._thread.start()
        return self

    def _run(self) -> None:
        context, part = self.spark.sparkContext, beside(self.out)
        context.addJobTag(self.tag)
        try:
            made = self.make()
            if isinstance(made, dict):
                self._names = list(made)
            for path, rows in ([(part, made)] if self._names is None else [(f"{part}/{name}", rows) for name, rows in made.items()]):
                if self.state == RUNNING:
                    rows.write.parquet(path)
            with self._lock:
                if self.state == RUNNING:
                    renamed(self.spark, part, self.out)
                    self.state = DONE
        except BaseException as error:  # the thread's only way to tell
            with self._lock:
                if self.state == RUNNING:
                    self.state, self.error = FAILED, error
        finally:
            drop(self.spark, part)
            context.removeJobTag(self.tag)

    def cancel(self) -> bool:
        """Stop the run's jobs, and those that it would begin; whether it was still to end."""
        with self._lock:
            open_ = self.state in (WAITING, RUNNING)
            if open_:
                self.state = CANCELLED
        while open_ and self._thread is not None and self._thread.is_alive():
            # a job that begins between two of its actions is stopped by the next turn
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.2)
        return open_

    def wait(self, seconds: float | None = None) -> str:
        """The state after the end, or after so many seconds."""
        if self._thread is not None:
            self._thread.join(seconds)
        return self.state

    def result(self) -> DataFrame | dict[str, DataFrame]:
        """The table (or tables by name) once it is written; raises what the run failed with."""
        if self.wait() != DONE:
            raise self.error or RuntimeError(f"the run is {self.state}")
        read = self.spark.read.parquet
        return read(self.out) if self._names is None else {name: read(f"{self.out}/{name}") for name in self._names}

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        jobs = [found.get() for k in tracker.getJobIdsForTag(self.tag) if (found := tracker.getJobInfo(k)).isDefined()]
        ended = sum(j.status().toString() != "RUNNING" for j in jobs)
        ids = {k for j in jobs for k in j.stageIds()}
        stages = [found.get() for k in ids if (found := tracker.getStageInfo(k)).isDefined()]
        total, done = sum(s.numTasks() for s in stages), sum(s.numCompletedTasks() for s in stages)
        return Progress(self.state, len(jobs), ended, total, done, None if self.error is None else str(self.error))


class BatchProgress(StreamingQueryListener):
    """Batches and rows that the streams of a session have ended, by the id of the query; ``ended`` has its error, or None."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)
        self.batches.setdefault(str(event.id), 0)
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            at = str(event.progress.id)
            self.rows[at] = self.rows.get(at, 0) + event.progress.numInputRows
            self.batches[at] = self.batches.get(at, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
