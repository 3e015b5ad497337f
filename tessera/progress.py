"""Execution arguments of the API: `parallel` is checked and left to Spark's scheduler; `progress` reports finished tasks."""

from __future__ import annotations

import datetime as dt
import os
import threading
import uuid

from pyspark.sql import SparkSession

DEFAULT = "{completed} of {total} ({percent}%), about {tremaining} left"


def workers(parallel) -> int:
    """True: all CPUs; False, 0, 1: one; n > 1: n; negative: CPUs less n."""
    cpus = os.cpu_count() or 1
    if parallel is True:
        return cpus
    if not isinstance(parallel, int):
        raise ValueError("parallel must be a bool or an int")
    return max(1, cpus + parallel if parallel < 0 else int(parallel))


def _parsed(progress) -> tuple[str | None, int]:
    match progress:
        case True:
            return DEFAULT, 1
        case False:
            return None, 1
        case str():
            return progress, 1
        case int() if progress > 0:
            return DEFAULT, progress
        case (str() as form, int() as step) if step > 0 and step is not True:
            return form, step
    raise ValueError(f"progress takes a bool, a format, a step from 1, both as a pair, or a function, not {progress!r}")


class Moment:
    """What a format can name: counts, times and durations, without fractions of seconds."""

    def __init__(self, completed: int, total: int, now: dt.datetime, start: dt.datetime):
        spent = now - start
        whole = spent * (total / completed) if completed else spent
        self.values = {"completed": completed, "total": total, "remaining": total - completed, "percent": 100 * completed // total if total else 100}
        self.values |= {k: v.isoformat(sep=" ", timespec="seconds") for k, v in (("start", start), ("now", now), ("finish", start + whole))}
        self.values |= {k: str(dt.timedelta(seconds=int(v.total_seconds()))) for k, v in (("telapsed", spent), ("tremaining", whole - spent), ("ttotal", whole))}

    def put(self, form: str) -> str:
        return form.format_map(self.values)


def make_progress_callback(progress):
    """A function of (completed, total, now, start): the given one, or one that prints a format at every step."""
    if callable(progress):
        return progress
    form, step = _parsed(progress)

    def printed(completed: int, total: int, now: dt.datetime, start: dt.datetime) -> None:
        if form is not None and completed % step == 0:
            print(Moment(completed, total, now, start).put(form))

    return printed


class Progress:
    """Calls back for every task that ends in the Spark jobs of a `with` block; the total grows as stages become known.

    The jobs are found by a group of their own, which ends with the block.
    """

    GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")

    def __init__(self, spark: SparkSession, progress, every: float = 0.2):
        self.context, self.call, self.every = spark.sparkContext, make_progress_callback(progress), every
        self.silent, self.done, self.total = progress is False, 0, 0

    def __enter__(self) -> "Progress":
        self.start = dt.datetime.now()
        if not self.silent:
            self.group, self.ended = f"tessera-{uuid.uuid4().hex}", threading.Event()
            self.before = [self.context.getLocalProperty(k) for k in self.GROUP]
            self.context.setLocalProperty(self.GROUP[0], self.group)
            self.thread = threading.Thread(target=self._watch, daemon=True)
            self.thread.start()
        return self

    def _look(self) -> None:
        tracker = self.context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(self.group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        infos = [i for i in map(tracker.getStageInfo, stages) if i]
        self.total = max(self.total, sum(i.numTasks for i in infos))
        self._report(sum(i.numCompletedTasks for i in infos))

    def _report(self, done: int) -> None:
        for k in range(self.done + 1, done + 1):
            self.call(k, max(self.total, k), dt.datetime.now(), self.start)
        self.done = max(self.done, done)

    def _watch(self) -> None:
        while not self.ended.wait(self.every):
            self._look()

    def __exit__(self, kind, error, trace) -> None:
        if self.silent:
            return
        self.ended.set()
        self.thread.join()
        for k, v in zip(self.GROUP, self.before):
            self.context.setLocalProperty(k, v)
        if kind is None:
            self._look()
            self._report(self.total)
