"""Progress and abort of an action: a callback with tasks done and planned, and a way to stop its jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

T = TypeVar("T")


class Aborted(RuntimeError):
    """The action was stopped on request."""


def watched(
    spark: SparkSession, action: Callable[[], T], progress: Callable[[int, int], None] | None = None, abort: threading.Event | None = None, every: float = 0.2
) -> T:
    """action()'s result. While it runs, progress(done, planned) is called with its tasks so far, and setting abort cancels its jobs.

    Counts cover the stages that have begun, so planned grows as the action goes on; the last call has both equal.
    """
    sc, group = spark.sparkContext, f"watched-{uuid.uuid4().hex}"
    out: dict = {}

    def run() -> None:
        sc.setJobGroup(group, "watched action", interruptOnCancel=True)
        try:
            out["value"] = action()
        except BaseException as err:
            out["error"] = err

    thread = InheritableThread(target=run)
    thread.start()
    tracker, stages = sc.statusTracker(), {}
    while thread.is_alive():
        thread.join(every)
        if abort is not None and abort.is_set():
            sc.cancelJobGroup(group)
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for s in info.stageIds if info else ():
                if (at := tracker.getStageInfo(s)) is not None and (at.numActiveTasks or at.numCompletedTasks):
                    stages[s] = (at.numCompletedTasks, at.numTasks)
        if progress is not None and stages:
            progress(*map(sum, zip(*stages.values())))
    if abort is not None and abort.is_set() and "error" in out:
        raise Aborted("stopped on request") from out["error"]
    if "error" in out:
        raise out["error"]
    if progress is not None:
        total = sum(n for _, n in stages.values())
        progress(total, total)
    return out["value"]
