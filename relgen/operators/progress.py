"""Progress inside a table's job, and ending it: rows read so far, and what was written so far is kept."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Progress:
    """What a job's tasks have done so far."""

    rows: int = 0
    tasks: int = 0
    all_tasks: int = 0


@dataclass
class Outcome:
    finished: bool
    progress: Progress


def progress_of(spark: SparkSession, tag: str) -> Progress:
    """Rows read and tasks done by all jobs with a tag, finished ones too."""
    out, store = Progress(), spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(None)
    for i in range(jobs.size()):
        job = jobs.apply(i)
        if not job.jobTags().contains(tag):
            continue
        out.tasks += job.numCompletedTasks()
        out.all_tasks += job.numTasks()
        stages = job.stageIds()
        for k in range(stages.size()):
            try:
                out.rows += store.lastStageAttempt(stages.apply(k)).inputRecords()
            except Py4JJavaError:  # a stage that was never submitted has no data
                continue
    return out


def tracked(spark: SparkSession, action: Callable[[], object], report: Callable[[Progress], None] | None = None, cancelled: Callable[[], bool] | None = None, every: float = 0.2) -> Outcome:
    """Runs ``action``, whose jobs report their progress and end, running tasks too, soon after ``cancelled`` says so."""
    tag, error, done = f"relgen-{uuid.uuid4().hex}", [], threading.Event()

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            action()
        except Exception as e:  # noqa: BLE001 - raised below, unless it was cancelled
            error.append(e)
        finally:
            spark.sparkContext.removeJobTag(tag)
            done.set()

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    stopped = False
    while not done.wait(every):
        if report:
            report(progress_of(spark, tag))
        if not stopped and cancelled and cancelled():
            stopped = True
            spark.sparkContext.cancelJobsWithTag(tag)
    if error and not stopped:
        raise error[0]
    last = progress_of(spark, tag)
    if report:
        report(last)
    return Outcome(not stopped, last)


def kept_rows(df: DataFrame, path: str, report: Callable[[Progress], None] | None = None, cancelled: Callable[[], bool] | None = None) -> Outcome:
    """Writes ``df`` as Parquet, each task's rows as soon as it is done, so that a cancelled run keeps what it has made."""
    write = df.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    return tracked(df.sparkSession, lambda: write.parquet(path), report, cancelled)
