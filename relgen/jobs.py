"""Job history, result cache and rate limit."""

from __future__ import annotations

import json
import os
import threading
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class JobStore:
    """Jobs with rising ids, kept in a JSON file where one is named."""

    def __init__(self, path: str | None = None) -> None:
        self.path, self.lock, self.jobs = path, threading.Lock(), []
        if path and Path(path).exists():
            self.jobs = json.loads(Path(path).read_text())
        self.next = max((j["id"] for j in self.jobs), default=0) + 1

    def add(self, **job: object) -> dict:
        with self.lock:
            made = {"id": self.next, "status": "complete", "created": time.time()} | job
            self.next += 1
            self.jobs.append(made)
            self._save()
            return made

    def list(self) -> list[dict]:
        """Newest first."""
        return self.jobs[::-1]

    def get(self, job_id: int) -> dict | None:
        return next((j for j in self.jobs if j["id"] == job_id), None)

    def delete(self, job_id: int) -> bool:
        with self.lock:
            before = len(self.jobs)
            self.jobs = [j for j in self.jobs if j["id"] != job_id]
            self._save()
            return len(self.jobs) < before

    def _save(self) -> None:
        if self.path:
            temporary = f"{self.path}.tmp"
            Path(temporary).write_text(json.dumps(self.jobs))
            os.replace(temporary, self.path)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(j["id"], j["status"], float(j["created"])) for j in self.jobs]
        return spark.createDataFrame(rows, "id bigint, status string, created double")


class ResultCache:
    """Results by request, for a time."""

    def __init__(self, seconds: float = 60) -> None:
        self.seconds, self.kept = seconds, {}

    def get(self, key: str) -> object | None:
        found = self.kept.get(key)
        return found[1] if found and time.time() - found[0] < self.seconds else None

    def put(self, key: str, value: object) -> None:
        self.kept = {k: v for k, v in self.kept.items() if time.time() - v[0] < self.seconds}
        self.kept[key] = (time.time(), value)


def rate_limited(events: DataFrame, key: str, at: str, limit: int = 60, window: str = "1 minute") -> DataFrame:
    """(key, window start, n) of those with over ``limit`` events in a fixed window; batch or streaming."""
    return events.groupBy(F.col(key), F.window(at, window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")


def health(started: float, jobs: JobStore) -> dict:
    from relgen import __version__

    return {"status": "ok", "version": __version__, "uptime": time.time() - started, "jobs": len(jobs.jobs)}
