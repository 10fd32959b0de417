"""Progress of running streams as a table: rates, rows of state, slow stages."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

ROWS = "run string, batch long, input_rows long, rows_per_s double, trigger_ms long, state_rows long, state_removed long, late_rows long, watermark string, slow array<string>"
#: A stage of a micro-batch that takes longer is slow.
SLOW_MS = 30_000


def progress_row(p: dict, slow_ms: int = SLOW_MS) -> tuple:
    """One row of a progress report."""
    took = p.get("durationMs", {})
    states = p.get("stateOperators", [])
    total = lambda name: sum(s.get(name, 0) for s in states)
    slow = sorted(k for k, v in took.items() if k != "triggerExecution" and v > slow_ms)
    return (p["runId"], p["batchId"], p.get("numInputRows", 0), float(p.get("processedRowsPerSecond") or 0.0), took.get("triggerExecution", 0), total("numRowsTotal"), total("numRowsRemoved"), total("numRowsDroppedByWatermark"), p.get("eventTime", {}).get("watermark"), slow)


class ProgressWriter(StreamingQueryListener):
    """Keeps the reports of a session's streams; ``write`` makes those of ended runs a table, a folder for each.

    Reports come on Spark's listener thread, which starts no jobs: writing is left to the caller.
    """

    def __init__(self, spark: SparkSession, path: str, slow_ms: int = SLOW_MS):
        self.spark, self.path, self.slow_ms = spark, path, slow_ms
        self.held: dict[str, dict[int, tuple]] = {}
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        self.held.setdefault(str(event.runId), {})

    def onQueryProgress(self, event) -> None:
        row = progress_row(json.loads(event.progress.json), self.slow_ms)
        self.held.setdefault(row[0], {})[row[1]] = row  # a batch reported twice is one row

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def write(self, runs: int = 1, wait_s: float = 60.0) -> None:
        """Waits until so many runs have ended and been reported, and writes their rows; a run written again is the same folder."""
        with self.news:
            if not self.news.wait_for(lambda: len(self.ended) >= runs, wait_s):
                raise TimeoutError(f"{len(self.ended)} of {runs} streams ended within {wait_s} s")
        for run in sorted(self.ended):
            rows = self.held.pop(run, {})
            if rows:
                self.spark.createDataFrame(list(rows.values()), ROWS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def table(self) -> DataFrame:
        return self.spark.read.schema(ROWS.replace("run string, ", "")).option("basePath", self.path).parquet(f"{self.path}/run=*")
