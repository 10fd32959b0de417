"""A durable task log with state: deliveries that are pending, reclaim of idle ones, dead letters and a breaker per lane.

Rows are (lane, task, kind, ts); kind is deliver, ack or fail. A delivered task is pending until it is acknowledged. One that
is idle for ``idle_ms`` is delivered again; when that would be more than ``most`` deliveries it goes to the dead letters. After
``threshold`` failures in a row a lane's breaker opens: deliveries are held and nothing is reclaimed, until it closes after
``pause_ms`` and delivers what it held.

What is due before a row's time happens before the row, whichever micro-batch brings it, and timers on the watermark do
the rest. So the result depends on the rows alone, not on how they are cut into micro-batches. Rows later than the
watermark are dropped by Spark, and what falls due after the last watermark has not happened yet. State of a lane holds its pending and held tasks
and nothing else; an empty lane holds none.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairnspark.scratch import Scratch

OUTCOMES = "lane long, task long, outcome string, deliveries int, at long"
NEVER = 1 << 62
#: Outcomes in a frame, and rows in a file of a slice.
FRAME_ROWS, FILE_ROWS = 10_000, 500_000
KINDS = pd.CategoricalDtype(["ack", "deliver", "fail"], ordered=True)


class TaskLog(StatefulProcessor):
    def __init__(self, idle_ms: int, most: int, threshold: int, pause_ms: int):
        self.idle_ms, self.most, self.threshold, self.pause_ms = idle_ms, most, threshold, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "task long", "deliveries int, due long")
        self.held = handle.getMapState("held", "task long", "place long")
        self.breaker = handle.getValueState("breaker", "failures int, open_until long")

    def _load(self) -> None:
        self.tasks = {k[0]: tuple(v) for k, v in self.pending.iterator()} if self.pending.exists() else {}
        self.waiting = {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        self.failures, self.open_until = self.breaker.get() if self.breaker.exists() else (0, -1)
        self.queue = [(due, task) for task, (_, due) in self.tasks.items()]
        heapify(self.queue)
        self.before = dict(self.tasks), dict(self.waiting), (self.failures, self.open_until)

    def _store(self) -> None:
        tasks, waiting, breaker = self.before
        for state, old, new in ((self.pending, tasks, self.tasks), (self.held, waiting, {k: (v,) for k, v in self.waiting.items()})):
            old = {k: v if isinstance(v, tuple) else (v,) for k, v in old.items()}
            for k in old.keys() - new.keys():
                state.removeKey((k,))
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue((k,), v)
        now = (self.failures, self.open_until)
        if now == (0, -1):
            if breaker != now:
                self.breaker.clear()
        elif now != breaker:
            self.breaker.update(now)
        due = self._next_due()
        if due < NEVER:
            self.handle.registerTimer(due)

    def _start(self, task: int, deliveries: int, due: int) -> None:
        self.tasks[task] = (deliveries, due)
        heappush(self.queue, (due, task))

    def _next_due(self) -> int:
        """The breaker's end, or the first deadline; those of tasks that are gone or have a later one are passed over."""
        if self.open_until >= 0:
            return self.open_until
        while self.queue and self.tasks.get(self.queue[0][1], (0, NEVER))[1] != self.queue[0][0]:
            heappop(self.queue)
        return self.queue[0][0] if self.queue else NEVER

    def _advance(self, upto: int) -> Iterator[tuple]:
        """Everything that falls due up to a time, in order."""
        late: list[int] = []
        while (due := self._next_due()) <= upto:
            if self.open_until >= 0:
                self.failures, self.open_until = 0, -1
                yield None, "closed", 0, due
                for task in sorted(self.waiting, key=lambda t: (self.waiting[t], t)):
                    yield self._deliver(task, due)
                self.waiting = {}
                # what fell due meanwhile falls due now
                while self.queue and self.queue[0][0] < due:
                    d, task = heappop(self.queue)
                    if self.tasks.get(task, (0, NEVER))[1] == d:
                        late.append(task)
                for task in late:
                    self._start(task, self.tasks[task][0], due)
                late.clear()
                continue
            task = self.queue[0][1]
            n = self.tasks[task][0]
            if n + 1 > self.most:
                del self.tasks[task]
                yield task, "dead", n, due
            else:
                self._start(task, n + 1, due + self.idle_ms)
                yield task, "reclaimed", n + 1, due

    def _deliver(self, task: int, at: int) -> tuple:
        self._start(task, 1, at + self.idle_ms)
        return task, "delivered", 1, at

    def _apply(self, task: int, kind: str, at: int) -> Iterator[tuple]:
        if kind == "deliver":
            if task in self.tasks or task in self.waiting:
                return  # a replayed delivery
            if self.open_until >= 0:
                self.waiting[task] = at
                yield task, "held", 0, at
            else:
                yield self._deliver(task, at)
        elif task in self.tasks:
            if kind == "ack":
                self.failures = 0 if self.open_until < 0 else self.failures
                yield task, "acked", self.tasks.pop(task)[0], at
            elif self.open_until < 0:
                self.failures += 1
                yield task, "failed", self.tasks[task][0], at
                if self.failures >= self.threshold:
                    self.open_until = at + self.pause_ms
                    yield None, "open", 0, at

    def _frame(self, lane: int, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(lane, *r) for r in rows], columns=[c.split()[0] for c in OUTCOMES.split(", ")]).astype({"task": "Int64", "deliveries": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        got = pd.concat([f[["task", "kind", "at"]].astype({"kind": KINDS}) for f in rows])
        got = got.assign(then=got["kind"] != "deliver").sort_values(["at", "then", "task", "kind"])  # at one instant deliveries come first
        out: list[tuple] = []
        for task, kind, at in zip(got["task"], got["kind"], got["at"]):
            out.extend(self._advance(at))
            out.extend(self._apply(task, kind, at))
            if len(out) >= FRAME_ROWS:
                yield self._frame(key[0], out)
                out = []
        self._store()
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = list(self._advance(timerValues.getCurrentWatermarkInMs()))
        self._store()
        yield self._frame(key[0], out)

    def close(self) -> None:
        pass


def task_log(rows: DataFrame, idle_ms: int, most: int, threshold: int, pause_ms: int, late: str = "10 minutes") -> DataFrame:
    """OUTCOMES of the stream rows(lane, task, kind, ts); needs the RocksDB state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.withWatermark("ts", late).select("lane", "task", "kind", "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy("lane").transformWithStateInPandas(TaskLog(idle_ms, most, threshold, pause_ms), OUTCOMES, "Append", "EventTime")


def sliced(rows: DataFrame, parts: int = 4, ts: str = "ts") -> DataFrame:
    """A stream that brings rows in some micro-batches in the order of their times: each part is written as the same number of files and read as one."""
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark)
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    at = F.unix_micros(ts)
    cuts = rows.select(F.percentile_approx(at, [i / parts for i in range(1, parts)]).alias("c")).first()["c"] or []
    edges = [None, *cuts, None]
    within = [(F.lit(low is None) | (at >= F.lit(low or 0))) & (F.lit(high is None) | (at < F.lit(high or 0))) for low, high in zip(edges, edges[1:])]
    least = min(rows.select(*[F.count(F.when(w, 1)) for w in within]).first())
    files = least // FILE_ROWS + 1  # every slice has rows for all its files, so a micro-batch is a slice
    for w in within:
        part = rows.where(w)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(f"{scratch.folder}/rows")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{scratch.folder}/rows")
