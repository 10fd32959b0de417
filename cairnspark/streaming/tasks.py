"""Task logs and event streams. Every transformation works on batch and streaming DataFrames alike; ``drain`` runs a stream to its end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from cairnspark.batches import in_slices
from cairnspark.scratch import shared_folder

ENVELOPE = "k long"


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """L1: the events table as a replayable file source; offsets live in the query's checkpoint."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Runs a stream over all input there is. Each micro-batch overwrites its own folder, so a replayed batch changes nothing; of repeated keys the last batch counts."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    out = spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        out = out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out.drop("batch")


def decode(log: DataFrame, body: str, schema: str = ENVELOPE) -> DataFrame:
    """L2: log with payload, null where the envelope cannot be read."""
    return log.withColumn("payload", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def split_dead(log: DataFrame, attempts: Column, most: int = 3) -> DataFrame:
    """Log with outcome (retry or dead) and the seconds until the next attempt."""
    return log.withColumn("outcome", F.when(attempts > most, "dead").otherwise("retry")).withColumn("wait_s", F.when(attempts <= most, F.pow(F.lit(2.0), attempts - 1)))


def failure_runs(log: DataFrame, key: str, failed: Column, order: list[str]) -> DataFrame:
    """Log with run: how many failures in a row end at each row (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    marked = log.withColumn("__island", island).withColumn("__f", F.when(failed, 1).otherwise(0))
    return marked.withColumn("run", F.sum("__f").over(Window.partitionBy(key, "__island").orderBy(*order)).cast("long")).drop("__island", "__f")


def not_done(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks whose document is not completed, cancelled or deleted; on streams a stream-static anti join."""
    return tasks.join(done.select(key), key, "left_anti")


def current_attempts(tasks: DataFrame, key: str, attempt: str) -> DataFrame:
    """Tasks of each key's newest attempt."""
    newest = tasks.groupBy(key).agg(F.max(attempt).alias("__newest"))
    return tasks.join(newest, key).where(F.col(attempt) >= F.col("__newest")).drop("__newest")


def countdown(done: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs(job_id, attempt, total) with status; subtasks count once however often they are delivered."""
    n = done.groupBy("job_id", "attempt").agg(F.count_distinct("subtask").alias("n_done"))
    both = jobs.join(n, ["job_id", "attempt"], "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)))
    return both.withColumn("status", F.when(F.col("n_done") >= F.col("total"), "completed").otherwise("processing"))


def fan_out(jobs: DataFrame, key: str, n: Column) -> DataFrame:
    """(key, chunk_index), indexes from 0, of as many subtasks as each job has; none for a job of no chunks."""
    return jobs.where(n > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_index"))


def stuck(jobs: DataFrame, updated: Column, as_of: Column, minutes: int = 30) -> DataFrame:
    """L12"""
    return jobs.where(updated < as_of - F.make_interval(mins=F.lit(minutes)))


def tumbling(events: DataFrame, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; on streams rows later than ``late`` are dropped."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    """A session ends when its key is silent for the gap."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def first_in_window(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first row of each key; on streams state lives as long as the watermark allows."""
    if events.isStreaming:
        return events.withWatermark("ts", late or "1 hour").dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return events.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def hits_before(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """Events with the number of the key's rows in the seconds up to each."""
    w = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds + 1, 0)
    return events.withColumn("hits", F.count(F.lit(1)).over(w))


def limiter(events: DataFrame, key: str = "user_id", most: int = 3, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """H10, exact and stateful: (key, event_id, allowed); refused rows are not recorded.

    State holds at most ``most`` times a key, and goes when the watermark passes the last of them by the window. Rows
    later than the watermark are dropped, so no row is judged by times that have been forgotten.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for e, at in zip(rows["event_id"], rows["at"], strict=True):
            held = [t for t in held if t > at - seconds]
            ok = len(held) < most
            if ok:
                held.append(int(at))
            out.append((k[0], e, ok))
        state.update((held,))
        state.setTimeoutTimestamp(max((held[-1] + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "event_id", "allowed"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "event_id", "ts", F.col("ts").cast("long").alias("at"))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class ThinkSplitter:
    """Splits streamed text into thought and answer; a tag that may still be cut is held back."""

    TAGS = {False: "<think>", True: "</think>"}

    def __init__(self) -> None:
        self.inside, self.held = False, ""

    def feed(self, delta: str, last: bool = False) -> list[tuple[str, str]]:
        self.held += delta
        out: list[tuple[str, str]] = []
        while True:
            tag = self.TAGS[self.inside]
            at = self.held.find(tag)
            kind = "thought" if self.inside else "answer"
            if at >= 0:
                if at:
                    out.append((kind, self.held[:at]))
                self.held, self.inside = self.held[at + len(tag) :], not self.inside
                continue
            keep = 0 if last else max((n for n in range(1, len(tag)) if self.held.endswith(tag[:n])), default=0)
            ready = self.held[: len(self.held) - keep]
            if ready:
                out.append((kind, ready))
            self.held = self.held[len(self.held) - keep :]
            return out


def split_thoughts(deltas: DataFrame) -> DataFrame:
    """deltas(stream_id, seq, text) to (stream_id, thought, answer); a stream's deltas are gathered in one row, in order, and fed one by one."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda d: d["text"])
    streams = deltas.groupBy("stream_id").agg(parts.alias("deltas"))

    def one(texts: list[str | None]) -> tuple[str, str]:
        s, thought, answer = ThinkSplitter(), [], []
        for t in [*texts, None]:
            for kind, part in s.feed(t or "", last=t is None):
                (thought if kind == "thought" else answer).append(part)
        return "".join(thought), "".join(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            split = [one([t or "" for t in texts]) for texts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in zip(*split))], ["stream_id", "thought", "answer"])

    return streams.mapInArrow(run, "stream_id long, thought string, answer string")
