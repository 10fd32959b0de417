"""The stateful task log, state that ends, and progress, as streams of several micro-batches."""

import datetime
import heapq
import random

import pytest
from pyspark.sql import functions as F

from cairnspark.streaming import log as L
from cairnspark.streaming import tasks as S
from cairnspark.streaming.progress import ProgressWriter, progress_row

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
MINUTE = 60_000
IDLE, MOST, THRESHOLD, PAUSE = 30 * MINUTE, 3, 3, 60 * MINUTE


def simulated(rows, end):
    """One lane's outcomes, as a queue of instants: rows, deadlines (stale ones are skipped) and the breaker's end."""
    queue = [(at, 2, task, kind) for task, kind, at in rows]
    heapq.heapify(queue)
    count, due, held, fails, open_until, out = {}, {}, [], 0, None, []

    def start(task, at):
        count[task], due[task] = 1, at + IDLE
        heapq.heappush(queue, (due[task], 1, task, "due"))
        out.append((task, "delivered", 1, at))

    while queue:
        at, order, task, kind = heapq.heappop(queue)
        if at > end and order != 2:
            continue
        if kind == "close":
            fails, open_until = 0, None
            out.append((None, "closed", 0, at))
            for t in [t for _, t in sorted(held)]:
                start(t, at)
            held.clear()
            for t in count:
                if due[t] < at:
                    due[t] = at
                    heapq.heappush(queue, (at, 1, t, "due"))
        elif kind == "due":
            if task not in count or due[task] != at or open_until is not None:
                continue
            if count[task] == MOST:
                out.append((task, "dead", MOST, at))
                del count[task]
            else:
                count[task] += 1
                due[task] = at + IDLE
                heapq.heappush(queue, (due[task], 1, task, "due"))
                out.append((task, "reclaimed", count[task], at))
        elif kind == "deliver" and task not in count and all(t != task for _, t in held):
            if open_until is not None:
                held.append((at, task))
                out.append((task, "held", 0, at))
            else:
                start(task, at)
        elif kind == "ack" and task in count:
            out.append((task, "acked", count.pop(task), at))
            fails = 0 if open_until is None else fails
        elif kind == "fail" and task in count and open_until is None:
            fails += 1
            out.append((task, "failed", count[task], at))
            if fails == THRESHOLD:
                open_until = at + PAUSE
                heapq.heappush(queue, (open_until, 0, -1, "close"))
                out.append((None, "open", 0, at))
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for task in range(160):
        at = rng.randrange(0, 1500) * MINUTE + task
        rows.append((task % 3, task, "deliver", at))
        if rng.random() < 0.2:
            rows.append((task % 3, task, "deliver", at + rng.randrange(1, 20) * MINUTE))
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            rows.append((task % 3, task, "fail", at + rng.randrange(1, 40) * MINUTE + 7))
        if rng.random() < 0.6:
            rows.append((task % 3, task, "ack", at + rng.randrange(1, 130) * MINUTE + 3))
    return sorted(set(rows), key=lambda r: r[3])


@pytest.mark.parametrize("seed, parts", [(1, 1), (1, 4), (2, 3)])
def test_task_log_against_a_simulation(spark, seed, parts):
    rows = made(seed)
    base = int(START.timestamp() * 1000)
    stream = L.sliced(spark.createDataFrame([(lane, task, kind, START + datetime.timedelta(milliseconds=at)) for lane, task, kind, at in rows], "lane long, task long, kind string, ts timestamp"), parts)
    got = S.drain(L.task_log(stream, IDLE, MOST, THRESHOLD, PAUSE), mode="append").collect()
    water = max(at for *_, at in rows) - 10 * MINUTE
    kinds = set()
    for lane in range(3):
        own = [(t, k, at) for x, t, k, at in rows if x == lane]
        want = simulated(own, max(water, max(at for *_, at in own)))
        assert sorted((r["task"] if r["task"] is not None else -1, r["outcome"], r["deliveries"], r["at"] - base) for r in got if r["lane"] == lane) == sorted((t if t is not None else -1, o, n, at) for t, o, n, at in want)
        kinds |= {o for _, o, _, _ in want}
    assert kinds == {"delivered", "acked", "failed", "reclaimed", "dead", "held", "open", "closed"}


def test_limiter_against_a_fold_and_its_state_ends(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(6), i, rng.randrange(0, 40_000)) for i in range(400)}, key=lambda r: r[2])
    df = spark.createDataFrame([(u, i, START + datetime.timedelta(seconds=s)) for u, i, s in rows], "user_id long, event_id long, ts timestamp")
    # a last row, a day later, lets the watermark pass everything else
    df = df.union(spark.createDataFrame([(99, 9999, START + datetime.timedelta(days=1))], "user_id long, event_id long, ts timestamp"))
    writer = ProgressWriter(spark, str(tmp_path / "progress"))
    spark.streams.addListener(writer)
    try:
        got = {r["event_id"]: r["allowed"] for r in S.drain(S.limiter(L.sliced(df, 4), seconds=3600), mode="append").collect()}
        writer.write()
    finally:
        spark.streams.removeListener(writer)
    held, want = {}, {9999: True}
    for u, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
        own = held[u] = [t for t in held.get(u, []) if t > s - 3600]
        want[i] = len(own) < 3
        if want[i]:
            own.append(s)
    assert got == want
    seen = writer.table().orderBy("batch").collect()
    assert sum(r["input_rows"] for r in seen) == 401 and max(r["state_rows"] for r in seen) >= 6
    assert seen[-1]["state_rows"] <= 1  # only the last key's state is left


def test_nonces_are_forgotten_and_late_rows_dropped(spark, tmp_path):
    minutes = [0, 5, 600, 605, 1200, 1, 1201]  # the row of minute 1 comes when the watermark has passed it
    rows = [(i, n, START + datetime.timedelta(minutes=m)) for i, (n, m) in enumerate(zip("aabbcac", minutes))]
    folder = tmp_path / "rows"
    for r in rows:
        spark.createDataFrame([r], "event_id long, nonce string, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("event_id long, nonce string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    writer = ProgressWriter(spark, str(tmp_path / "progress"))
    spark.streams.addListener(writer)
    try:
        got = sorted(r["event_id"] for r in S.drain(S.first_in_window(stream, ["nonce"], "30 minutes").select("event_id"), mode="append").collect())
        writer.write()
    finally:
        spark.streams.removeListener(writer)
    assert got == [0, 2, 4]
    seen = writer.table()
    assert seen.agg(F.sum("late_rows")).first()[0] == 1 and seen.agg(F.max("state_rows")).first()[0] <= 2 and seen.agg(F.sum("state_removed")).first()[0] >= 2


def test_slow_stages_of_a_report():
    p = {"runId": "r", "batchId": 3, "numInputRows": 5, "durationMs": {"addBatch": 31_000, "getBatch": 10, "triggerExecution": 40_000}, "stateOperators": [{"numRowsTotal": 2, "numRowsRemoved": 1}, {"numRowsTotal": 3}]}
    assert progress_row(p) == ("r", 3, 5, 0.0, 40_000, 5, 1, 0, None, ["addBatch"])
