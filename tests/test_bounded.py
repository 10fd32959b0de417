"""Work and batches that grow no faster than their input, and the same results in the forms that need no shuffle."""

import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnspark.batches import in_batches, in_slices
from cairnspark.operators import cells as C
from cairnspark.operators import chunking as K
from cairnspark.operators import communities as L
from cairnspark.operators import postings as P
from cairnspark.plans import catalog
from cairnspark.scratch import Scratch
from cairnspark.streaming import log
from cairnspark.streaming import tasks as S

SF = "/root/testdata/sf0.001"


def docs(spark):
    made = [(10_001, None), (10_002, ""), (10_003, "第1条 " + "词" * 6000 + "。\n短句。" * 900), (10_004, "# A\n\n" + "one two. " * 900 + "\n## B\n\n" + "three. " * 400)]
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))


def test_rows_leave_in_batches_of_bounded_text():
    parent = "x" * 100_000  # as the parent of each of its children
    frames = list(in_batches(((1, i, parent) for i in range(500)), ["doc_id", "i", "parent"]))
    assert sum(map(len, frames)) == 500 and max(f["parent"].str.len().sum() for f in frames) <= 2_100_000
    assert list(in_batches([], ["a"])) == [] and [len(f) for f in in_batches([(1,)] * 5, ["a"], 128)] == [2, 2, 1]
    b = pa.RecordBatch.from_arrays([pa.array(range(150))], ["a"])
    assert [x.num_rows for x in in_slices([b])] == [64, 64, 22] and [v for x in in_slices([b]) for v in x.column(0).to_pylist()] == list(range(150))


@pytest.mark.parametrize("mode", ["laws", "fixed", "naive"])
def test_limits_in_the_fold_are_those_of_chunk_rows(spark, mode):
    d = docs(spark)
    folded = K.chunk_documents(d, mode, K.LIMITS)
    assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, K.enforce_limits(K.chunk_documents(d, mode)).collect()))


def test_paths_in_the_fold_are_those_of_chunk_rows(spark):
    d = docs(spark)
    folded = K.document_paths(d)
    assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: sorted((r["doc_id"], r["child_index"], tuple(r["section_path"]), r["element_type"]) for r in rows)
    assert key(folded.collect()) == key(K.section_paths(K.chunk_documents(d)).collect())


def test_fan_out_of_a_long_document(spark, tmp_path):
    d = spark.createDataFrame([(0, "x" * 122_698, "en", "s"), (1, "", "en", "s"), (2, "y" * 451, "en", "s")], "doc_id long, text string, lang string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["l13_fan_out"](spark, str(tmp_path)).select("doc_id", "chunk_index").collect()))
    assert got == sorted(c.sql(catalog.ORACLES["l13_fan_out"]).fetchall())
    assert S.fan_out(d, "doc_id", F.ceil(F.length("text") / 450)).groupBy("doc_id").count().orderBy("doc_id").collect() == [(0, 273), (2, 2)]


def test_fan_out_numbers_all_chunks(spark, tmp_path):
    d = spark.createDataFrame([(0, "x" * 122_698, "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, "y" * 451, "en", "s"), (9, "z" * 900, "en", "s")], "doc_id long, text string, lang string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["l13_fan_out"](spark, str(tmp_path)).select("doc_id", "chunk_index").collect()))
    assert got == sorted(c.sql(catalog.ORACLES["l13_fan_out"]).fetchall()) == [*((0, i) for i in range(273)), (3, 0), (3, 1)]


def test_a_lane_with_many_pending_tasks(spark):
    lane = log.TaskLog(1000, 3, 1 << 30, 1)
    lane.tasks, lane.waiting, lane.queue, lane.failures, lane.open_until = {}, {}, [], 0, -1
    start, out = time.time(), []
    for i in range(30_000):
        out.extend(lane._advance(i // 100))
        out.extend(lane._apply(i, "deliver", i // 100))
    for i in range(0, 30_000, 2):
        out.extend(lane._apply(i, "ack", 400))
    out.extend(lane._advance(10_000))
    assert len(out) == 30_000 + 15_000 + 15_000 * 3 and not lane.tasks and time.time() - start < 20


def test_slices_of_several_files_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(log, "FILE_ROWS", 40)
    rows = spark.range(400).select(F.col("id"), F.timestamp_seconds(F.col("id") * 3600 + 1_700_000_000).alias("ts"))
    stream = log.sliced(rows)
    got = S.drain(S.first_in_window(stream, ["id"], "10 minutes").select("id"), mode="append").collect()
    assert sorted(r["id"] for r in got) == list(range(400))  # none comes after the watermark of a later slice


@pytest.mark.parametrize("route", ["bm25", "sparse"])
def test_hits_and_not_postings_leave_a_block(route):
    rng = np.random.default_rng(3)
    rows = [(f"w{t}", sorted(rng.choice(500, 300, replace=False).tolist())) for t in range(40)]
    held = pa.table({"term": [t for t, _ in rows], "ids": [i for _, i in rows], "tfs": pa.array([[1 + (x + n) % 5 for x in i] for n, (_, i) in enumerate(rows)], pa.list_(pa.int32())), "dls": pa.array([[50 + x for x in i] for _, i in rows], pa.list_(pa.int32()))})
    asked = pa.table({"query_id": [1, 2], "terms": [[f"w{t}" for t in range(40)], ["w3", "none"]], "weights": [[1.0] * 40, [1.0, 1.0]]})
    out = P._score_block(route, 60.0, 10)(held, asked).to_pylist()
    assert len(out) == 20
    want = {}
    for n, (_, ids) in enumerate(rows):
        for x in ids:
            want[x] = want.get(x, 0) + P.VALUES[route](1 + (x + n) % 5, 50 + x, 60.0)
    best = sorted(want, key=lambda x: (-round(want[x], 9), x))[:10]
    found = sorted(((-round(r["score"], 9), r["chunk_id"]) for r in out if r["query_id"] == 1))[:10]
    assert [x for _, x in found] == best and [-s for s, _ in found] == pytest.approx([want[x] for x in best])


def test_small_cells_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_ROWS", 100)
    rows = spark.range(1000).select(F.when(F.col("id") < 350, 0).otherwise(F.col("id") % 60 + 1).cast("int").alias("cell"))
    shards, n = C.sharded(rows)
    got = {r["cell"]: (r["first"], r["cuts"]) for r in shards.collect()}
    assert got[0] == (0, 4) and len(got) == 61 and 10 <= n <= 13


def test_edges_lie_in_buckets_of_the_node_that_sums_them(spark):
    edges = spark.range(2000).select((F.col("id") % 40).alias("a"), (F.col("id") * 7 % 50 + 40).alias("b"), F.lit(1.0).alias("w")).distinct()
    scratch = Scratch(spark)
    nodes = scratch.keep(spark.range(90).select("id", F.col("id").cast("string").alias("name"), F.xxhash64(F.col("id").cast("string")).alias("h")))
    level = L.Level(scratch, scratch.keep(edges), nodes, 90, 2.0 * edges.count())
    labels, found, q = level.weighed(level.start)
    assert "Exchange" not in level.both.groupBy("a", "b").agg(F.sum("w"))._jdf.queryExecution().executedPlan().toString()
    assert found.count() == labels.count() == level.n and q == pytest.approx(-sum(r["k"] ** 2 for r in labels.collect()) / level.m2**2)
    scratch.drop(level.both)
    assert not [t for t in spark.catalog.listTables() if t.name == level.both._scratch_table]


def as_words(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["chunk_id", "dl", "words"])


def test_blocks_of_postings_are_counted_as_codes(monkeypatch):
    monkeypatch.setattr(P, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 1)}))}))
    rng = np.random.default_rng(5)
    terms = [*(f"w{i}" for i in range(300)), "é", "中文", "z𝔘", "￮"]
    rows = [(i * 7 % 103, [terms[int(x) % len(terms)] for x in rng.zipf(1.3, rng.integers(0, 60))]) for i in range(100)] + [(500, []), (501, ["a"]), (501, ["a", "a"])]
    b = as_words(rows)
    got = [r for x in P._blocks(2, 4, 16)(iter([b.slice(i, 11) for i in range(0, len(rows), 11)])) for r in x.to_pylist()]
    want = []
    for k in range(0, len(rows), 16):
        held = {}
        for i, words in rows[k : k + 16]:
            for t in set(words):
                held.setdefault(t, []).append((i, words.count(t), len(words)))
        for t in sorted(held):
            ids, tfs, dls = map(list, zip(*sorted(held[t])))
            want.append({"term": t, "block": 2 << 48 | 1 << 24 | k // 16, "span": 1, "n": len(ids), "max_tf": max(tfs), "min_dl": min(dls), "ids": ids, "tfs": tfs, "dls": dls})
    assert got == want
    many = as_words([(i, [f"t{x}" for x in own]) for i, own in enumerate(rng.integers(0, 40_000, (4000, 400)))])
    start = time.thread_time()
    assert sum(x.num_rows for x in P._blocks(0, 4, 512)(iter([many]))) > 100_000
    assert time.thread_time() - start < 3  # 1.6 million words


def test_few_texts_of_a_batch_are_python_objects():
    b = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["word. " * 3000] * 3000)], ["doc_id", "text"])  # 54 MB
    run = K.folded(lambda d, t: [(d, i, [t[:5]], None) for i in range(2)], K.PATHS)
    tracemalloc.start()
    out = [x.num_rows for x in run(iter([b]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out) == 6000 and peak < 15_000_000
    text = "Abstract\nOne.\n\nTwo.\nMethods\nThree."
    got = [r for x in K.folded(lambda d, t: ((d, *r) for r in K.chunk_text(t, "paper")), K.CHUNKS)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, None, ""])], ["doc_id", "text"])])) for r in x.to_pylist()]
    assert [(r["doc_id"], r["parent_index"], r["child_index"], r["child"]) for r in got] == [(1, 0, 0, "Abstract\nOne."), (1, 0, 1, "Two."), (1, 1, 2, "Methods\nThree.")]
