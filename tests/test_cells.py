"""Vector cells: exact mode, recall, scope, pruning and batches."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from cairnspark.operators import cells as K
from cairnspark.operators.retrieval import dense_topk
from cairnspark.plans import retrieval as R

SF = "/root/testdata/sf0.01"


def rows(df):
    return {(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in df.collect()}


def made(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)) + 4 * np.eye(8)[rng.integers(0, 8, n)]
    data = [(i, f"kb{i % 5}", v.tolist()) for i, v in enumerate(x)] + [(9000, "kb0", [0.0] * 8), (9001, None, x[0].tolist())]
    return spark.createDataFrame(data, "chunk_id long, kb_id string, vector array<double>")


def test_all_cells_give_the_exact_result_and_a_batch_can_be_repeated(spark, tmp_path):
    v = made(spark)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    index = K.build(v.where("chunk_id < 400"), str(tmp_path / "i"), cells=12)
    K.append(index, v.where("chunk_id >= 400"), 1)
    want = rows(dense_topk(v, q, 6))
    assert rows(K.search(index, q, 6, share=1.0)) == want
    first = sorted(Path(index.path, "rows/batch=0").rglob("*.parquet"))
    K.append(index, v.where("chunk_id >= 400"), 1)
    assert rows(K.search(index, q, 6, share=1.0)) == want and sorted(Path(index.path, "rows/batch=0").rglob("*.parquet")) == first
    scoped = v.where("kb_id in ('kb1', 'kb3')")
    assert rows(K.search(index, q, 6, share=1.0, kb_ids=["kb1", "kb3"])) == rows(dense_topk(scoped, q, 6))


def test_folders_of_other_cells_and_buckets_are_pruned(spark, tmp_path):
    v = made(spark)
    index = K.build(v, str(tmp_path / "i"), cells=12)
    q = v.where("chunk_id = 50").select(F.col("chunk_id").alias("query_id"), "vector")
    found = K.search(index, q, 5, share=0.25, kb_ids=["kb1"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1][:200] and "bucket#" in plan.split("PartitionFilters: [")[1][:200]
    assert {r["rank"] for r in found.collect()} <= set(range(1, 6))
    # what is no Parquet at all is never opened
    centres = index.centres()
    x = np.array(v.where("chunk_id = 50").first()["vector"])
    near = np.argsort(-centres @ x, kind="stable")[:3].tolist()
    for p in Path(index.path, "rows").rglob("cell=*"):
        if int(p.name.split("=")[1]) not in near:
            for f in p.glob("*.parquet"):
                f.write_bytes(b"PAR1" + bytes(64) + b"PAR1")
    assert rows(K.search(index, q, 5, share=0.25, kb_ids=["kb1"])) == rows(found)


def test_recall_of_the_shipped_share(spark):
    wanted = rows(R.dense_hits(spark, SF))
    found = {(a, b) for a, b, *_ in rows(R.j1_cells(spark, SF))}
    assert len(found & {(a, b) for a, b, *_ in wanted}) >= 0.9 * len(wanted)


def test_one_row_and_one_cell(spark, tmp_path):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0])], "chunk_id long, kb_id string, vector array<double>")
    index = K.build(v, str(tmp_path / "i"))
    assert rows(K.search(index, v.select(F.lit(7).alias("query_id"), "vector"))) == {(7, 1, 1, 1.0)}
