"""Injected providers, splitting against small models, dense search against brute force, and keyed helpers."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.operators import chunking, graph, lifecycle, retrieval
from cairnspark.plans import catalog
from cairnspark.providers import Providers, embedding_route, routed

SF = "/root/testdata/sf0.001"


def test_flagship_takes_other_routes_and_rerankers(spark):
    p = Providers(routes={"bm25": retrieval.bm25_topk}, rerank=lambda hits: hits.withColumn("rerank", F.lit(0.9)))
    rows = catalog.flagship(spark, SF, p).collect()
    assert rows and {r["query_id"] for r in rows} <= {r["item_id"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    with pytest.raises(ValueError):
        p.answer(F.lit("?"))


def test_embedding_route(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "")], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "a red fox")], "query_id long, text string")
    p = Providers()
    got = routed(docs, asked, 1, Providers(routes={"dense": embedding_route(p.embed)})).collect()
    assert [(r["query_id"], r["route"], r["chunk_id"]) for r in got] == [(7, "dense", 1)]


def test_dense_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).round(1)
    x[50:150] = x[50]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, vector array<double>")
    old = retrieval.SHARD_ROWS, retrieval.QUERY_BLOCK
    retrieval.SHARD_ROWS, retrieval.QUERY_BLOCK = 70, 9
    try:
        got = retrieval.dense_topk(v, v.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), 5).collect()
    finally:
        retrieval.SHARD_ROWS, retrieval.QUERY_BLOCK = old
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 10):
        s = np.round(unit @ unit[q], 12)
        want = np.lexsort((np.arange(300), -np.round(s, 9)))[:5].tolist()
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [round(r["score"], 9) for r in mine] == [round(float(s[i]), 9) for i in want]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["一、one", "1. two", "plain", "第三条 x", "[Figure] y", "原告 z", "# head", ""]), max_size=12))
def test_structure_parts_begin_at_marks(lines):
    text = "\n".join(lines)
    parts = chunking.units(text, "structure")
    assert "".join("".join(p.split()) for p in parts) == "".join(text.split())
    marks = re.compile(f"(?:{chunking.MARKS})")
    assert all(marks.match(p) for p in parts[1:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .", min_size=1, max_size=70).filter(str.strip), max_size=12), st.integers(20, 60))
def test_normalised_parts(parts, most):
    out = chunking.normalise(parts, most)
    assert "".join("".join(p.split()) for p in out) == "".join("".join(p.split()) for p in parts)
    assert all(len(p) <= most for p in out)


def test_plain_headings_only_without_markdown():
    assert chunking.Breadcrumb("# a\n第一章 b").feed("第一章 b") == ""
    assert chunking.Breadcrumb("第一章 b").feed("第一章 b\n二、c") == "第一章 b > 二、c"
    assert chunking.Breadcrumb("").feed("一、" + "很长" * 30) == ""


def test_reclaim_and_admission(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:30:00"), (3, "2024-01-01 00:10:00")], "id long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = lifecycle.reclaim(e, e.where("id = 3"), "id", F.lit("2024-01-01 01:10:00"), 1800).collect()
    assert [(r["id"], r["deliveries"]) for r in got] == [(2, 1)]
    w = spark.createDataFrame([("k", i, "slow") for i in range(3)], "kb string, doc long, lane string")
    assert [r["admitted"] for r in lifecycle.admit(w, ["kb"], "doc", "lane", {"slow": 1, "fast": 2}).orderBy("doc").collect()] == [True, False, False]


def test_type_filters_keep_centres(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "name string, type string")
    centre = spark.createDataFrame([("c",)], "name string")
    assert graph.of_types(rows, []).count() == 3
    assert {r["name"] for r in graph.of_types(rows, ["x"], centre).collect()} == {"a", "c"}
