"""Operators that SQL cannot express, against small models and invariants."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.functions import names, vectors
from cairnspark.operators import chunking, graph, retrieval
from cairnspark.sources import loaders, sinks
from cairnspark.streaming.tasks import ThinkSplitter


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#|", max_size=4000), st.sampled_from(["naive", "laws", "paper", "qa", "fixed", "sentences"]))
def test_chunks_cover_the_text(text, mode):
    rows = chunking.chunk_text(text, mode)
    assert [r[1] for r in rows] == list(range(len(rows)))
    assert bool(rows) == bool(text.strip())
    if mode in ("laws", "paper", "sentences"):
        assert "".join("".join(r[3].split()) for r in rows) == "".join(text.split())


def test_tables_stay_whole():
    table = "| a | b |\n| - | - |\n" + "".join(f"| {i} | x |\n" for i in range(400))
    parts = chunking.parents("Intro.\n\n" + table + "\n\nEnd.")
    assert any(p == table.strip() for p in parts)


@given(st.lists(st.tuples(st.floats(0, 1), st.sets(st.integers(0, 5))), max_size=8))
def test_mmr_is_a_permutation(rows):
    order = retrieval.mmr_order([s for s, _ in rows], [t for _, t in rows])
    assert sorted(order) == list(range(len(rows)))
    if rows:
        assert rows[order[0]][0] == max(s for s, _ in rows)


@given(st.text(alphabet="ab<>/think", max_size=60), st.integers(1, 7))
def test_think_splitter_does_not_depend_on_cuts(text, step):
    def run(k):
        s, out = ThinkSplitter(), {"thought": "", "answer": ""}
        for i in [*range(0, len(text), k), None]:
            for kind, part in s.feed(text[i : i + k] if i is not None else "", last=i is None):
                out[kind] += part
        return out

    assert run(step) == run(max(1, len(text)))


@given(st.text(max_size=30))
def test_normal_names_are_stable(name):
    assert names.normal_name(names.normal_name(name)) == names.normal_name(name)


def test_lenient_json():
    assert names.lenient_json('Sure:\n```json\n{"a": [1]}\n```') == '{"a": [1]}'
    assert names.lenient_json("x [1, 2] y") == "[1, 2]"
    assert names.lenient_json("none {") is None and names.lenient_json(None) is None


def test_hash_vectors_have_unit_length():
    assert abs((vectors.hash_vector("some words here") ** 2).sum() - 1) < 1e-9
    assert not vectors.hash_vector("").any()


def test_labels_stay_inside_components(spark):
    e = spark.createDataFrame([(n,) for n in "abcxyz"], "name string")
    r = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1)], "source string, target string, weight long")
    got = {r["name"]: r["community"] for r in graph.communities(e, r, 3).collect()}
    assert {got[n] for n in "abc"} <= set("abc") and {got[n] for n in "xy"} <= set("xy") and got["z"] == "z"


def test_office_and_text_sources(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<d xmlns:w="{w}"><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></d>')
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "t.txt").write_bytes("häl".encode() + b"\xff lo")
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in loaders.load(spark, str(tmp_path), ".DOCX").collect()}
    assert got == {"a.docx": "One\n\nTwo", "broken.docx": None}
    assert [r["content"] for r in loaders.load(spark, str(tmp_path), "txt").collect()] == ["häl lo"]
    assert loaders.listing(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        loaders.load(spark, str(tmp_path), "exe")


def test_vector_sink(spark, tmp_path):
    v = spark.createDataFrame([(1, "x" * 70_000, [1.0, 2.0])], "chunk_id long, content string, vector array<double>")
    sinks.write_vectors(sinks.stamped(v, "kb", "t"), str(tmp_path / "v"))
    row = spark.read.parquet(str(tmp_path / "v")).select("dim", F.length("content").alias("n")).first()
    assert (row["dim"], row["n"]) == (2, 60_000)
    with pytest.raises(ValueError):
        sinks.delete_matching(v, v, [])


def test_dense_topk_of_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "chunk_id long, vector array<double>")
    none = spark.createDataFrame([], "query_id long, vector array<double>")
    assert retrieval.dense_topk(v, none).count() == 0
    q = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, vector array<double>")
    assert [(r["chunk_id"], round(r["score"], 3)) for r in retrieval.dense_topk(v, q).orderBy("rank").collect()] == [(1, 0.707), (2, 0.0)]
