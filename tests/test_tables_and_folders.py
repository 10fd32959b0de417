"""Tables that change in place, and library folders as a source."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnspark.sources import folder as D
from cairnspark.sources import tables as T

SCHEMA = "doc_id long, chunk int, kb_id string, text string, dim int, bucket int"


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, chunk int, kb_id string, text string, dim int")
    return df.withColumn("bucket", T.bucket("kb_id", 8))


def held(table):
    return {(r["doc_id"], r["chunk"], r["kb_id"], r["text"], r["dim"]) for r in table.read().collect()}


def files(table):
    return {p: p.stat().st_mtime_ns for p in Path(table.path).rglob("*.parquet")}


def test_changes_rewrite_touched_partitions_only(spark, tmp_path):
    rows = [(i, c, f"kb{i % 5}", f"text {i} {c}", 32 if i % 2 else 64) for i in range(40) for c in range(2)] + [(99, 0, None, "no base", 64)]
    df = made(spark, rows)
    table = T.PartitionedTable(spark, str(tmp_path / "t"), df.schema)
    assert held(table) == set() and table.create(df) and not table.create(df) and held(table) == set(rows)
    first = files(table)
    # a document with other chunks, in another base, and a new one
    new = [(7, 0, "kb0", "moved", 64), (500, 0, "kb2", "fresh", 64)]
    for _ in range(2):  # a retried batch
        table.replace(made(spark, new), ["doc_id"])
        rows_now = {r for r in rows if r[0] != 7} | set(new)
        assert held(table) == rows_now and table.read().count() == len(rows_now)
    kept = files(table)
    untouched = [p for p in first if not any(x in str(p) for x in {f"dim={d}/bucket={b}" for d, b in {(r["dim"], r["bucket"]) for r in made(spark, [*new, *[x for x in rows if x[0] == 7]]).collect()}})]
    assert untouched and all(kept.get(p) == first[p] for p in untouched)
    table.delete(spark.createDataFrame([("kb3",)], "kb_id string"), ["kb_id"])
    assert held(table) == {r for r in rows_now if r[2] != "kb3"}
    table.delete(spark.createDataFrame([(99, 0), (99, 1)], "doc_id long, chunk int"), ["doc_id", "chunk"])
    assert not [r for r in held(table) if r[0] == 99]
    with pytest.raises(ValueError):
        table.delete(df, [])
    table.keep_only("dim", 64)
    assert {r[4] for r in held(table)} == {64} and not list(Path(table.path).glob("dim=32/*/*.parquet"))
    table.delete(table.read().select("doc_id"), ["doc_id"])  # everything
    assert held(table) == set()
    table.replace(made(spark, new), ["doc_id"])
    assert held(table) == set(new)


@pytest.fixture
def library(tmp_path):
    for i, (name, body) in enumerate([("a.TXT", "one é".encode()), ("b.md", b"# two \xff"), ("sub/c.csv", b"x,y\n1,2"), ("d.png", b"\x89PNG"), ("e.flac", b"fLaC"), ("f.docx", b"PK")]):
        p = tmp_path / "lib" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
        os.utime(p, (1000 + i, 1000 + i))
    return str(tmp_path / "lib")


def test_folder_source(spark, library):
    D.register(spark)
    df = spark.read.format("library").option("path", library).option("task_bytes", 1).load()
    got = {r["name"]: (r["kind"], r["reader"], r["content"], r["flag"]) for r in df.collect()}
    assert got == {"a.TXT": ("txt", "text", "one é", False), "b.md": ("md", "text", "# two ", False), "c.csv": ("csv", "table", "x,y\n1,2", False), "d.png": ("png", "image", "", True), "e.flac": ("flac", "audio", "", True), "f.docx": ("docx", "office", None, False)}
    assert df.rdd.getNumPartitions() == 6
    some = df.where("reader = 'audio'")
    assert [r["name"] for r in some.collect()] == ["e.flac"] and some.rdd.getNumPartitions() == 1
    assert df.where(F.col("kind").isin("md", "csv")).count() == 2 and df.where("size > 4").count() == 3
    Path(library, "x.webp").write_bytes(b"")
    with pytest.raises(Exception, match="unsupported file type: webp"):
        spark.read.format("library").option("path", library).load().count()
    assert spark.read.format("library").option("path", library).option("unknown", "skip").load().count() == 6
    assert spark.read.format("library").option("path", library).option("kinds", "md").load().count() == 1


def test_folder_stream_replays_from_offsets(spark, library, tmp_path):
    D.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.format("library").option("path", library).option("batch_files", 2).load().select("name")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        batches = len([p for p in q.recentProgress if p["numInputRows"]])
        q.stop()
        return batches

    assert run() == 3
    Path(library, "g.md").write_bytes(b"new")
    assert run() == 1
    names = sorted(r[0] for r in spark.read.parquet(out).collect())
    assert names == ["a.TXT", "b.md", "c.csv", "d.png", "e.flac", "f.docx", "g.md"]
