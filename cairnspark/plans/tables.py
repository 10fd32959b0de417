"""Queries of tables that change in place and of library folders."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.plans.registry import library, query, table
from cairnspark.scratch import Scratch
from cairnspark.sources import folder
from cairnspark.sources.tables import PartitionedTable, bucket

ROWS_SQL = "rows AS (SELECT doc_id, source AS kb_id, md5(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN 32 ELSE 64 END::INTEGER AS dim FROM documents)"


def stored(spark: SparkSession, sf: str) -> PartitionedTable:
    """The documents as a new table under dimension and bucket of their base."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("kb_id"), F.md5("text").alias("digest"), F.when(F.col("doc_id") % 3 == 0, 32).otherwise(64).alias("dim"), bucket("source").alias("bucket"))
    made = PartitionedTable(spark, f"{Scratch(spark).folder}/rows", d.schema)
    made.create(d)
    return made


def read(made: PartitionedTable) -> DataFrame:
    return made.read().select("doc_id", "kb_id", "digest", "dim")


@query("b3_table_replace", f"WITH {ROWS_SQL} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'moved' ELSE kb_id END AS kb_id, CASE WHEN doc_id % 10 = 0 THEN md5('new ' || doc_id) ELSE digest END AS digest, CASE WHEN doc_id % 10 = 0 THEN 64 ELSE dim END::INTEGER AS dim FROM rows")
def b3_table(spark, sf):
    """A tenth of the documents is written anew in another base, twice, as a retried job would."""
    made = stored(spark, sf)
    new = made.read().where("doc_id % 10 = 0").select("doc_id", F.lit("moved").alias("kb_id"), F.md5(F.concat(F.lit("new "), "doc_id")).alias("digest"), F.lit(64).alias("dim")).withColumn("bucket", bucket("kb_id"))
    new = Scratch(spark).keep(new)
    made.replace(new, ["doc_id"])
    made.replace(new, ["doc_id"])
    return read(made)


@query("b4_table_delete", f"WITH {ROWS_SQL} SELECT * FROM rows WHERE kb_id <> 'src1' AND doc_id % 7 <> 3")
def b4_table(spark, sf):
    """A base and some documents are deleted."""
    made = stored(spark, sf)
    made.delete(spark.createDataFrame([("src1",)], "kb_id string"), ["kb_id"])
    made.delete(table(spark, sf, "documents").where("doc_id % 7 = 3").select("doc_id"), ["doc_id"])
    return read(made)


@query("b26_table_dimension", f"WITH {ROWS_SQL} SELECT * FROM rows WHERE dim = 64")
def b26_table(spark, sf):
    """All dimensions but one are dropped as folders; the table is there already, so it isn't made again."""
    made = stored(spark, sf)
    made.create(made.read())
    made.keep_only("dim", 64)
    return read(made)


@query("b11_table_drop_base", "SELECT p_brand AS kb_id, count(*)::BIGINT AS n FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1")
def b11_table(spark, sf):
    """The entities of one base leave the graph's table."""
    e = table(spark, sf, "part").select(F.col("p_brand").alias("kb_id"), F.col("p_partkey").alias("name"), bucket("p_brand").alias("bucket"))
    made = PartitionedTable(spark, f"{Scratch(spark).folder}/entities", e.schema, ("bucket",))
    made.create(e)
    made.delete(spark.createDataFrame([("Brand#11",)], "kb_id string"), ["kb_id"])
    return made.read().groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"))


@query("b12_table_summaries", "SELECT n_regionkey AS kb_id, n_name AS summary FROM nation WHERE n_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey % 2 = 1")
def b12_table(spark, sf):
    """Summaries of some bases are cleared and written anew; those of others stay."""
    rows = lambda df, kb, name: df.select(F.col(kb).alias("kb_id"), F.col(name).alias("summary"), bucket(kb).alias("bucket"))
    old = rows(table(spark, sf, "nation"), "n_regionkey", "n_name")
    made = PartitionedTable(spark, f"{Scratch(spark).folder}/summaries", old.schema, ("bucket",))
    made.create(old)
    made.replace(rows(table(spark, sf, "region").where("r_regionkey % 2 = 1"), "r_regionkey", "r_name"), ["kb_id"])
    return made.read().select("kb_id", "summary")


@query("b16_table_config", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer")
def b16_table(spark, sf):
    """A patch of settings, of which only known fields reach the table."""
    known = ["segment"]
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"), bucket("c_custkey", 8).alias("bucket"))
    made = PartitionedTable(spark, f"{Scratch(spark).folder}/settings", c.schema, ("bucket",))
    made.create(c)
    some = c.where("key % 3 = 0")
    patch = some.withColumn("value", F.lit("new")).unionByName(some.withColumn("name", F.lit("colour")).withColumn("value", F.lit("red")))
    made.replace(patch.where(F.col("name").isin(known)), ["key", "name"])
    return made.read().select("key", "value")


@query("b21_table_cancel", "SELECT doc_id, CASE WHEN doc_id % 11 IN (7, 8, 9) AND source = 'src2' THEN 'cancelled' ELSE CASE WHEN doc_id % 11 < 6 THEN 'completed' WHEN doc_id % 11 = 6 THEN 'failed' WHEN doc_id % 11 < 9 THEN 'processing' WHEN doc_id % 11 = 9 THEN 'pending' ELSE 'cancelled' END END AS status FROM documents")
def b21_table(spark, sf):
    """Unfinished documents of one base are cancelled in place: only its bucket is written."""
    d = library(spark, sf).select("doc_id", "kb_id", "status", bucket("kb_id").alias("bucket"))
    made = PartitionedTable(spark, f"{Scratch(spark).folder}/status", d.schema, ("bucket",))
    made.create(d)
    open_now = made.read().where("kb_id = 'src2' and status in ('processing', 'pending')")
    made.replace(open_now.withColumn("status", F.lit("cancelled")), ["doc_id"])
    return made.read().select("doc_id", "status")


def written_files(docs: DataFrame, path: str) -> int:
    """Files doc_<id>.txt of docs(doc_id, text) in a folder that all tasks see; how many."""
    path = path.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(f"{path}/doc_{i}.txt", "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@query("a2_library_folder", "SELECT 'doc_' || doc_id || '.txt' AS name, 'text' AS reader, strlen(coalesce(text, ''))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents")
def a2_folder(spark, sf):
    """The documents as files of a library folder, listed and read by the data source."""
    path = f"{Scratch(spark).folder}/library"
    written_files(table(spark, sf, "documents"), path)
    folder.register(spark)
    rows = spark.read.format("library").option("path", path).load().where("reader = 'text'")
    return rows.select("name", "reader", "size", F.md5("content").alias("digest"))
