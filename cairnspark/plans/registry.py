"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the rows of a document library: knowledge base, tenant, file, size, status, times."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 11
    return d.select(
        "doc_id",
        "text",
        F.col("source").alias("kb_id"),
        F.col("lang").alias("tenant_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.sha2("text", 256).alias("file_hash"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.when(k < 6, "completed").when(k == 6, "failed").when(k < 9, "processing").when(k == 9, "pending").otherwise("cancelled").alias("status"),
        F.ceil(F.length("text") / 450).cast("long").alias("chunk_count"),
    )


#: The same rows for DuckDB.
LIBRARY_SQL = """library AS (SELECT doc_id, text, source AS kb_id, lang AS tenant_id, 'doc_' || doc_id || '.txt' AS filename, sha256(text) AS file_hash,
  strlen(text)::BIGINT AS file_size, CASE WHEN doc_id % 11 < 6 THEN 'completed' WHEN doc_id % 11 = 6 THEN 'failed' WHEN doc_id % 11 < 9 THEN 'processing'
  WHEN doc_id % 11 = 9 THEN 'pending' ELSE 'cancelled' END AS status, ceil(length(text) / 450)::BIGINT AS chunk_count FROM documents)"""
