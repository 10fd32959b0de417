"""Writers and keyed merges: every one is idempotent, so a retried job leaves the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.text import byte_limit

BUCKETS = 64
LONGEST_TEXT = 60_000


def stamped(vectors: DataFrame, kb_id: str, tenant_id: str) -> DataFrame:
    """B1, B2: vectors with their scope, dimension and bucket, texts within the byte limit."""
    out = vectors.withColumns({"kb_id": F.lit(kb_id), "tenant_id": F.lit(tenant_id), "dim": F.size("vector"), "bucket": F.pmod(F.xxhash64(F.lit(kb_id)), F.lit(BUCKETS)).cast("int")})
    return out.withColumn("content", byte_limit(F.col("content"), LONGEST_TEXT)) if "content" in out.columns else out


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A partitioned table that is there after the first write; readers of one base read one bucket."""
    vectors.write.partitionBy("dim", "bucket").mode("append").parquet(path)


def replace_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the documents in ``new`` replace all their old rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_matching(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without the named keys; a delete without keys is refused."""
    if not keys:
        raise ValueError("a delete needs at least one key column")
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def merge_counters(old: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts grow by the number of hits, last_used becomes the latest time."""
    new = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("seen"))
    return old.join(new, "key", "left").select("key", (F.col("count") + F.coalesce("n", F.lit(0))).alias("count"), F.greatest("last_used", "seen").alias("last_used"))


def append_audit(rows: DataFrame, path: str) -> None:
    """B15"""
    rows.write.mode("append").parquet(path)


def cache_key(*parts: str):
    """Every parameter that shapes a result is part of its key."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def unexpired(cache: DataFrame, as_of) -> DataFrame:
    """B13"""
    return cache.where(F.col("expires_at") > as_of)
