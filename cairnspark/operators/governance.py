"""Scoped views, authorisation, listings, quotas and folder trees over relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.scratch import Scratch

IDENTIFIER = r"^[0-9a-zA-Z_-]{1,64}$"


def valid_id(value: Column) -> Column:
    """C5"""
    return F.coalesce(value.rlike(IDENTIFIER), F.lit(False))


def scoped(rows: DataFrame, tenant: str | None, platform: bool = False, shared: DataFrame | None = None) -> DataFrame:
    """A tenant's rows, and those of knowledge bases shared with it; all for the platform, none for nobody."""
    if platform:
        return rows
    if tenant is None:
        return rows.where(F.lit(False))
    own = rows.where(F.col("tenant_id") == tenant)
    if shared is None:
        return own
    return own.unionByName(rows.where(F.col("tenant_id") != tenant).join(shared.select("kb_id").distinct(), "kb_id", "left_semi").select(rows.columns))


def decision(write: Column) -> Column:
    """200, 403 or 404 of rows (tenant, kb_tenant, role, subject, owner, visibility, org_permission, grant, in_scope).

    ``grant`` is the strongest grant of the subject: 0 none, 1 read, 2 write; ``in_scope`` is null unless a machine key asks.
    """
    c = F.col
    denied_write = F.when(write, 403).otherwise(200)
    return (
        F.when(c("kb_tenant") != c("tenant"), F.when(~write & (c("grant") >= 1), 200).otherwise(404))
        .when(c("role").isNull() & c("subject").isNull() & c("in_scope").isNotNull(), F.when(c("in_scope"), 200).otherwise(404))
        .when(F.coalesce(c("owner") == c("subject"), F.lit(False)), 200)
        .when(c("visibility") == "organization", F.when(~write | (c("org_permission") == "write"), 200).otherwise(403))
        .when(F.coalesce(c("role").isin("admin", "super_admin"), F.lit(False)), denied_write)
        .when(c("grant") >= 2, 200)
        .when(c("grant") == 1, denied_write)
        .otherwise(404)
    )


def relation_label(owner: Column, subject: Column, granted: Column, visibility: Column, is_admin: Column) -> Column:
    """C10"""
    return F.when(F.coalesce(owner == subject, F.lit(False)), "mine").when(granted, "shared").when(visibility == "organization", "org").when(is_admin, "others").otherwise("shared")


def link_active(active: Column, expires: Column, used: Column, most: Column, as_of: Column) -> Column:
    """C13"""
    return active & (expires.isNull() | (expires > as_of)) & (most.isNull() | (used < most))


def status_order(status: Column) -> Column:
    """G6"""
    return F.when(status == "completed", 0).when(status == "failed", 1).when(status == "processing", 2).when(status == "pending", 3).otherwise(4)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a sorted listing; the size is held within 1 and 100."""
    size = max(1, min(100, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def last_page(number: int, total: int, size: int) -> int:
    """G5"""
    return max(1, min(number, -(-total // size)))


def clamp(v: Column, low: int, high: int) -> Column:
    """G9"""
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))


def capacity(used: Column, total: Column, per_file: int = 300, megabytes: int = 1) -> dict[str, Column]:
    """E4"""
    return {"percent": F.round(F.least(F.lit(1.0), used / total), 6), "approx_files": F.floor(total / (megabytes * per_file)).cast("long")}


def recommended_capacity(memory: Column, bases: Column) -> Column:
    """G11"""
    return F.when((memory > 0) & (bases > 0), F.least(F.lit(10_000_000), F.floor(F.floor(memory * 0.35 / 8192 / bases) / 1000) * 1000)).otherwise(100_000).cast("long")


def gate(incoming: DataFrame, used: DataFrame, cap: int) -> DataFrame:
    """incoming(kb_id, doc_id, n_chunks) with accepted: whether it fits beside what its base holds already."""
    u = used.groupBy("kb_id").agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("used"))
    return incoming.join(u, "kb_id", "left").withColumn("accepted", F.coalesce("used", F.lit(0)) + F.col("n_chunks") <= cap).drop("used")


def duplicates(files: DataFrame) -> DataFrame:
    """files(kb_id, doc_id, file_hash) with first_id: the first of the same content in its base, null for the first itself.

    A min per key with partial sums, joined back: a content that a third of all files share stays one row.
    """
    first = files.groupBy("kb_id", "file_hash").agg(F.min("doc_id").alias("first"))
    return files.join(first, ["kb_id", "file_hash"]).withColumn("first_id", F.when(F.col("first") != F.col("doc_id"), F.col("first"))).drop("first")


def trails(folders: DataFrame) -> DataFrame:
    """(id, trail): the folders above each of folders(id, parent_id), nearest first, by pointer doubling.

    One row a folder: a round joins each trail with that of its last folder, so depth d takes log2(d) rounds, and each
    round is a written table. A parent without a row of its own ends a trail; a folder on or below a cycle has each
    folder of the cycle once, never itself; of rows that repeat an id the least parent counts.
    """
    scratch = Scratch(folders.sparkSession)
    one = folders.where("id is not null").groupBy("id").agg(F.min("parent_id").alias("last"))
    now = scratch.keep(one.select("id", F.array_compact(F.array("last")).alias("trail"), "last"))
    while now.where("last is not null").limit(1).count():
        up = now.select(F.col("id").alias("last"), F.col("trail").alias("__t"), F.col("last").alias("__l"))
        both = now.join(up, "last", "left").select("id", F.concat("trail", F.coalesce("__t", F.array().cast("array<string>"))).alias("long"), F.col("__l").alias("last"))
        both = both.withColumn("trail", F.array_remove(F.array_distinct("long"), F.col("id")))
        # what repeats a folder has been round a cycle
        further = scratch.keep(both.select("id", "trail", F.when(F.size("trail") == F.size("long"), F.col("last")).alias("last")))
        scratch.drop(now)
        now = further
    return now.select("id", "trail")


def ancestors(folders: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of every folder above another, whatever the depth."""
    return trails(folders).select("id", F.posexplode("trail").alias("depth", "ancestor")).select("id", "ancestor", (F.col("depth") + 1).alias("depth"))


def descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of every folder below one of roots(root)."""
    return ancestors(folders).select(F.col("ancestor").alias("root"), "id").join(roots.select("root").distinct(), "root", "left_semi")


def folder_classes(paths: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """(path, supported) of uploaded files."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return paths.select("path", ext.isin(*supported).alias("supported"))


def parent_folders(paths: DataFrame) -> DataFrame:
    """Every folder above some file."""
    parts = F.split("path", "/")
    n = F.size(parts) - 1
    return paths.where(n > 0).select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder")).distinct()


def changed_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """fields(id, name, value) that differ, with both values."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["id", "name"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def with_fallback(value: Column, low, high, default) -> Column:
    """K9: a setting within its range, else its default."""
    return F.when(value.between(low, high), value).otherwise(default)


def first_failure(requested: DataFrame) -> DataFrame:
    """(request_id, status) of requested(request_id, pos, status): the first refusal, else 200."""
    bad = F.min(F.when(F.col("status") != 200, F.struct("pos", "status")))
    return requested.groupBy("request_id").agg(F.coalesce(bad["status"], F.lit(200)).alias("status"))


def ordered_ids(rows: DataFrame, by: str, value: str, pos: str, most: int | None = None) -> DataFrame:
    """Distinct values of each group by first place, with the number of them."""
    first = rows.groupBy(by, value).agg(F.min(pos).alias("first"))
    w = Window.partitionBy(by).orderBy("first")
    out = first.withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= most) if most else out
