"""Vectors in cells: a written table under (bucket of the knowledge base, cell), searched by the cells nearest to a query.

Centres come from k-means by cosine on a bounded sample of unit vectors; every vector is indexed under its nearest
centre. A query reads a share of the cells, those whose centres are nearest, of the buckets of the bases it may see,
and ranks their vectors exactly; it is sent once to a shard of cells, whatever the number of cells it probes there; folders of other cells and buckets are not opened. With a share of 1 the result is exact.
A batch is appended by the same centres; the centres stay until the index is built anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import vectors as V
from cairnspark.operators.retrieval import QUERY_BLOCK, SHARD_ROWS, meet, ranked, scope
from cairnspark.scratch import exists

#: Rows that k-means is fitted on, and the most centres; with 1,024 doubles a centre they take 32 MB.
SAMPLE, MOST_CELLS = 100_000, 4096
BUCKETS = 16
ROUNDS = 10
#: The share of cells that a query probes; vectors without clusters need so many for a recall of 0.9 (README has figures).
SHARE = 0.6
ROWS = "chunk_id long, kb_id string, vector array<double>, slice int, batch int, bucket int, cell int"


@dataclass(frozen=True)
class Cells:
    """An index in a folder."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows")

    def centres(self) -> np.ndarray:
        """MOST_CELLS rows at most."""
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()])


def _nearest(centres: np.ndarray, n: int):
    """A pandas UDF: the n nearest centres of each vector; a vector without direction goes to the first."""

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
        s = x @ centres.T
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return near


def _bucket(kb: str = "kb_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.coalesce(F.col(kb), F.lit(""))), F.lit(buckets)).cast("int")


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 5) -> Cells:
    """Fits centres to vectors(chunk_id, kb_id, vector) and writes them as batch 0; an index that is there is kept, centres and all."""
    spark = vectors.sparkSession
    if exists(spark, f"{path}/centres"):
        return append(Cells(spark, path), vectors, 0)
    n = vectors.count()
    cells = cells or int(min(MOST_CELLS, max(1, round(n**0.5))))
    x = vectors.select(V.as_double(F.col("vector")).alias("v")).where(F.exists("v", lambda c: c != 0))
    x = x.sample(min(1.0, 1.2 * SAMPLE / max(1, n)), seed).limit(SAMPLE).select(array_to_vector("v").alias("features")) if n > SAMPLE else x.select(array_to_vector("v").alias("features"))
    found = KMeans(k=cells, maxIter=ROUNDS, seed=seed, distanceMeasure="cosine").fit(x).clusterCenters() if cells > 1 else [np.ones(len(x.first()["features"]))]
    units = [c / (np.linalg.norm(c) or 1.0) for c in found]
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(units)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    return append(Cells(spark, path), vectors, 0)


def append(index: Cells, vectors: DataFrame, batch: int) -> Cells:
    """Writes a batch; the same batch again leaves the same rows."""
    near = _nearest(index.centres(), 1)
    placed = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("kb_id").cast("string").alias("kb_id"), V.as_double(F.col("vector")).alias("vector"))
    placed = placed.withColumn("cell", near("vector")[0]).withColumn("bucket", _bucket())
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("slices"))  # MOST_CELLS rows at most
    # a cell that holds everything is still cut into parts of bounded size, and one of a few rows is one file
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int"))
    placed = placed.select("chunk_id", "kb_id", "vector", "slice", "bucket", "cell")
    placed.repartition("bucket", "cell", "slice").write.mode("overwrite").partitionBy("bucket", "cell").parquet(f"{index.path}/rows/batch={batch}")
    return index


def search(index: Cells, queries: DataFrame, k: int = 10, share: float = SHARE, kb_ids: list | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best by cosine of a share of the cells; of the named bases alone, if any are given."""
    centres = index.centres()
    probes = max(1, min(len(centres), round(share * len(centres))))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), V.as_double(F.col("vector")).alias("vector"))
    rows = index.rows()
    if kb_ids:
        names = [str(b) for b in kb_ids]
        held = [r[0] for r in index.spark.createDataFrame([(b,) for b in names], "kb_id string").select(_bucket()).distinct().collect()]
        rows = scope(rows.where(F.col("bucket").isin(held)), names)
    near = None
    if probes < len(centres):
        near = asked.select("query_id", F.explode(_nearest(centres, probes)("vector")).alias("cell"))
        rows = rows.where(F.col("cell").isin([r[0] for r in near.select("cell").distinct().collect()]))  # MOST_CELLS at most
    shards, n_shards = sharded(rows)
    if near is None:
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    else:
        probed = near.join(F.broadcast(shards), "cell").select("query_id", "cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("cuts") - 1)).alias("shard"))
        asked = asked.join(probed.groupBy("query_id", "shard").agg(F.collect_list("cell").alias("cells")), "query_id")
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    at = F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("cuts")).cast("int")
    rows = rows.join(F.broadcast(shards), "cell").select("chunk_id", "vector", "cell", at.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return ranked(meet(rows, asked, ["shard", "block"], k), ["query_id"], k)


def sharded(rows: DataFrame) -> tuple[DataFrame, int]:
    """(cell, first, cuts) and the number of shards: neighbouring cells share a shard of some SHARD_ROWS rows, larger ones are cut into several."""
    found, shard, used = [], 0, 0
    for cell, n in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect():  # MOST_CELLS at most
        cuts = -(-n // SHARD_ROWS)
        if used and used + n > SHARD_ROWS:
            shard, used = shard + 1, 0
        found.append((cell, shard, cuts))
        shard, used = (shard + cuts, 0) if cuts > 1 else (shard, used + n)
    return rows.sparkSession.createDataFrame(found, "cell int, first int, cuts int"), shard + 1
