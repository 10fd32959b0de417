"""Tables that change: rows under partitions, of which a change rewrites only those that it touches.

A change reads the touched partitions, writes what they are to hold as a table of its own, and overwrites them by
Spark's dynamic partition overwrite; partitions that end up empty are removed. Files of other partitions stay as they
are. Every change is stated by keys and whole rows, so a retried one leaves the same table. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnspark.scratch import Scratch, exists, maybe_broadcast

BUCKETS = 64


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a knowledge base or other scope; a null scope has one too."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class PartitionedTable:
    """Rows of a schema under partitions ``by``, whose columns are integers that are never null."""

    spark: SparkSession
    path: str
    schema: StructType
    by: tuple[str, ...] = ("dim", "bucket")

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def create(self, rows: DataFrame) -> bool:
        """Writes the table if there is none; whether it did."""
        if exists(self.spark, self.path):
            return False
        self._write(rows)
        return True

    def replace(self, rows: DataFrame, key: list[str]) -> None:
        """All rows that share a key with new ones go, wherever they are, and the new ones come."""
        scratch = Scratch(self.spark)
        new = scratch.keep(rows.select(self.schema.fieldNames()))
        keys = new.select(key).distinct()
        self._change(new.select(*self.by).unionByName(self._places(keys, key)), lambda old: old.join(maybe_broadcast(keys), key, "left_anti").select(self.schema.fieldNames()).unionByName(new))
        scratch.drop(new)

    def delete(self, gone: DataFrame, key: list[str]) -> None:
        """Rows with the named keys go; a delete without keys is refused."""
        if not key:
            raise ValueError("a delete needs at least one key column")
        gone = Scratch(self.spark).keep(gone.select(key).distinct())
        self._change(self._places(gone, key), lambda old: old.join(maybe_broadcast(gone), key, "left_anti").select(self.schema.fieldNames()))

    def keep_only(self, name: str, value: int) -> None:
        """Partitions of another value of a partition column are removed as folders; no row is read."""
        for p in self.partitions():
            if p[name] != value:
                self._remove(p)

    def partitions(self) -> list[dict[str, int]]:
        """What partitions there are; their number is that of the values of ``by``."""
        return [r.asDict() for r in self.read().select(*self.by).distinct().collect()]

    def _places(self, keys: DataFrame, key: list[str]) -> DataFrame:
        """Partitions that hold rows with some keys; other columns aren't read."""
        own = list(dict.fromkeys([*self.by, *key]))
        return self.read().select(own).join(maybe_broadcast(keys), key, "left_semi").select(*self.by)

    def _change(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        at = [r.asDict() for r in touched.distinct().collect()]  # partitions, not rows
        if not at:
            return
        inside = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c) == F.lit(p[c]) for c in self.by]) for p in at])
        scratch = Scratch(self.spark)
        kept = scratch.keep(change(self.read().where(inside)))
        self._write(kept)
        left = {tuple(r) for r in kept.select(*self.by).distinct().collect()}
        for p in at:
            if tuple(p[c] for c in self.by) not in left:
                self._remove(p)
        scratch.drop(kept)

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.select(self.schema.fieldNames()).repartition(*self.by)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.path)

    def _remove(self, partition: dict[str, int]) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *[f"{c}={partition[c]}" for c in self.by]]))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
