"""Where tables between two steps are written: one folder that every executor sees."""

from __future__ import annotations

import logging
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most two longs that a size-checked join may broadcast (some 32 MB).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session that names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cairnspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """Written tables that cut lineage: a lost executor costs a re-read, not a re-run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/cairnspark-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep_buckets(self, df: DataFrame, by: str, most: int) -> DataFrame:
        """A written table in buckets of a column, as many as a shuffle has partitions or ``most``: sums and joins by the column need no shuffle."""
        self.n += 1
        path, name = f"{self.folder}/{self.n}", f"cairnspark_{uuid.uuid4().hex}"
        n = min(most, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df.repartition(n, by).write.bucketBy(n, by).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            if name := getattr(t, "_scratch_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            try:
                path.getFileSystem(conf).delete(path, True)
            except Py4JError as e:  # a table that stays costs disk only
                logging.getLogger(__name__).warning("scratch table %s stays: %s", path, e)


def maybe_broadcast(small: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted rows are within the bound; else Spark shuffles both sides."""
    rows = small.count() if rows is None else rows
    return F.broadcast(small) if rows <= most else small
