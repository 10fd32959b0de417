"""What the operators of this subpackage share: tables, scratch tables and size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.scratch import BROADCAST_ROWS, Scratch, maybe_broadcast  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def byte_groups(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of runs of rows of about so many bytes together; null is empty."""
    first, held, n = 0, [], 0
    for k, t in enumerate(texts):
        t = t.as_buffer().to_pybytes() if t.is_valid else b""
        if held and n + len(t) > most:
            yield first, held
            first, held, n = k, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield first, held


_caches: dict[str, Callable[[], None]] = {}


def worker_caches(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Spark reuses Python workers: an operator that starts a task here frees what other operators keep here."""
    for name in [x for x in _caches if x != owner]:
        _caches.pop(name)()
    if clear:
        _caches[owner] = clear


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b): the least reachable node, by hooking and contraction.

    Every node hooks to its least neighbour, pointers are doubled until the hooks are flat, and the edges are
    renamed and those inside one component dropped, so rounds after the first work on few edges. Each step is a
    written table.
    """

    def changed(df: DataFrame) -> bool:
        return bool(df.limit(1).count())

    edges = scratch.keep(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or changed(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")))
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            flatter = scratch.keep(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            scratch.drop(hooks)
            hooks = flatter.select("node", "up")
            hooks._scratch_path = flatter._scratch_path
            if not changed(flatter.where("moved")):
                break
        if labels is None:
            after = hooks.select("node", F.col("up").alias("component"))
        else:
            after = labels.join(hooks.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        after = scratch.keep(after)
        renamed = edges.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(hooks.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").where("ua != ub")
        fewer = scratch.keep(renamed.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        scratch.drop(edges, hooks, *([labels] if labels is not None else []))
        edges, labels = fewer, after
    scratch.drop(edges)
    return labels
