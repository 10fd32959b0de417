"""Approximate nearest neighbours: a robust-pruned directed graph a shard, built and searched inside Spark groups.

Distinct vectors are dealt to shards of bounded size by a hash. In every shard, greedy searches from its medoid
propose neighbours for batches of nodes, relaxed distance pruning keeps edges in diverse directions, and
reversed edges are pruned alike. Vectors get one more component that makes all of them equally long, so the
largest inner product is the least distance. The graph is a written table, a row a node; queries meet every
shard in blocks of bounded size and walk its graph with a beam. Scores of what a beam finds are taken on the
original vectors in double precision, and the shards' finds are merged by rank.

Copies of a vector are one node: of each distinct vector the k + 1 smallest ids are all that any query's k
nearest can name, so a vector that a third of all rows share costs no more than another.

Results: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors
of equal length are compared; a row whose id is null is no query and no candidate; a vec_id that repeats names each
of its vectors, and a query with such an id is searched with each of them, without candidates of its own id;
extra columns are ignored; an empty table gives an empty result; with fewer candidates than k, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.common import Scratch

SALTS = 64


@dataclass(frozen=True)
class Graph:
    """degree: edges of a node; beam: width while building; search: width of a query; relax: how much longer a detour may be before an edge stays; insert: nodes whose reversed edges are added together."""

    shard_rows: int = 4096
    degree: int = 32
    beam: int = 48
    search: int = 96
    relax: float = 1.2
    insert: int = 1024
    batch: int = 256
    query_block: int = 4096
    expand: int = 4


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(node, vec_id, vector) of the k + 1 smallest ids of each distinct vector; node is the vector's hash."""
    # a repeated row takes one place only; partial aggregation leaves one of its rows a task
    salted = rows.dropDuplicates(["node", "vec_id"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("node", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = some.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return few.drop("salt", "r")


def _augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component: all rows get the length of the longest vector."""
    rest = np.sqrt(np.maximum(longest**2 - (x.astype(np.float64) ** 2).sum(1), 0.0))
    return np.c_[x, rest].astype(np.float32)


def _prune(x: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Per node at[i], up to degree of its candidates near[i] (-1: none): the closest first, then none that a kept one is relax times closer to."""
    b, c = near.shape
    rows = np.arange(b)
    near = np.sort(near, 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == at[:, None]] = -1
    vectors = x[near]
    squares = (x**2).sum(1)
    dist = squares[near] - 2 * np.einsum("bcd,bd->bc", vectors, x[at]) + squares[at][:, None]
    dist[near < 0] = np.inf
    left = dist.copy()
    taken = np.zeros((b, c), bool)
    out = np.full((b, degree), -1, np.int32)
    for k in range(min(degree, c)):
        best = left.argmin(1)
        alive = np.isfinite(left[rows, best])
        if not alive.any():
            break
        out[alive, k] = near[rows, best][alive]
        chosen = vectors[rows, best]
        between = squares[near] - 2 * np.einsum("bcd,bd->bc", vectors, chosen) + squares[near[rows, best]][:, None]
        left[(relax**2 * between <= dist) & alive[:, None]] = np.inf
        left[rows, best] = np.inf
        taken[rows[alive], best[alive]] = True
    # places that diversity leaves empty go to the closest of the rest
    kept = (out >= 0).sum(1)
    dist[taken] = np.inf
    order = np.argsort(dist, 1)[:, :degree]
    place = np.arange(degree)[None, :] - kept[:, None]
    rest = order[rows[:, None], np.clip(place, 0, order.shape[1] - 1)]
    fill = (place >= 0) & (place < order.shape[1]) & np.isfinite(dist[rows[:, None], rest])
    out[fill] = near[rows[:, None], rest][fill]
    return out


def _walk(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, width: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches of a batch of queries: (nodes, scores), best first; -1 and -inf where a beam has fewer."""
    b = len(q)
    width = max(width, expand)
    rows = np.arange(b)[:, None]
    beam = np.full((b, width), -1, np.int64)
    score = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    beam[:, 0], score[:, 0], done[:, 0] = start, q @ x[start], False
    seen = np.zeros((b, len(x) + 1), bool)
    seen[:, start] = seen[:, -1] = True
    while True:
        open_score = np.where(done, -np.inf, score)
        pick = np.argpartition(-open_score, expand - 1, 1)[:, :expand]
        live = np.isfinite(open_score[rows, pick])
        active = np.flatnonzero(live.any(1))
        if not len(active):
            return beam, score
        done[rows, pick] = True
        nodes = np.where(live, beam[rows, pick], -1)[active]
        near = np.where((nodes >= 0)[:, :, None], edges[nodes], -1).reshape(len(active), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        old = seen[active[:, None], near]
        seen[active[:, None], near] = True
        near[old] = -1
        found = np.where(near >= 0, np.einsum("bcd,bd->bc", x[near], q[active]), -np.inf).astype(np.float32)
        all_nodes = np.concatenate((beam[active], near), 1)
        all_scores = np.concatenate((score[active], found), 1)
        all_done = np.concatenate((done[active], near < 0), 1)
        order = np.argsort(-all_scores, 1, kind="stable")[:, :width]
        take = np.arange(len(active))[:, None]
        beam[active], score[active], done[active] = all_nodes[take, order], all_scores[take, order], all_done[take, order]


def build(vectors: np.ndarray, g: Graph, longest: float) -> tuple[np.ndarray, int]:
    """(edges, start) of the graph over the rows of vectors."""
    n = len(vectors)
    x = _augmented(vectors, longest)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    rng = np.random.Generator(np.random.PCG64(5))
    degree = min(g.degree, max(1, n - 1))
    edges = rng.integers(0, n, (n, degree)).astype(np.int32)
    edges[edges == np.arange(n)[:, None]] = -1
    for relax in (1.0, g.relax):
        order = rng.permutation(n)
        for first in range(0, n, g.insert):
            at = order[first : first + g.insert]
            for some in range(0, len(at), g.batch):
                own = at[some : some + g.batch]
                near, _ = _walk(x, edges, start, x[own], g.beam, g.expand)
                edges[own] = _prune(x, own, np.concatenate((near, edges[own]), 1), degree, relax)
            into, back = edges[at].ravel(), np.repeat(at, degree)
            into, back = into[into >= 0], back[into >= 0]
            by = np.argsort(into, kind="stable")
            into, back = into[by], back[by]
            nodes, begin, count = np.unique(into, return_index=True, return_counts=True)
            extra = np.full((len(nodes), int(count.max()) if len(nodes) else 1), -1, np.int64)
            extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(into)) - np.repeat(begin, count)] = back
            for some in range(0, len(nodes), g.batch):
                own = nodes[some : some + g.batch]
                edges[own] = _prune(x, own, np.concatenate((edges[own], extra[some : some + g.batch]), 1), degree, relax)
    return edges, start


def index(nodes: DataFrame, g: Graph, longest: float) -> DataFrame:
    """(shard, place, node, least_id, start, vector, edges): the graph of every shard of nodes(shard, node, least_id, vector)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        x = np.array(t.column("vector").to_pylist(), np.float32)
        edges, start = build(x, g, longest)
        n = t.num_rows
        return pa.table({"shard": t.column("shard"), "place": pa.array(np.arange(n, dtype=np.int32)), "node": t.column("node"), "least_id": t.column("least_id"), "start": pa.array(np.full(n, start, np.int32)), "vector": t.column("vector"), "edges": pa.array([e[e >= 0] for e in edges], pa.list_(pa.int32()))})

    return nodes.groupBy("shard").applyInArrow(run, "shard long, place int, node long, least_id long, start int, vector array<double>, edges array<int>")


def walk_shards(graph: DataFrame, queries: DataFrame, k: int, g: Graph, longest: float) -> DataFrame:
    """(query_id, query_node, node, least_id, score): what each query(shard, block, query_id, node, vector) finds in its shard."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query_node", "node", "least_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        left = left.sort_by("place")
        raw = np.array(left.column("vector").to_pylist(), np.float64)
        x = _augmented(raw.astype(np.float32), longest)
        edges = np.full((len(raw), max([1, *map(len, left.column("edges").to_pylist())])), -1, np.int32)
        for i, e in enumerate(left.column("edges").to_pylist()):
            edges[i, : len(e)] = e
        start = left.column("start")[0].as_py()
        q = np.array(right.column("vector").to_pylist(), np.float64)
        node, least = left.column("node").to_numpy(), left.column("least_id").to_numpy()
        own = right.column("node").to_numpy()
        parts = []
        for first in range(0, len(q), g.batch):
            part = q[first : first + g.batch]
            found, _ = _walk(x, edges, start, np.c_[part, np.zeros(len(part))].astype(np.float32), g.search, g.expand)
            exact = np.where(found >= 0, np.einsum("bcd,bd->bc", raw[found], part), -np.inf)
            order = np.lexsort((least[found], -exact), axis=1)[:, : k + 1]
            take = np.arange(len(part))[:, None]
            found, exact = found[take, order], exact[take, order]
            real = np.isfinite(exact)
            who = np.repeat(np.arange(first, first + len(part)), real.sum(1))
            parts.append((who, found[real], exact[real]))
        who, found, exact = (np.concatenate([p[j] for p in parts]) for j in range(3))
        ids = right.column("query_id").to_numpy()
        return pa.table([pa.array(ids[who]), pa.array(own[who]), pa.array(node[found]), pa.array(least[found]), pa.array(exact)], names)

    by = ["shard", "block"]
    return graph.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(run, "query_id long, query_node long, node long, least_id long, score double")


def search(embeddings: DataFrame, k: int = 20, every: int = 20, g: Graph = Graph()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by ``every``."""
    scratch = Scratch(embeddings.sparkSession)
    rows = embeddings.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    rows = rows.withColumn("node", F.xxhash64("vector"))
    few = scratch.keep(distinct_vectors(rows, k))
    nodes = few.groupBy("node").agg(F.min(F.struct("vec_id", "vector")).alias("x")).select("node", F.col("x.vec_id").alias("least_id"), F.col("x.vector").alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = nodes.agg(F.count(F.lit(1)), F.max(length)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    shards = -(-n // g.shard_rows)
    shard = F.pmod(F.xxhash64("node"), F.lit(shards)) + F.size("vector") * F.lit(shards)
    graph = scratch.keep(index(nodes.select(shard.alias("shard"), "node", "least_id", "vector"), g, longest))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "node", "vector")
    asked = scratch.keep(asked.dropDuplicates(["query_id", "node"]))
    blocks = max(1, -(-asked.count() // g.query_block))
    in_block = F.pmod(F.xxhash64("query_id", "node"), F.lit(blocks)).alias("block")
    each = F.sequence(F.size("vector") * F.lit(shards), F.size("vector") * F.lit(shards) + shards - 1)
    queries = asked.select(F.explode(each).alias("shard"), in_block, "query_id", "node", "vector")
    met = graph.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("block", F.col("block").cast("long"))
    found = walk_shards(met, queries.withColumn("shard", F.col("shard").cast("long")), k, g, longest)
    # of each query's nodes the best k + 1 hold k candidates besides its own id
    best = Window.partitionBy("query_id", "query_node").orderBy(F.desc("score"), "least_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r", "least_id")
    named = found.join(few.select("node", "vec_id"), "node").where("vec_id != query_id")
    named = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.select("query_id", F.row_number().over(last).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
