"""Modularity communities by Louvain: moves of single nodes by their gain, then contraction, level by level.

Nodes are longs in the order of their names, and a level's edges are written once, in buckets of the node that they
start from. A step looks up the label of each edge's other end and adds up the votes per (node, community) in the
bucket where they lie, so edges are not shuffled again; no node's neighbours are gathered in one row. The same sums
give what every node has inside its own community, so one pass over the edges measures the modularity of the labels
and finds every node's next best move.

All nodes find their best move at once, and moves made at once may harm each other. So a half of them, drawn by hash,
is tried and its modularity measured on the whole graph; if that falls, an eighth is tried; and if that fails too, the
moves that are the best one at both communities they touch, which can't disturb each other, so their gains add up.
Modularity therefore never falls. Labels and contracted graphs are written tables, so a lost executor costs the step
it was in.

Up to DENSE_NODES nodes the same steps run on arrays: nodes are numbered without gaps, a step is one pass over the
edges, in parts of bounded size, with the labels as arrays in every worker, and only moves leave it; what follows from
the moves is small and done where the labels are. Larger graphs, or names that share a hash, keep labels as tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.scratch import Scratch, maybe_broadcast

#: Rounds of moves a level, levels, and the least growth of modularity that is worth another round.
PASSES, LEVELS, TOLERANCE = 10, 10, 1e-4
SHARES = (0.5, 0.125)
LEAST_GAIN = 1e-12
#: Labels of so many nodes may be broadcast (three longs and a double each, some 200 MB); more are shuffled.
LABEL_ROWS = 3_000_000
#: Edges in a bucket, until there are as many buckets as a shuffle has partitions.
BUCKET_ROWS = 200_000
#: Nodes whose labels may be arrays (28 bytes a node in each worker, some 280 MB), edges of one array, and edges that a task deals at once.
DENSE_NODES, PART_EDGES, HELD_EDGES = 10_000_000, 500_000, 2_000_000


@dataclass
class Communities:
    """labels(name, community): the smallest name of each community stands for it; modularity after every accepted step, and the levels."""

    labels: DataFrame
    modularity: list[float] = field(default_factory=list)
    levels: int = 0


def undirected(relations: DataFrame) -> DataFrame:
    """(a, b, w) with a <= b: the weights of relations(source, target, weight) between two nodes, added up."""
    ends = relations.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("weight").cast("double").alias("w"))
    return ends.groupBy("a", "b").agg(F.sum("w").alias("w"))


def numbered(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """nodes(id, name, h): longs in the order of the names of edges(a, b), and a hash of the name."""
    names = edges.select(F.col("a").alias("name")).union(edges.select(F.col("b").alias("name"))).distinct()
    return scratch.keep(names.orderBy("name").select(F.monotonically_increasing_id().alias("id"), "name", F.xxhash64("name").alias("h")))


class Level:
    """A graph of edges(a, b, w) between longs, as one level of moves sees it: its edges from both ends, in buckets of the first."""

    def __init__(self, scratch: Scratch, edges: DataFrame, nodes: DataFrame, n_nodes: int, m2: float):
        self.scratch, self.n, self.m2 = scratch, n_nodes, m2
        ends = edges.select(F.col("a").alias("node"), "w").union(edges.select(F.col("b").alias("node"), "w"))
        degrees = ends.groupBy("node").agg(F.sum("w").alias("k"))
        hashed = degrees.join(maybe_broadcast(nodes.select(F.col("id").alias("node"), "h"), n_nodes, LABEL_ROWS), "node")
        self.start = scratch.keep(hashed.select("node", F.col("node").alias("community"), "h", "k"))
        self.n = self.start.count()
        self.loops = edges.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        apart = edges.where("a != b")
        both = apart.select("a", "b", "w").union(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        self.both = scratch.keep_buckets(both, "a", apart.count() // BUCKET_ROWS + 1)

    def weighed(self, labels: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """labels(node, community, h, k), kept with tot, the degrees of the community; (node, home, k, home_tot, own, best), a row a node with neighbours; and the modularity.

        own is the node's weight to its own community, best the other community of the largest offer; ties go by the
        hash of the community's name.
        """
        total = labels.groupBy("community").agg(F.sum("k").alias("tot"))
        known = self.scratch.keep(labels.join(maybe_broadcast(total, self.n, LABEL_ROWS), "community").select("node", "community", "h", "k", "tot"))
        other = known.select(F.col("node").alias("b"), "community", "h", "tot")
        votes = self.both.join(maybe_broadcast(other, self.n, LABEL_ROWS), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("v"), F.first("h").alias("h"), F.first("tot").alias("tot"))
        home = known.select("node", F.col("community").alias("home"), "k", (F.col("tot") - F.col("k")).alias("home_tot"))
        at = votes.join(home.hint("shuffle_hash"), "node")
        own = F.coalesce(F.max(F.when(F.col("community") == F.col("home"), F.col("v"))), F.lit(0.0)).alias("own")
        # what a node's own community offers is the same for all its moves, so the best offer is found in one sum per node
        offer = F.col("v") - F.col("k") * F.col("tot") / self.m2
        best = F.max(F.when(F.col("community") != F.col("home"), F.struct(offer.alias("offer"), F.struct("h", "community").alias("c")))).alias("best")
        found = self.scratch.keep(at.groupBy("node", "home", "k", "home_tot").agg(own, best))
        inside, squares = found.select("own", F.lit(0.0).alias("x")).union(known.select(F.lit(0.0), F.col("k") * F.col("tot"))).agg(F.sum("own"), F.sum("x")).first()
        return known, found, (inside + 2 * self.loops) / self.m2 - squares / self.m2**2

    def moves(self, found: DataFrame) -> DataFrame:
        """(node, target, h, gain, community): of each node of weighed() the move of largest gain in modularity, if any gains."""
        gain = F.col("best.offer") - F.col("own") + F.col("k") * F.col("home_tot") / self.m2
        return found.where("best is not null").select("node", F.col("best.c.community").alias("target"), F.col("best.c.h").alias("h"), (2 * gain / self.m2).alias("gain"), F.col("home").alias("community")).where(F.col("gain") > LEAST_GAIN)


def independent(moves: DataFrame) -> DataFrame:
    """The moves that are the best one at both communities they touch."""
    rank = F.struct("gain", "node")
    touched = moves.select("node", rank.alias("r"), F.explode(F.array("community", "target")).alias("at"))
    best = touched.groupBy("at").agg(F.max("r").alias("r")).select("at", F.col("r.node").alias("node"))
    return moves.join(best.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2"), "node", "left_semi")


def move_nodes(scratch: Scratch, edges: DataFrame, nodes: DataFrame, n_nodes: int, m2: float, trace: list[float], passes: int, tolerance: float) -> tuple[DataFrame, int] | None:
    """labels(node, community, h, k, tot) after local moves and how many they are, or None if nothing moves."""
    level = Level(scratch, edges, nodes, n_nodes, m2)
    labels, found, q = level.weighed(level.start)
    if not trace:
        trace.append(q)
    any_moved = False
    for number in range(passes):
        moves = level.moves(found)
        n = moves.count()
        if not n:
            break
        named = moves.join(maybe_broadcast(nodes.select(F.col("id").alias("node"), "name"), n_nodes), "node")
        draw = F.pmod(F.xxhash64("name", F.lit(number)), F.lit(1 << 20)) / float(1 << 20)
        tries = [named.where(draw < share) for share in SHARES] + [independent(moves)]
        for chosen in tries:
            to = chosen.select("node", "target", F.col("h").alias("target_h"))
            tried = labels.join(maybe_broadcast(to, n), "node", "left").select("node", F.coalesce("target", "community").alias("community"), F.coalesce("target_h", "h").alias("h"), "k")
            tried, next_found, q = level.weighed(tried)
            if q > trace[-1]:
                break
            scratch.drop(tried, next_found)
        if q <= trace[-1]:  # rounding is all that is left
            break
        scratch.drop(labels, found)
        labels, found, any_moved, grown = tried, next_found, True, q - trace[-1]
        trace.append(q)
        if grown < tolerance and chosen is not tries[-1]:
            break
    scratch.drop(found, level.both)
    return (labels, level.n) if any_moved else None


def drawn(h: np.ndarray, number: int) -> np.ndarray:
    """xxhash64(name, number) of names of these hashes, as Spark computes it, scaled to 0 to 1."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = (h.view(np.uint64) + (p5 + np.uint64(4))) ^ np.uint64(number * int(p1) & (1 << 64) - 1)
    x = (x << np.uint64(23) | x >> np.uint64(41)) * p2 + p3
    x = (x ^ x >> np.uint64(33)) * p2
    x = (x ^ x >> np.uint64(29)) * p3
    return ((x ^ x >> np.uint64(32)) & np.uint64((1 << 20) - 1)).astype(float) / (1 << 20)


def best_moves(a: np.ndarray, b: np.ndarray, w: np.ndarray, community: np.ndarray, tot: np.ndarray, k: np.ndarray, h: np.ndarray, m2: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Twice the weight inside communities of all edges of some nodes (loops stand once, at twice their weight), and (node, target, gain) of the nodes that gain."""
    apart = a != b
    loops = float(w[~apart].sum())
    a, b, w = a[apart], b[apart], w[apart]
    if not len(a):
        return loops, a, a, w
    key = a.astype(np.int64) << 32 | community[b]
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    v, node, c = np.add.reduceat(w[order], starts), key[starts] >> 32, key[starts] & 0xFFFFFFFF
    at_home = c == community[node]
    firsts = np.flatnonzero(np.diff(node, prepend=-1))
    group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(node))))
    own = np.add.reduceat(np.where(at_home, v, 0.0), firsts)
    offer = np.where(at_home, -np.inf, v - k[node] * tot[c] / m2)
    best = np.maximum.reduceat(offer, firsts)
    tie = ~at_home & (offer == best[group])  # ties go by the hash of the community's name
    spelt = np.where(tie, h[c], np.iinfo(np.int64).min)
    target = np.maximum.reduceat(np.where(tie & (spelt == np.maximum.reduceat(spelt, firsts)[group]), c, -1), firsts)
    node = node[firsts]
    gain = 2 * (best - own + k[node] * (tot[community[node]] - k[node]) / m2) / m2
    gains = gain > LEAST_GAIN
    return loops + float(own.sum()), node[gains].astype(np.int32), target[gains].astype(np.int32), gain[gains]


def independent_moves(node: np.ndarray, home: np.ndarray, target: np.ndarray, gain: np.ndarray, n: int) -> np.ndarray:
    """independent() of arrays: which moves are the best one at both communities they touch."""
    place = np.empty(len(node), np.int64)
    place[np.lexsort((node, gain))] = np.arange(len(node))
    best = np.full(n, -1)
    for at in (home, target):
        np.maximum.at(best, at, place)
    return (best[home] == place) & (best[target] == place)


EDGES = "part int, a binary, b binary, w binary"


def as_edges(part: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple:
    """A row of EDGES: arrays of int32, int32 and double."""
    return part, a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes(), w.tobytes()


def edges_of(b: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The arrays of rows of EDGES."""
    for row in range(b.num_rows):
        yield tuple(np.frombuffer(b.column(c)[row].as_buffer(), kind) for c, kind in (("a", np.int32), ("b", np.int32), ("w", np.float64)))


def added_up(edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, w), each pair once, sorted."""
    a, b, w = (np.concatenate(c) for c in zip(*edges))
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return (key[starts] >> 32).astype(np.int32), (key[starts] & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(w[order], starts)


def dealt(edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """Rows of EDGES of added up edges, one a part of the first node."""
    a, b, w = added_up(edges)
    order = np.argsort(a % parts, kind="stable")
    a, b, w = a[order], b[order], w[order]
    starts = np.flatnonzero(np.diff(a % parts, prepend=-1)).tolist()
    rows = [as_edges(int(a[s]) % parts, a[s:e], b[s:e], w[s:e]) for s, e in zip(starts, [*starts[1:], len(a)])]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["part", "a", "b", "w"])


class Dense:
    """A graph between nodes 0 to n - 1 of names with hashes h, as rows of EDGES: every edge from both ends and loops once at twice their weight; all edges of a node a are in one row."""

    def __init__(self, scratch: Scratch, pieces: DataFrame, parts: int, h: np.ndarray):
        self.scratch, self.h, self.parts = scratch, h, parts

        def run(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(as_edges(t.column("part")[0].as_py(), *added_up(list(edges_of(t)))), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "a", "b", "w"])])

        tasks = min(parts, max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), parts // 8))
        self.both = scratch.keep(pieces.repartition(tasks, "part").groupBy("part").applyInArrow(run, EDGES))

    def shared(self, *arrays: np.ndarray):
        return self.scratch.spark.sparkContext.broadcast(arrays)  # at most DENSE_NODES values each

    def each(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], kinds: tuple) -> list[np.ndarray]:
        """What f gives of the edges of each part, as arrays of these kinds, put together."""
        names = [f"c{i}" for i in range(len(kinds))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for edges in edges_of(b):
                    yield pa.RecordBatch.from_arrays([pa.array([c.astype(k).tobytes()], pa.binary()) for c, k in zip(f(*edges), kinds)], names)

        found = self.both.mapInArrow(run, ", ".join(f"{n} binary" for n in names)).toArrow()
        return [np.concatenate([np.zeros(0, k), *(np.frombuffer(v.as_buffer(), k) for v in found.column(n))]) for n, k in zip(names, kinds)]

    def degrees(self) -> np.ndarray:
        def run(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple:
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            return a[starts], np.add.reduceat(w, starts)

        node, sums = self.each(run, (np.int32, np.float64))
        k = np.zeros(len(self.h))
        k[node] = sums
        return k

    def weighed(self, community: np.ndarray, k: np.ndarray, m2: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The modularity of the labels, and every node's best move (node, target, gain) if any gains; one pass over the edges."""
        tot = np.bincount(community, weights=k, minlength=len(k))
        held = self.shared(community, tot, k, self.h)

        def run(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple:
            inside, *moves = best_moves(a, b, w, *held.value, m2)
            return np.array([inside]), *moves

        inside, *moves = self.each(run, (np.float64, np.int32, np.int32, np.float64))
        held.destroy()
        return float(inside.sum()) / m2 - float((tot**2).sum()) / m2**2, *moves

    def moved(self, k: np.ndarray, m2: float, trace: list[float], passes: int, tolerance: float) -> np.ndarray | None:
        """The community of every node after local moves, or None if nothing moves; the steps are those of move_nodes()."""
        n = len(k)
        community = np.arange(n, dtype=np.int32)
        q, node, target, gain = self.weighed(community, k, m2)
        if not trace:
            trace.append(q)
        any_moved = False
        for number in range(passes):
            if not len(node):
                break
            draw = drawn(self.h[node], number)
            tries = [lambda share=share: draw < share for share in SHARES] + [lambda: independent_moves(node, community[node], target, gain, n)]
            for last, chosen in enumerate(tries, 1):
                some, tried = chosen(), community.copy()
                tried[node[some]] = target[some]
                q, *after = self.weighed(tried, k, m2)
                if q > trace[-1]:
                    break
            if q <= trace[-1]:  # rounding is all that is left
                break
            community, any_moved, grown = tried, True, q - trace[-1]
            node, target, gain = after
            trace.append(q)
            if grown < tolerance and last < len(tries):
                break
        return community if any_moved else None

    def contracted(self, community: np.ndarray) -> Dense:
        """The graph between the communities; a community has the number and the hash of the node that it is called by."""
        held = self.shared(community)

        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, w in edges_of(batch):
                    yield dealt([(held.value[0][a], held.value[0][b], w)], parts)

        after = Dense(self.scratch, self.both.mapInArrow(run, EDGES), parts, self.h)
        self.scratch.drop(self.both)
        held.destroy()
        return after


def by_number(spelt: DataFrame, h: np.ndarray, parts: int) -> DataFrame:
    """Rows of EDGES, some for each part, of spelt(a, b, w) between the numbers of names of distinct hashes h, as Dense holds them."""
    order = np.argsort(h)
    held = spelt.sparkSession.sparkContext.broadcast((h[order], order.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = held.value
        edges, size = [], 0
        for batch in batches:
            a, b = (number[np.searchsorted(hashes, batch.column(i).to_numpy())] for i in range(2))
            w = batch.column(2).to_numpy()
            back = a != b
            edges += [(a, b, np.where(back, w, 2 * w)), (b[back], a[back], w[back])]
            size += 2 * len(a)
            if size >= HELD_EDGES:
                yield dealt(edges, parts)
                edges, size = [], 0
        if size:
            yield dealt(edges, parts)

    return spelt.select(F.xxhash64("a"), F.xxhash64("b"), "w").mapInArrow(run, EDGES)


def dense_louvain(scratch: Scratch, spelt: DataFrame, n_edges: int, nodes: DataFrame, n_nodes: int, m2: float, passes: int, levels: int, tolerance: float) -> tuple[DataFrame | None, list[float], int]:
    """labels(name, community) of nodes(id, name, h), whose ids are 0 to n_nodes - 1 in the order of names, if anything moves; the trace and the levels."""
    known = nodes.select("id", "h").toArrow()
    h = np.empty(n_nodes, np.int64)
    h[known.column("id").to_numpy()] = known.column("h").to_numpy()
    partitions = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-2 * n_edges // PART_EDGES), min(partitions, 2 * n_edges // BUCKET_ROWS + 1))
    graph = Dense(scratch, by_number(spelt, h, parts), parts, h)
    k, trace, level, names = graph.degrees(), [], 0, None
    while level < levels:
        before = trace[-1] if trace else None
        community = graph.moved(k, m2, trace, passes, tolerance)
        if community is None:
            break
        level += 1
        names = community if names is None else community[names]
        if before is not None and trace[-1] - before < tolerance or level == levels:
            break
        k = np.bincount(community, weights=k, minlength=n_nodes)
        graph = graph.contracted(community)
    scratch.drop(graph.both)
    if names is None:
        return None, trace, 0
    first = np.full(n_nodes, n_nodes)
    np.minimum.at(first, names, np.arange(n_nodes))
    held = graph.shared(first[names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(held.value[0][b.column(0).to_numpy()])], ["name", "first"])

    called = nodes.select(F.col("id").alias("first"), F.col("name").alias("community"))
    return nodes.select("id", "name").mapInArrow(run, "name string, first long").join(called, "first").select("name", "community"), trace, level


def without_gaps(nodes: DataFrame) -> DataFrame:
    """nodes(id, ...) of numbered() with ids from 0 on, in the same order."""
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(map(tuple, nodes.groupBy(part.alias("p")).count().collect()))  # a row a partition
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    start = F.create_map(*(F.lit(x).cast("long") for (p, _), s in zip(counts, starts) for x in (p, s)))
    return nodes.withColumn("id", start[part.cast("long")] + at)


def louvain(entities: DataFrame, relations: DataFrame, passes: int = PASSES, levels: int = LEVELS, tolerance: float = TOLERANCE) -> Communities:
    """Communities of entities(name) by relations(source, target, weight); an entity without relations is one by itself."""
    scratch = Scratch(entities.sparkSession)
    ends = relations.where("source is not null and target is not null and weight > 0").select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("w"))
    spelt = scratch.keep(ends)
    n_edges, m2 = spelt.agg(F.count(F.lit(1)), 2 * F.coalesce(F.sum("w"), F.lit(0.0))).first()
    alone = entities.select("name").distinct()
    if not m2:
        return Communities(alone.withColumn("community", F.col("name")), [], 0)
    nodes = numbered(scratch, spelt)
    n_nodes = nodes.count()
    if n_nodes <= DENSE_NODES and nodes.agg(F.count_distinct("h")).first()[0] == n_nodes:
        named, trace, level = dense_louvain(scratch, spelt, n_edges, without_gaps(nodes), n_nodes, m2, passes, levels, tolerance)
        if named is None:
            return Communities(alone.withColumn("community", F.col("name")), trace, 0)
        return Communities(alone.join(named, "name", "left").select("name", F.coalesce("community", "name").alias("community")), trace, level)
    spelt = undirected(spelt.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("w").alias("weight")))
    end = lambda old, new: maybe_broadcast(nodes.select(F.col("name").alias(old), F.col("id").alias(new)), n_nodes)
    edges = scratch.keep(spelt.join(end("a", "ia"), "a").join(end("b", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "w"))
    trace: list[float] = []
    names, level = None, 0
    while level < levels:
        before = trace[-1] if trace else None
        moved = move_nodes(scratch, edges, nodes, n_nodes, m2, trace, passes, tolerance)
        if moved is None:
            break
        labels, n = moved
        level += 1
        flat = labels.select("node", "community")
        if names is None:
            names = scratch.keep(flat.withColumnRenamed("node", "id"))
        else:
            up = flat.select(F.col("node").alias("community"), F.col("community").alias("up"))
            names = scratch.keep(names.join(up, "community").select("id", F.col("up").alias("community")))
        own, other = (maybe_broadcast(flat.select(F.col("node").alias(e), F.col("community").alias(f"c{e}")), n, LABEL_ROWS) for e in "ab")
        ends = edges.join(own, "a").join(other, "b")
        edges = scratch.keep(ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        if before is not None and trace[-1] - before < tolerance:
            break
    if names is None:
        return Communities(alone.withColumn("community", F.col("name")), trace, 0)
    first = names.groupBy("community").agg(F.min("id").alias("first"))
    spelling = lambda old, new: nodes.select(F.col("id").alias(old), F.col("name").alias(new))
    named = names.join(first, "community").select("id", "first").join(spelling("id", "name"), "id").join(spelling("first", "community"), "first").select("name", "community")
    return Communities(alone.join(named, "name", "left").select("name", F.coalesce("community", "name").alias("community")), trace, level)


def summaries(labels: DataFrame, relations: DataFrame, least: int = 3, most: int = 100, members: int = 30) -> DataFrame:
    """The largest communities with their first members and the number of relations inside."""
    scratch = Scratch(labels.sparkSession)
    labels = scratch.keep(labels)
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") >= least)
    top = scratch.keep(sizes.orderBy(F.desc("n_members"), "community").limit(most))  # `most` rows
    own = scratch.keep(labels.join(F.broadcast(top.select("community")), "community", "left_semi"))
    n_own = own.count()
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("name"))).where(F.col("r") <= members)
    first = first.groupBy("community").agg(F.array_sort(F.collect_list("name")).alias("members"))
    end = lambda name, at: maybe_broadcast(own.select(F.col("name").alias(name), F.col("community").alias(at)), n_own)
    ends = relations.join(end("source", "community"), "source").join(end("target", "__c"), "target")
    inside = ends.where("community = __c").groupBy("community").agg(F.count(F.lit(1)).alias("n_relations"))
    return top.join(first, "community").join(inside, "community", "left").select("community", "n_members", "members", F.coalesce("n_relations", F.lit(0)).cast("long").alias("n_relations"))
