"""Ranked routes and their fusion: dense, sparse and lexical search, reciprocal ranks, rerank, diversity, context.

Hits are rows (query_id, chunk_id, score, ...). Ties rank by chunk_id, so every rank is reproducible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions import text as T
from cairnspark.functions import vectors as V
from cairnspark.scratch import Scratch, maybe_broadcast

RRF_K = 60
#: Vectors and queries that meet in one task, and queries whose scores are held at once.
SHARD_ROWS, QUERY_BLOCK, TILE = 20_000, 4096, 256
#: Query terms that may be broadcast.
BROADCAST_TERMS = 1_000_000


def ranked(hits: DataFrame, by: list[str], k: int | None = None, score: str = "score") -> DataFrame:
    """Hits with rank, from 1, within each group; the k best if k is given."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), "chunk_id")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def placed(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """H2: rows with place, from 0, and n, the size of their group, in an order within each group that may hold any share of the table.

    Rows are dealt by ranges of (group, order), counted within a range, and the counts of a group's earlier ranges
    are added; what is added has a row for each group and range.
    """
    scratch = Scratch(rows.sparkSession)
    dealt = scratch.keep(rows.repartitionByRange(F.col(by).asc_nulls_first(), *order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(by, "__part").orderBy(*order)
    group = Window.partitionBy(by)
    counts = dealt.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__c"))
    earlier = F.coalesce(F.sum("__c").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), earlier.alias("__first"), F.sum("__c").over(group).alias("n"))
    both = dealt.join(maybe_broadcast(first, most=100_000), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    return both.withColumn("place", F.row_number().over(own) - 1 + F.col("__first")).drop("__part", "__by", "__p", "__first")


def scope(chunks: DataFrame, kb_ids: list | None = None, doc_types: list | None = None, kb: str = "kb_id", kind: str = "file_type") -> DataFrame:
    """Rows of the named knowledge bases and types; no list, no filter."""
    wanted = [F.col(c).isin(*v) for c, v in ((kb, kb_ids), (kind, doc_types)) if v]
    for w in wanted:
        chunks = chunks.where(w)
    return chunks


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of vectors(chunk_id, vector) of largest cosine for each of queries(query_id, vector).

    Vectors are dealt to shards and queries to blocks, both of bounded size; a shard meets a block in one task,
    keeps the k best of each query, and these partial lists are ranked again. Nothing passes through the driver
    but two counts.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_BLOCK))
    each = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    v = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), V.as_double(F.col("vector")).alias("vector"), F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), each(blocks, "block"))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), V.as_double(F.col("vector")).alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), each(shards, "shard"))
    return ranked(meet(v, q, ["shard", "block"], k), ["query_id"], k)


def meet(vectors: DataFrame, queries: DataFrame, by: list[str], k: int) -> DataFrame:
    """(query_id, chunk_id, score): of each group of vectors and queries that share the keys ``by``, the k largest cosines of every query; queries with ``cells`` meet vectors of these cells alone."""

    def unit(rows: pa.Table) -> np.ndarray:
        x = np.array(rows.column("vector").to_pylist(), float)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        who, what, how = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            x, asked = unit(left), unit(right)
            chunk, ids = left.column("chunk_id").to_numpy(), right.column("query_id").to_numpy()
            probed = None
            if "cells" in right.column_names:
                known, cell = np.unique(left.column("cell").to_numpy(), return_inverse=True)
                probed = np.array([np.isin(known, cells) for cells in right.column("cells").to_pylist()])
            for first in range(0, len(asked), TILE):
                scores = np.round(asked[first : first + TILE] @ x.T, 12)
                if probed is not None:
                    scores[~probed[first : first + TILE][:, cell]] = -np.inf
                least = np.partition(scores, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
                for i, row in enumerate(scores):
                    near = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                    near = near[np.lexsort((chunk[near], -row[near]))][:k]
                    who.append(np.full(len(near), ids[first + i]))
                    what.append(chunk[near])
                    how.append(row[near])
        return pa.table([pa.array(np.concatenate(c)) for c in (who, what, how)], ["query_id", "chunk_id", "score"])

    return vectors.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(run, "query_id long, chunk_id long, score double")


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)


def _hinted(terms: DataFrame) -> DataFrame:
    """Distinct query terms; a broadcast only where their counted rows are few."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def term_weights(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, dl, tf) of docs(chunk_id, text), of the terms(term) alone if given; dl is the number of words."""
    split = docs.select("chunk_id", words().alias("words"))
    rows = split.select("chunk_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if terms is not None:
        rows = rows.join(_hinted(terms), "term", "left_semi")
    return rows.groupBy("chunk_id", "term").agg(F.first("dl").alias("dl"), F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): distinct words of queries(query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(words())).alias("term"))


def sparse_topk(weights: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Inner products of weights(chunk_id, term, weight) with queries(query_id, term, weight)."""
    q = queries.select("query_id", "term", F.col("weight").alias("q"))
    hits = weights.join(q, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return ranked(hits.withColumn("score", F.round("score", 9)), ["query_id"], k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of docs(chunk_id, text) for queries(query_id, text): words that no query has go before the first shuffle.

    Document lengths come with the postings; idf is ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    asked = query_terms(queries)
    used = term_weights(docs, asked.select("term").distinct())
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words())).alias("avgdl"))
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")  # total is one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = used.join(asked.join(idf, "term"), "term").withColumn("part", part).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    return ranked(hits.withColumn("score", F.round("score", 9)), ["query_id"], k)


def rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, routes, ranks) from hits(query_id, route, chunk_id, rank)."""
    return hits.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"),
        F.array_sort(F.collect_set("route")).alias("routes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "rank")))).alias("ranks"),
    )


def type_weight(kind: Column, file_type: Column) -> Column:
    """Tables count 0.8, except those of a CSV file."""
    return F.when((kind == "table") & (F.coalesce(file_type, F.lit("")) != "csv"), 0.8).otherwise(1.0)


def source_k(n_sources: Column, k: int) -> Column:
    """G3"""
    return F.when(n_sources <= 4, 3 * k).otherwise(F.greatest(F.lit(k), F.floor(12 * k / n_sources))).cast("long")


def lexical_rerank(hits: DataFrame, query: str = "query", content: str = "content") -> DataFrame:
    """J6's default, a stand-in for a model: the share of the query's tokens that the content holds; columns named query_tokens and content_tokens save splitting."""
    q, c = (F.col(f"{x}_tokens") if f"{x}_tokens" in hits.columns else T.tokens(F.col(x)) for x in (query, content))
    return hits.withColumn("rerank", F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(0.0))


def project_hits(rows: DataFrame, fields: list[str], score: str) -> DataFrame:
    """The output fields that the rows have, null for those that they lack, and the score."""
    return rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields], F.col(score).alias("score"))


def merge_predicates(parts: list[str | None]) -> str | None:
    """All predicates that are not blank, each in parentheses; none gives no predicate."""
    kept = [f"({p.strip()})" for p in parts if p and p.strip()]
    return " AND ".join(kept) or None


def position_score(hits: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """H3: 1 / (1 + place), places from 0."""
    return ranked(hits, by, score=score).withColumn("position_score", 1 / F.col("rank"))


def coarse_rank(events: DataFrame, by: str = "query_id") -> DataFrame:
    """events(query_id, ordinal, vector, query_vector, base) by cosine, by base where a vector is missing; ties keep their order."""
    score = F.coalesce(V.cosine(F.col("vector"), F.col("query_vector")), F.col("base")).cast("double")
    scored = events.withColumn("score", F.when(F.col("vector").isNull() | F.col("query_vector").isNull(), F.col("base").cast("double")).otherwise(score))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "ordinal")))


def penalised(score: Column, content: Column) -> Column:
    """J7"""
    return F.when(T.is_fragment(content), score * 0.5).otherwise(score)


def soft_threshold(hits: DataFrame, threshold: float = 0.5, trigger: float = 0.3, factor: float = 0.7, floor: float = 0.3, last: float = 0.15) -> DataFrame:
    """Hits at the threshold; where a query has none, those at a lowered one; else its best, if good enough."""
    lowered = max(floor, threshold * factor) if threshold > trigger else threshold
    q = Window.partitionBy("query_id")
    first = F.row_number().over(q.orderBy(F.desc("rerank"), "chunk_id"))
    marked = hits.select("*", F.max("rerank").over(q).alias("__best"), first.alias("__first"))
    keep = F.when(F.col("__best") >= threshold, F.col("rerank") >= threshold).when(F.col("__best") >= lowered, F.col("rerank") >= lowered).otherwise((F.col("__first") == 1) & (F.col("rerank") >= last))
    return marked.where(keep).drop("__best", "__first")


def composite(hits: DataFrame, base: str = "base") -> DataFrame:
    """0.6 rerank, 0.3 base, 0.1 place, within 0 and 1."""
    q = Window.partitionBy("query_id")
    place = F.row_number().over(q.orderBy(F.desc("rerank"), "chunk_id")) - 1
    n = F.count(F.lit(1)).over(q)
    prior = F.when(n == 1, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - place / n))
    score = F.col("rerank") * 0.6 + F.col(base) * 0.3 + prior * 0.1
    return hits.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 12))


def mmr_order(scores: list[float], sets: list[set], weight: float = 0.7) -> list[int]:
    """All places, each the best of what is left by relevance less its likeness to those before."""
    left, out = list(range(len(scores))), []
    most = [0.0] * len(scores)
    while left:
        best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * most[i], -i))
        left.remove(best)
        out.append(best)
        for i in left:
            union = len(sets[i] | sets[best])
            most[i] = max(most[i], len(sets[i] & sets[best]) / union if union else 0.0)
    return out


def mmr(hits: DataFrame, weight: float = 0.7) -> DataFrame:
    """hits(query_id, chunk_id, score, content) with mmr_rank; groups are one query's reranked hits, at most a few dozen."""
    tokened = hits.select("query_id", "chunk_id", "score", T.tokens(F.col("content")).alias("tokens"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        order = mmr_order(f["score"].tolist(), [set(t) for t in f["tokens"]], weight)
        f = f.iloc[order][["query_id", "chunk_id", "score"]]
        return f.assign(mmr_rank=range(1, len(f) + 1))

    return tokened.groupBy("query_id").applyInPandas(run, "query_id long, chunk_id long, score double, mmr_rank int")


def expand_parents(hits: DataFrame, parents: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Content becomes the parent's text, from the first store that has it; the child's text stays beside it."""
    both = hits.join(parents.select(F.col("chunk_id").alias("parent_id"), F.nullif(F.trim("content"), F.lit("")).alias("__p")), "parent_id", "left")
    found = F.col("__p")
    if second is not None:
        both = both.join(second.select(F.col("chunk_id").alias("parent_id"), F.nullif(F.trim("content"), F.lit("")).alias("__s")), "parent_id", "left")
        found = F.coalesce("__p", "__s")
    return both.withColumn("child_content", F.col("content")).withColumn("content", F.coalesce(found, "content")).drop("__p", "__s")


def best_per_chunk(hits: DataFrame, by: list[str], score: str = "score", order: str = "ordinal") -> DataFrame:
    """Of each chunk the row of largest score, the first on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def seen_before(hits: DataFrame) -> DataFrame:
    """hits(session, call_no, chunk_id, content): chunks that an earlier call returned lose their content."""
    first = F.min("call_no").over(Window.partitionBy("session", "chunk_id"))
    old = first < F.col("call_no")
    return hits.select("*", old.alias("already_retrieved")).withColumn("content", F.when(F.col("already_retrieved"), "").otherwise(F.col("content")))


def source_list(sources: DataFrame, most: int = 100_000) -> Column:
    """The sources(source, n) that every question fans out to, as one array value; a longer list is refused."""
    rows = sources.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a question fans out to {most} sources at most")
    return F.array(*[F.struct(F.lit(r["source"]).alias("source"), F.lit(r["n"]).cast("long").alias("n")) for r in rows])


def first_rows(rows: DataFrame, by: str, order: str, k: int, salts: int = 64) -> DataFrame:
    """The k first rows of each group, cut in salted parts first, so that no task sorts a whole hot group."""
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(order), F.lit(salts)))
    some = salted.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__s").orderBy(order))).where(F.col("__r") <= k)
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__r") <= k).drop("__s", "__r")


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """Numbered texts of each query while they fit; nothing after the first that does not."""
    w = Window.partitionBy("query_id").orderBy("rank")
    item = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("content"))
    return hits.withColumn("item", item).withColumn("used", F.sum(F.length("item")).over(w).cast("long")).where(F.col("used") <= budget)


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(ordinal, stage, query_id, n)."""
    out = None
    for i, (name, rows) in enumerate(stages):
        part = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("ordinal"), F.lit(name).alias("stage"), "query_id", "n")
        out = part if out is None else out.unionByName(part)
    return out
