"""What a user can put in the place of the defaults, each as a function over columns or DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import vectors as V
from cairnspark.operators import graph as G
from cairnspark.operators import retrieval as R
from cairnspark.operators.chunking import chunk_documents
from cairnspark.operators.communities import louvain
from cairnspark.operators.substrings import contains_join
from cairnspark.sources.loaders import load

#: docs(chunk_id, text), queries(query_id, text), k to (query_id, chunk_id, score, rank)
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def hash_embedding(text: Column) -> Column:
    """J19"""
    return V.hash_embedder()(text)


def sparse_route(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """J2 over square roots of term counts."""
    q = R.query_terms(queries).selectExpr("query_id", "term", "1.0D as weight")
    w = R.term_weights(docs, q.select("term").distinct()).selectExpr("chunk_id", "term", "sqrt(cast(tf as double)) as weight")
    return R.sparse_topk(w, q, k)


def embedding_route(embed: Callable[[Column], Column]) -> Retriever:
    """A dense route over texts that an embedder turns into vectors."""

    def route(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return R.dense_topk(docs.select("chunk_id", embed(docs["text"]).alias("vector")), queries.select("query_id", embed(queries["text"]).alias("vector")), k)

    return route


@dataclass(frozen=True)
class Graph:
    """A property graph as DataFrames; see operators.graph for their columns."""

    entities: DataFrame
    relations: DataFrame
    events: DataFrame
    mentions: DataFrame

    def search(self, patterns: DataFrame) -> DataFrame:
        """(pid, name) of entities whose name holds one of patterns(pid, pattern)."""
        keyed = self.entities.select(F.xxhash64("name").alias("tid"), "name").distinct()
        found = contains_join(keyed.select("tid", F.col("name").alias("text")), patterns)
        return found.join(keyed, "tid").select("pid", "name")

    def ego(self, centre: DataFrame, hops: int = 1) -> DataFrame:
        """(name, degree, hop) of the entities round centre(name)."""
        return G.neighbourhood(self.entities, self.relations, centre, hops)

    def overview(self, n: int) -> tuple[DataFrame, DataFrame]:
        """The n entities of highest degree and the relations among them."""
        return G.overview(self.entities, self.relations, n)

    def detail(self, centre: DataFrame) -> DataFrame:
        """(name, other, type): direct neighbours of centre(name)."""
        return G.detail(self.relations, centre)

    def stats(self) -> DataFrame:
        """(type, n, n_orphans)"""
        return G.stats(self.entities)

    def events_of(self, names: DataFrame) -> DataFrame:
        """(event_id, mention_count) of events that mention names(name)."""
        return G.events_by_entities(self.mentions, names)

    def recall(self, chunks: DataFrame, seeds: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, chunk_id, rank, score): chunks of seed events and of events one hop on."""
        return G.event_recall(self.mentions, chunks, seeds, k=k)

    def communities(self) -> DataFrame:
        """(name, community)"""
        return louvain(self.entities, self.relations).labels

    def upserted(self, entities: DataFrame, relations: DataFrame) -> Graph:
        """With more entities(kb_id, name, type, doc_ids, seq) and relations(kb_id, source, target, type, doc_id, seq); this graph's entities have the same columns."""
        merged = G.upsert_entities(self.entities.select(entities.columns), entities)
        edges = G.upsert_relations(self.relations.select(relations.columns).unionByName(relations), merged)
        return replace(self, entities=G.degrees(merged, edges), relations=edges)

    def without_document(self, doc_id: Column) -> Graph:
        """Without what only one document supports; entities hold doc_ids, relations and events doc_id."""
        return Graph(**G.delete_document(doc_id, self.entities, self.relations, self.events, self.mentions))

    def sizes(self) -> DataFrame:
        """(part, n)"""
        out = None
        for name in ("entities", "relations", "events", "mentions"):
            part = getattr(self, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
            out = part if out is None else out.unionByName(part)
        return out


@dataclass(frozen=True)
class Providers:
    """embed: text to array<double>; rerank: hits(query, content) with rerank; routes by name; chunk: docs to child rows; load: (session, path, file type) to texts; generate: prompt to answer, no default."""

    embed: Callable[[Column], Column] = hash_embedding
    rerank: Callable[[DataFrame], DataFrame] = R.lexical_rerank
    routes: Mapping[str, Retriever] = field(default_factory=lambda: {"bm25": R.bm25_topk, "sparse": sparse_route})
    chunk: Callable[[DataFrame], DataFrame] = chunk_documents
    load: Callable[[SparkSession, str, str], DataFrame] = load
    generate: Callable[[Column], Column] | None = None

    def answer(self, prompt: Column) -> Column:
        """M1"""
        if self.generate is None:
            raise ValueError("no text model is provided")
        return self.generate(prompt)


def routed(docs: DataFrame, queries: DataFrame, k: int, providers: Providers) -> DataFrame:
    """(query_id, route, chunk_id, score, rank): the hits of every route."""
    out = None
    for name, route in providers.routes.items():
        part = route(docs, queries, k).selectExpr("query_id", f"'{name}' as route", "chunk_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out
