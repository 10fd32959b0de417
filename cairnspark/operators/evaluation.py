"""Retrieval metrics, gold by containment, and the route decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.substrings import contains_join


def route(mode: Column, n_kbs: Column, has_files: Column, skip: Column, many: Column | None = None, tools: Column | None = None) -> Column:
    """C17: agent, multi_kb, single_kb, chitchat or none."""
    many, tools = F.lit(False) if many is None else many, F.lit(False) if tools is None else tools
    agent = F.when(skip, "chitchat").when((n_kbs > 0) | has_files | tools, "agent").otherwise("none")
    plain = F.when(skip, "chitchat").when(many | has_files | (n_kbs > 1), "multi_kb").when(n_kbs > 0, "single_kb").otherwise("none")
    return F.when(mode == "agent", agent).otherwise(plain)


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of docs(chunk_id, text) that contain the text of items(query_id, text), by signatures."""
    found = contains_join(docs.select(F.col("chunk_id").alias("tid"), "text"), items.select(F.col("query_id").alias("pid"), F.col("text").alias("pattern")))
    return found.select(F.col("pid").alias("query_id"), F.col("tid").alias("chunk_id"))


def chunk_pages(chunks: DataFrame, letters: int = 50) -> DataFrame:
    """(doc_id, page) of chunks(doc_id, chunk, pages): the page, from 1, that holds the chunk's first letters nearest to its own start."""
    anchored = chunks.select("doc_id", F.substring(F.trim("chunk"), 1, letters).alias("anchor"), F.posexplode("pages").alias("page", "text")).where("anchor <> ''")
    found = anchored.select("doc_id", (F.col("page") + 1).alias("page"), F.instr("text", F.col("anchor")).alias("at")).where("at > 0")
    return found.groupBy("doc_id").agg(F.min(F.struct("at", "page"))["page"].alias("page"))


def first_hits(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, first): rank of the first right hit of every question with gold."""
    right = hits.join(gold.select("query_id", F.col("doc_id").alias("chunk_id")), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return gold.select("query_id").distinct().join(right, "query_id", "left")


def metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """Recall at k, mean reciprocal rank and hit rate over questions with gold."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return first_hits(hits, gold).agg(
        F.count(F.lit(1)).alias("n_questions"),
        *[share(F.col("first") <= k).alias(f"recall_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"),
        share(F.col("first").isNotNull()).alias("hit_rate"),
    )


def delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """A less b; both are one row."""
    other = b.select(F.col("mrr").alias("m"), F.col("recall_10").alias("r"))
    return a.crossJoin(other).select(F.round(F.col("mrr") - F.col("m"), 9).alias("mrr_delta"), F.round(F.col("recall_10") - F.col("r"), 9).alias("recall_10_delta"))
