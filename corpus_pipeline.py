"""Corpus pipeline: five stages over documents, each a written table that the next reads.

toxicity and the quality classifier reject documents, line dedup deletes shared blocks (documents that lose
all their lines go), the n-gram Jaccard join keeps one document of each group, packing returns the pieces.
All stages but the last return the columns of documents.

Every stage takes null ids and texts, empty texts, repeated rows and empty tables: a null text is an empty one, a
row with a null id is judged like any other, rows that repeat an id are told apart by their texts, and of rows
with the same id and text the n-gram Jaccard join keeps one unless the text has no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import compression_toxicity, importance_resampling
from cairnspark.llm.common import Scratch, maybe_broadcast, table
from cairnspark.llm.jaccard_join import one_of_each
from cairnspark.llm.line_dedup import dedup_lines
from cairnspark.llm.packing import pack_documents
from cairnspark.llm.queries import vocabulary


def _keep(docs: DataFrame, verdict: DataFrame, stays: str) -> DataFrame:
    """docs without rejected rows, told apart by id and text; repeated rows share their verdict unless one of them stays."""
    by = verdict.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.max(F.expr(stays).cast("int")).alias("stays"))
    gone = Scratch(docs.sparkSession).keep(by.where("stays = 0").drop("stays"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__key"))
    return docs.join(maybe_broadcast(gone), same, "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = compression_toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return _keep(docs, found, "predicted = 0")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = importance_resampling.resample(docs, table(spark, sf_dir, "labels"))
    return _keep(docs, found, "selected")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = dedup_lines(docs).where("n_removed = 0 or trim(text) != ''")
    found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
    return found.select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("packing", packing),
]

#: Compression, hashing and tokenizers are beyond SQL; tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
