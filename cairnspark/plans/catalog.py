"""All registered queries of the retrieval and document-analytics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.plans import governance, graph, lifecycle, retrieval, routes, sources, streaming, tables, text, webpages  # noqa: F401
from cairnspark.plans.registry import ORACLES, QUERIES  # noqa: F401
from cairnspark.providers import Providers


def flagship(spark: SparkSession, sf_dir: str, providers: Providers | None = None) -> DataFrame:
    """Hybrid retrieval with the given routes and reranker."""
    return retrieval.hybrid(spark, sf_dir, providers=providers).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")
