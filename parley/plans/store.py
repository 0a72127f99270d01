"""The store that triage answers from, where none is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.operators import precedents, retrieval
from parley.operators.taxonomy import policy_documents
from parley.session import path_exists, stage
from parley.sources.readers import load_precedents


def default_documents(spark: SparkSession, path: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Stored precedents if `path` holds some; else policies, with precedents chosen from `pairs` by the flat cap."""
    if path and path_exists(spark, path):
        return load_precedents(spark, path)
    return policy_documents(spark) if pairs is None else precedents.build_precedents_flat(pairs)


def default_index(spark: SparkSession, path: str | None = None, pairs: DataFrame | None = None) -> retrieval.TermIndex:
    """Index over the default documents."""
    return retrieval.tfidf_index(stage(default_documents(spark, path, pairs), "store"))
