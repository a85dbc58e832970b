"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semloom.plans import assembly_queries, audit_queries, iterative_queries, labelling_queries, record_queries, relational_queries, text_queries, vector_queries

MODULES = (vector_queries, text_queries, relational_queries, audit_queries, assembly_queries, iterative_queries, record_queries, labelling_queries)


def _all() -> dict:
    return {name: pair for m in MODULES for name, pair in m.QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine neighbours of every entity, re-ranked by their context."""
    return vector_queries.rerank_context(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
