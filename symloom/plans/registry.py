"""All queries of the core with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.plans import data_queries, flow_queries, graph_queries, ingest_queries, relational_queries, sample_queries, shape_queries

_MODULES = (data_queries, relational_queries, graph_queries, ingest_queries, shape_queries, flow_queries, sample_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return graph_queries.gt13_who_calls(spark, folder)
