"""Queries of the problems on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import leaks, packing, pii
from symloom.sources.tables import table


def p7_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every piece of every document, for every capacity."""
    placed, _ = packing.pack_all(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))
    return placed


def p7_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity the documents that were placed, containers above the capacity, and documents whose pieces leave a gap."""
    limits = table(spark, folder, "pack_limits").select(F.col("limit_id").alias("l_id"), "capacity_tokens")
    placed = p7_assignment(spark, folder).join(limits, F.col("limit_id") == F.col("l_id"))
    size = F.col("end_token") - F.col("start_token")
    containers = placed.groupBy("limit_id", "container").agg(F.sum(size).alias("used"), F.first("capacity_tokens").alias("room"))
    over = containers.groupBy(F.col("limit_id").alias("c_id")).agg(F.count_if(F.col("used") > F.col("room")).alias("too_full"))
    documents = (
        placed.groupBy("limit_id", "doc_id")
        .agg(F.sum(size).alias("sum"), F.max("end_token").alias("end"), F.min("start_token").alias("start"), F.max("piece").alias("last"), F.count(F.lit(1)).alias("n"), F.min("capacity_tokens").alias("room"))
        .groupBy("limit_id")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("sum") != F.col("end")) | (F.col("start") != 0) | (F.col("n") != F.col("last") + 1) | ((F.col("n") > 1) & (F.col("end") <= F.col("room")))).alias("broken"))
    )
    return documents.join(over, F.col("limit_id") == F.col("c_id")).select("limit_id", "documents", "broken", "too_full")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used per capacity beside the least possible number, and how full they are."""
    _, facts = packing.pack_all(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))
    return spark.createDataFrame(
        [tuple(f.values()) for f in facts],
        "limit_id long, capacity_tokens int, pieces long, containers long, fixed_by_dominance long, least_possible long, fill double",
    )


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _passages(spark, folder).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item the documents that hold a passage of it and the longest one in words."""
    return (
        _passages(spark, folder)
        .groupBy("item_id")
        .agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest"))
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.mentions(table(spark, folder, "documents")).select("doc_id", "kind", "start_char").distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p7_assignment, p7_cover, p7_fill, p8_found, p8_items, p9_found, p9_redacted)}
ORACLES: dict[str, str] = {
    "p7_cover": "SELECT limit_id, count(*) AS documents, 0 AS broken, 0 AS too_full FROM pack_limits, documents WHERE capacity_tokens > 0 GROUP BY limit_id",
}
