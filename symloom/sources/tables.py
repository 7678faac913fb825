"""Readers of the domain tables and the views every operator starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def latest(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key, the one that is greatest by order; nulls of order come last.

    An aggregate of one struct, so repeats collapse before the shuffle and a
    hot key costs no more than any other. Rows with a null key are left out.
    Where the order ties, the greatest of the named columns wins.
    """
    packed = F.struct(*order, *[F.col(c).alias(f"c_{i}") for i, c in enumerate(columns)])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(packed).alias("_row"))
        .select(F.col("_key").alias(key), *[F.col(f"_row.c_{i}").alias(c) for i, c in enumerate(columns)])
    )


def current_symbols(symbols: DataFrame, *columns: str) -> DataFrame:
    """Of each symbol id the row with the latest updated_at."""
    return latest(symbols, "id", [F.col("updated_at").alias("_order")], list(columns))


def current_options(options: DataFrame) -> DataFrame:
    """Of each repository the build options with the latest created_at."""
    return latest(
        options,
        "repo_id",
        [F.col("created_at").alias("_created"), F.col("id").alias("_id")],
        ["file_size_policy", "chunk_overlap_lines", "include_node_modules"],
    )


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per key out of exact or late repeats: the one updated last."""
    rest = [c for c in df.columns if c not in (key, "updated_at")]
    order = [F.col("updated_at").alias("_order")] if "updated_at" in df.columns else [F.lit(0).alias("_order")]
    keep = (["updated_at"] if "updated_at" in df.columns else []) + rest
    return latest(df, key, order, keep).select(*df.columns)
