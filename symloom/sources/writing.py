"""Writing tables: inserts that skip repeats, and texts packed above a size.

Defined cases: null keys are kept as rows of their own only where the caller
leaves them in; null texts stay null; an empty frame writes an empty table.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.session import cut

#: Bytes above which a text is packed, and the level (fixed values).
PACK_ABOVE, LEVEL = 10 * 1024, 6


def insert_ignore(rows: DataFrame, key: str, into: str | None = None) -> DataFrame:
    """Rows written as a table, of repeated keys one; returns the table as it was stored.

    into is a folder; without it the table lies with those of the application.
    """
    kept = rows.dropDuplicates([key])
    if into is None:
        return cut(kept)
    kept.write.mode("append").parquet(into)
    return rows.sparkSession.read.parquet(into)


@F.pandas_udf(T.BinaryType())
def _gzip(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8", "replace"), LEVEL, mtime=0))


@F.pandas_udf(T.StringType())
def _gunzip(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: None if p is None else gzip.decompress(p).decode("utf-8"))


def packed(df: DataFrame, column: str) -> DataFrame:
    """The column as payload (binary, gzip where the text is above ``PACK_ABOVE`` bytes) and is_packed."""
    large = F.octet_length(column) > PACK_ABOVE
    payload = F.when(large, _gzip(F.when(large, F.col(column)))).otherwise(F.encode(column, "UTF-8"))
    return df.withColumns({"payload": payload, "is_packed": F.coalesce(large, F.lit(False))}).drop(column)


def unpacked(df: DataFrame, column: str) -> DataFrame:
    """The texts of packed() again."""
    text = F.when(F.col("is_packed"), _gunzip(F.when(F.col("is_packed"), F.col("payload")))).otherwise(F.decode("payload", "UTF-8"))
    return df.withColumn(column, text).drop("payload")
