"""References to records that do not exist.

The keys that exist are cut into ranges and kept as one sorted array per range.
A range is ``WIDTH`` consecutive values where keys lie close together; where they
are sparse it is wider by their mean distance, so that an array still holds about
as many, and a wide range that turns out to hold more than ``FULL`` of them is cut
into ranges of ``WIDTH`` values again. An array is thus bounded whatever the keys
are. References go to the task of their range; there each Arrow batch
is looked up in the array by one vectorised binary search, and only misses leave
the task. A range that more references name than one task should take is split:
its references are salted by row and its array is sent to each salt.

Defined cases: null references are no references; zero and negative values are
looked up like any other; repeated rows of one id count once; a table of parents
without rows makes every reference a miss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.session import cut

#: Key values per range: an array holds 8 bytes for each, 128 KB at most.
WIDTH = 16_384
#: Keys of one array at most, where ranges are wider.
FULL = 8 * WIDTH
#: Mean distance of keys up to which ranges are not widened.
SPARSE = 4
#: Added to the numbers of wide ranges, beyond the numbers of narrow ones.
WIDE = 1 << 52
#: References of one range that one task takes before the range is split.
ROWS_PER_TASK = 250_000


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream over (range, salt, kind) order: an array first, then its references."""
    current, array = None, np.empty(0, "<i8")
    for pdf in batches:
        buckets, salts = pdf["bucket"].to_numpy(), pdf["salt"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (salts[1:] != salts[:-1])])
        misses = np.zeros(len(pdf), bool)
        kinds, wanted, packed = pdf["kind"].to_numpy(), pdf["key"].to_numpy(), pdf["packed"]
        for a, b in zip(edges, [*edges[1:], len(pdf)], strict=True):
            at = (int(pdf["bucket"].iat[a]), int(pdf["salt"].iat[a]))
            if at != current:
                current, array = at, np.empty(0, "<i8")
            heads = a + np.flatnonzero(kinds[a:b] == 0)
            start = a
            for h in heads:
                array = np.frombuffer(packed.iat[h], "<i8")
                start = h + 1
            look = wanted[start:b]
            if len(array):
                place = np.minimum(np.searchsorted(array, look), len(array) - 1)
                misses[start:b] = array[place] != look
            else:
                misses[start:b] = True
        misses &= kinds == 1
        yield pdf.loc[misses, ["field", "row_id", "key", "created_at"]]



@F.pandas_udf(T.BinaryType())
def _packed(keys: pd.Series) -> pd.Series:
    return keys.map(lambda x: np.asarray(x, "<i8").tobytes())


def _ranges(keys: DataFrame, width: int) -> Callable[[DataFrame], DataFrame]:
    """What adds to a frame with a key the number of the key's range, as bucket."""

    def floored(by: int) -> Column:
        # in whole numbers: keys beyond 2**53 are no exact doubles
        return F.expr(f"key div {by}L - if(key % {by}L < 0, 1L, 0L)")

    narrow = floored(WIDTH)
    if width == WIDTH:
        return lambda df: df.withColumn("bucket", narrow)
    wide = floored(width) + F.lit(WIDE)
    full = keys.groupBy(wide.alias("w_bucket")).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > FULL).select("w_bucket")

    def ranged(df: DataFrame) -> DataFrame:
        joined = df.withColumn("wide", wide).join(full, F.col("wide") == F.col("w_bucket"), "left")
        return joined.withColumn("bucket", F.when(F.col("w_bucket").isNull(), F.col("wide")).otherwise(narrow)).drop("wide", "w_bucket")

    return ranged


def dangling(parents: DataFrame, references: DataFrame) -> DataFrame:
    """References without a parent.

    parents: key. references: field (a label), row_id, key, created_at.
    Returns the distinct references whose key is no parent.
    """
    spark = references.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kind = dict(references.dtypes)["created_at"]
    seen = Observation()
    facts = (F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    keys = cut(parents.where("key is not null").select(F.col("key").cast("long")).distinct().observe(seen, *facts))
    n, least, most = (seen.get.get(k) for k in ("n", "least", "most"))
    width = WIDTH * max(1, (most - least + 1) // n if n else 1)
    ranged = _ranges(keys, width if width > SPARSE * WIDTH else WIDTH)
    refs = ranged(references.where("key is not null and row_id is not null").select("field", "row_id", F.col("key").cast("long"), "created_at"))
    load = (
        refs.groupBy("bucket")
        .count()
        .select("bucket", F.ceil(F.col("count") / F.lit(ROWS_PER_TASK)).cast("int").alias("salts"))
    )
    split = load.where("salts > 1")
    salted = refs.join(split, "bucket", "left").select(
        "bucket",
        F.pmod(F.xxhash64("row_id", "field"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
        F.lit(1).alias("kind"),
        "field",
        "row_id",
        "key",
        "created_at",
        F.lit(None).cast("binary").alias("packed"),
    )
    arrays = (
        ranged(keys)
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
        .join(load, "bucket")
        .select(
            "bucket",
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
            F.lit(0).alias("kind"),
            F.lit(None).cast("string").alias("field"),
            F.lit(None).cast("long").alias("row_id"),
            F.lit(None).cast("long").alias("key"),
            F.lit(None).cast(kind).alias("created_at"),
            _packed(F.col("keys")).alias("packed"),
        )
    )
    lined = (
        arrays.unionByName(salted)
        .repartition(tasks, "bucket", "salt")
        .sortWithinPartitions("bucket", "salt", "kind")
        .withColumns({"key": F.coalesce("key", F.lit(0)), "row_id": F.coalesce("row_id", F.lit(0))})
    )
    return lined.mapInPandas(_probe, f"field string, row_id long, key long, created_at {kind}").distinct()


def gone_symbols(symbols: DataFrame, deletions: DataFrame) -> DataFrame:
    """Ids of current symbols that were deleted after their current row was written."""
    last = deletions.where("symbol_id is not null").groupBy("symbol_id").agg(F.max("deleted_at").alias("deleted_at"))
    return symbols.join(last, (F.col("id") == F.col("symbol_id")) & (F.col("deleted_at") > F.col("updated_at"))).select("id")


def by_month(misses: DataFrame) -> DataFrame:
    """Dangling references per table, field and month of created_at; the month is null where that is."""
    return misses.groupBy(
        "table_name", "field_name", F.date_format("created_at", "yyyy-MM").alias("month")
    ).agg(F.count(F.lit(1)).alias("dangling"), F.count_distinct("target_id").alias("targets"))
