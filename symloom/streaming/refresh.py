"""Incremental refresh: snapshots compared, change events gathered in windows, streams applied in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.session import cut
from symloom.sources import code


def changes(before: DataFrame, after: DataFrame, key: str = "path", mark: str = "content_hash") -> DataFrame:
    """State of every key over two snapshots: new, changed, deleted or same."""
    a = before.select(F.col(key).alias("k_a"), F.col(mark).alias("m_a"))
    b = after.select(F.col(key).alias("k_b"), F.col(mark).alias("m_b"))
    state = (
        F.when(F.col("k_a").isNull(), "new").when(F.col("k_b").isNull(), "deleted").when(~F.col("m_a").eqNullSafe(F.col("m_b")), "changed").otherwise("same")
    )
    return a.join(b, F.col("k_a") == F.col("k_b"), "full").select(F.coalesce("k_a", "k_b").alias(key), state.alias("state"))


def refreshed(current: DataFrame, update: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """A table after an update: rows of deleted or updated keys leave, updated rows come."""
    kept = current.join(deleted.select(key), key, "left_anti").join(update.select(key), key, "left_anti")
    return kept.unionByName(update, allowMissingColumns=True)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; works on a stream, where late events beyond the bound are dropped, and on a table."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        source.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events", "total")
    )


def debounced(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Bursts of changes of one key: one row per session of events without a longer gap."""
    source = events.withWatermark("ts", gap) if events.isStreaming else events
    return (
        source.groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("first_at"), "events")
    )


def follow(spark: SparkSession, folder: str, schema, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a function on the latest row per path of each batch of change files in a folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("path").agg(F.max_by(F.struct(*df.columns), "ts").alias("row")).select("row.*")
        apply(last, epoch)

    return (
        spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def refresh(files: DataFrame, texts: DataFrame, symbols: DataFrame, dependencies: DataFrame, complete: bool = False) -> DataFrame:
    """One incremental run: what becomes of every symbol and edge, as counts by kind and fate.

    files: id, repo_id, path, content_hash as indexed. texts: file_id, repo_id,
    path, language, content as they are now; complete says that a file without
    a text is gone. Symbols of changed and gone files leave, those of changed
    files are parsed again and keep their id where file, name and type are the
    same. Edges from symbols that left go; edges into them are linked again by
    qualified name, and otherwise stay without a target if they are imports, or
    go as orphans.
    """
    now = texts.select(F.col("file_id").alias("t_id"), F.sha2("content", 256).alias("hash"))
    old = files.select(F.col("id").alias("f_id"), "content_hash")
    state = old.join(now, F.col("f_id") == F.col("t_id"), "full").select(
        F.coalesce("f_id", "t_id").alias("file_id"),
        F.when(F.col("f_id").isNull(), "new").when(F.col("t_id").isNull(), "deleted" if complete else "same").when(~F.col("hash").eqNullSafe(F.col("content_hash")), "changed").otherwise("same").alias("state"),
    )
    moved = cut(state.where("state <> 'same'"))
    again = texts.join(moved.where("state in ('new', 'changed')").select(F.col("file_id").alias("m_id")), F.col("file_id") == F.col("m_id"), "left_semi")
    parsed = code.parsed_symbols(again).select(F.col("file_id").alias("p_file"), F.col("name").alias("p_name"), F.col("symbol_type").alias("p_type")).distinct()
    leaving = symbols.join(moved.select(F.col("file_id").alias("m_id")), F.col("file_id") == F.col("m_id"), "left_semi")
    same = (F.col("file_id") == F.col("p_file")) & (F.col("name") == F.col("p_name")) & (F.col("symbol_type") == F.col("p_type"))
    fates = cut(
        leaving.join(parsed, same, "full").select("id", "qualified_name", F.when(F.col("id").isNull(), "added").when(F.col("p_file").isNull(), "removed").otherwise("reparsed").alias("fate"))
    )
    gone = fates.where("fate = 'removed'").select(F.col("id").alias("g_id"))
    left = symbols.where("qualified_name is not null").join(gone, F.col("id") == F.col("g_id"), "left_anti").groupBy(F.col("qualified_name").alias("q")).agg(F.min("id").alias("new_target"))
    d = dependencies.join(gone.select(F.col("g_id").alias("from_gone")), F.col("from_symbol_id") == F.col("from_gone"), "left").join(gone.select(F.col("g_id").alias("to_gone")), F.col("to_symbol_id") == F.col("to_gone"), "left")
    linked = d.join(left, F.col("to_qualified_name") == F.col("q"), "left")
    fate = (
        F.when(F.col("from_gone").isNotNull(), "removed").when(F.col("to_gone").isNull(), "kept").when(F.col("new_target").isNotNull(), "relinked").when(F.col("dependency_type") == "imports", "unlinked").otherwise("orphaned")
    )
    untouched = symbols.join(moved.select(F.col("file_id").alias("m_id")), F.col("file_id") == F.col("m_id"), "left_anti")
    every = (
        untouched.select(F.lit("symbol").alias("kind"), F.lit("kept").alias("fate")).unionByName(fates.select(F.lit("symbol").alias("kind"), "fate")).unionByName(linked.select(F.lit("edge").alias("kind"), fate.alias("fate")))
    )
    return every.groupBy("kind", "fate").agg(F.count(F.lit(1)).alias("rows"))
