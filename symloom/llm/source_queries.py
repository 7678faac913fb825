"""Queries of the problems on source texts, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm import authorship, chunks, sources
from symloom.sources.tables import current_options, table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_texts")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sources.parse_sources(_texts(spark, folder)).where("not accepted").select("file_id").distinct()


def p1_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every error of every file that does not parse, the first one marked as the cause."""
    parsed = sources.parse_sources(_texts(spark, folder)).where("not accepted")
    return parsed.select("file_id", "language", F.posexplode("all_errors").alias("at", "error")).select(
        "file_id", "language", (F.col("at") == 0).alias("is_cause"), "error.line", "error.offset", "error.message"
    )


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return sources.failure_rates(sources.parse_sources(_texts(spark, folder)), "repo_id", "language")


def p1_acceptance(spark: SparkSession, folder: str) -> DataFrame:
    rates = sources.failure_rates(sources.parse_sources(_texts(spark, folder)), "language")
    return rates.select("language", "files", (F.col("files") - F.col("invalid")).alias("accepted"), (1 - F.col("rate")).alias("acceptance"))


def p1_reported(spark: SparkSession, folder: str) -> DataFrame:
    return sources.reported(sources.parse_sources(_texts(spark, folder)), table(spark, folder, "build_errors"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    options = current_options(table(spark, folder, "build_options"))
    return chunks.split_items(chunks.source_items(_texts(spark, folder), options))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("pieces > 1").select(F.col("item_id").alias("file_id")).distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("pieces > 1").withColumnRenamed("item_id", "file_id")


def p3_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Per cut text the hash of what its pieces add one after the other, and pieces that are too large or leave a gap."""
    options = current_options(table(spark, folder, "build_options"))
    items = chunks.source_items(_texts(spark, folder), options)
    limits = items.select(F.col("item_id").alias("l_id"), "limit")
    w = Window.partitionBy("item_id").orderBy("piece")
    pieces = chunks.split_items(items).where("pieces > 1").withColumn("before", F.coalesce(F.lag("end_char").over(w), F.lit(0)))
    added = F.expr("substr(text, before - start_char + 1)")
    return (
        pieces.join(limits, F.col("item_id") == F.col("l_id"))
        .groupBy(F.col("item_id").alias("file_id"))
        .agg(
            F.sha2(F.array_join(F.expr("transform(array_sort(collect_list(struct(piece, substr(text, before - start_char + 1) as added))), x -> x.added)"), ""), 256).alias("hash"),
            F.count_if((F.col("bytes") > F.greatest("limit", F.lit(4))) | (F.col("start_char") > F.col("before")) | (F.length(added) == 0)).alias("wrong"),
        )
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return authorship.classify(_texts(spark, folder)).where("is_foreign").select("file_id").distinct()


def p4_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    return authorship.classify(_texts(spark, folder)).where("not is_foreign").select("file_id", "repo_id", F.round("score", 4).alias("score"))


def p4_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a label that the forest did not learn from, and how many of them it tells right."""
    return authorship.held_out(_texts(spark, folder))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and description of each documented function in hand-written files that parse."""
    first = authorship.first_pass(_texts(spark, folder), sources.pairs, sources.PAIRS)
    foreign = authorship.judged(first).where("is_foreign").select("file_id").distinct()
    return sources.exploded(first).join(foreign, "file_id", "left_anti")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).select("file_id", "name", "start_line").distinct()


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_errors, p1_rates, p1_acceptance, p1_reported, p3_found, p3_pieces, p3_round_trip, p4_found, p4_handwritten, p4_held_out, p5_found, p5_pairs)
}

_CUT = """
FROM source_texts s JOIN (
  SELECT repo_id, file_size_policy.chunking_threshold AS threshold,
         row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
  FROM build_options WHERE repo_id IS NOT NULL) o ON o.repo_id = s.repo_id AND o.rn = 1
WHERE strlen(s.content) > o.threshold"""

ORACLES = {
    "p3_found": f"SELECT DISTINCT s.file_id {_CUT}",
    "p3_round_trip": f"SELECT s.file_id, sha256(s.content) AS hash, 0 AS wrong {_CUT}",
}
