"""Queries of the general data problems: hierarchies and dangling references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import hierarchy as H
from symloom.operators import references as R
from symloom.sources.tables import current_symbols, table

Query = Callable[[SparkSession, str], DataFrame]


def _symbol_tree(spark: SparkSession, folder: str, names: bool) -> DataFrame:
    symbols = current_symbols(table(spark, folder, "symbols"), "parent_symbol_id", "name")
    return H.hierarchy(symbols, "id", "parent_symbol_id", "name" if names else None)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    tree = _symbol_tree(spark, folder, names=False)
    return tree.where("depth >= 6 or is_cyclic").select(F.col("node_id").alias("symbol_id"), "root_id")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    tree = _symbol_tree(spark, folder, names=True)
    return tree.select(
        F.col("node_id").alias("symbol_id"),
        "root_id",
        "depth",
        "is_cyclic",
        F.array_join("path_names", ".", "?").alias("full_path"),
        F.array_join(F.col("path_ids").cast("array<string>"), "/").alias("id_path"),
    )


def _members(spark: SparkSession, folder: str, tree: DataFrame) -> DataFrame:
    return H.circle_members(current_symbols(table(spark, folder, "symbols"), "parent_symbol_id", "name"), tree, "id", "parent_symbol_id")


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every symbol, those below circles included."""
    tree = _symbol_tree(spark, folder, names=True)
    return H.descendants(tree, _members(spark, folder, tree))


def p2_members(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols on and below circles; all those on one circle are above each other and above all below it."""
    tree = _symbol_tree(spark, folder, names=False)
    return _members(spark, folder, tree).select(F.col("id").alias("symbol_id"), F.col("circle").alias("circle_id"), "on_circle")


def p2_circles(spark: SparkSession, folder: str) -> DataFrame:
    tree = _symbol_tree(spark, folder, names=False)
    return (
        tree.where("is_cyclic").groupBy(F.col("root_id").alias("circle_id")).agg(F.count(F.lit(1)).alias("symbols"))
    )


def _misses(spark: SparkSession, folder: str) -> DataFrame:
    symbols = current_symbols(table(spark, folder, "symbols"), "updated_at", "parent_symbol_id", "created_at")
    deletions = table(spark, folder, "symbol_deletions")
    framework = table(spark, folder, "framework_symbols").select(F.col("id").alias("key"))
    gone = R.gone_symbols(symbols, deletions)
    alive = symbols.select("id").join(gone, "id", "left_anti").select(F.col("id").alias("key"))
    dependencies = table(spark, folder, "dependencies")
    calls = table(spark, folder, "api_calls")

    def refs(df: DataFrame, label: str, column: str) -> DataFrame:
        return df.select(
            F.lit(label).alias("field"), F.col("id").alias("row_id"), F.col(column).alias("key"), "created_at"
        )

    both = F.explode(
        F.array(
            F.struct(F.lit("dependencies.from_symbol_id").alias("field"), F.col("from_symbol_id").alias("key")),
            F.struct(F.lit("dependencies.to_symbol_id").alias("field"), F.col("to_symbol_id").alias("key")),
        )
    )
    references = (
        dependencies.select("id", "created_at", both.alias("ref"))
        .select("ref.field", F.col("id").alias("row_id"), "ref.key", "created_at")
        .unionByName(refs(calls, "api_calls.endpoint_symbol_id", "endpoint_symbol_id"))
        .unionByName(refs(symbols, "symbols.parent_symbol_id", "parent_symbol_id"))
    )
    misses = R.dangling(alive.unionByName(framework), references)
    name = F.split("field", r"\.")
    return misses.select(
        name[0].alias("table_name"),
        name[1].alias("field_name"),
        "row_id",
        F.col("key").alias("target_id"),
        "created_at",
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _misses(spark, folder).select("table_name", "field_name", "row_id").distinct()


def p6_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return R.by_month(_misses(spark, folder))


_CURRENT = """
cur AS (
  SELECT id, parent_symbol_id, name, updated_at, created_at FROM (
    SELECT id, parent_symbol_id, name, updated_at, created_at,
           row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_symbol_id DESC NULLS LAST, name DESC) AS rn
    FROM symbols WHERE id IS NOT NULL) WHERE rn = 1)"""

_TREE = f"""
WITH RECURSIVE {_CURRENT},
tree AS (
  SELECT c.id, c.id AS root_id, 0 AS depth, coalesce(c.name, '?') AS full_path, CAST(c.id AS VARCHAR) AS id_path
  FROM cur c WHERE c.parent_symbol_id IS NULL OR NOT EXISTS (SELECT 1 FROM cur p WHERE p.id = c.parent_symbol_id)
  UNION ALL
  SELECT c.id, t.root_id, t.depth + 1, t.full_path || '.' || coalesce(c.name, '?'), t.id_path || '/' || CAST(c.id AS VARCHAR)
  FROM cur c JOIN tree t ON c.parent_symbol_id = t.id),
lost AS (SELECT c.id, c.parent_symbol_id FROM cur c WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.id = c.id)),
walk AS (
  SELECT id AS start_id, id AS at_id FROM lost
  UNION
  SELECT w.start_id, l.parent_symbol_id FROM walk w JOIN lost l ON l.id = w.at_id),
on_circle AS (
  SELECT DISTINCT w.start_id AS id FROM walk w JOIN lost l ON l.id = w.at_id AND l.parent_symbol_id = w.start_id),
circles AS (
  SELECT w.start_id AS id, min(w.at_id) AS root_id FROM walk w JOIN on_circle o ON o.id = w.at_id GROUP BY w.start_id)"""

_MISSES = f"""
WITH {_CURRENT},
gone AS (
  SELECT c.id FROM cur c JOIN (SELECT symbol_id, max(deleted_at) AS deleted_at FROM symbol_deletions GROUP BY symbol_id) d
  ON d.symbol_id = c.id WHERE d.deleted_at > c.updated_at),
alive AS (
  SELECT id FROM cur WHERE id NOT IN (SELECT id FROM gone)
  UNION SELECT id FROM framework_symbols),
refs AS (
  SELECT 'dependencies' AS table_name, 'from_symbol_id' AS field_name, id AS row_id, from_symbol_id AS target_id, created_at FROM dependencies
  UNION SELECT 'dependencies', 'to_symbol_id', id, to_symbol_id, created_at FROM dependencies
  UNION SELECT 'api_calls', 'endpoint_symbol_id', id, endpoint_symbol_id, created_at FROM api_calls
  UNION SELECT 'symbols', 'parent_symbol_id', id, parent_symbol_id, created_at FROM cur),
misses AS (
  SELECT r.* FROM refs r WHERE r.target_id IS NOT NULL AND r.row_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM alive a WHERE a.id = r.target_id))"""

QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_descendants": p2_descendants,
    "p2_circles": p2_circles,
    "p2_members": p2_members,
    "p6_found": p6_found,
    "p6_by_month": p6_by_month,
}

ORACLES: dict[str, str] = {
    "p2_found": f"""{_TREE}
SELECT id AS symbol_id, root_id FROM tree WHERE depth >= 6
UNION ALL SELECT id, root_id FROM circles""",
    "p2_paths": f"""{_TREE}
SELECT id AS symbol_id, root_id, depth, false AS is_cyclic, full_path, id_path FROM tree
UNION ALL SELECT id, root_id, NULL, true, NULL, NULL FROM circles""",
    "p2_descendants": f"""{_TREE},
pairs AS (
  SELECT id AS ancestor_id, id AS descendant_id, 0 AS distance FROM cur
  UNION ALL
  SELECT p.ancestor_id, c.id, p.distance + 1 FROM pairs p JOIN cur c ON c.parent_symbol_id = p.descendant_id WHERE c.id NOT IN (SELECT id FROM on_circle))
SELECT ancestor_id, descendant_id, distance FROM pairs WHERE distance > 0""",
    "p2_circles": f"""{_TREE}
SELECT root_id AS circle_id, count(*) AS symbols FROM circles GROUP BY root_id""",
    "p2_members": f"""{_TREE}
SELECT c.id AS symbol_id, c.root_id AS circle_id, o.id IS NOT NULL AS on_circle FROM circles c LEFT JOIN on_circle o ON o.id = c.id""",
    "p6_found": f"{_MISSES} SELECT DISTINCT table_name, field_name, row_id FROM misses",
    "p6_by_month": f"""{_MISSES}
SELECT table_name, field_name, strftime(created_at, '%Y-%m') AS month, count(*) AS dangling, count(DISTINCT target_id) AS targets
FROM misses GROUP BY ALL""",
}
