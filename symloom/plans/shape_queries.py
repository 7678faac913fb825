"""Response shapes, classifications and linking rules over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import graph
from symloom.operators import relations as R
from symloom.plans.graph_queries import _EDGES, _SEED, _calls
from symloom.plans.sqlquery import bound, twins
from symloom.sources import code
from symloom.sources.graph import view, view_sql
from symloom.sources.tables import table

TWINS: dict[str, tuple[str, str] | str] = {
    "sc16_json_rows": "SELECT id, to_json(STRUCTOF(id AS id, coalesce(name, '') AS name, coalesce(symbol_type, '') AS type)) AS response FROM {s}",
    "pr09_routes_filtered": "SELECT DISTINCT upper(http_method) AS method, endpoint_path FROM {a} WHERE upper(http_method) = 'POST' AND endpoint_path ILIKE '%order%' ORDER BY method, endpoint_path LIMIT 50",
    "pr10_components": "SELECT s.id, s.name, f.path FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE s.symbol_type = 'component' OR s.entity_type = 'component'",
    "pr11_composables": "SELECT id, name FROM {s} WHERE entity_type = 'composable' AND name ILIKE '%cache%'",
    "pr12_scenes_and_nodes": "SELECT n.id AS node_id, n.name, p.id AS scene_id FROM {s} n LEFT JOIN {s} p ON p.id = n.parent_symbol_id AND p.symbol_type = 'godot_scene' WHERE n.symbol_type = 'godot_node'",
    "pr18_roots_and_children": "SELECT p.id, p.name, count(c.id) AS children FROM {s} p LEFT JOIN {s} c ON c.parent_symbol_id = p.id WHERE p.parent_symbol_id IS NULL AND p.symbol_type = 'class' GROUP BY p.id, p.name",
    "jn04_file_edge_join": "SELECT d.id, a.path AS from_path, b.path AS to_path FROM {d} d JOIN {s} x ON x.id = d.from_symbol_id JOIN {f} a ON a.id = x.file_id JOIN {s} y ON y.id = d.to_symbol_id JOIN {f} b ON b.id = y.file_id WHERE d.dependency_type = 'imports'",
    "jn15_first_container": ("k AS (SELECT c.id AS child_id, p.id AS parent_id, row_number() OVER (PARTITION BY c.id ORDER BY p.id) AS rn FROM {s} c JOIN {s} p ON p.file_id = c.file_id AND p.symbol_type IN ('class', 'interface') AND p.id <> c.id AND c.start_line >= p.start_line AND c.end_line <= p.end_line WHERE c.symbol_type = 'method')", "SELECT child_id, parent_id FROM k WHERE rn = 1"),
    "ag16_nested_groups": ("k AS (SELECT f.repo_id, s.symbol_type, count(*) AS n FROM {s} s JOIN {f} f ON f.id = s.file_id GROUP BY f.repo_id, s.symbol_type), t AS (SELECT repo_id, concat(symbol_type, ':', CAST(n AS VARCHAR(20))) AS part FROM k)", "SELECT repo_id, LISTAGG(part BY part) AS parts FROM t GROUP BY repo_id"),
    "ag20_slowest_files": "SELECT file_id, count(*) AS symbols, max(end_line) AS last_line FROM {s} GROUP BY file_id HAVING count(*) > 3 ORDER BY last_line DESC, file_id LIMIT 10",
    "so07_truncation_by_rank": ("k AS (SELECT id, CASE WHEN is_exported THEN 3 WHEN visibility = 'private' THEN 1 ELSE 2 END AS pr FROM {s})", "SELECT id, pr FROM k ORDER BY pr, id LIMIT 200"),
    "so08_enum_order": "SELECT symbol_type, count(*) AS n, CASE symbol_type WHEN 'class' THEN 1 WHEN 'interface' THEN 2 WHEN 'component' THEN 3 WHEN 'function' THEN 4 WHEN 'method' THEN 5 WHEN 'property' THEN 6 ELSE 7 END AS place FROM {s} GROUP BY symbol_type ORDER BY place, symbol_type",
    "so09_threshold_top": "SELECT to_symbol_id, count(*) AS n FROM {d} WHERE to_symbol_id IS NOT NULL GROUP BY to_symbol_id HAVING count(*) >= 5 ORDER BY n DESC, to_symbol_id LIMIT 50",
    "gt12_impact_class": "SELECT d.id, CASE WHEN d.dependency_type IN ('api_call', 'shares_schema', 'frontend_backend') THEN 'cross_stack' WHEN d.dependency_type = 'implements' THEN 'interface_contract' WHEN d.dependency_type = 'inherits' THEN 'implementation' WHEN d.calling_object IS NOT NULL THEN 'delegation' ELSE 'direct' END AS impact FROM {d} d",
    "gt08_cross_stack_impact": "SELECT a.endpoint_symbol_id AS backend_id, count(DISTINCT a.caller_symbol_id) AS frontend_symbols, count(DISTINCT d.to_symbol_id) AS backend_symbols FROM {a} a LEFT JOIN {d} d ON d.from_symbol_id = a.endpoint_symbol_id AND d.dependency_type = 'calls' WHERE a.endpoint_symbol_id IS NOT NULL GROUP BY a.endpoint_symbol_id",
    "gt14_list_dependencies": ("c AS (SELECT DISTINCT d.from_symbol_id, d.to_symbol_id, d.dependency_type FROM {d} d WHERE d.to_symbol_id IS NOT NULL AND d.from_symbol_id <> d.to_symbol_id)", "SELECT c.from_symbol_id, c.to_symbol_id, c.dependency_type, s.name, f.path FROM c JOIN {s} s ON s.id = c.to_symbol_id LEFT JOIN {f} f ON f.id = s.file_id WHERE c.dependency_type IN ('inherits', 'implements', 'api_call')"),
    "ce06_database_operations": "SELECT s.id, CASE WHEN lower(f.language) = 'php' AND RX(s.name, '^(save|create|update|delete|find|where|insert)') THEN true WHEN lower(f.language) = 'csharp' AND RX(s.name, '^(Save|Add|Update|Remove|Find|Insert|Execute)') THEN true WHEN lower(f.language) IN ('javascript', 'typescript') AND RX(s.name, '^(save|create|update|delete|find|insert|query)') THEN true ELSE false END AS is_database FROM {s} s LEFT JOIN {f} f ON f.id = s.file_id WHERE s.symbol_type IN ('method', 'function')",
    "fd02_roles": "SELECT id, CASE WHEN symbol_type IN ('function', 'method') THEN 'executor' WHEN symbol_type IN ('class', 'component', 'godot_scene') AND entity_type = 'model' THEN 'entity' WHEN symbol_type IN ('class', 'component', 'godot_scene', 'namespace', 'godot_node') THEN 'container' ELSE 'data' END AS role FROM {s}",
    "fd05_parent_container": ("k AS (SELECT d.to_symbol_id AS id, d.from_symbol_id AS parent_id, 1 AS p FROM {d} d WHERE d.dependency_type = 'contains' AND d.to_symbol_id IS NOT NULL AND d.from_symbol_id IS NOT NULL UNION ALL SELECT d.to_symbol_id, d.from_symbol_id, 2 FROM {d} d JOIN {s} c ON c.id = d.from_symbol_id AND c.symbol_type = 'component' WHERE d.dependency_type = 'calls' AND d.to_symbol_id IS NOT NULL), m AS (SELECT id, parent_id, p, row_number() OVER (PARTITION BY id ORDER BY p, parent_id) AS rn FROM k)", "SELECT id, parent_id, p FROM m WHERE rn = 1"),
    "fd15_test_symbols": "SELECT s.id FROM {s} s LEFT JOIN {f} f ON f.id = s.file_id WHERE NOT coalesce(f.is_test, false) AND NOT coalesce(f.path LIKE '%test%', false) AND NOT RX(coalesce(s.name, ''), '^(test|it|describe)[A-Z_]')",
    "fd16_inherited_entity": "SELECT s.id, coalesce(s.entity_type, p.entity_type) AS entity FROM {s} s LEFT JOIN {s} p ON p.id = s.parent_symbol_id",
    "fd17_related_routes": "SELECT DISTINCT s.id, upper(a.http_method) AS method, a.endpoint_path FROM {s} s JOIN {a} a ON a.endpoint_symbol_id = s.id WHERE s.symbol_type = 'method'",
    "rs03_name_parts": "SELECT id, CASE WHEN instr(qualified_name, '.') > 0 THEN split_part(qualified_name, '.', 1) END AS head, regexp_replace(name, '<.*>', '') AS plain FROM {s}",
    "rs05_language_compatible": "SELECT d.id FROM {d} d JOIN {s} a ON a.id = d.from_symbol_id JOIN {f} fa ON fa.id = a.file_id JOIN {s} b ON b.id = d.to_symbol_id JOIN {f} fb ON fb.id = b.file_id WHERE lower(fa.language) = lower(fb.language) OR (lower(fa.language) IN ('javascript', 'typescript', 'vue') AND lower(fb.language) IN ('javascript', 'typescript', 'vue'))",
    "rs06_store_resolver": "SELECT DISTINCT d.id, s.id AS store_id FROM {d} d JOIN {s} s ON s.name = d.resolved_class AND s.symbol_type = 'class' WHERE d.resolved_class LIKE '%Store'",
    "rs09_framework_registry": "SELECT d.id, x.framework, x.qualified_name FROM {d} d JOIN {x} x ON x.id = d.to_symbol_id",
    "rs11_route_handlers": "SELECT a.id, s.id AS handler_id, p.id AS controller_id FROM {a} a JOIN {s} s ON s.id = a.endpoint_symbol_id LEFT JOIN {s} p ON p.id = s.parent_symbol_id AND p.symbol_type = 'class'",
    "rs15_component_hierarchy": "SELECT c.id, c.parent_symbol_id AS parent_id, p.name AS parent_name FROM {s} c LEFT JOIN {s} p ON p.id = c.parent_symbol_id WHERE c.symbol_type = 'component'",
    "rs17_scene_scripts": "SELECT n.id, d.to_symbol_id AS script_id FROM {s} n JOIN {d} d ON d.from_symbol_id = n.id WHERE n.symbol_type IN ('godot_scene', 'godot_node') AND d.dependency_type = 'references'",
    "se13_framework_search": ("hits AS (SELECT s.id, s.name, 'laravel' AS framework, 1 AS p FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE lower(f.language) = 'php' AND s.name ILIKE '%cache%' UNION ALL SELECT s.id, s.name, 'vue', 2 FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE lower(f.language) = 'vue' AND s.name ILIKE '%cache%')", "SELECT id, name, framework FROM hits ORDER BY p, name, id LIMIT 30"),
    "se15_entity_heuristics": "SELECT s.id, CASE WHEN f.path ILIKE '%/models/%' OR s.base_class = 'Model' THEN 'model' WHEN s.name LIKE '%Controller' THEN 'controller' WHEN f.path ILIKE '%/jobs/%' OR s.name LIKE '%Job' OR s.name LIKE '%Worker' THEN 'job' END AS kind FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE s.symbol_type = 'class'",
    "xs06_shared_contracts": ("k AS (SELECT s.name, s.id, CASE WHEN lower(f.language) IN ('php', 'csharp') THEN 'backend' ELSE 'frontend' END AS side FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE s.symbol_type IN ('class', 'interface'))", "SELECT a.name, count(DISTINCT a.id) AS frontend_types, count(DISTINCT b.id) AS backend_types FROM k a JOIN k b ON b.name = a.name AND b.side = 'backend' WHERE a.side = 'frontend' GROUP BY a.name"),
    "xs07_contract_drift": ("t AS (SELECT s.id, s.name, CASE WHEN lower(f.language) IN ('php', 'csharp') THEN 'backend' ELSE 'frontend' END AS side FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE s.symbol_type = 'class'), fields AS (SELECT DISTINCT t.name, t.side, c.name AS field FROM t JOIN {s} c ON c.parent_symbol_id = t.id WHERE c.symbol_type = 'property'), both_sides AS (SELECT name FROM t GROUP BY name HAVING count(DISTINCT side) = 2), fr AS (SELECT name, field FROM fields WHERE side = 'frontend'), ba AS (SELECT name, field FROM fields WHERE side = 'backend')", "SELECT coalesce(fr.name, ba.name) AS name, coalesce(fr.field, ba.field) AS field, CASE WHEN fr.name IS NULL THEN 'backend_only' WHEN ba.name IS NULL THEN 'frontend_only' ELSE 'same' END AS state FROM fr FULL OUTER JOIN ba ON ba.name = fr.name AND ba.field = fr.field JOIN both_sides q ON q.name = coalesce(fr.name, ba.name)"),
    "xs10_best_caller": ("k AS (SELECT a.id, s.id AS symbol_id, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN lower(f.language) IN ('vue', 'typescript', 'javascript') THEN 0 ELSE 1 END, CASE WHEN s.symbol_type IN ('function', 'method') THEN 0 ELSE 1 END, s.id) AS rn FROM {a} a JOIN {s} c ON c.id = a.caller_symbol_id JOIN {s} s ON s.file_id = c.file_id LEFT JOIN {f} f ON f.id = s.file_id)", "SELECT id, symbol_id FROM k WHERE rn = 1"),
    "in08_tagged_union": "SELECT 'api_call' AS kind, id, created_at FROM {a} UNION ALL SELECT 'error', id, created_at FROM {b}",
    "ig03_size_text": ("k AS (SELECT id, size, CASE WHEN size < 1024 THEN concat(CAST(size AS VARCHAR(20)), ' B') WHEN size < 1048576 THEN concat(CAST(CAST(floor(size / 1024) AS BIGINT) AS VARCHAR(20)), ' KB') ELSE concat(CAST(CAST(floor(size / 1048576) AS BIGINT) AS VARCHAR(20)), ' MB') END AS label FROM {f})", "SELECT id, label FROM k WHERE size IS NOT NULL"),
    "dc02_override_set": "SELECT DISTINCT from_symbol_id AS id FROM {d} WHERE dependency_type IN ('implements', 'inherits')",
    "dc03_exported_set": "SELECT id FROM {s} WHERE is_exported",
    "dc10_latest_repository": "SELECT id, name FROM {r} ORDER BY last_indexed DESC NULLS LAST, id LIMIT 1",
}

QUERIES = {
    "sc16_json_rows": bound(R.json_rows),
    "pr09_routes_filtered": bound(R.routes, method="POST", text="order", limit=50),
    "pr10_components": bound(R.components),
    "pr11_composables": bound(R.entities_named, entity_type="composable", text="cache"),
    "pr12_scenes_and_nodes": bound(R.nodes_with_scenes),
    "pr18_roots_and_children": bound(R.roots_with_children, symbol_type="class"),
    "jn04_file_edge_join": bound(R.file_edges_of_type, kind="imports"),
    "jn15_first_container": bound(R.first_container),
    "ag16_nested_groups": bound(R.type_lists_per_repository),
    "ag20_slowest_files": bound(R.large_files, more_than=3, limit=10),
    "so07_truncation_by_rank": bound(R.truncated_by_rank, limit=200),
    "so08_enum_order": bound(R.types_in_order, order=["class", "interface", "component", "function", "method", "property"]),
    "so09_threshold_top": bound(R.most_referred, least=5, limit=50),
    "gt12_impact_class": bound(R.impact_classes),
    "gt08_cross_stack_impact": bound(R.cross_stack_impact),
    "gt14_list_dependencies": bound(R.dependencies_of_types, "inherits", "implements", "api_call"),
    "ce06_database_operations": bound(R.database_operations, verbs={("php",): "^(save|create|update|delete|find|where|insert)", ("csharp",): "^(Save|Add|Update|Remove|Find|Insert|Execute)", ("javascript", "typescript"): "^(save|create|update|delete|find|insert|query)"}),
    "fd02_roles": bound(R.roles),
    "fd05_parent_container": bound(R.parent_containers),
    "fd15_test_symbols": bound(R.symbols_outside_tests),
    "fd16_inherited_entity": bound(R.inherited_entities),
    "fd17_related_routes": bound(R.routes_of_methods),
    "rs03_name_parts": bound(R.name_parts),
    "rs05_language_compatible": bound(R.language_compatible),
    "rs06_store_resolver": bound(R.store_targets),
    "rs09_framework_registry": bound(R.framework_targets),
    "rs11_route_handlers": bound(R.route_controllers),
    "rs15_component_hierarchy": bound(R.component_parents),
    "rs17_scene_scripts": bound(R.scene_scripts),
    "se13_framework_search": bound(R.framework_search, text="cache", frameworks={"php": "laravel", "vue": "vue"}, limit=30),
    "se15_entity_heuristics": bound(R.entity_heuristics),
    "xs06_shared_contracts": bound(R.shared_contracts),
    "xs07_contract_drift": bound(R.contract_drift),
    "xs10_best_caller": bound(R.best_callers),
    "in08_tagged_union": bound(R.tagged_rows),
    "ig03_size_text": bound(R.size_labels),
    "dc02_override_set": bound(R.overriding),
    "dc03_exported_set": bound(R.exported),
    "dc10_latest_repository": bound(R.latest_repository),
}
ORACLES = twins(TWINS)


def gt11_call_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Caller paths of the seed as names in order, joined by arrows."""
    found = graph.paths(*_calls(spark, folder), 3, reverse=True)
    names = view(spark, folder, "s", "name").select(F.col("id").alias("s_id"), F.coalesce("name", F.lit("?")).alias("name"))
    steps = found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("ids"), F.posexplode("path").alias("at", "step"))
    named = steps.join(names, F.col("step") == F.col("s_id"), "left").select("ids", "at", F.coalesce("name", F.lit("?")).alias("name"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    return named.groupBy("ids").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " → ").alias("chain"))


def ga10_import_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Imports of scripts resolved to files of the repository, the first candidate path that exists winning."""
    texts = table(spark, folder, "source_texts")
    owners = texts.select(F.col("file_id").alias("o_id"), "repo_id", "path")
    found = code.parsed_imports(texts).join(owners, F.col("file_id") == F.col("o_id"))
    local = found.where(F.col("source").rlike(r"^(\.|@/|src/)")).select("file_id", "repo_id", "source", "line_number", code.import_candidates("path", "source").alias("candidates"))
    files = view(spark, folder, "f", "repo_id", "path").select(F.col("repo_id").alias("f_repo"), F.col("path").alias("f_path"), F.col("id").alias("target_id"))
    tried = local.select("file_id", "repo_id", "source", "line_number", F.posexplode("candidates").alias("rank", "candidate"))
    hits = tried.join(files, (F.col("repo_id") == F.col("f_repo")) & (F.col("candidate") == F.col("f_path")))
    best = hits.groupBy("file_id", "source", "line_number").agg(F.min(F.struct("rank", "target_id")).alias("best"))
    return local.join(best, ["file_id", "source", "line_number"], "left").select("file_id", "source", "line_number", F.col("best.target_id").alias("target_id"))


QUERIES |= {f.__name__: f for f in (gt11_call_chains, ga10_import_targets)}
ORACLES["gt11_call_chains"] = f"""WITH RECURSIVE {_EDGES}, {_SEED}, {view_sql("s", "name")},
w AS (SELECT seed, e.src AS node, 1 AS depth, [seed, e.src] AS path, list_append([coalesce(a.name, '?')], coalesce(b.name, '?')) AS names FROM seed JOIN e ON e.dst = seed LEFT JOIN s a ON a.id = seed LEFT JOIN s b ON b.id = e.src
      UNION ALL SELECT w.seed, e.src, w.depth + 1, list_append(w.path, e.src), list_append(w.names, coalesce(b.name, '?')) FROM w JOIN e ON e.dst = w.node LEFT JOIN s b ON b.id = e.src WHERE w.depth < 3 AND NOT list_contains(w.path, e.src))
SELECT list_aggregate(path, 'string_agg', '>') AS ids, list_aggregate(names, 'string_agg', ' → ') AS chain FROM w"""
