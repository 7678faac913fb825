"""Relational operators with the parameters they are registered with, and SQL that says the same on its own."""

from __future__ import annotations

from symloom.operators import relations as R
from symloom.plans.sqlquery import bound, twins

#: The symbol that is called most, as a common table expression for queries about one symbol.
_HOT = """hot AS (SELECT d0.to_symbol_id AS hot_id FROM {d} d0 JOIN {s} s0 ON s0.id = d0.to_symbol_id
  WHERE d0.dependency_type = 'calls' GROUP BY d0.to_symbol_id ORDER BY count(*) DESC, d0.to_symbol_id LIMIT 1)"""

TWINS: dict[str, tuple[str, str] | str] = {
    # scans and writes
    "sc08_symbols_by_repository": "SELECT f.repo_id, s.id, s.name, s.symbol_type FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE f.repo_id = 7",
    "sc09_keyset_batch": "SELECT id, name, description FROM {s} WHERE id > 1500 AND description IS NOT NULL ORDER BY id LIMIT 100",
    "sc11_upsert_keep_latest": "SELECT id, repo_id, path, language, is_test FROM {f}",
    "sc12_insert_skip_rate": "SELECT count(*) AS offered, count(DISTINCT id) AS stored, round(100.0 * (count(*) - count(DISTINCT id)) / count(*), 2) AS skipped_pct FROM {api_calls}",
    "sc13_cascade_delete": ("gone AS (SELECT id FROM {f} WHERE repo_id = 3), gone_symbols AS (SELECT s.id FROM {s} s WHERE s.file_id IN (SELECT id FROM gone))", "SELECT d.id, d.from_symbol_id, d.to_symbol_id FROM {d} d WHERE NOT EXISTS (SELECT 1 FROM gone_symbols g WHERE g.id = d.from_symbol_id) AND NOT EXISTS (SELECT 1 FROM gone_symbols g WHERE g.id = d.to_symbol_id)"),
    "sc14_set_null_on_delete": ("gone_symbols AS (SELECT s.id FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE f.repo_id = 3)", "SELECT d.id, CASE WHEN g.id IS NULL THEN d.to_symbol_id END AS to_symbol_id FROM {d} d LEFT JOIN gone_symbols g ON g.id = d.to_symbol_id"),
    "sc15_graph_export_edges": "SELECT DISTINCT 'IN_FILE' AS rel, s.id AS start_id, s.file_id AS end_id FROM {s} s WHERE s.file_id IS NOT NULL UNION ALL SELECT DISTINCT upper(dependency_type), from_symbol_id, to_symbol_id FROM {d} WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL",
    "sc15_graph_export_nodes": "SELECT 'File' AS label, id AS node_id, path AS name FROM {f} UNION ALL SELECT 'Symbol', id, name FROM {s}",
    "sc18_repository_listing": "SELECT r.id, r.name, r.language_primary, count(f.id) AS files FROM {r} r LEFT JOIN {f} f ON f.repo_id = r.id GROUP BY r.id, r.name, r.language_primary",
    # projections and filters
    "pr01_point_lookup": "SELECT id, name, qualified_name, file_id FROM {s} WHERE id = 1234",
    "pr02_batch_lookup": (_HOT, "SELECT DISTINCT s.id, s.name, s.symbol_type FROM {s} s JOIN {d} d ON d.from_symbol_id = s.id JOIN hot ON hot.hot_id = d.to_symbol_id"),
    "pr03_fuzzy_path": ("hits AS (SELECT id, path, 1 AS priority FROM {f} WHERE path = 'src/index.ts' UNION ALL SELECT id, path, 2 FROM {f} WHERE path LIKE '%/Order%Manager.php' UNION ALL SELECT id, path, 3 FROM {f} WHERE path LIKE '%Manager.%')", "SELECT id, path, priority FROM hits ORDER BY priority, path, id LIMIT 1"),
    "pr04_nested_rows": "SELECT d.id, CASE WHEN a.id IS NOT NULL THEN CAST(to_json(struct_pack(id := a.id, name := a.name, file := struct_pack(id := fa.id, path := fa.path))) AS VARCHAR) END AS from_symbol, CASE WHEN b.id IS NOT NULL THEN CAST(to_json(struct_pack(id := b.id, name := b.name, file := struct_pack(id := fb.id, path := fb.path))) AS VARCHAR) END AS to_symbol FROM {d} d LEFT JOIN {s} a ON a.id = d.from_symbol_id LEFT JOIN {f} fa ON fa.id = a.file_id LEFT JOIN {s} b ON b.id = d.to_symbol_id LEFT JOIN {f} fb ON fb.id = b.file_id WHERE d.dependency_type IN ('inherits', 'implements')",
    "pr05_escaped_substring": "SELECT id, name FROM {s} WHERE lower(name) LIKE '%!_order%' ESCAPE '!'",
    "pr08_symbols_by_type": "SELECT id, name FROM {s} WHERE symbol_type = 'interface'",
    "pr08_files_by_language": "SELECT id, path FROM {f} WHERE lower(language) = 'vue'",
    "pr13_edge_type_lists": "SELECT id, dependency_type FROM {d} WHERE dependency_type IN ('inherits', 'implements') AND dependency_type NOT IN ('contains')",
    "pr14_regex_predicate": "SELECT id, name FROM {s} WHERE RX(name, '^(resolve|merge)[A-Z]')",
    "pr15_line_containment": "SELECT o.id AS outer_id, i.id AS inner_id FROM {s} o JOIN {s} i ON i.file_id = o.file_id AND o.symbol_type = 'class' AND i.symbol_type = 'method' AND i.start_line >= o.start_line AND i.end_line <= o.end_line",
    "pr16_modified_since": "SELECT f.id, f.path FROM {f} f JOIN {r} r ON r.id = f.repo_id WHERE f.last_modified > r.last_indexed",
    "pr17_array_predicates": "SELECT id, name FROM {r} WHERE cardinality(framework_stack) > 1",
    "pr19_symbol_with_framework": "SELECT s.id, s.name, x.qualified_name AS framework_name FROM {s} s LEFT JOIN {x} x ON x.name = s.name AND x.framework = s.framework WHERE s.symbol_type = 'function'",
    # joins
    "jn01_symbols_files": "SELECT s.id, s.name, f.path FROM {s} s JOIN {f} f ON f.id = s.file_id",
    "jn02_edge_with_both_ends": "SELECT d.id, fs.name AS from_name, ff.path AS from_path, ts.name AS to_name, tf.path AS to_path FROM {d} d LEFT JOIN {s} fs ON fs.id = d.from_symbol_id LEFT JOIN {f} ff ON ff.id = fs.file_id LEFT JOIN {s} ts ON ts.id = d.to_symbol_id LEFT JOIN {f} tf ON tf.id = ts.file_id",
    "jn03_callers_distinct": (_HOT, "SELECT DISTINCT d.from_symbol_id, d.dependency_type, s.name FROM {d} d JOIN hot ON hot.hot_id = d.to_symbol_id LEFT JOIN {s} s ON s.id = d.from_symbol_id WHERE d.from_symbol_id <> d.to_symbol_id"),
    "jn05_calls_with_endpoint": "SELECT DISTINCT a.id, c.name AS caller, e.name AS endpoint, f.path FROM {a} a JOIN {s} e ON e.id = a.endpoint_symbol_id JOIN {s} c ON c.id = a.caller_symbol_id LEFT JOIN {f} f ON f.id = c.file_id",
    "jn06_constant_in_on": "SELECT s.id, count(d.id) AS calls FROM {s} s LEFT JOIN {d} d ON d.to_symbol_id = s.id AND d.dependency_type = 'calls' GROUP BY s.id",
    "jn07_never_called": "SELECT s.id, s.name FROM {s} s LEFT JOIN {d} d ON d.to_symbol_id = s.id WHERE s.symbol_type IN ('function', 'method') GROUP BY s.id, s.name HAVING count(*) FILTER (WHERE d.dependency_type = 'calls') = 0",
    "jn08_not_exists": "SELECT d.id FROM {d} d WHERE d.to_symbol_id IS NULL AND d.dependency_type <> 'imports' AND NOT EXISTS (SELECT 1 FROM {s} s WHERE s.qualified_name = d.to_qualified_name)",
    "jn09_nested_in": "SELECT id, name FROM {s} WHERE file_id IN (SELECT id FROM {f} WHERE repo_id IN (SELECT id FROM {r} WHERE language_primary = 'php'))",
    "jn10_not_in_paths": "SELECT f.id FROM {f} f WHERE NOT EXISTS (SELECT 1 FROM {source_texts} t WHERE t.repo_id = f.repo_id AND t.path = f.path)",
    "jn11_two_hop_degree": ("e AS (SELECT DISTINCT from_symbol_id AS a, to_symbol_id AS b FROM {d} WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL)", "SELECT x.a AS id, count(DISTINCT y.b) AS two_hops FROM e x JOIN e y ON y.a = x.b GROUP BY x.a"),
    "jn12_container_path": "SELECT m.id AS method_id, c.id AS container_id, f.path FROM {s} m JOIN {d} d ON d.to_symbol_id = m.id AND d.dependency_type = 'contains' JOIN {s} c ON c.id = d.from_symbol_id JOIN {f} f ON f.id = c.file_id WHERE m.symbol_type = 'method'",
    "jn13_service_calls": "SELECT DISTINCT k.from_symbol_id AS caller_id, p.id AS service_id FROM {d} k JOIN {s} m ON m.id = k.to_symbol_id JOIN {s} p ON p.id = m.parent_symbol_id WHERE k.dependency_type = 'calls' AND m.symbol_type = 'method' AND p.entity_type = 'service'",
    "jn14_interface_pairs": ("im AS (SELECT DISTINCT d.from_symbol_id AS class_id, d.to_symbol_id AS interface_id FROM {d} d WHERE d.dependency_type = 'implements')", "SELECT im.interface_id, im.class_id, a.id AS interface_method, b.id AS class_method FROM im JOIN {s} a ON a.parent_symbol_id = im.interface_id JOIN {s} b ON b.parent_symbol_id = im.class_id AND b.name = a.name"),
    "jn16_innermost_class": ("pairs AS (SELECT i.id AS inner_id, o.id AS outer_id, row_number() OVER (PARTITION BY i.id ORDER BY o.end_line - o.start_line, o.id) AS rn FROM {s} i JOIN {s} o ON o.file_id = i.file_id AND o.symbol_type = 'class' AND i.id <> o.id AND i.start_line >= o.start_line AND i.end_line <= o.end_line WHERE i.symbol_type IN ('method', 'property'))", "SELECT inner_id, outer_id FROM pairs WHERE rn = 1"),
    "jn19_lateral_aggregate": ("per AS (SELECT file_id, count(*) AS symbols, count(DISTINCT symbol_type) AS kinds FROM {s} GROUP BY file_id)", "SELECT f.id, coalesce(p.symbols, 0) AS symbols, coalesce(p.kinds, 0) AS kinds FROM {f} f LEFT JOIN per p ON p.file_id = f.id"),
    "jn20_scalar_subquery": "SELECT language, count(*) AS files, round(100.0 * count(*) / (SELECT count(*) FROM {f}), 2) AS pct FROM {f} GROUP BY language",
    "jn21_lateral_rows": ("e AS (SELECT s.file_id, d.id, d.line_number FROM {d} d JOIN {s} s ON s.id = d.from_symbol_id WHERE d.line_number IS NOT NULL AND s.file_id IS NOT NULL)", "SELECT k.file_id, l.id, l.line_number, l.place FROM (SELECT DISTINCT file_id FROM e) k CROSS JOIN LATERAL (SELECT e.id, e.line_number, row_number() OVER (ORDER BY e.line_number DESC, e.id) AS place FROM e WHERE e.file_id = k.file_id QUALIFY place <= 3) l"),
    "jn22_first_source_wins": ("src AS (SELECT endpoint_symbol_id AS id, 'endpoint' AS kind, 1 AS p FROM {a} WHERE endpoint_symbol_id IS NOT NULL UNION ALL SELECT id, 'component', 2 FROM {s} WHERE symbol_type = 'component' UNION ALL SELECT id, 'framework', 3 FROM {x}), ranked AS (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY p, kind) AS rn FROM src)", "SELECT id, kind FROM ranked WHERE rn = 1"),
    # aggregates
    "ag01_counts": "SELECT (SELECT count(*) FROM {r}) AS repositories, (SELECT count(*) FROM {f}) AS files, (SELECT count(*) FROM {s}) AS symbols, (SELECT count(*) FROM {d}) AS dependencies",
    "ag02_count_distinct": "SELECT dependency_type, count(DISTINCT from_symbol_id) AS callers, count(DISTINCT to_symbol_id) AS callees FROM {d} GROUP BY dependency_type",
    "ag03_distinct_tuples": "SELECT count(*) AS tuples FROM (SELECT DISTINCT from_symbol_id, to_symbol_id, dependency_type, line_number FROM {d}) q",
    "ag04_filtered_counts": "SELECT f.repo_id, count(*) FILTER (WHERE f.is_test) AS tests, count(*) FILTER (WHERE f.is_generated) AS generated, count(*) AS files FROM {f} f GROUP BY f.repo_id",
    "ag05_having": "SELECT name, count(*) AS n FROM {s} GROUP BY name HAVING count(*) > 3",
    "ag06_group_by_case": ("k AS (SELECT CASE WHEN path LIKE '%.vue' THEN 'vue' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.php' THEN 'php' WHEN path LIKE '%.cs' THEN 'csharp' ELSE 'other' END AS kind, size FROM {f})", "SELECT kind, count(*) AS files, sum(size) AS bytes FROM k GROUP BY kind"),
    "ag07_min_id_per_key": "SELECT from_symbol_id, to_symbol_id, min(id) AS id FROM {d} WHERE to_symbol_id IS NOT NULL GROUP BY from_symbol_id, to_symbol_id",
    "ag08_percentages": "SELECT symbol_type, count(*) AS n, round(100.0 * count(description) / nullif(count(*), 0), 2) AS described_pct FROM {s} GROUP BY symbol_type",
    "ag09_roll_ups": "SELECT symbol_type, round(avg(end_line - start_line), 4) AS mean_lines, min(end_line - start_line) AS least, max(end_line - start_line) AS most FROM {s} GROUP BY symbol_type",
    "ag10_string_agg": ("k AS (SELECT DISTINCT f.repo_id, lower(f.language) AS lang FROM {f} f WHERE f.language IS NOT NULL)", "SELECT repo_id, LISTAGG(lang BY lang) AS languages FROM k GROUP BY repo_id"),
    "ag11_parameter_groups": "SELECT to_symbol_id, parameter_context, count(*) AS calls, count(DISTINCT from_symbol_id) AS callers, min(line_number) AS first_line FROM {d} WHERE parameter_context IS NOT NULL AND to_symbol_id IS NOT NULL GROUP BY to_symbol_id, parameter_context",
    "ag12_parameter_insights": "SELECT to_symbol_id, count(DISTINCT parameter_context) AS patterns, count(*) FILTER (WHERE parameter_context LIKE '%null%') AS null_patterns FROM {d} WHERE to_symbol_id IS NOT NULL GROUP BY to_symbol_id HAVING count(DISTINCT parameter_context) > 1",
    "ag13_health": "SELECT count(*) AS calls, count(*) FILTER (WHERE endpoint_symbol_id IS NULL) AS orphans, CASE WHEN count(*) FILTER (WHERE endpoint_symbol_id IS NULL) * 10 > count(*) THEN 'degraded' ELSE 'healthy' END AS status FROM {a}",
    "ag14_frameworks_per_repository": "SELECT DISTINCT f.repo_id, s.framework FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE s.framework IS NOT NULL",
    "ag15_pivot": "SELECT repo_id, count(*) FILTER (WHERE upper(http_method) = 'GET') AS get_calls, count(*) FILTER (WHERE upper(http_method) = 'POST') AS post_calls, count(*) FILTER (WHERE upper(http_method) NOT IN ('GET', 'POST')) AS other_calls FROM {a} GROUP BY repo_id",
    "ag17_first_wins": ("k AS (SELECT from_symbol_id, to_symbol_id, id, line_number, row_number() OVER (PARTITION BY from_symbol_id, to_symbol_id ORDER BY id) AS rn FROM {d} WHERE to_symbol_id IS NOT NULL)", "SELECT from_symbol_id, to_symbol_id, id, line_number FROM k WHERE rn = 1"),
    "ag18_most_complete": ("k AS (SELECT name, file_id, id, row_number() OVER (PARTITION BY name, file_id ORDER BY CASE WHEN signature IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN is_exported THEN 0 ELSE 1 END, CASE WHEN description IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN qualified_name IS NOT NULL THEN 0 ELSE 1 END, id) AS rn FROM {s})", "SELECT name, file_id, id FROM k WHERE rn = 1"),
    "ag19_specific_then_short": ("k AS (SELECT s.name, s.id, s.entity_type, row_number() OVER (PARTITION BY s.name ORDER BY CASE WHEN s.entity_type IS NOT NULL THEN 0 ELSE 1 END, length(f.path), s.id) AS rn FROM {s} s JOIN {f} f ON f.id = s.file_id)", "SELECT name, id, entity_type FROM k WHERE rn = 1"),
    "ag21_primary_language": ("k AS (SELECT repo_id, lower(language) AS lang, count(*) AS n FROM {f} WHERE language IS NOT NULL GROUP BY repo_id, lower(language)), m AS (SELECT repo_id, lang, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, lang) AS rn FROM k)", "SELECT repo_id, lang, n FROM m WHERE rn = 1"),
    # windows
    "wn01_keep_latest": ("k AS (SELECT id, row_number() OVER (PARTITION BY from_symbol_id, to_qualified_name, dependency_type, line_number ORDER BY id DESC) AS rn FROM {d})", "SELECT id FROM k WHERE rn = 1"),
    "wn02_sample_per_group": ("k AS (SELECT symbol_type, id, name, row_number() OVER (PARTITION BY symbol_type ORDER BY id) AS rn FROM {s})", "SELECT symbol_type, id, name FROM k WHERE rn <= 5"),
    "wn03_count_over": "SELECT id, parent_symbol_id, count(*) OVER (PARTITION BY parent_symbol_id) AS siblings FROM {s} WHERE parent_symbol_id IS NOT NULL",
    "wn04_share_of_category": "SELECT symbol_type, entity_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol_type), 2) AS pct FROM {s} GROUP BY symbol_type, entity_type",
    # order and pages
    "so01_order_limit": "SELECT id, name, end_line - start_line AS lines FROM {s} WHERE end_line IS NOT NULL AND start_line IS NOT NULL ORDER BY end_line - start_line DESC, id LIMIT 25",
    "so02_ranked_choice": "SELECT id, name, symbol_type FROM {s} WHERE symbol_type IN ('function', 'method', 'class') ORDER BY CASE symbol_type WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, id LIMIT 1",
    "so03_cursor_page": ("page AS (SELECT id, name FROM {s} WHERE id > 2000 ORDER BY id LIMIT 51)", "SELECT id, name, (SELECT count(*) FROM page) > 50 AS has_more FROM page ORDER BY id LIMIT 50"),
    "so04_offset_page": "SELECT id, name FROM {s} ORDER BY id LIMIT 40 OFFSET 80",
    "so05_page_with_total": "SELECT id, name, (SELECT count(*) FROM {s}) AS total FROM {s} ORDER BY id LIMIT 20",
    "so06_callers_page": (_HOT, "SELECT d.from_symbol_id, count(*) AS calls FROM {d} d JOIN hot ON hot.hot_id = d.to_symbol_id WHERE d.from_symbol_id > 1000 GROUP BY d.from_symbol_id ORDER BY d.from_symbol_id LIMIT 50"),
    "so10_samples_with_totals": ("k AS (SELECT entity_type, id, row_number() OVER (PARTITION BY entity_type ORDER BY id) AS rn, count(*) OVER (PARTITION BY entity_type) AS total FROM {s} WHERE entity_type IS NOT NULL)", "SELECT entity_type, id, total FROM k WHERE rn <= 50"),
    # sets
    "st01_labelled_metrics": "SELECT 'files' AS metric, count(*) AS value FROM {f} UNION ALL SELECT 'symbols', count(*) FROM {s} UNION ALL SELECT 'edges', count(*) FROM {d} UNION ALL SELECT 'api_calls', count(*) FROM {a}",
    "st04_heterogeneous_edges": "SELECT from_symbol_id AS src, to_symbol_id AS dst, dependency_type AS kind FROM {d} UNION ALL SELECT caller_symbol_id, endpoint_symbol_id, 'api_call' FROM {a}",
    "st05_linked_ids": "SELECT id FROM (SELECT from_symbol_id AS id FROM {d} UNION SELECT to_symbol_id FROM {d} UNION SELECT caller_symbol_id FROM {a} UNION SELECT endpoint_symbol_id FROM {a}) q WHERE id IS NOT NULL",
    "st06_new_relationships": "SELECT DISTINCT a.caller_symbol_id AS src, a.endpoint_symbol_id AS dst FROM {a} a WHERE a.endpoint_symbol_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {d} d WHERE d.from_symbol_id = a.caller_symbol_id AND d.to_symbol_id = a.endpoint_symbol_id)",
    "st08_intersect_except": "SELECT parent_symbol_id AS id FROM {s} WHERE parent_symbol_id IS NOT NULL INTERSECT SELECT from_symbol_id FROM {d} WHERE dependency_type = 'contains'",
    # lookups of impact and framework data
    "gt16_test_impact": (_HOT, "SELECT DISTINCT f.id AS file_id, f.path FROM {d} d JOIN hot ON hot.hot_id = d.to_symbol_id JOIN {s} s ON s.id = d.from_symbol_id JOIN {f} f ON f.id = s.file_id WHERE f.path LIKE '%test%' OR f.path LIKE '%spec%'"),
    "gt16_impact_sets": (_HOT + ", k AS (SELECT DISTINCT d.from_symbol_id AS id FROM {d} d JOIN hot ON hot.hot_id = d.to_symbol_id WHERE d.from_symbol_id IN (SELECT id FROM {s}))", "SELECT DISTINCT 'route' AS kind, endpoint_symbol_id AS symbol_id FROM {a} WHERE endpoint_symbol_id IN (SELECT id FROM k) UNION SELECT 'job', s.id FROM {s} s LEFT JOIN {f} f ON f.id = s.file_id WHERE s.id IN (SELECT id FROM k) AND (f.path ILIKE '%/jobs/%' OR s.name LIKE '%Job') UNION SELECT 'test', s.id FROM {s} s JOIN {f} f ON f.id = s.file_id WHERE s.id IN (SELECT id FROM k) AND (f.path ILIKE '%test%' OR f.path ILIKE '%spec%')"),
    "ga01_relatives": (_HOT, "SELECT DISTINCT 'caller' AS relation, from_symbol_id AS other_id FROM {d} d JOIN hot ON hot_id = to_symbol_id WHERE dependency_type = 'calls' AND from_symbol_id IS NOT NULL UNION SELECT 'implementation', from_symbol_id FROM {d} d JOIN hot ON hot_id = to_symbol_id WHERE dependency_type IN ('implements', 'inherits') AND from_symbol_id IS NOT NULL UNION SELECT 'callee', to_symbol_id FROM {d} d JOIN hot ON hot_id = from_symbol_id WHERE dependency_type = 'calls' AND to_symbol_id <> hot_id UNION SELECT 'parent', to_symbol_id FROM {d} d JOIN hot ON hot_id = from_symbol_id WHERE dependency_type IN ('implements', 'inherits') AND to_symbol_id <> hot_id"),
    "ga01_implementations": "SELECT d.to_symbol_id AS interface_id, d.from_symbol_id AS class_id FROM {d} d WHERE d.dependency_type = 'implements' AND d.to_symbol_id IS NOT NULL GROUP BY d.to_symbol_id, d.from_symbol_id",
    "ga04_direct_recursion": "SELECT DISTINCT from_symbol_id AS id FROM {d} WHERE from_symbol_id = to_symbol_id AND dependency_type = 'calls'",
    "ga06_unused_functions": "SELECT s.id, s.name FROM {s} s WHERE s.symbol_type = 'function' AND NOT coalesce(s.is_exported, false) AND NOT EXISTS (SELECT 1 FROM {d} d WHERE d.to_symbol_id = s.id AND d.dependency_type = 'calls')",
    "ga07_complexity": ("o AS (SELECT from_symbol_id AS id, count(DISTINCT to_symbol_id) AS n FROM {d} WHERE dependency_type = 'calls' GROUP BY from_symbol_id), i AS (SELECT to_symbol_id AS id, count(DISTINCT from_symbol_id) AS n FROM {d} WHERE dependency_type = 'calls' GROUP BY to_symbol_id), p AS (SELECT from_symbol_id AS id, count(DISTINCT to_symbol_id) AS n FROM {d} WHERE dependency_type IN ('inherits', 'implements') GROUP BY from_symbol_id)", "SELECT s.id, 1 + coalesce(o.n, 0) + CAST(floor(coalesce(i.n, 0) / 2) AS BIGINT) + 2 * coalesce(p.n, 0) AS complexity FROM {s} s LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id LEFT JOIN p ON p.id = s.id"),
    "ga08_file_importers": "SELECT DISTINCT tf.id AS file_id, ff.id AS importer_id FROM {d} d JOIN {s} a ON a.id = d.from_symbol_id JOIN {f} ff ON ff.id = a.file_id JOIN {s} b ON b.id = d.to_symbol_id JOIN {f} tf ON tf.id = b.file_id WHERE d.dependency_type = 'imports' AND ff.id <> tf.id",
    "ga12_file_edges": "SELECT a.file_id AS from_file, b.file_id AS to_file, d.dependency_type, min(d.line_number) AS line_number, count(*) AS edges FROM {d} d JOIN {s} a ON a.id = d.from_symbol_id JOIN {s} b ON b.id = d.to_symbol_id WHERE a.file_id <> b.file_id GROUP BY a.file_id, b.file_id, d.dependency_type",
    # cross-stack and incremental
    "xs13_feature_clusters": ("k AS (SELECT regexp_extract(name, '^([A-Z][a-z]+)', 1) AS word FROM {s} WHERE symbol_type IN ('class', 'component'))", "SELECT word, count(*) AS symbols FROM k WHERE word <> '' GROUP BY word HAVING count(*) > 1"),
    "xs15_multi_framework": "SELECT id, name FROM {r} WHERE array_contains(framework_stack, 'vue') AND array_contains(framework_stack, 'laravel')",
    "in01_change_detection": ("snap AS (SELECT t.repo_id, t.path, t.file_id FROM {source_texts} t)", "SELECT coalesce(f.id, p.file_id) AS file_id, CASE WHEN f.id IS NULL THEN 'new' WHEN p.file_id IS NULL THEN 'deleted' WHEN f.last_modified > r.last_indexed THEN 'changed' ELSE 'same' END AS state FROM {f} f FULL OUTER JOIN snap p ON p.file_id = f.id LEFT JOIN {r} r ON r.id = f.repo_id"),
    "in03_deleted_files": "SELECT f.id, f.path FROM {f} f WHERE NOT coalesce(f.is_generated, false) AND NOT EXISTS (SELECT 1 FROM {source_texts} t WHERE t.file_id = f.id)",
    "in04_orphan_files": "SELECT t.file_id FROM {source_texts} t WHERE NOT EXISTS (SELECT 1 FROM {s} s WHERE s.file_id = t.file_id)",
    "rs12_resolve_by_name": ("n AS (SELECT qualified_name, min(id) AS id FROM {s} WHERE qualified_name IS NOT NULL GROUP BY qualified_name)", "SELECT d.id, coalesce(d.to_symbol_id, n.id) AS to_symbol_id FROM {d} d LEFT JOIN n ON n.qualified_name = d.to_qualified_name WHERE d.to_symbol_id IS NULL"),
    "rs13_orphan_edges": "SELECT d.id FROM {d} d WHERE d.to_symbol_id IS NULL AND (d.to_qualified_name IS NULL OR (d.dependency_type <> 'imports' AND NOT EXISTS (SELECT 1 FROM {s} s WHERE s.qualified_name = d.to_qualified_name)))",
    "rs19_edges_with_both_ends": "SELECT d.id, d.from_symbol_id, d.to_symbol_id, coalesce(d.to_qualified_name, t.qualified_name) AS to_qualified_name FROM {d} d JOIN {s} t ON t.id = d.to_symbol_id WHERE EXISTS (SELECT 1 FROM {s} c WHERE c.id = d.from_symbol_id)",
    "se07_qualified_context": "SELECT d.qualified_context, d.resolved_class, count(*) AS n FROM {d} d WHERE d.qualified_context ILIKE '%manager%' OR d.resolved_class ILIKE '%manager%' GROUP BY d.qualified_context, d.resolved_class",
    "se08_method_signatures": "SELECT DISTINCT d.to_symbol_id, d.method_signature FROM {d} d WHERE d.method_signature ILIKE '%(userId%'",
    "se09_namespace_context": "SELECT DISTINCT d.namespace_context, s.name FROM {d} d JOIN {s} s ON s.id = d.from_symbol_id WHERE d.namespace_context ILIKE '%store%'",
    "se14_route_substring": "SELECT DISTINCT endpoint_path, upper(http_method) AS method FROM {a} WHERE endpoint_path ILIKE '%invoice%'",
    "au01_unresolved_by_type": "SELECT dependency_type, count(*) AS edges, count(*) FILTER (WHERE to_symbol_id IS NULL) AS unresolved, round(100.0 * count(*) FILTER (WHERE to_symbol_id IS NULL) / count(*), 2) AS pct FROM {d} GROUP BY dependency_type",
    "au02_name_collisions": "SELECT f.repo_id, count(*) AS symbols, count(*) - count(DISTINCT s.name) AS collisions FROM {s} s JOIN {f} f ON f.id = s.file_id GROUP BY f.repo_id",
    "au03_files_without_symbols": "SELECT f.repo_id, count(*) AS files FROM {f} f LEFT JOIN {s} s ON s.file_id = f.id WHERE s.id IS NULL GROUP BY f.repo_id",
    "au04_lines_out_of_order": "SELECT id, start_line, end_line FROM {s} WHERE end_line < start_line",
    "au05_cross_language_edges": "SELECT lower(ff.language) AS from_language, lower(tf.language) AS to_language, count(*) AS edges FROM {d} d JOIN {s} a ON a.id = d.from_symbol_id JOIN {f} ff ON ff.id = a.file_id JOIN {s} b ON b.id = d.to_symbol_id JOIN {f} tf ON tf.id = b.file_id WHERE lower(ff.language) <> lower(tf.language) GROUP BY lower(ff.language), lower(tf.language)",
    "au06_edges_per_month": "SELECT MONTH(created_at) AS month, dependency_type, count(*) AS edges FROM {d} GROUP BY MONTH(created_at), dependency_type",
    "au07_store_naming": "SELECT id, name FROM {s} WHERE RX(name, '^use[A-Z].*Store$') OR RX(name, 'Store$')",
    "au08_blank_descriptions": "SELECT symbol_type, count(*) FILTER (WHERE description IS NULL) AS missing, count(*) FILTER (WHERE trim(description) = '') AS blank FROM {s} GROUP BY symbol_type",
    "au09_errors_by_repository": "SELECT repo_id, count(*) AS errors, count(DISTINCT file_path) AS files FROM {b} GROUP BY repo_id",
    "au10_scene_nodes": "SELECT p.id AS scene_id, count(*) AS nodes FROM {s} p JOIN {s} c ON c.parent_symbol_id = p.id WHERE p.symbol_type = 'godot_scene' AND c.symbol_type = 'godot_node' GROUP BY p.id",
    "au11_signal_edges": "SELECT a.name AS source, b.name AS target, count(*) AS edges FROM {d} d JOIN {s} a ON a.id = d.from_symbol_id JOIN {s} b ON b.id = d.to_symbol_id WHERE d.dependency_type = 'signal_connection' GROUP BY a.name, b.name",
    "au12_rollup_cube": "SELECT f.repo_id, s.symbol_type, count(*) AS n FROM {s} s JOIN {f} f ON f.id = s.file_id GROUP BY CUBE (f.repo_id, s.symbol_type)",
}

QUERIES = {
    "sc08_symbols_by_repository": bound(R.symbols_of_repository, repo_id=7),
    "sc09_keyset_batch": bound(R.described_after, after=1500, size=100),
    "sc11_upsert_keep_latest": bound(R.upserted, "repo_id", "path", "language", "is_test"),
    "sc12_insert_skip_rate": lambda spark, folder: R.skip_rate(R.Graph(spark, folder).table("api_calls")),
    "sc13_cascade_delete": bound(R.without_repository, repo_id=3),
    "sc14_set_null_on_delete": bound(R.unlinked_from_repository, repo_id=3),
    "sc15_graph_export_edges": bound(R.exported_edges),
    "sc15_graph_export_nodes": bound(R.exported_nodes),
    "sc18_repository_listing": bound(R.repositories_with_files),
    "pr01_point_lookup": bound(R.symbol_by_id, symbol_id=1234),
    "pr02_batch_lookup": bound(R.callers_of_most_called),
    "pr03_fuzzy_path": bound(R.file_by_path, exact="src/index.ts", suffix="%/Order%Manager.php", part="%Manager.%"),
    "pr04_nested_rows": bound(R.nested_json, "inherits", "implements"),
    "pr05_escaped_substring": bound(R.names_with, text="_order"),
    "pr08_symbols_by_type": bound(R.symbols_of_type, "interface"),
    "pr08_files_by_language": bound(R.files_of_language, language="vue"),
    "pr13_edge_type_lists": bound(R.edges_of_types, include=["inherits", "implements"], exclude=["contains"]),
    "pr14_regex_predicate": bound(R.names_like, "^(resolve|merge)[A-Z]"),
    "pr15_line_containment": bound(R.containment, inner=["method"], outer=["class"]),
    "pr16_modified_since": bound(R.modified_since_indexed),
    "pr17_array_predicates": bound(R.stacks_of_at_least, n=2),
    "pr19_symbol_with_framework": bound(R.with_framework_symbol, symbol_type="function"),
    "jn01_symbols_files": bound(R.symbols_with_files),
    "jn02_edge_with_both_ends": bound(R.edges_with_ends),
    "jn03_callers_distinct": bound(R.distinct_callers),
    "jn05_calls_with_endpoint": bound(R.calls_with_endpoint),
    "jn06_constant_in_on": bound(R.calls_per_symbol),
    "jn07_never_called": bound(R.never_called, "function", "method"),
    "jn08_not_exists": bound(R.unknown_targets),
    "jn09_nested_in": bound(R.symbols_of_primary_language, language="php"),
    "jn10_not_in_paths": bound(R.files_without_text),
    "jn11_two_hop_degree": bound(R.two_hop_degree),
    "jn12_container_path": bound(R.container_paths),
    "jn13_service_calls": bound(R.service_calls),
    "jn14_interface_pairs": bound(R.interface_pairs),
    "jn16_innermost_class": bound(R.innermost_class),
    "jn19_lateral_aggregate": bound(R.symbols_per_file),
    "jn20_scalar_subquery": bound(R.share_of_languages),
    "jn21_lateral_rows": bound(R.latest_edges_of, n=3),
    "jn22_first_source_wins": bound(R.entity_lookup),
    "ag01_counts": lambda spark, folder: (lambda g: R.totals(g, repositories=g.r("name"), files=g.f("path"), symbols=g.s("name"), dependencies=g.d("line_number")))(R.Graph(spark, folder)),
    "ag02_count_distinct": bound(R.ends_per_type),
    "ag03_distinct_tuples": bound(R.distinct_tuples, "from_symbol_id", "to_symbol_id", "dependency_type", "line_number"),
    "ag04_filtered_counts": bound(R.file_flags_per_repository),
    "ag05_having": bound(R.frequent_names, more_than=3),
    "ag06_group_by_case": bound(R.files_by_ending, endings={".vue": "vue", ".ts": "typescript", ".php": "php", ".cs": "csharp"}),
    "ag07_min_id_per_key": bound(R.first_id_per_pair),
    "ag08_percentages": bound(R.described_share),
    "ag09_roll_ups": bound(R.line_statistics),
    "ag10_string_agg": bound(R.languages_per_repository),
    "ag11_parameter_groups": bound(R.parameter_groups),
    "ag12_parameter_insights": bound(R.parameter_insights),
    "ag13_health": bound(R.call_health),
    "ag14_frameworks_per_repository": bound(R.frameworks_per_repository),
    "ag15_pivot": bound(R.methods_per_repository),
    "ag17_first_wins": bound(R.first_edge_per_pair),
    "ag18_most_complete": bound(R.most_complete),
    "ag19_specific_then_short": bound(R.specific_then_short),
    "ag21_primary_language": bound(R.primary_language),
    "wn01_keep_latest": bound(R.keep_latest),
    "wn02_sample_per_group": bound(R.samples_per_type, n=5),
    "wn03_count_over": bound(R.siblings),
    "wn04_share_of_category": bound(R.share_within_type),
    "so01_order_limit": bound(R.longest_symbols, limit=25),
    "so02_ranked_choice": bound(R.first_by_rank, "function", "method", "class"),
    "so03_cursor_page": bound(R.page_after, after=2000, size=50),
    "so04_offset_page": bound(R.page_at, offset=80, size=40),
    "so05_page_with_total": bound(R.page_with_total, size=20),
    "so06_callers_page": bound(R.callers_page, after=1000, size=50),
    "so10_samples_with_totals": bound(R.samples_with_totals, n=50),
    "st01_labelled_metrics": bound(R.labelled_metrics),
    "st04_heterogeneous_edges": bound(R.all_edges),
    "st05_linked_ids": bound(R.linked_ids),
    "st06_new_relationships": bound(R.new_relationships),
    "st08_intersect_except": bound(R.parents_with_edges),
    "gt16_test_impact": bound(R.tests_touched),
    "gt16_impact_sets": lambda spark, folder: (lambda g: R.impact_sets(g, R.callers_of_most_called(g)))(R.Graph(spark, folder)),
    "ga01_implementations": bound(R.implementations),
    "ga01_relatives": lambda spark, folder: (lambda g: R.relatives(g, *(R.most_called(g).first() or [-1])))(R.Graph(spark, folder)),
    "ga04_direct_recursion": bound(R.self_calls),
    "ga06_unused_functions": bound(R.unused_functions),
    "ga07_complexity": bound(R.complexity),
    "ga08_file_importers": bound(R.file_importers),
    "ga12_file_edges": bound(R.file_edges),
    "xs13_feature_clusters": bound(R.feature_clusters),
    "xs15_multi_framework": bound(R.with_all_frameworks, "vue", "laravel"),
    "in01_change_detection": bound(R.change_states),
    "in03_deleted_files": bound(R.deleted_files),
    "in04_orphan_files": bound(R.orphan_texts),
    "rs12_resolve_by_name": bound(R.resolved_by_name),
    "rs13_orphan_edges": bound(R.orphan_edges),
    "rs19_edges_with_both_ends": bound(R.storable_edges),
    "se07_qualified_context": bound(R.contexts_with, text="manager"),
    "se08_method_signatures": bound(R.signatures_with, text="(userId"),
    "se09_namespace_context": bound(R.namespaces_with, text="store"),
    "se14_route_substring": bound(lambda g: R.routes(g, text="invoice").select("endpoint_path", "method")),
    "au01_unresolved_by_type": bound(R.unresolved_by_type),
    "au02_name_collisions": bound(R.name_collisions),
    "au03_files_without_symbols": bound(R.files_without_symbols),
    "au04_lines_out_of_order": bound(R.lines_out_of_order),
    "au05_cross_language_edges": bound(R.edges_across_languages),
    "au06_edges_per_month": bound(R.edges_per_month),
    "au07_store_naming": bound(R.names_like, "^use[A-Z].*Store$", "Store$"),
    "au08_blank_descriptions": bound(R.description_gaps),
    "au09_errors_by_repository": bound(R.errors_per_repository),
    "au10_scene_nodes": bound(R.nodes_per_scene),
    "au11_signal_edges": bound(R.signals_by_name),
    "au12_rollup_cube": bound(R.cube_of_types),
}
ORACLES = twins(TWINS)
