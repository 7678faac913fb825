"""Queries on flows, discovery, search, edge building, files as a graph and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import exprs as X
from symloom.operators import discovery, flow, graph, resolve, search
from symloom.operators import relations as R
from symloom.plans.graph_queries import _EDGES, _SEED, FULLTEXT, _calls, _ends, _seed
from symloom.session import cut
from symloom.sources import code, writing
from symloom.sources.graph import Graph, view, view_sql
from symloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_A = ("caller_symbol_id", "endpoint_symbol_id", "http_method", "endpoint_path", "line_number")


def _stack(spark: SparkSession, folder: str) -> DataFrame:
    d = view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "dependency_type", "line_number", "parameter_context", "qualified_context")
    return cut(flow.stack_edges(d, view(spark, folder, "a", *_A)))


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return Graph(spark, folder).placed("", ("name", "symbol_type", "qualified_name")).withColumnRenamed("f_path", "path")


def _first_seed(spark: SparkSession, folder: str) -> int | None:
    return _calls(spark, folder)[1].first()[0]


def _busiest_endpoint(edges: DataFrame) -> int | None:
    row = edges.where("kind = 'api_call' and method is not null").groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return row[0] if row else None


_STACK = f"""{view_sql("d", "from_symbol_id", "to_symbol_id", "dependency_type", "line_number", "parameter_context", "qualified_context")}, {view_sql("a", *_A)}, {view_sql("s", "name", "symbol_type", "file_id", "qualified_name")}, {view_sql("f", "path")},
calls AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM d WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL AND from_symbol_id <> to_symbol_id AND dependency_type = 'calls')"""
_QUALIFIED = "CASE WHEN {n} IS NULL THEN 'unknown' WHEN {p} IS NULL THEN {n} ELSE regexp_replace(string_split({p}, '/')[-1], '\\.(cs|js|ts|php|vue)$', '') || '.' || {n} END"


@query(f"""WITH RECURSIVE {_STACK}, {_SEED.replace(" e ", " calls ").replace("FROM e)", "FROM calls)")},
w AS (SELECT seed AS node, 0 AS depth FROM seed UNION SELECT c.src, w.depth + 1 FROM w JOIN calls c ON c.dst = w.node WHERE w.depth < 3), far AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
direct AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst, dependency_type AS kind, line_number AS line, 1 AS depth FROM d WHERE to_symbol_id = (SELECT seed FROM seed) AND from_symbol_id IS NOT NULL),
steps AS (SELECT d.from_symbol_id AS src, d.to_symbol_id AS dst, d.dependency_type AS kind, d.line_number AS line, a.depth FROM d JOIN far a ON a.node = d.from_symbol_id AND a.depth > 1 JOIN far b ON b.node = d.to_symbol_id AND b.depth BETWEEN 1 AND 2 WHERE d.dependency_type = 'calls'),
one AS (SELECT src, dst, kind, line, depth FROM steps QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst, kind, line NULLS FIRST) = 1), every AS (SELECT * FROM direct UNION ALL SELECT * FROM one)
SELECT e.src AS caller_id, e.depth, {_QUALIFIED.format(n="s.name", p="f.path")} AS caller, coalesce(t.qualified_name, {_QUALIFIED.format(n="t.name", p="g.path")}) AS callee, e.kind, e.line
FROM every e LEFT JOIN s ON s.id = e.src LEFT JOIN f ON f.id = s.file_id LEFT JOIN s t ON t.id = e.dst LEFT JOIN f g ON g.id = t.file_id""")
def gt13_callers_in_full(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and transitive callers of the seed in the shape of a response."""
    seed = _first_seed(spark, folder)
    found = flow.who_calls(-1 if seed is None else seed, _stack(spark, folder), _named(spark, folder), depth=3)
    return found.select("caller_id", "depth", "caller", "callee", "kind", "line")


@query(f"""WITH RECURSIVE {_STACK}, hot AS (SELECT endpoint_symbol_id AS id FROM a WHERE endpoint_symbol_id IS NOT NULL AND caller_symbol_id IS NOT NULL AND http_method IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT DISTINCT from_symbol_id AS caller_id, dependency_type AS kind, line_number AS line, false AS is_cross_stack FROM d WHERE to_symbol_id = (SELECT id FROM hot) AND from_symbol_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.endpoint_symbol_id = d.to_symbol_id AND a.caller_symbol_id = d.from_symbol_id AND d.dependency_type = 'api_call' AND a.line_number IS NOT DISTINCT FROM d.line_number AND a.http_method IS NOT NULL)
UNION ALL SELECT DISTINCT caller_symbol_id, 'api_call', line_number, true FROM a WHERE endpoint_symbol_id = (SELECT id FROM hot) AND caller_symbol_id IS NOT NULL AND http_method IS NOT NULL""")
def gt13_cross_stack_callers(spark: SparkSession, folder: str) -> DataFrame:
    """Callers of the busiest endpoint on both sides of the stack."""
    # calls without a method tell of no side
    known = cut(_stack(spark, folder).where("not (kind = 'api_call' and method is null and endpoint is not null)"))
    goal = _busiest_endpoint(known)
    return flow.who_calls(-1 if goal is None else goal, known, _named(spark, folder), cross_stack=True).select("caller_id", "kind", "line", "is_cross_stack")


@query(f"""WITH RECURSIVE {_STACK}, hot AS (SELECT to_symbol_id AS id FROM d WHERE parameter_context IS NOT NULL AND from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT parameter_context) DESC, 1 LIMIT 1)
SELECT parameter_context, count(*) AS calls, coalesce(string_agg(DISTINCT CAST(line_number AS VARCHAR), ','), '') = '' AS no_lines, contains(parameter_context, 'null') AS has_null FROM d WHERE to_symbol_id = (SELECT id FROM hot) AND from_symbol_id IS NOT NULL AND parameter_context IS NOT NULL GROUP BY parameter_context""")
def gt13_parameter_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """How the symbol with most kinds of parameters is called."""
    edges = _stack(spark, folder)
    row = edges.where("parameter_context is not null").groupBy("dst").agg(F.count_distinct("parameter_context").alias("n")).orderBy(F.desc("n"), "dst").first()
    found = flow.parameter_analysis(row[0] if row else -1, edges)
    return found.select("parameter_context", "calls", (F.col("lines") == "").alias("no_lines"), "has_null")


@query(f"""WITH RECURSIVE {_STACK}, e AS (SELECT DISTINCT src, dst FROM (SELECT from_symbol_id AS src, to_symbol_id AS dst FROM d WHERE dependency_type = 'calls' UNION SELECT caller_symbol_id, endpoint_symbol_id FROM a) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
hot AS (SELECT endpoint_symbol_id AS seed FROM a WHERE endpoint_symbol_id IS NOT NULL AND caller_symbol_id IS NOT NULL AND http_method IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
w AS (SELECT seed AS node, 0 AS depth FROM hot UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 4)
SELECT node, min(depth) AS depth FROM w WHERE node <> (SELECT seed FROM hot) GROUP BY node""")
def gt05_callers_across_the_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Callers of the busiest endpoint up to four steps away, over calls and API calls."""
    edges = _stack(spark, folder)
    links = edges.where("(kind = 'calls' or method is not null or endpoint is not null) and src <> dst").select("src", "dst").distinct()
    goal = _busiest_endpoint(edges)
    return graph.reach(links, spark.createDataFrame([(goal,)], "seed long"), 4, reverse=True).select("node", "depth")


_FLOW = f"""e AS (SELECT DISTINCT src, dst FROM (SELECT from_symbol_id AS src, to_symbol_id AS dst, dependency_type AS kind FROM d UNION SELECT caller_symbol_id, endpoint_symbol_id, 'api_call' FROM a) WHERE kind IN {flow.FLOW_TYPES} AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"""


@query(f"""WITH RECURSIVE {_STACK}, {_FLOW}, start AS (SELECT min(dst) AS id FROM (SELECT dst FROM calls GROUP BY dst HAVING count(*) BETWEEN 3 AND 8) WHERE dst IN (SELECT src FROM calls)),
goal AS (SELECT max(dst) AS id FROM (SELECT b.dst FROM calls a JOIN calls b ON b.src = a.dst WHERE a.src = (SELECT id FROM start) AND b.dst <> (SELECT id FROM start) UNION SELECT dst FROM calls WHERE src = (SELECT id FROM start))),
w AS (SELECT id AS node, [id] AS path FROM start UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE len(w.path) < 5 AND NOT list_contains(w.path, e.dst) AND w.node <> (SELECT id FROM goal))
SELECT list_aggregate(path, 'string_agg', '>') AS path, len(path) - 1 AS distance FROM w WHERE node = (SELECT id FROM goal)""")
def gt15_all_flows(spark: SparkSession, folder: str) -> DataFrame:
    """All flows of at most four steps from the seed to a symbol two calls away."""
    links, seed = _calls(spark, folder)
    start = seed.first()[0]
    if start is None:
        return spark.createDataFrame([], "path string, distance int")
    near = links.where(F.col("src") == start).select("dst")
    far = near.join(links.toDF("a", "b"), F.col("dst") == F.col("a")).select(F.col("b").alias("dst")).where(F.col("dst") != start)
    goal = near.unionByName(far).agg(F.max("dst")).first()[0]
    found = flow.trace_flow(start, goal, _stack(spark, folder), all_paths=True, depth=4)
    steps = F.array_sort(F.collect_list(F.struct("position", "node")))
    joined = found.groupBy("path").agg(F.transform(steps, lambda x: x["node"].cast("string")).alias("nodes"))
    return joined.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("distance"))


@query()
def gt15_trace_flow(spark: SparkSession, folder: str) -> DataFrame:
    """The shortest flow between two symbols, with names and files."""
    edges = _stack(spark, folder)
    start, goal = _ends(edges.where("kind = 'calls'"))
    if start is None:
        return spark.createDataFrame([], "position int, node long, name string, path string")
    found = flow.trace_flow(start, goal, edges).drop("path")
    return found.join(_named(spark, folder), F.col("node") == F.col("id"), "left").select("position", "node", "name", "path")


# search


_FIELDS = ("name", "signature", "description", "qualified_name")


@query(f"WITH {view_sql('s', *_FIELDS)}, {FULLTEXT} SELECT id, name, 'fulltext' AS way FROM ft ORDER BY rank DESC, name, id LIMIT 30")
def se01_default_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(view(spark, folder, "s", *_FIELDS), "merge order")


@query(f"""WITH {view_sql("s", *_FIELDS)} SELECT id, name, 'qualified' AS way FROM s WHERE contains(lower(coalesce(qualified_name, '')), 'order') ORDER BY name, id LIMIT 30""")
def se11_mode_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    return search.dispatch(view(spark, folder, "s", *_FIELDS), "qualified", "Order")


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), k AS (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id BETWEEN 5 AND 60)
SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 6) AS similarity FROM embeddings e, q WHERE e.vec_id IN (SELECT vec_id FROM k)""")
def se05_similarity_of_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of a set of ids to one vector."""
    vectors = table(spark, folder, "embeddings")
    row = vectors.where("vec_id = 0").select("embedding").first()
    return search.of_ids(vectors, list(row[0]) if row else [], vectors.where("vec_id between 5 and 60").select(F.col("vec_id").alias("id")))


@query(f"""WITH {view_sql("s", "name")}, h AS (SELECT id, name FROM s WHERE contains(lower(name), 'ledger')) SELECT id, name, (SELECT count(*) FROM h) AS total FROM h ORDER BY name, id LIMIT 20 OFFSET 20""")
def se10_search_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of twenty names that hold a word, with the number of all."""
    found = R.names_with(Graph(spark, folder), "ledger")
    return search.page(found, F.asc("name"), F.asc("id"), size=20, after=20)


@query(f"""WITH {view_sql("s", "name", "symbol_type")} SELECT id, name FROM s WHERE symbol_type IN {search.TYPES_OF_ENTITY["store"]} AND contains(lower(name), 'order')""")
def se12_entity_types(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of the types that a search for stores looks at."""
    s = view(spark, folder, "s", "name", "symbol_type").where(F.col("symbol_type").isin(*search.TYPES_OF_ENTITY["store"]))
    return s.where(R.has("name", "order")).select("id", "name")


# files as a graph


_FILES = f"""{view_sql("d", "from_symbol_id", "to_symbol_id", "dependency_type")}, {view_sql("s", "file_id")},
fe AS (SELECT DISTINCT a.file_id AS src, b.file_id AS dst FROM d JOIN s a ON a.id = d.from_symbol_id JOIN s b ON b.id = d.to_symbol_id WHERE a.file_id <> b.file_id AND d.dependency_type IN ('inherits', 'implements'))"""


@query(f"""WITH RECURSIVE {_FILES}, seed AS (SELECT min(src) AS id FROM fe), w AS (SELECT id AS node, 0 AS depth FROM seed UNION SELECT fe.dst, w.depth + 1 FROM w JOIN fe ON fe.src = w.node WHERE w.depth < 20)
SELECT max(depth) AS depth, count(*) AS files FROM (SELECT node, min(depth) AS depth FROM w GROUP BY node) WHERE node <> (SELECT id FROM seed) HAVING count(*) > 0""")
def ga09_file_depth(spark: SparkSession, folder: str) -> DataFrame:
    """How deep the files go that the first file depends on by inheritance, and how many they are."""
    g = Graph(spark, folder)
    links = cut(R.file_edges(g).where(F.col("dependency_type").isin("inherits", "implements")).select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")).distinct())
    found = graph.reach(links, links.agg(F.min("src").alias("seed")), 20)
    return found.agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("files")).where("files > 0")


@query()
def ga11_file_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between files by their imports: a file of the repository, or a package outside it."""
    from symloom.plans.shape_queries import ga10_import_targets

    inside = ga10_import_targets(spark, folder).where("target_id is not null").select(F.col("file_id").alias("from_file"), F.col("target_id").alias("to_id"), F.lit("file").alias("kind"))
    imports = code.parsed_imports(table(spark, folder, "source_texts"))
    packages = resolve.virtual_symbols(imports).select(F.col("id").alias("v_id"), F.col("name").alias("v_name"))
    package = F.regexp_extract("source", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    outside = imports.join(packages, package == F.col("v_name")).select(F.col("file_id").alias("from_file"), F.col("v_id").alias("to_id"), F.lit("package").alias("kind"))
    return inside.unionByName(outside).distinct()


# edges out of names


_RS_D = ("from_symbol_id", "to_symbol_id", "to_symbol", "dependency_type", "line_number", "calling_object", "resolved_class", "qualified_context")
_RS_S = ("name", "symbol_type", "file_id", "start_line", "parent_symbol_id")
_GROUP = "CASE WHEN {p} LIKE '%.php' THEN 'php' WHEN regexp_matches({p}, '\\.(tsx?|jsx?|vue)$') THEN 'script' WHEN {p} LIKE '%.cs' THEN 'csharp' WHEN {p} LIKE '%.py' THEN 'python' ELSE 'unknown' END"


@query(f"""WITH {view_sql("d", *_RS_D)}, {view_sql("s", *_RS_S)}, {view_sql("f", "path")},
n AS (SELECT s.*, {_GROUP.format(p="coalesce(f.path, '')")} AS g FROM s LEFT JOIN f ON f.id = s.file_id),
ask AS (SELECT d.*, regexp_replace(d.to_symbol, '<.*$', '') AS asked, o.g, o.file_id FROM d JOIN n o ON o.id = d.from_symbol_id WHERE d.to_symbol IS NOT NULL AND (d.calling_object IS NULL OR d.resolved_class IS NOT NULL)),
q AS (SELECT *, CASE WHEN contains(asked, '.') THEN regexp_extract(asked, '^(.*)\\.[^.]*$', 1) END AS qualifier, regexp_extract(asked, '[^.]*$') AS member, lower(CASE WHEN starts_with(coalesce(resolved_class, qualified_context), 'field_call_') THEN regexp_replace(substr(coalesce(resolved_class, qualified_context), 12), '^_', '') ELSE string_split(coalesce(resolved_class, qualified_context), '.')[1] END) AS wanted,
  NOT (contains(asked, '.') AND (string_split(asked, '.')[1] IN {resolve.EXTERNAL} OR list_has_any(string_split(asked, '.'), {list(resolve.EXTERNAL_PARTS)}) OR (asked[1] <> '.' AND (asked[1] = lower(asked[1]) OR asked[1] = '_')))) AS open_ FROM ask),
mem AS (SELECT DISTINCT c.name AS qn, m.id, m.name, m.g, c.id AS cid FROM n c JOIN n m ON m.file_id = c.file_id AND m.start_line >= c.start_line AND m.id <> c.id WHERE c.symbol_type IN ('class', 'interface') AND c.name IS NOT NULL AND m.name IS NOT NULL
  UNION SELECT e.name, m.id, m.name, m.g, e.id FROM n e JOIN n m ON m.parent_symbol_id = e.id WHERE e.symbol_type = 'enum' AND m.symbol_type IN ('constant', 'property') AND m.name IS NOT NULL),
cand AS (SELECT q.id, 1 AS tier, m.id AS t FROM q JOIN mem m ON m.qn = q.qualifier AND m.name = q.member AND m.g = q.g
  UNION SELECT q.id, 2, m.id FROM q JOIN n i ON i.name = q.qualifier JOIN d h ON h.to_symbol_id = i.id AND h.dependency_type IN ('implements', 'inherits') JOIN mem m ON m.cid = h.from_symbol_id AND m.name = q.member AND m.g = q.g JOIN n c ON c.id = m.cid AND c.symbol_type IN ('class', 'interface')
  UNION SELECT q.id, 3, m.id FROM q JOIN n m ON m.name = q.member AND m.g = q.g WHERE q.open_),
top AS (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM cand) WHERE tier = best),
calls AS (SELECT q.id, q.from_symbol_id, q.line_number, any_value(top.k) AS k, min(top.t) AS first, min(top.tier) AS tier, (SELECT min(m.id) FROM n m JOIN n p ON p.id = m.parent_symbol_id WHERE m.name = q.member AND m.g = q.g AND lower(p.name) = q.wanted) AS ctx, any_value(coalesce(q.resolved_class, q.qualified_context)) AS context
  FROM q JOIN top ON top.id = q.id WHERE q.dependency_type = 'calls' GROUP BY q.id, q.from_symbol_id, q.line_number, q.member, q.g, q.wanted),
every AS (SELECT id, from_symbol_id AS from_id, CASE WHEN k = 1 THEN first WHEN ctx IS NOT NULL THEN ctx WHEN context IS NOT NULL THEN first END AS to_id, 'calls' AS kind, line_number FROM calls
  UNION ALL SELECT q.id, q.from_symbol_id, top.t, q.dependency_type, q.line_number FROM q JOIN top ON top.id = q.id JOIN n x ON x.id = top.t WHERE q.dependency_type <> 'calls' AND q.from_symbol_id <> top.t AND (q.dependency_type <> 'contains' OR x.file_id = q.file_id))
SELECT DISTINCT from_id, to_id, kind, line_number FROM every WHERE to_id IS NOT NULL""")
def rs01_built_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from the names of dependencies to symbols."""
    built = resolve.build_edges(view(spark, folder, "d", *_RS_D), view(spark, folder, "s", *_RS_S), view(spark, folder, "f", "path"))
    return built.select("from_id", "to_id", "kind", "line_number")


@query()
def rs04_resolution_strategies(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges each strategy gave."""
    return resolve.edge_counts(view(spark, folder, "d", *_RS_D), view(spark, folder, "s", *_RS_S), view(spark, folder, "f", "path"))


@query()
def rs07_virtual_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.virtual_symbols(code.parsed_imports(table(spark, folder, "source_texts")))


@query()
def rs08_autoloaded(spark: SparkSession, folder: str) -> DataFrame:
    """PHP names that dependencies mention, as files by the usual mapping of App."""
    names = view(spark, folder, "s", "qualified_name").select(F.col("qualified_name").alias("name")).where(F.contains("name", F.lit("\\")))
    rules = spark.createDataFrame([("App\\", "app/"), ("App\\Http\\", "app/Http/"), ("Tests\\", "tests/")], "prefix string, folder string")
    return resolve.autoloaded(names, rules)


@query()
def rs11_linked_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes declared in source texts with the method that handles them."""
    routes = code.parsed_routes(table(spark, folder, "source_texts"))
    return resolve.route_handlers(routes, view(spark, folder, "s", "name", "symbol_type", "parent_symbol_id"))


@query(f"""WITH {view_sql("a", *_A)}, {view_sql("s", "name", "file_id", "framework")}, {view_sql("f", "repo_id")}
SELECT f.repo_id, s.framework, upper(a.http_method) AS method, count(*) AS routes, count(DISTINCT s.id) AS handlers FROM a JOIN s ON s.id = a.endpoint_symbol_id LEFT JOIN f ON f.id = s.file_id GROUP BY ALL""")
def rs16_routes_of_frameworks(spark: SparkSession, folder: str) -> DataFrame:
    """Routes and their handlers by repository, framework and method."""
    s = Graph(spark, folder).placed("s_", ("framework",), ("repo_id",))
    joined = view(spark, folder, "a", *_A).join(s, F.col("endpoint_symbol_id") == F.col("s_id"))
    return joined.groupBy(F.col("s_f_repo_id").alias("repo_id"), F.col("s_framework").alias("framework"), F.upper("http_method").alias("method")).agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("s_id").alias("handlers"))


# discovery


def _discovery(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    symbols = view(spark, folder, "s", "symbol_type", "entity_type", "file_id", "parent_symbol_id", "name")
    edges = view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "dependency_type").select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), F.col("dependency_type").alias("kind"))
    calls = view(spark, folder, "a", "caller_symbol_id", "endpoint_symbol_id").select(F.col("caller_symbol_id").alias("src"), F.col("endpoint_symbol_id").alias("dst"))
    return cut(symbols), cut(edges.where("src is not null and dst is not null").distinct()), calls


def _entry(edges: DataFrame) -> DataFrame:
    links = edges.where("kind = 'calls' and src <> dst").select("src", "dst").distinct()
    return cut(_seed(links))


@query()
def fd06_discover(spark: SparkSession, folder: str) -> DataFrame:
    """The dependency traversal from the seed, by role and direction."""
    symbols, edges, _ = _discovery(spark, folder)
    return discovery.traverse(symbols, edges, _entry(edges))


@query()
def fd01_feature(spark: SparkSession, folder: str) -> DataFrame:
    """All strategies from the seed, round by round."""
    symbols, edges, calls = _discovery(spark, folder)
    return discovery.discover(symbols, edges, calls, _entry(edges))


@query()
def fd18_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The feature of the seed by category."""
    symbols, edges, calls = _discovery(spark, folder)
    return discovery.manifest(discovery.discover(symbols, edges, calls, _entry(edges)), symbols)


def _one_strategy(spark: SparkSession, folder: str, make, entity: str, kind: str = "entity_type") -> DataFrame:
    """What one strategy finds in its first round from all symbols of an entity type."""
    symbols, edges, calls = _discovery(spark, folder)
    known = symbols.where(F.col(kind) == entity).select(F.col("id").alias("node"))
    found = make(symbols, edges, calls)(known, 0)
    return found.groupBy("node").agg(F.round(F.max("relevance"), 6).alias("relevance"))


_FD = f"""WITH {view_sql("d", "from_symbol_id", "to_symbol_id", "dependency_type")}, {view_sql("s", "symbol_type", "entity_type")}, {view_sql("a", "caller_symbol_id", "endpoint_symbol_id")},
e AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst, dependency_type AS kind FROM d WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL), t AS (SELECT id, entity_type AS en FROM s)"""


@query(f"""{_FD}, k AS (SELECT id FROM t WHERE en = 'controller'), back AS (SELECT DISTINCT caller_symbol_id AS id FROM a WHERE endpoint_symbol_id IN (SELECT id FROM k) AND caller_symbol_id IS NOT NULL),
users AS (SELECT DISTINCT src AS id FROM e WHERE kind = 'calls' AND dst IN (SELECT id FROM back)),
every AS (SELECT endpoint_symbol_id AS node FROM a WHERE caller_symbol_id IN (SELECT id FROM k) AND endpoint_symbol_id IS NOT NULL UNION SELECT id FROM back UNION SELECT id FROM users
  UNION SELECT src FROM e JOIN t ON t.id = src WHERE dst IN (SELECT id FROM back) AND ((kind = 'contains' AND en IN ('store', 'component', 'composable')) OR (kind = 'calls' AND en = 'component'))
  UNION SELECT src FROM e JOIN t ON t.id = src WHERE dst IN (SELECT id FROM users) AND ((kind = 'contains' AND en IN ('component', 'composable')) OR (kind = 'calls' AND en = 'component')))
SELECT node, CAST(0.9 AS DOUBLE) AS relevance FROM every""")
def fd10_cross_stack(spark: SparkSession, folder: str) -> DataFrame:
    return _one_strategy(spark, folder, discovery.cross_stack, "controller")


_STORES = """held AS (SELECT DISTINCT e.src AS store, e.dst AS method FROM e JOIN t ON t.id = e.src AND t.en = 'store' WHERE e.kind = 'contains')"""
_STORED = "SELECT {c} AS id FROM {f} WHERE {c} IN (SELECT method FROM held) UNION SELECT h.store FROM {f} JOIN held h ON h.method = {c} UNION SELECT {c} FROM {f} JOIN t ON t.id = {c} AND t.en = 'store'"
_BACK = """ends AS (SELECT DISTINCT endpoint_symbol_id AS id FROM a WHERE caller_symbol_id IN (SELECT id FROM st) AND endpoint_symbol_id IS NOT NULL), beyond AS (SELECT DISTINCT dst AS id FROM e WHERE kind IN ('calls', 'references') AND src IN (SELECT id FROM ends))"""


@query(f"""{_FD}, {_STORES}, k AS (SELECT id FROM t WHERE en = 'component'), used AS (SELECT DISTINCT dst FROM e WHERE kind IN ('calls', 'imports', 'references') AND src IN (SELECT id FROM k)),
direct AS (SELECT dst AS id FROM used JOIN t ON t.id = dst AND en IN ('composable', 'component') UNION {_STORED.format(c="dst", f="used")}),
users AS (SELECT DISTINCT src AS id FROM e JOIN t ON t.id = src AND en = 'component' WHERE kind IN ('imports', 'references', 'calls') AND dst IN (SELECT id FROM k)), called AS (SELECT DISTINCT dst FROM e WHERE kind = 'calls' AND src IN (SELECT id FROM users)),
st AS ({_STORED.format(c="dst", f="called")}), {_BACK}
SELECT node, max(r) AS relevance FROM (SELECT id AS node, 0.95e0 AS r FROM direct UNION ALL SELECT id, 0.9e0 FROM users UNION ALL SELECT id, 0.9e0 FROM st UNION ALL SELECT id, 0.85e0 FROM ends UNION ALL SELECT id, 0.8e0 FROM beyond) GROUP BY node""")
def fd11_props(spark: SparkSession, folder: str) -> DataFrame:
    return _one_strategy(spark, folder, discovery.props, "component")


@query(f"""{_FD}, {_STORES}, k AS (SELECT id FROM t WHERE en = 'composable'), nested AS (SELECT id FROM k UNION SELECT dst FROM e WHERE kind = 'contains' AND src IN (SELECT id FROM k)), called AS (SELECT DISTINCT dst FROM e WHERE kind = 'calls' AND src IN (SELECT id FROM nested)),
st AS ({_STORED.format(c="dst", f="called")}), {_BACK},
parts AS (SELECT src AS id FROM e JOIN t ON t.id = src AND en = 'component' WHERE kind IN ('calls', 'imports', 'references') AND dst IN (SELECT id FROM k) UNION SELECT dst FROM e JOIN t ON t.id = dst AND en = 'component' WHERE kind IN ('references', 'imports') AND src IN (SELECT id FROM nested))
SELECT node, max(r) AS relevance FROM (SELECT id AS node, 0.95e0 AS r FROM parts UNION ALL SELECT id, 0.9e0 FROM st UNION ALL SELECT id, 0.85e0 FROM ends UNION ALL SELECT id, 0.8e0 FROM beyond) GROUP BY node""")
def fd12_composables(spark: SparkSession, folder: str) -> DataFrame:
    return _one_strategy(spark, folder, discovery.composables, "composable")


@query(f"""{_FD}, k AS (SELECT id FROM s WHERE symbol_type = 'method') SELECT DISTINCT node, CAST(0.75 AS DOUBLE) AS relevance FROM (SELECT dst AS node FROM e WHERE kind = 'signal_connection' AND src IN (SELECT id FROM k) UNION SELECT src FROM e WHERE kind = 'signal_connection' AND dst IN (SELECT id FROM k))""")
def fd13_signals(spark: SparkSession, folder: str) -> DataFrame:
    return _one_strategy(spark, folder, lambda s, e, c: discovery.signals(s, e, 3), "method", "symbol_type")


@query(f"""WITH {view_sql("s", "symbol_type", "entity_type")}, k AS (SELECT id, coalesce(entity_type, '') AS en, symbol_type AS st FROM s)
SELECT id, CASE WHEN st IN ('method', 'function') OR en = 'composable' THEN 'executor' WHEN en IN {discovery.ENTITIES} THEN CASE WHEN st = 'class' THEN 'container' ELSE 'entity' END WHEN st = 'class' THEN 'container' WHEN en = 'store' THEN 'entity' WHEN st = 'file' THEN 'container' ELSE 'data' END AS role,
CASE WHEN en IN ('controller', 'method') AND st = 'method' THEN 'forward' WHEN en = 'model' OR (en = 'service' AND st = 'class') THEN 'backward' WHEN en = 'component' AND st <> 'method' THEN 'forward'
  WHEN st IN ('method', 'function', 'class', 'file') OR en = 'composable' OR en = 'store' OR en IN {discovery.ENTITIES} THEN 'both' ELSE 'forward' END AS going FROM k""")
def fd03_directions(spark: SparkSession, folder: str) -> DataFrame:
    """Role of every symbol and the direction a traversal takes from it."""
    kind, entity = F.col("symbol_type"), F.col("entity_type")
    return view(spark, folder, "s", "symbol_type", "entity_type").select("id", discovery.role(kind, entity).alias("role"), discovery.direction(kind, entity, F.lit(None).cast("string")).alias("going"))


@query(f"""{_FD}, r AS (SELECT id, symbol_type AS st, coalesce(entity_type, '') AS en, CASE WHEN symbol_type IN ('method', 'function') OR coalesce(entity_type, '') = 'composable' THEN 'executor' WHEN coalesce(entity_type, '') IN {discovery.ENTITIES} THEN CASE WHEN symbol_type = 'class' THEN 'container' ELSE 'entity' END
  WHEN symbol_type = 'class' THEN 'container' WHEN coalesce(entity_type, '') = 'store' THEN 'entity' WHEN symbol_type = 'file' THEN 'container' ELSE 'data' END AS role FROM s),
j AS (SELECT e.*, a.role AS ar, a.en AS ae, b.role AS br, b.en AS be, b.st AS bt FROM e JOIN r a ON a.id = src JOIN r b ON b.id = dst WHERE src <> dst),
f AS (SELECT src, dst, CASE WHEN (ar = 'executor' AND (kind IN ('calls', 'api_call', 'contains') OR (kind = 'references' AND be IN {discovery.ENTITIES}))) OR (ar = 'entity' AND (kind IN ('calls', 'api_call') OR (kind = 'references' AND be IN {discovery.REFERRED}))) OR (ar = 'container' AND kind = 'contains') THEN 'always'
  WHEN kind = 'references' AND be NOT IN {discovery.REFERRED} AND (ar = 'executor' OR (ar = 'entity' AND ae <> 'component')) THEN 'near' END AS how FROM j),
k AS (SELECT DISTINCT src, dst, 'forward' AS way, CASE how WHEN 'near' THEN 2 END AS most FROM f WHERE how IS NOT NULL
  UNION SELECT DISTINCT dst, src, 'backward', NULL FROM j WHERE kind IN ('calls', 'api_call', 'contains') OR (kind = 'references' AND (be IN ('composable', 'model') OR (br = 'executor' AND bt = 'function'))))
SELECT way, most, count(*) AS edges FROM k GROUP BY way, most""")
def fd04_role_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Number of edges a traversal may take, by way and depth."""
    symbols, edges, _ = _discovery(spark, folder)
    return discovery.role_edges(symbols, edges).groupBy("way", "most").agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH RECURSIVE {_EDGES}, {_SEED}, w AS (SELECT seed AS node, 0 AS depth FROM seed UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 4), m AS (SELECT node, min(depth) AS depth FROM w WHERE node <> (SELECT seed FROM seed) GROUP BY node)
SELECT node, depth FROM m ORDER BY depth, node LIMIT 12""")
def so11_pruned_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve nearest callers of the seed, as a bounded queue keeps them."""
    return R.pruned_queue(graph.reach(*_calls(spark, folder), 4, reverse=True).select("node", "depth"), 12)


# cross-stack reports


@query(f"""WITH {view_sql("a", "repo_id", "caller_symbol_id", "endpoint_symbol_id", "http_method", "endpoint_path")}
SELECT repo_id, count(*) AS calls, count(*) FILTER (WHERE endpoint_symbol_id IS NULL) AS unmatched, count(*) FILTER (WHERE caller_symbol_id IS NULL) AS without_caller, count(*) FILTER (WHERE http_method IS NULL) AS without_method, count(*) FILTER (WHERE endpoint_path IS NULL) AS without_path,
round(100.0 * count(*) FILTER (WHERE endpoint_symbol_id IS NULL) / count(*), 2) AS unmatched_pct FROM a GROUP BY repo_id""")
def xs08_match_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository how many calls lack what."""
    a = view(spark, folder, "a", "repo_id", "caller_symbol_id", "endpoint_symbol_id", "http_method", "endpoint_path")
    lacks = lambda c: F.count_if(F.col(c).isNull())
    return a.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("calls"), lacks("endpoint_symbol_id").alias("unmatched"), lacks("caller_symbol_id").alias("without_caller"), lacks("http_method").alias("without_method"), lacks("endpoint_path").alias("without_path"),
        R.share(lacks("endpoint_symbol_id"), F.count(F.lit(1))).alias("unmatched_pct"),
    )


@query(f"""WITH {view_sql("a", "repo_id", "endpoint_path")}, {view_sql("f", "repo_id", "path", "language")} SELECT f.id, f.path FROM f WHERE (lower(coalesce(f.language, '')) IN ('javascript', 'typescript', 'vue') OR regexp_matches(coalesce(f.path, ''), '\\.(js|jsx|ts|tsx|vue|mjs|cjs)$')) AND f.repo_id IN (SELECT repo_id FROM a)""")
def xs09_frontend_files(spark: SparkSession, folder: str) -> DataFrame:
    """Frontend files of repositories that make API calls."""
    f = view(spark, folder, "f", "repo_id", "path", "language")
    front = F.coalesce(F.lower("language").isin("javascript", "typescript", "vue"), F.lit(False)) | F.coalesce(F.col("path").rlike(r"\.(js|jsx|ts|tsx|vue|mjs|cjs)$"), F.lit(False))
    repos = view(spark, folder, "a", "repo_id", "endpoint_path").select(F.col("repo_id").alias("r")).distinct()
    return f.where(front).join(repos, F.col("repo_id") == F.col("r"), "left_semi").select("id", "path")


@query(f"""WITH {view_sql("a", "repo_id", "caller_symbol_id", "endpoint_symbol_id")}, {view_sql("s", "name", "file_id")}, {view_sql("f", "repo_id", "path")},
e AS (SELECT caller_symbol_id AS src, endpoint_symbol_id AS dst, count(*) AS calls FROM a WHERE caller_symbol_id IS NOT NULL AND endpoint_symbol_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT src AS id, 'frontend' AS side FROM e UNION SELECT dst, 'backend' FROM e)
SELECT 'node' AS row_kind, n.side AS label, n.id AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS calls FROM n JOIN s ON s.id = n.id UNION ALL SELECT 'edge', 'api_call', src, dst, calls FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")
def xs12_stack_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges of the graph between frontend and backend."""
    known = view(spark, folder, "s", "name").select(F.col("id").alias("k"))
    e = view(spark, folder, "a", "caller_symbol_id", "endpoint_symbol_id").where("caller_symbol_id is not null and endpoint_symbol_id is not null").groupBy(F.col("caller_symbol_id").alias("src"), F.col("endpoint_symbol_id").alias("dst")).agg(F.count(F.lit(1)).alias("calls"))
    none = F.lit(None).cast("long")
    ends = e.select(F.lit("frontend").alias("label"), F.col("src").alias("a")).unionByName(e.select(F.lit("backend").alias("label"), F.col("dst").alias("a"))).distinct()
    nodes = ends.join(known, F.col("a") == F.col("k"), "left_semi").select(F.lit("node").alias("row_kind"), "label", "a", none.alias("b"), none.alias("calls"))
    edges = e.join(known, F.col("src") == F.col("k"), "left_semi").join(known, F.col("dst") == F.col("k"), "left_semi")
    return nodes.unionByName(edges.select(F.lit("edge").alias("row_kind"), F.lit("api_call").alias("label"), F.col("src").alias("a"), F.col("dst").alias("b"), "calls"))


# writing


@query("""SELECT count(DISTINCT id) AS stored, count(*) - count(DISTINCT id) AS skipped FROM api_calls WHERE id IS NOT NULL""")
def sc10_inserted(spark: SparkSession, folder: str) -> DataFrame:
    """API calls written as a table, repeats of an id left out, read back and counted."""
    rows = table(spark, folder, "api_calls").where("id is not null")
    written = writing.insert_ignore(rows, "id")
    return rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(written.agg(F.count(F.lit(1)).alias("stored")))).select("stored", (F.col("n") - F.col("stored")).alias("skipped"))


@query("""SELECT doc_id, strlen(text) > 10240 AS packed, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL""")
def sc17_packed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Texts above 10 KB packed with gzip and unpacked again: the same bytes, and whether they were packed."""
    packed = writing.packed(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"), "text")
    return writing.unpacked(packed, "text").select("doc_id", F.col("is_packed").alias("packed"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"""WITH {view_sql("d", "to_symbol_id", "parameter_context")} SELECT to_symbol_id, count(DISTINCT parameter_context) AS patterns FROM d WHERE parameter_context IS NOT NULL AND to_symbol_id IS NOT NULL GROUP BY to_symbol_id HAVING count(DISTINCT parameter_context) > 2""")
def pr20_cached_reads(spark: SparkSession, folder: str) -> DataFrame:
    """A table of contexts kept for repeated reads: one read counts, one gives rows."""
    kept = cut(view(spark, folder, "d", "to_symbol_id", "parameter_context").where("parameter_context is not null and to_symbol_id is not null").groupBy("to_symbol_id").agg(F.count_distinct("parameter_context").alias("patterns")))
    return kept.where("patterns > 2")


@query("""SELECT file_id, language IS NOT NULL AND lower(trim(language)) = CASE regexp_extract(lower(path), '\\.([^./]+)$', 1) WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'vue' THEN 'vue' WHEN 'php' THEN 'php' WHEN 'cs' THEN 'csharp' ELSE 'unknown' END AS agrees FROM source_texts""")
def sc06_language_of_extension(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the language of a text is what its path's extension says."""
    t = table(spark, folder, "source_texts")
    return t.select("file_id", F.coalesce(F.lower(F.trim("language")) == X.language_of_path(F.col("path")), F.lit(False)).alias("agrees"))


@query("""WITH k AS (SELECT file_id, path, content, row_number() OVER (PARTITION BY repo_id ORDER BY path, file_id) AS n FROM source_texts) SELECT count(*) AS pieces, sum(strlen(content)) AS bytes FROM (SELECT DISTINCT content FROM k)""")
def ig05_merged_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Texts after exact repeats are merged: how many are left and their bytes."""
    once = table(spark, folder, "source_texts").groupBy(F.sha2("content", 256).alias("hash")).agg(F.min(F.octet_length("content")).alias("bytes"))
    return once.where("hash is not null").agg(F.count(F.lit(1)).alias("pieces"), F.sum("bytes").alias("bytes"))

