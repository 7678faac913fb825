"""Traversal, ranking, search, dead code, cross-stack, resolution, discovery and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions import exprs as X
from symloom.operators import crossstack, deadcode, graph, importance, resolve, search
from symloom.session import cut
from symloom.sources.graph import view, view_sql
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


def _edges(spark: SparkSession, folder: str, *types: str, reverse: bool = False) -> DataFrame:
    return graph.edges(view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "dependency_type"), *types, reverse=reverse)


_D = view_sql("d", "from_symbol_id", "to_symbol_id", "dependency_type")
_EDGES = f"""{_D},
e AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM d
      WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL AND from_symbol_id <> to_symbol_id AND dependency_type = 'calls')"""
#: The symbol that queries about one symbol start from: the smallest one that calls and is called by 3 to 8 others.
_SEED = "seed AS (SELECT min(dst) AS seed FROM (SELECT dst FROM e GROUP BY dst HAVING count(*) BETWEEN 3 AND 8) WHERE dst IN (SELECT src FROM e))"


def _seed(links: DataFrame) -> DataFrame:
    callers = links.select(F.col("src").alias("dst")).distinct()
    return links.groupBy("dst").count().where("count between 3 and 8").join(callers, "dst", "left_semi").agg(F.min("dst").alias("seed"))


def _seed_of(spark: SparkSession, folder: str) -> DataFrame:
    return _seed(_edges(spark, folder, "calls"))


def _calls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Call edges as a table, and the seed taken from it: one scan of the dependencies for a whole query."""
    links = cut(_edges(spark, folder, "calls"))
    return links, cut(_seed(links))


@query(f"""WITH RECURSIVE {_EDGES}, {_SEED},
w AS (SELECT seed, e.src AS node, 1 AS depth, [seed, e.src] AS path FROM seed JOIN e ON e.dst = seed
      UNION ALL SELECT w.seed, e.src, w.depth + 1, list_append(w.path, e.src) FROM w JOIN e ON e.dst = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, e.src))
SELECT node, depth, list_aggregate(path, 'string_agg', '>') AS path FROM w""")
def gt01_transitive_caller_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.paths(*_calls(spark, folder), 3, reverse=True)
    return found.select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES}, {_SEED},
w AS (SELECT seed, e.dst AS node, 1 AS depth, [seed, e.dst] AS path FROM seed JOIN e ON e.src = seed
      UNION ALL SELECT w.seed, e.dst, w.depth + 1, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE w.depth < 4 AND NOT list_contains(w.path, e.dst))
SELECT node, depth, list_aggregate(path, 'string_agg', '>') AS path FROM w""")
def gt02_transitive_dependency_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.paths(*_calls(spark, folder), 4)
    return found.select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH {_D}, k AS (SELECT id FROM (SELECT DISTINCT from_symbol_id AS id FROM d WHERE dependency_type = 'implements'))
SELECT d.id, d.from_symbol_id, d.to_symbol_id, d.dependency_type FROM d
WHERE (d.from_symbol_id IN (SELECT id FROM k) OR d.to_symbol_id IN (SELECT id FROM k)) AND d.dependency_type IN ('calls', 'contains')""")
def gt03_bulk_relationships(spark: SparkSession, folder: str) -> DataFrame:
    d = view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "dependency_type")
    ids = d.where("dependency_type = 'implements' and from_symbol_id is not null").select(F.col("from_symbol_id").alias("k")).distinct()
    wanted = d.where(F.col("dependency_type").isin("calls", "contains"))
    a = wanted.join(ids, F.col("from_symbol_id") == F.col("k"), "left_semi")
    b = wanted.join(ids, F.col("to_symbol_id") == F.col("k"), "left_semi")
    return a.unionByName(b).distinct().select("id", "from_symbol_id", "to_symbol_id", "dependency_type")


_REACH = f"""WITH RECURSIVE {_EDGES}, {_SEED},
w AS (SELECT seed AS node, 0 AS depth FROM seed UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 5)"""


@query(f"{_REACH} SELECT node, min(depth) AS depth FROM w WHERE node <> (SELECT seed FROM seed) GROUP BY node")
def gt07_transitive_callers(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reach(*_calls(spark, folder), 5, reverse=True).select("node", "depth")


@query(f"""{_REACH}, m AS (SELECT node, min(depth) AS depth FROM w WHERE node <> (SELECT seed FROM seed) GROUP BY node)
SELECT depth, count(*) AS nodes FROM m GROUP BY depth""")
def ga02_call_depth(spark: SparkSession, folder: str) -> DataFrame:
    return gt07_transitive_callers(spark, folder).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"{_REACH.replace('w.depth < 5', 'w.depth < 10')} SELECT node, min(depth) AS depth FROM w WHERE node <> (SELECT seed FROM seed) GROUP BY node")
def gt07_callers_default_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Transitive callers down to the default depth."""
    return graph.reach(*_calls(spark, folder), reverse=True).select("node", "depth")


@query(f"""WITH RECURSIVE {_EDGES}, {_SEED}, w(node, depth) USING KEY (node) AS (SELECT seed, 0 FROM seed UNION SELECT e.src, min(w.depth) + 1 FROM w JOIN e ON e.dst = w.node LEFT JOIN recurring.w AS r ON r.node = e.src WHERE r.node IS NULL GROUP BY e.src)
SELECT depth, count(*) AS nodes FROM w WHERE depth > 0 GROUP BY depth""")
def ga02_full_call_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Callers on every level until there is none left; ga02_call_depth stops where its SQL twin does."""
    found = graph.reach(*_calls(spark, folder), None, reverse=True)
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


def _ends(links: DataFrame) -> tuple[int | None, int | None]:
    """The symbols between which flows are traced: the smallest caller and the greatest callee."""
    return tuple(links.agg(F.min("src"), F.max("dst")).first())


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM d WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL AND from_symbol_id <> to_symbol_id)),
both_ways AS (SELECT src, dst FROM u UNION SELECT dst, src FROM u),
w AS (SELECT min(src) AS node, 0 AS depth FROM e UNION SELECT b.dst, w.depth + 1 FROM w JOIN both_ways b ON b.src = w.node WHERE w.depth < 8),
far AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
SELECT (SELECT depth FROM far WHERE node = (SELECT max(dst) FROM e)) AS steps, (SELECT min(src) FROM e) AS first, (SELECT max(dst) FROM e) AS last, true AS linked WHERE (SELECT depth FROM far WHERE node = (SELECT max(dst) FROM e)) IS NOT NULL""")
def gt09_shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    """Length and ends of the shortest path between two symbols, and whether each of its steps is an edge."""
    links = cut(_edges(spark, folder))
    start, goal = _ends(_edges(spark, folder, "calls"))
    if start is None:
        return spark.createDataFrame([], "steps int, first long, last long, linked boolean")
    path = cut(graph.shortest_path(links, start, goal))
    steps = path.alias("a").join(path.alias("b"), F.col("b.position") == F.col("a.position") + 1).select(F.col("a.node").alias("p"), F.col("b.node").alias("q"))
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    held = steps.join(both, (F.col("p") == F.col("src")) & (F.col("q") == F.col("dst"))).agg(F.count(F.lit(1)).alias("held"))
    ends = path.agg(F.max("position").alias("steps"), F.min_by("node", "position").alias("first"), F.max_by("node", "position").alias("last"))
    return ends.where("steps is not null").join(F.broadcast(held)).select("steps", "first", "last", (F.col("held") == F.col("steps")).alias("linked"))


@query(f"""WITH RECURSIVE {_EDGES}, {_SEED},
w AS (SELECT e.src AS node, [seed, e.src] AS path FROM seed JOIN e ON e.dst = seed
      UNION ALL SELECT e.src, list_append(w.path, e.src) FROM w JOIN e ON e.dst = w.node WHERE len(w.path) < 4 AND NOT list_contains(w.path, e.src))
SELECT list_aggregate(path, 'string_agg', '>') AS path FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.dst = w.node)""")
def gt10_all_simple_paths(spark: SparkSession, folder: str) -> DataFrame:
    # the goals are entry points: symbols that nothing calls
    links, seed = _calls(spark, folder)
    called = links.select(F.col("dst").alias("c")).distinct()
    found = graph.paths(links, seed, 3, reverse=True).join(called, F.col("node") == F.col("c"), "left_anti")
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES}, {_SEED},
w AS (SELECT e.dst AS node, [seed, e.dst] AS path FROM seed JOIN e ON e.src = seed
      UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE len(w.path) < 5 AND NOT list_contains(w.path, e.dst))
SELECT list_aggregate(path, 'string_agg', '>') AS path FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = w.node)""")
def ga03_leaf_call_chains(spark: SparkSession, folder: str) -> DataFrame:
    links, seed = _calls(spark, folder)
    callers = links.select(F.col("src").alias("c")).distinct()
    found = graph.paths(links, seed, 4).join(callers, F.col("node") == F.col("c"), "left_anti")
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query()
def ga05_cycle_core(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between symbols that lie on a cycle of dependencies of any type."""
    return graph.on_cycles(_edges(spark, folder))


@query()
def ga05_file_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between files that lie on a cycle; a file depends on another when a symbol of it does."""
    s = view(spark, folder, "s", "file_id").select("id", "file_id").where("file_id is not null")
    a, b = s.toDF("a", "src"), s.toDF("b", "dst")
    links = _edges(spark, folder).toDF("from", "to").join(a, F.col("from") == F.col("a")).join(b, F.col("to") == F.col("b"))
    return graph.on_cycles(links.where("src <> dst").select("src", "dst").distinct())


def _ranking_symbols(spark: SparkSession, folder: str) -> DataFrame:
    s = view(spark, folder, "s", "name", "symbol_type", "file_id", "qualified_name")
    f = view(spark, folder, "f", "path").select(F.col("id").alias("f_id"), "path")
    return s.join(f, F.col("file_id") == F.col("f_id"), "left")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cut(importance.weighted(view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "dependency_type")))


def _words(text: str) -> str:
    return "\\b(" + text + ")\\b"


def _importance_sql(depth: str = "NULL") -> str:
    """Scores by counting rows per symbol; m names the symbols (id, name, symbol_type, qualified_name, path, depth)."""
    low, file, full = "lower(coalesce(name, ''))", "lower(coalesce(path, ''))", "coalesce(nullif(qualified_name, ''), name, '')"
    has = lambda c, *ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
    rx = lambda c, p, flags="c": f"regexp_matches({c}, '{p}', '{flags}')"
    return f"""
rows_in AS (SELECT to_symbol_id AS id, count(*) AS n, count(DISTINCT from_symbol_id) AS k FROM d WHERE to_symbol_id IS NOT NULL GROUP BY 1),
rows_out AS (SELECT from_symbol_id AS id, count(*) AS n, count(DISTINCT to_symbol_id) AS k FROM d WHERE from_symbol_id IS NOT NULL GROUP BY 1),
rows_second AS (SELECT a.to_symbol_id AS id, count(b.id) AS n FROM d a LEFT JOIN d b ON a.from_symbol_id = b.to_symbol_id WHERE a.to_symbol_id IS NOT NULL GROUP BY 1),
hops AS (SELECT DISTINCT from_symbol_id AS a, to_symbol_id AS b FROM d WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL),
rows_near AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT a AS id, b AS x FROM hops UNION SELECT h.a, g.b FROM hops h JOIN hops g ON g.a = h.b) GROUP BY id),
lang AS (SELECT m.*, CASE WHEN {file} LIKE '%.php' THEN 'php' WHEN {file} LIKE '%.cs' THEN 'csharp' WHEN {file} LIKE '%.ts' OR {file} LIKE '%.js' THEN 'script' WHEN {file} LIKE '%.gd' THEN 'godot'
  WHEN {full} <> coalesce(name, '') AND contains({full}, chr(92)) THEN 'php' WHEN {full} <> coalesce(name, '') AND {rx(full, '^[A-Z][a-zA-Z0-9]*(\\.[A-Z][a-zA-Z0-9]*)+')} AND NOT contains({full}, '::') THEN 'csharp'
  WHEN {full} <> coalesce(name, '') AND {rx(full, '^[a-z]+(\\.[a-z]+)+\\.[A-Z]')} THEN 'java' WHEN {full} <> coalesce(name, '') AND {has(full, '@/', '../')} THEN 'script' ELSE 'unknown' END AS lang FROM m),
stores AS (SELECT *, {rx(low, _words(importance.STORING))} AND CASE lang
  WHEN 'php' THEN {rx(full, '::(create|insert|update|save|delete|destroy|upsert)\\b', 'i')} OR {rx(full, '\\\\models\\\\', 'i')} OR {has(file, '/models/')} OR {rx(file, '\\b(eloquent|repository)\\b')} OR {has(low, 'repository')}
  WHEN 'csharp' THEN {rx(low, '\\b(savechanges|add|update|remove|delete|insert|executesql|execute)\\b')} OR {rx(file, '\\b(repository|dbcontext|database|entity)\\b')} OR {has(low, 'repository', 'db')}
  WHEN 'script' THEN {has(low, 'repository', 'prisma', 'orm')} OR {rx(file, '\\b(model|schema|entity|collection)\\b')}
  WHEN 'godot' THEN {rx(low, '(save|load)_(resource|scene|config|data|game)')} OR {rx(low, 'resource_?saver|config_?file')}
  ELSE {has(low, 'repository', 'db', 'database', 'persist')} END AS stores FROM lang),
parts AS (SELECT m.id, m.stores, m.depth, least(sqrt(coalesce(i.k, 0) * coalesce(o.k, 0)) / 10, 1.0e0) AS betweenness, least((coalesce(i.n, 0) * 1.5e0 + coalesce(o.n, 0)) / 20, 1.0e0) AS degree,
  least(coalesce(x.n, 0) / 50, 1.0e0) AS eigenvector, least(coalesce(nr.n, 0) / 30, 1.0e0) AS closeness,
  greatest(0.0e0, least(1.0e0, CASE symbol_type WHEN 'method' THEN 0.6e0 WHEN 'function' THEN 0.6e0 WHEN 'class' THEN 0.7e0 WHEN 'interface' THEN 0.5e0 WHEN 'variable' THEN 0.3e0 WHEN 'property' THEN 0.3e0 ELSE 0.5e0 END
   + CASE WHEN {rx(low, _words(importance.STORING))} THEN 0.4e0 ELSE 0 END + CASE WHEN {rx(low, _words(importance.PROCESSING))} THEN 0.3e0 ELSE 0 END
   + CASE WHEN path LIKE '%/Service%' OR path LIKE '%/Controller%' THEN 0.2e0 ELSE 0 END - CASE WHEN {rx(low, _words(importance.REPORTING))} THEN 0.5e0 ELSE 0 END
   - CASE WHEN {rx(low, '^(' + importance.ANSWERING + ')\\b', 'i')} THEN 0.3e0 ELSE 0 END + coalesce(greatest(0.0e0, (1 - m.depth / 5.0e0) * 0.2e0), 0))) AS semantic
  FROM stores m LEFT JOIN rows_in i ON i.id = m.id LEFT JOIN rows_out o ON o.id = m.id LEFT JOIN rows_second x ON x.id = m.id LEFT JOIN rows_near nr ON nr.id = m.id),
plain AS (SELECT *, 0.3e0 * betweenness + 0.2e0 * degree + 0.15e0 * eigenvector + 0.1e0 * closeness + 0.25e0 * semantic AS plain FROM parts),
scored AS (SELECT *, least(CASE WHEN stores THEN greatest(plain * 2.5e0 - coalesce(depth, 0) * 0.02e0, 0.0e0) ELSE plain END, 1.0e0) AS score FROM plain)"""


_RANKED = f"""{_D}, {view_sql("s", "name", "symbol_type", "file_id", "qualified_name")}, {view_sql("f", "path")}"""
_ALL = "m AS (SELECT s.id, s.name, s.symbol_type, s.qualified_name, f.path, CAST(NULL AS INTEGER) AS depth FROM s LEFT JOIN f ON f.id = s.file_id)"
_IMPORTANCE = f"WITH {_RANKED}, {_ALL}, {_importance_sql()}"


@query(f"""{_IMPORTANCE} SELECT id, round(CAST(betweenness AS DOUBLE), 6) AS betweenness, round(CAST(degree AS DOUBLE), 6) AS degree, round(CAST(eigenvector AS DOUBLE), 6) AS eigenvector,
round(CAST(closeness AS DOUBLE), 6) AS closeness, round(CAST(semantic AS DOUBLE), 6) AS semantic, stores AS is_database FROM scored""")
def ce01_centrality_proxies(spark: SparkSession, folder: str) -> DataFrame:
    r = importance.importance(_ranking_symbols(spark, folder), _pairs(spark, folder))
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("betweenness", "degree", "eigenvector", "closeness", "semantic")], "is_database")


@query(f"{_IMPORTANCE} SELECT id, round(CAST(score AS DOUBLE), 4) AS score FROM scored")
def ce07_importance(spark: SparkSession, folder: str) -> DataFrame:
    scored = importance.importance(_ranking_symbols(spark, folder), _pairs(spark, folder))
    return scored.select("id", F.round("score", 4).alias("score"))


@query(f"{_IMPORTANCE} SELECT id, round(CAST(score AS DOUBLE), 4) AS score, row_number() OVER (ORDER BY score DESC, id) AS place FROM scored QUALIFY place <= 100")
def ce08_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most important symbols, in order."""
    scored = importance.importance(_ranking_symbols(spark, folder), _pairs(spark, folder))
    top = importance.ranked(scored.withColumn("score", F.col("score")), 100)
    return top.select("id", F.round("score", 4).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))).alias("place"))


def gt13_who_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Callers of the seed up to three steps away with name, file and importance; the dependencies are scanned once."""
    d = view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "dependency_type")
    typed = cut(d.where("from_symbol_id is not null or to_symbol_id is not null").groupBy(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), "dependency_type").agg(F.count(F.lit(1)).alias("n")))
    links = cut(typed.where("dependency_type = 'calls' and src <> dst").select("src", "dst"))
    seed = _seed(links)
    callers = cut(graph.reach(links, seed, 3, reverse=True).select("node", "depth"))
    s = view(spark, folder, "s", "name", "symbol_type", "file_id", "qualified_name")
    f = view(spark, folder, "f", "path").select(F.col("id").alias("f_id"), "path")
    named = cut(callers.join(s, F.col("node") == F.col("id")).join(f, F.col("file_id") == F.col("f_id"), "left").drop("f_id"))
    pairs = typed.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    scored = importance.importance(named, pairs, few=True).select(F.col("id").alias("i_id"), F.round("score", 4).alias("score"))
    return named.join(scored, F.col("node") == F.col("i_id")).select("node", "depth", "name", "symbol_type", "path", "score")


query(f"""WITH RECURSIVE {_RANKED}, ec AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM d WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL AND from_symbol_id <> to_symbol_id AND dependency_type = 'calls'),
seed AS (SELECT min(dst) AS seed FROM (SELECT dst FROM ec GROUP BY dst HAVING count(*) BETWEEN 3 AND 8) WHERE dst IN (SELECT src FROM ec)),
w AS (SELECT seed AS node, 0 AS depth FROM seed UNION SELECT ec.src, w.depth + 1 FROM w JOIN ec ON ec.dst = w.node WHERE w.depth < 3),
mn AS (SELECT node, min(depth) AS depth FROM w WHERE node <> (SELECT seed FROM seed) GROUP BY node),
m AS (SELECT s.id, s.name, s.symbol_type, s.qualified_name, f.path, mn.depth FROM mn JOIN s ON s.id = mn.node LEFT JOIN f ON f.id = s.file_id), {_importance_sql()}
SELECT m.id AS node, m.depth, m.name, m.symbol_type, m.path, round(CAST(scored.score AS DOUBLE), 4) AS score FROM m JOIN scored ON scored.id = m.id""")(gt13_who_calls)


_S4 = view_sql("s", "name", "signature", "description")


@query(f"""WITH {_S4},
k AS (SELECT id, name, {" + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{w}') THEN 1 ELSE 0 END" for w in ("order", "ledger") for c in ("name", "signature", "description"))} AS score,
  CASE WHEN lower(coalesce(name, '')) = 'order' THEN 1000 WHEN starts_with(lower(coalesce(name, '')), 'order') THEN 100 WHEN contains(lower(coalesce(name, '')), 'order') THEN 10 ELSE 0 END AS boost FROM s)
SELECT id, name, score, boost FROM k WHERE score > 0 ORDER BY score DESC, boost DESC, name, id LIMIT 30""")
def se02_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return search.lexical(view(spark, folder, "s", "name", "signature", "description"), "Order ledger")


#: Ranks of the symbols with both words: of two words the covers are neighbouring places of different ones.
FULLTEXT = """words AS (SELECT id, name, [x for x in string_split_regex(lower(regexp_replace(coalesce(name, '') || ' ' || coalesce(signature, '') || ' ' || coalesce(description, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') if x <> ''] AS w FROM s),
places AS (SELECT id, name, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM words WHERE list_contains(w, 'order') AND list_contains(w, 'merge')),
steps AS (SELECT id, name, pos, word, lag(pos) OVER o AS before, lag(word) OVER o AS other FROM places WHERE word IN ('order', 'merge') WINDOW o AS (PARTITION BY id ORDER BY pos)),
ft AS (SELECT id, name, round(sum(CASE WHEN other <> word THEN 0.1e0 / (pos - before) ELSE 0 END), 6) AS rank FROM steps GROUP BY id, name)"""


@query(f"WITH {_S4}, {FULLTEXT} SELECT id, name, rank FROM ft ORDER BY rank DESC, name, id LIMIT 100")
def se03_fulltext(spark: SparkSession, folder: str) -> DataFrame:
    return search.fulltext(view(spark, folder, "s", "name", "signature", "description"), "merge order")


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    row = table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


@query("""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sim AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS similarity FROM n q JOIN n e ON q.vec_id % 20 = 0)
SELECT query_id, vec_id, similarity FROM sim WHERE similarity >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 100""")
def se04_vector(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest rows of every row whose id is divisible by 20, exactly."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search.neighbours(vectors.where("vec_id % 20 = 0"), vectors, 0.25)


@query(f"""WITH {_S4}, {FULLTEXT},
k AS (SELECT id, name, {" + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{w}') THEN 1 ELSE 0 END" for w in ("merge", "order") for c in ("name", "signature", "description"))} AS score,
  CASE WHEN lower(coalesce(name, '')) = 'merge' THEN 1000 WHEN starts_with(lower(coalesce(name, '')), 'merge') THEN 100 WHEN contains(lower(coalesce(name, '')), 'merge') THEN 10 ELSE 0 END AS boost FROM s),
p1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, boost DESC, name, id) - 1 AS pos FROM k WHERE score > 0 QUALIFY pos < 21),
p2 AS (SELECT id, row_number() OVER (ORDER BY rank DESC, name, id) - 1 AS pos FROM ft QUALIFY pos < 21),
p3 AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) - 1 AS pos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) >= 0 QUALIFY pos < 21),
parts AS (SELECT id, greatest(0.1e0, 1 - CAST(pos AS DOUBLE) / (SELECT count(*) FROM p1)) * 0.3e0 AS part FROM p1 UNION ALL SELECT id, greatest(0.1e0, 1 - CAST(pos AS DOUBLE) / (SELECT count(*) FROM p2)) * 0.3e0 FROM p2 UNION ALL SELECT id, greatest(0.1e0, 1 - CAST(pos AS DOUBLE) / (SELECT count(*) FROM p3)) * 0.4e0 FROM p3)
SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id ORDER BY score DESC, id LIMIT 30""")
def se06_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical and full-text hits and the neighbours of a vector, each at most 21, as one ranked list of 30."""
    s = view(spark, folder, "s", "name", "signature", "description")
    part = -(-30 * 7 // 10)
    lexical = search.positions(search.lexical(s, "merge order", part), F.desc("score"), F.desc("boost"), F.asc("name"), F.asc("id"))
    fulltext = search.positions(search.fulltext(s, "merge order", part), F.desc("rank"), F.asc("name"), F.asc("id"))
    near = search.vector(table(spark, folder, "embeddings"), _query_vector(spark, folder), 0.0, part)
    vectors = search.positions(near.withColumnRenamed("vec_id", "id"), F.desc("similarity"), F.asc("id"))
    return search.hybrid({"lexical": lexical, "vector": vectors, "fulltext": fulltext}, 30)


_DC_S = ("name", "symbol_type", "entity_type", "file_id", "signature", "is_exported")


def _rx(column: str, *groups: tuple[str, ...]) -> str:
    """SQL of a match with any of some groups of patterns, false for nulls."""
    one = "|".join(f"(?:{p})" for group in groups for p in group)
    return f"coalesce(regexp_matches({column}, '{one}'), false)"


_DC = f"""WITH {_D}, {view_sql("s", *_DC_S)}, {view_sql("f", "path", "repo_id")},
dead AS (SELECT s.*, f.path, f.repo_id FROM s JOIN f ON f.id = s.file_id WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.dependency_type = 'calls' AND d.to_symbol_id = s.id)
  AND NOT ({" OR ".join(f"f.path LIKE '{p}' ESCAPE chr(92)" for p in deadcode.TEST_LIKE)})),
kept AS (SELECT * FROM dead WHERE symbol_type NOT IN {deadcode.ENTRY_TYPES} AND NOT coalesce(entity_type IN {deadcode.ENTRY_ENTITIES}, false) AND symbol_type NOT IN {deadcode.IMPLICIT_TYPES} AND NOT coalesce(is_exported, false)
  AND NOT {_rx("name", deadcode.ENTRY_NAMES, deadcode.TEST_NAMES, deadcode.SIGNAL_NAMES, deadcode.KEPT_NAMES)} AND NOT {_rx("path", deadcode.TEST_PATHS)}
  AND NOT {_rx("signature", deadcode.CALLBACK_SIGNATURES, deadcode.TEST_SIGNATURES, deadcode.IMPLICIT_SIGNATURES, deadcode.SIGNAL_SIGNATURES, deadcode.KEPT_SIGNATURES, deadcode.EXPLICIT_SIGNATURES)}
  AND NOT ({_rx("name", deadcode.IMPLICIT_NAMES)} AND {_rx("signature", (deadcode.IMPLICIT_BODY,))})),
pairs AS (SELECT DISTINCT b.id, a.name FROM d JOIN s i ON i.id = d.to_symbol_id AND (i.symbol_type = 'interface' OR i.entity_type = 'interface') JOIN s c ON c.id = d.from_symbol_id
  JOIN s a ON a.file_id = i.file_id AND (a.symbol_type = 'method' OR a.entity_type = 'interface_method') JOIN s b ON b.file_id = c.file_id AND b.name = a.name AND b.symbol_type IN ('method', 'class_method') WHERE d.dependency_type = 'implements'),
flags AS (SELECT k.*, EXISTS (SELECT 1 FROM pairs p WHERE p.id = k.id) AS bloat, EXISTS (SELECT 1 FROM d WHERE d.from_symbol_id = k.id AND d.dependency_type IN ('implements', 'inherits', 'extends')) AS heir,
  {_rx("signature", (r"\bprivate\b", r"\bprotected\b"))} OR coalesce(name, '') LIKE '#%' OR coalesce(name, '') LIKE '!_%' ESCAPE '!' AS hidden, {_rx("name", deadcode.GENERIC_NAMES)} AS generic FROM kept k),
named AS (SELECT *, CASE WHEN bloat THEN 'interface_bloat' WHEN symbol_type IN ('class', 'type_alias', 'struct') OR coalesce(entity_type = 'class', false) THEN 'dead_class'
  WHEN (symbol_type = 'method' OR coalesce(entity_type IN ('method', 'class_method'), false)) THEN CASE WHEN hidden THEN 'dead_private_method' ELSE 'dead_public_method' END ELSE 'dead_function' END AS category FROM flags),
found AS (SELECT id, name, repo_id, path, category, CASE WHEN category IN ('dead_private_method', 'interface_bloat') OR (category IN ('dead_public_method', 'dead_class') AND NOT heir) THEN 'high' WHEN heir OR generic THEN 'low' ELSE 'medium' END AS confidence FROM named)"""


def _dead_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, folder, "s", *_DC_S), view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "dependency_type"), view(spark, folder, "f", "path", "repo_id")


@query(f"{_DC} SELECT id, name, repo_id FROM dead")
def dc01_zero_callers(spark: SparkSession, folder: str) -> DataFrame:
    return deadcode.candidates(*_dead_inputs(spark, folder)).select("id", "name", "repo_id")


@query(f"{_DC} SELECT id FROM dead WHERE id NOT IN (SELECT id FROM kept)")
def dc05_false_positives(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates that some rule explains."""
    return deadcode.candidates(*_dead_inputs(spark, folder)).where(deadcode.is_false_positive()).select("id")


@query(f"{_DC} SELECT id, name FROM pairs")
def dc06_interface_bloat(spark: SparkSession, folder: str) -> DataFrame:
    """Methods that implement one of an interface, whether they are called or not."""
    s, d, _ = _dead_inputs(spark, folder)
    return deadcode.interface_pairs(s, d).select(F.col("implementation_id").alias("id"), F.col("interface_name").alias("name"))


@query(f"{_DC} SELECT id, name, repo_id, path, category, confidence FROM found")
def dc07_dead_code(spark: SparkSession, folder: str) -> DataFrame:
    return deadcode.findings(*_dead_inputs(spark, folder)).select("id", "name", "repo_id", "path", "category", "confidence")


@query(f"{_DC} SELECT f.id, f.confidence, n.hidden AS is_private, n.heir AS is_override, n.bloat AS implements_interface FROM found f JOIN named n ON n.id = f.id WHERE f.confidence IN ('high', 'medium') ORDER BY CASE f.confidence WHEN 'high' THEN 0 ELSE 1 END, f.id LIMIT 200")
def dc09_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 surest findings of at least medium confidence with their evidence."""
    found = deadcode.limited(deadcode.findings(*_dead_inputs(spark, folder), threshold="medium"), 200)
    return found.select("id", "confidence", "evidence.is_private", "evidence.is_override", "evidence.implements_interface")


@query(f"{_DC} SELECT category, confidence, count(*) AS findings, count(DISTINCT path) AS files FROM found GROUP BY category, confidence")
def dc11_dead_code_summary(spark: SparkSession, folder: str) -> DataFrame:
    return deadcode.summary(deadcode.findings(*_dead_inputs(spark, folder)))


_A = ("repo_id", "caller_symbol_id", "endpoint_symbol_id", "http_method", "endpoint_path")
_URL = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(endpoint_path, ''), '[?#].*$', '')), '\$\{[^}]*\}|\{[^}]*\}|:[a-z_]\w*', '{param}', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g')"""
_CALLS = f"""WITH {view_sql("a", *_A)}, u AS (SELECT *, upper(coalesce(http_method, 'GET')) AS method, {_URL} AS url FROM a),
routes AS (SELECT method, url, count(*) AS calls, count(DISTINCT caller_symbol_id) AS callers, min(endpoint_symbol_id) AS handler_id FROM u GROUP BY method, url)"""


@query(f"{_CALLS} SELECT method, url, calls, callers, handler_id FROM routes")
def xs11_routes(spark: SparkSession, folder: str) -> DataFrame:
    return crossstack.routes(view(spark, folder, "a", *_A))


@query(f"{_CALLS} SELECT u.id, u.method, u.url, r.handler_id FROM u LEFT JOIN (SELECT * FROM routes WHERE handler_id IS NOT NULL) r ON r.method = u.method AND r.url = u.url WHERE u.endpoint_symbol_id IS NULL")
def xs01_match_calls(spark: SparkSession, folder: str) -> DataFrame:
    return crossstack.matched(view(spark, folder, "a", *_A))


@query(f"""{_CALLS}, side AS (SELECT id AS r_id, coalesce(language_primary, '') IN ('javascript', 'typescript', 'vue') AS front FROM repositories),
x AS (SELECT DISTINCT method, url FROM u JOIN side ON r_id = repo_id WHERE url <> '' AND front), y AS (SELECT DISTINCT method, url FROM u JOIN side ON r_id = repo_id WHERE url <> '' AND NOT front)
SELECT CASE WHEN x.url IS NULL THEN 'second_only' WHEN y.url IS NULL THEN 'first_only' ELSE 'both' END AS state, count(*) AS urls FROM x FULL OUTER JOIN y ON x.method = y.method AND x.url = y.url GROUP BY 1""")
def st07_endpoint_diff(spark: SparkSession, folder: str) -> DataFrame:
    return crossstack.coverage(view(spark, folder, "a", *_A), view(spark, folder, "r", "language_primary"))


_PATTERN = r"""regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(endpoint_path, '')), '^`(.*)`$', '\1'), '/+', '/', 'g'), '(.)/$', '\1'), '\$\{\s*([^}]*?)\s*\}', '{\1}', 'g'), '\{([^}?]*)\?([^}]*)\}', '{\1\2}', 'g'), '[''"`]\s*\+\s*([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\+\s*[''"`]', '{\1}', 'g'), '^([^?]*)', 1)"""


def _fits(x: str, y: str) -> str:
    """SQL of two parameter names that can mean the same."""
    aliases = " OR ".join(f"(lower({x}) IN {g} AND lower({y}) IN {g})" for g in crossstack.ALIASES)
    root = lambda c: f"lower(regexp_replace({c}, '(_id|Id)$', '', 'i'))"
    return f"({x} = {y} OR {aliases} OR lower({x}) = replace(lower({y}), '_', '') OR ({root(x)} = {root(y)} AND length({root(x)}) > 2) OR (lower({x}) LIKE '%id' AND lower({y}) LIKE '%id'))"


_SIMILAR = f"""WITH {view_sql("a", *_A)}, side AS (SELECT id AS r_id, coalesce(language_primary, '') IN ('javascript', 'typescript', 'vue') AS front FROM repositories),
u AS (SELECT DISTINCT front, upper(coalesce(http_method, 'GET')) AS method, {_PATTERN} AS url FROM a JOIN side ON r_id = repo_id),
k AS (SELECT *, list_filter(string_split(url, '/'), lambda s: s <> '') AS p FROM u WHERE url <> ''),
x AS (SELECT a.method, a.url AS url_a, b.url AS url_b, a.p AS pa, b.p AS pb, len(a.p) AS n FROM k a JOIN k b ON a.front AND NOT b.front AND a.method = b.method AND len(a.p) = len(b.p) WHERE len(a.p) > 0),
steps AS (SELECT *, unnest(pa) AS sa, unnest(pb) AS sb FROM x),
c AS (SELECT method, url_a, url_b, any_value(n) AS n, any_value(array_to_string(pa, '/') = array_to_string(pb, '/')) AS same, count(*) FILTER (WHERE sa = sb) AS eq,
  count(*) FILTER (WHERE sa <> sb AND sa LIKE '{{%}}' AND sb LIKE '{{%}}') AS par, count(*) FILTER (WHERE sa <> sb AND sa LIKE '{{%}}' AND sb LIKE '{{%}}' AND {_fits("sa[2:-2]", "sb[2:-2]")}) AS fit,
  bool_or(sa LIKE '{{%}}' OR sb LIKE '{{%}}') AS has FROM steps GROUP BY method, url_a, url_b),
scores AS (SELECT *, CASE WHEN same THEN 1.0e0 ELSE round(CAST(eq AS DOUBLE) / n * 0.6e0 + CAST(par AS DOUBLE) / n * 0.3e0 + CASE WHEN par > 0 THEN CAST(fit AS DOUBLE) / par ELSE 1.0e0 END * 0.1e0, 3) END AS score FROM c),
found AS (SELECT method, url_a, url_b, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.95 AND NOT has THEN 'exact' WHEN score >= 0.7 THEN 'parameters' WHEN score >= 0.5 THEN 'structure' WHEN score >= 0.3 THEN 'partial' ELSE 'none' END AS match_type FROM scores WHERE score >= 0.5e0)"""


def _front_and_back(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return crossstack.sides(view(spark, folder, "a", *_A), view(spark, folder, "r", "language_primary"))


@query(f"{_SIMILAR} SELECT method, url_a, url_b, score, match_type FROM found")
def xs03_similar_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of frontend and backend URLs with a similarity of 0.5 or more."""
    return crossstack.similar(*_front_and_back(spark, folder))


@query(f"{_SIMILAR} SELECT k.method, k.url, f.url_b AS route, f.score, f.match_type FROM k LEFT JOIN (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY method, url_a ORDER BY score DESC, url_b) = 1) f ON f.method = k.method AND f.url_a = k.url WHERE k.front AND len(k.p) > 0")
def xs05_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """Of every frontend URL the backend URL that fits best, if any does."""
    return crossstack.best_matches(view(spark, folder, "a", *_A), view(spark, folder, "r", "language_primary"))


@query(f"""{_SIMILAR}, y AS (SELECT a.method, a.url AS url_a, b.url AS url_b, a.p AS pa, b.p AS pb, least(len(a.p), len(b.p)) AS n FROM k a JOIN k b ON a.front AND NOT b.front AND a.method = b.method WHERE len(a.p) > 0 AND len(b.p) > 0),
z AS (SELECT method, url_a, url_b, n, list_sum([CASE WHEN pa[i] = pb[i] THEN 1 ELSE 0 END for i in range(1, n + 1)]) AS eq FROM y)
SELECT method, url_a, url_b, round(CAST(eq AS DOUBLE) / n * 0.6e0, 6) AS score FROM z WHERE CAST(eq AS DOUBLE) / n > 0.3e0""")
def xs04_fallback_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of URLs of any lengths of which more than 0.3 of the common places are equal."""
    return crossstack.basic_matches(*_front_and_back(spark, folder))


@query(rf"""WITH {view_sql("a", *_A)}, u AS (SELECT DISTINCT endpoint_path, {_PATTERN} AS normalized FROM a)
SELECT coalesce(endpoint_path, '') AS endpoint_path, normalized, len(list_distinct(regexp_extract_all(normalized, '\{{([^}}]*)\}}', 1))) AS parameters FROM u""")
def xs02_url_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of an endpoint with its pattern and number of parameters."""
    p = crossstack.url_pattern(F.col("endpoint_path"))
    paths = view(spark, folder, "a", *_A).select("endpoint_path").distinct()
    return paths.select(F.coalesce("endpoint_path", F.lit("")).alias("endpoint_path"), p["normalized"].alias("normalized"), F.size(p["parameters"]).alias("parameters"))


_RS = f"""WITH {view_sql("d", "from_symbol_id", "to_symbol_id", "to_symbol", "to_qualified_name")}, {view_sql("s", "name", "qualified_name", "file_id")}, {view_sql("f", "repo_id")},
o AS (SELECT s.id, s.file_id, f.repo_id, s.name, s.qualified_name FROM s LEFT JOIN f ON f.id = s.file_id),
ask AS (SELECT d.id, d.to_symbol, d.to_qualified_name, o.file_id, o.repo_id FROM d LEFT JOIN o ON o.id = d.from_symbol_id WHERE d.to_symbol_id IS NULL),
q AS (SELECT qualified_name AS k, min(id) AS target, count(*) AS n FROM s WHERE qualified_name IS NOT NULL GROUP BY 1),
g AS (SELECT file_id AS kf, name AS kn, min(id) AS target, count(*) AS n FROM s WHERE name IS NOT NULL GROUP BY 1, 2),
h AS (SELECT repo_id AS kr, name AS kn, min(id) AS target, count(*) AS n FROM o WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
hits AS (SELECT ask.id, q.target, q.n, 1 AS rule FROM ask JOIN q ON q.k = ask.to_qualified_name UNION ALL SELECT ask.id, g.target, g.n, 2 FROM ask JOIN g ON g.kf = ask.file_id AND g.kn = ask.to_symbol
  UNION ALL SELECT ask.id, h.target, h.n, 3 FROM ask JOIN h ON h.kr = ask.repo_id AND h.kn = ask.to_symbol)
SELECT id, target AS to_symbol_id, rule, n AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rule, target, n) AS rn FROM hits) WHERE rn = 1"""


@query(_RS)
def rs02_resolution_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.resolve_by_cascade(
        view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "to_symbol", "to_qualified_name"),
        view(spark, folder, "s", "name", "qualified_name", "file_id"),
        view(spark, folder, "f", "repo_id"),
    )


@query(f"""WITH {view_sql("s", "symbol_type", "file_id", "start_line", "end_line")},
hit AS (SELECT i.id, o.id AS parent_id, row_number() OVER (PARTITION BY i.id ORDER BY o.end_line - o.start_line, o.id) AS rn FROM s i JOIN s o ON o.file_id = i.file_id AND o.symbol_type IN ('class', 'interface', 'trait') AND i.id <> o.id
  AND i.start_line >= o.start_line AND i.end_line <= o.end_line WHERE i.symbol_type IN ('method', 'property'))
SELECT id, parent_id FROM hit WHERE rn = 1""")
def rs10_link_parents(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.link_parents(view(spark, folder, "s", "symbol_type", "file_id", "start_line", "end_line"))


_RULES = ", ".join("(" + ", ".join([str(i), *[f"'{x}'" if isinstance(x, str) else str(x) for x in r]]) + ")" for i, r in enumerate(resolve.RULES))


@query(f"""WITH {view_sql("s", "name", "symbol_type", "file_id", "framework", "base_class", "namespace")}, {view_sql("f", "path")}, rules AS (SELECT * FROM (VALUES {_RULES}) AS t(n, fw, kind, how, pattern, entity, priority, endings)),
k AS (SELECT s.id, s.symbol_type, coalesce(s.name, '') AS nm, coalesce(f.path, '') AS p, trim(string_split(coalesce(s.base_class, ''), ',')[1]) AS b, s.framework, coalesce(s.namespace, '') AS ns FROM s LEFT JOIN f ON f.id = s.file_id),
w AS (SELECT *, coalesce(framework, CASE WHEN p LIKE '%.php' THEN CASE WHEN starts_with(ns, 'Illuminate' || chr(92)) OR starts_with(b, 'Illuminate' || chr(92)) THEN 'laravel' END WHEN p LIKE '%.cs' THEN CASE WHEN starts_with(ns, 'Godot.') OR b IN {resolve.ENGINE_BASES} THEN 'godot' ELSE 'csharp' END WHEN p LIKE '%.vue' THEN 'vue' WHEN p LIKE '%.tscn' OR p LIKE '%.godot' THEN 'godot' END) AS fw FROM k),
hits AS (SELECT w.id, r.entity, r.how || ': ' || r.pattern AS rule, row_number() OVER (PARTITION BY w.id ORDER BY r.priority DESC, r.n) AS place FROM w JOIN rules r ON r.fw = w.fw AND (r.kind = w.symbol_type OR (r.kind = '*' AND NOT EXISTS (SELECT 1 FROM rules q WHERE q.fw = r.fw AND q.kind = w.symbol_type)))
  AND CASE r.how WHEN 'suffix' THEN ends_with(w.nm, r.pattern) AND NOT (r.fw = 'godot' AND r.pattern = 'Controller' AND w.b = 'Controller') WHEN 'prefix' THEN regexp_matches(w.nm, r.pattern) WHEN 'folder' THEN contains(w.p, r.pattern) WHEN 'ending' THEN ends_with(w.p, r.pattern) ELSE w.b = r.pattern END
  AND (r.endings = '' OR len(list_filter(string_split(r.endings, ' '), lambda e: ends_with(w.p, e))) > 0))
SELECT w.id, w.fw AS framework, coalesce(h.entity, w.symbol_type) AS entity FROM w LEFT JOIN hits h ON h.id = w.id AND h.place = 1""")
def rs14_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Framework and entity type of every symbol."""
    s = view(spark, folder, "s", "name", "symbol_type", "file_id", "framework", "base_class", "namespace")
    return resolve.classify(s, view(spark, folder, "f", "path")).select("id", "framework", "entity")


@query(r"WITH " + view_sql("s", "name", "symbol_type") + r""", k AS (SELECT id, regexp_replace(regexp_replace(name, '^(get|set|create|update|delete|fetch|load|save|handle|process|use)([A-Z])', '\2'), '(.)(Controller|Service|Component|Store|Model|Handler|Manager|Repository)$', '\1') AS core FROM s WHERE symbol_type = 'class')
SELECT id, upper(substr(core, 1, 1)) || substr(core, 2) AS feature FROM k""")
def fd14_feature_names(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "s", "name", "symbol_type").where("symbol_type = 'class'").select("id", X.feature_name(F.col("name")).alias("feature"))


_F = view_sql("f", "path", "language", "is_test", "is_generated")


@query(f"""WITH {_F}, k AS (SELECT id, lower(regexp_extract(coalesce(path, ''), '\\.([^./]+)$', 1)) AS ext,
  regexp_matches(lower(coalesce(path, '')), '(^|/)(tests?|__tests__|specs?)/|\\.(test|spec)\\.[^/]+$|test\\.(php|cs)$') AS test,
  regexp_matches(lower(coalesce(path, '')), '\\.(generated|g|designer)\\.[^/]+$|(^|/)generated/|\\.min\\.[^/]+$|\\.d\\.ts$') AS generated,
  regexp_matches(coalesce(path, ''), '(^|/)(node_modules|\\.git|dist|build|coverage|\\.next|\\.nuxt|vendor|__pycache__|\\.venv|\\.[^/]+)/') AS skipped FROM f)
SELECT ext, count(*) AS files, count(*) FILTER (WHERE test) AS tests, count(*) FILTER (WHERE generated) AS generated, count(*) FILTER (WHERE skipped) AS skipped FROM k GROUP BY ext""")
def sc02_file_predicates(spark: SparkSession, folder: str) -> DataFrame:
    f = view(spark, folder, "f", "path", "language", "is_test", "is_generated")
    p = F.col("path")
    return f.groupBy(X.extension(p).alias("ext")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(X.is_test_path(p)).alias("tests"),
        F.count_if(X.is_generated_path(p)).alias("generated"),
        F.count_if(X.in_skipped_directory(p)).alias("skipped"),
    )


@query(f"""WITH {_F} SELECT id, path FROM f WHERE NOT regexp_matches(path, '(^|/)node_modules(/|$)|(^|/)[^/]*\\.min\\.js(/|$)|^vendor/(.*/)?')""")
def sc07_ignore_file(spark: SparkSession, folder: str) -> DataFrame:
    lines = ["# packages", "node_modules", "*.min.js", "!keep.js", "/vendor/**/"]
    return view(spark, folder, "f", "path", "language", "is_test", "is_generated").where(~X.ignored(F.col("path"), lines)).select("id", "path")


@query(f"""WITH {_F} SELECT id FROM f WHERE path LIKE 'src/%/Order%.php' ESCAPE '\\'""")
def pr06_glob(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "f", "path", "language", "is_test", "is_generated").where(F.col("path").like(X.glob_to_like("src/*/Order*.php"))).select("id")


@query(f"""WITH {_F} SELECT 'laravel' AS framework, count(*) AS files FROM f WHERE lower(coalesce(language, '')) = 'php' OR lower(coalesce(path, '')) LIKE '%.php'
UNION ALL SELECT 'vue', count(*) FROM f WHERE lower(coalesce(language, '')) = 'vue' OR lower(coalesce(path, '')) LIKE '%.vue'
UNION ALL SELECT 'node', count(*) FROM f WHERE lower(coalesce(language, '')) IN ('javascript', 'typescript') AND NOT lower(coalesce(path, '')) LIKE '%.vue'""")
def pr07_framework_predicates(spark: SparkSession, folder: str) -> DataFrame:
    f = view(spark, folder, "f", "path", "language", "is_test", "is_generated")
    flags = f.select(*[X.framework_is(x, F.col("language"), F.col("path")).alias(x) for x in ("laravel", "vue", "node")])
    counts = flags.agg(*[F.count_if(x).alias(x) for x in ("laravel", "vue", "node")])
    return counts.select(F.explode(F.create_map(*[y for x in ("laravel", "vue", "node") for y in (F.lit(x), F.col(x))])).alias("framework", "files"))


@query("SELECT file_id, sha256(content) AS hash FROM source_texts")
def in02_content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_texts").select("file_id", F.sha2("content", 256).alias("hash"))


@query("""SELECT t.file_id, CASE WHEN strlen(t.content) < 1 THEN 'skip' WHEN strlen(t.content) > 20971520 THEN 'reject' WHEN strlen(t.content) > 4096 THEN 'chunk' ELSE 'whole' END AS action, strlen(t.content) AS bytes FROM source_texts t""")
def ig02_size_policy(spark: SparkSession, folder: str) -> DataFrame:
    n = F.octet_length("content")
    action = F.when(n < 1, "skip").when(n > 20_971_520, "reject").when(n > 4096, "chunk").otherwise("whole")
    return table(spark, folder, "source_texts").select("file_id", action.alias("action"), n.cast("long").alias("bytes"))


@query("""SELECT file_id, starts_with(content, chr(65279)) AS has_bom, contains(content, chr(13) || chr(10)) AS has_crlf,
len(content) - len(replace(content, chr(10), '')) AS line_feeds FROM source_texts""")
def ig01_encoding(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("content")
    return table(spark, folder, "source_texts").select(
        "file_id",
        c.startswith("﻿").alias("has_bom"),
        F.contains(c, F.lit("\r\n")).alias("has_crlf"),
        (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("long").alias("line_feeds"),
    )


@query(f"""WITH {view_sql("s", "name", "file_id", "symbol_type")}, k AS (SELECT file_id, count(*) AS n, count(DISTINCT symbol_type) AS kinds FROM s GROUP BY file_id)
SELECT file_id, n AS symbols, kinds FROM k""")
def ig09_parse_maps(spark: SparkSession, folder: str) -> DataFrame:
    s = view(spark, folder, "s", "name", "file_id", "symbol_type")
    return s.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("symbol_type").alias("kinds"))


@query(f"""WITH {view_sql("s", "name", "start_line")}, p AS (SELECT id, name, row_number() OVER (ORDER BY id) AS rn FROM s WHERE id > 1500) SELECT id, name FROM p WHERE rn <= 50""")
def so03_keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "s", "name", "start_line").where("id > 1500").orderBy("id").limit(50).select("id", "name")


@query(f"""WITH {view_sql("a", "caller_symbol_id", "created_at")}, k AS (SELECT caller_symbol_id, created_at, lag(created_at) OVER (PARTITION BY caller_symbol_id ORDER BY created_at, id) AS before, row_number() OVER (PARTITION BY caller_symbol_id ORDER BY created_at, id) AS n FROM a)
SELECT caller_symbol_id, n, date_diff('day', before, created_at) AS days FROM k WHERE before IS NOT NULL""")
def wn05_gaps_between_calls(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("caller_symbol_id").orderBy("created_at", "id")
    a = view(spark, folder, "a", "caller_symbol_id", "created_at")
    return (
        a.select("caller_symbol_id", F.row_number().over(w).alias("n"), F.datediff("created_at", F.lag("created_at").over(w)).cast("long").alias("days"))
        .where("days is not null")
    )
