"""Queries of the ingest and refresh side: parsed rows, snapshots, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.sources import code
from symloom.sources import frameworks as W
from symloom.sources.graph import view
from symloom.sources.tables import table
from symloom.streaming import refresh


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_texts")


def pa01_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return code.parsed_symbols(_texts(spark, folder))


def pa02_imports(spark: SparkSession, folder: str) -> DataFrame:
    return code.parsed_imports(_texts(spark, folder))


def pa03_exports(spark: SparkSession, folder: str) -> DataFrame:
    return code.parsed_exports(_texts(spark, folder))


def pa04_calls(spark: SparkSession, folder: str) -> DataFrame:
    return code.parsed_calls(_texts(spark, folder))


def pa05_components(spark: SparkSession, folder: str) -> DataFrame:
    return code.parsed_components(_texts(spark, folder))


def pa09_routes(spark: SparkSession, folder: str) -> DataFrame:
    return code.parsed_routes(_texts(spark, folder))


def ig07_symbols_per_language(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder).select(F.col("file_id").alias("t_id"), "language")
    return (
        code.parsed_symbols(_texts(spark, folder))
        .join(texts, F.col("file_id") == F.col("t_id"))
        .groupBy("language", "symbol_type")
        .agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file_id").alias("files"))
    )


def in01_snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The files table against the texts that are there, by path and a hash of the content."""
    now = _texts(spark, folder).select(F.concat_ws(":", "repo_id", "path").alias("path"), F.sha2("content", 256).alias("content_hash"))
    before = view(spark, folder, "f", "repo_id", "path", "content_hash").select(F.concat_ws(":", "repo_id", "path").alias("path"), "content_hash")
    return refresh.changes(before, now).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


def in06_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return refresh.event_counts(table(spark, folder, "events"))


def in07_debounced_changes(spark: SparkSession, folder: str) -> DataFrame:
    return refresh.debounced(table(spark, folder, "events"), "user_id")


_SCRIPTS = "lower(language) in ('javascript', 'typescript', 'vue')"


def pa05_stores_and_composables(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.composables(t), "kind string, name string, line int", _SCRIPTS)


def pa06_react(spark: SparkSession, folder: str) -> DataFrame:
    schema = "name string, kind string, props array<string>, hooks array<string>, parts array<string>, line int"
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.react_components(t), schema, F.lower("language").isin("javascript", "typescript"))


def pa07_next_pages(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.next_page(p, t), "kind string, route string, method string", _SCRIPTS)


def pa08_node(spark: SparkSession, folder: str) -> DataFrame:
    """Routes and middleware of servers."""
    def rows(path: str, text: str, language: str) -> list[tuple]:
        routes = [("route", m, u, h, n) for m, u, h, n in code.routes(text)]
        return routes + [("middleware", verb, url, what, n) for _, verb, url, what, n in W.middlewares(text)]

    return W.rows_of(_texts(spark, folder), rows, "kind string, verb string, path string, what string, line int", F.lower("language").isin("javascript", "typescript"))


def pa09_laravel_routes(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.laravel_routes(t), "method string, path string, handler string, middleware string, line int", F.lower("language") == "php")


def pa09_laravel_classes(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.laravel_classes(t), "class string, kind string, member string, relation string, target string", F.lower("language") == "php")


def pa10_godot(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.godot(p, t), "kind string, name string, type string, parent string", F.lower("language") == "csharp")


def pa11_orm(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.orm_entities(t), "library string, entity string, field string, relation string, target string", _SCRIPTS)


def pa12_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.jobs(t), "kind string, library string, name string, line int", _SCRIPTS)


def pa13_tests(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.test_suites(t), "kind string, title string, line int, assertions int, mocks int")


def pa14_packages(spark: SparkSession, folder: str) -> DataFrame:
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: code.manifest(t), "section string, name string, version string", "ltrim(content) like '{%'")


def pa15_api_calls(spark: SparkSession, folder: str) -> DataFrame:
    """HTTP calls with constants put into their URLs."""
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.api_calls(t), "client string, method string, url string, line int", _SCRIPTS)


def pa04_call_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with their arguments and the kinds of these."""
    schema = "caller string, callee string, parameter_context string, parameter_types array<string>, line int"
    return W.rows_of(_texts(spark, folder), lambda p, t, lang: W.call_contexts(t, lang), schema)


def ig08_frameworks(spark: SparkSession, folder: str) -> DataFrame:
    """Frameworks of every repository with the number of files that speak for each, by kind of evidence."""
    found = W.rows_of(_texts(spark, folder), lambda p, t, lang: W.framework_evidence(p, t), "framework string, evidence string")
    repos = _texts(spark, folder).select(F.col("file_id").alias("t_id"), "repo_id")
    return found.join(repos, F.col("file_id") == F.col("t_id")).groupBy("repo_id", "framework", "evidence").agg(F.count_distinct("file_id").alias("files"))


def ig01_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of encoding, mark and line ends of every text, and its hash after normalisation."""
    found = W.rows_of(_texts(spark, folder), lambda p, t, lang: [W._encoding(t)], "encoding string, has_mark boolean, line_ends string, beyond_ascii double")
    hashes = _texts(spark, folder).select(F.col("file_id").alias("t_id"), F.sha2(W.normalised(F.col("content")), 256).alias("hash"))
    return found.join(hashes, F.col("file_id") == F.col("t_id")).select("file_id", "has_mark", "line_ends", "hash")


def ig02_size_policies(spark: SparkSession, folder: str) -> DataFrame:
    """What the policy in force for its repository does with every text."""
    from symloom.sources.tables import current_options

    p = current_options(table(spark, folder, "build_options")).select(F.col("repo_id").alias("o_repo"), "file_size_policy.*")
    n = F.octet_length("content").cast("long")
    many = F.ceil(n / F.col("chunking_threshold")) > F.coalesce("max_chunks_per_file", F.lit(100))
    action = (
        F.when(n < F.coalesce("min_file_size", F.lit(1)), "skip").when(n > F.coalesce("max_file_size", F.lit(20 << 20)), "reject").when((n > F.col("chunking_threshold")) & many, "truncate").when(n > F.col("chunking_threshold"), "chunk").otherwise("whole")
    )
    t = _texts(spark, folder).where("content is not null").join(p, F.col("repo_id") == F.col("o_repo"))
    return t.select("file_id", action.alias("action"), F.coalesce(n > F.col("warn_threshold"), F.lit(False)).alias("warned"))


def ig09_import_export_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Per file what it imports and exports, in one row."""
    i = code.parsed_imports(_texts(spark, folder)).groupBy(F.col("file_id").alias("i_id")).agg(F.array_sort(F.collect_set("source")).alias("imports"))
    e = code.parsed_exports(_texts(spark, folder)).groupBy(F.col("file_id").alias("e_id")).agg(F.array_sort(F.collect_set("name")).alias("exports"))
    return i.join(e, F.col("i_id") == F.col("e_id"), "full").select(F.coalesce("i_id", "e_id").alias("file_id"), F.array_join("imports", " ").alias("imports"), F.array_join("exports", " ").alias("exports"))


def ig07_merged_parse(spark: SparkSession, folder: str) -> DataFrame:
    """What all parsers find, merged: one row per file, kind and name with the parsers that found it."""
    texts = _texts(spark, folder)
    parts = [
        code.parsed_symbols(texts).select("file_id", F.col("symbol_type").alias("kind"), "name", F.lit("language").alias("parser")),
        W.rows_of(texts, lambda p, t, lang: [("component", c[0]) for c in W.react_components(t)], "kind string, name string", F.lower("language").isin("javascript", "typescript")).withColumn("parser", F.lit("react")),
        W.rows_of(texts, lambda p, t, lang: [(k, n) for k, n, _ in W.composables(t) if k in ("store", "composable")], "kind string, name string", _SCRIPTS).withColumn("parser", F.lit("vue")),
        W.rows_of(texts, lambda p, t, lang: [(c[1], c[0]) for c in W.laravel_classes(t)], "kind string, name string", F.lower("language") == "php").withColumn("parser", F.lit("laravel")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("file_id", "kind", "name").agg(F.array_join(F.array_sort(F.collect_set("parser")), ",").alias("parsers"))


def in05_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """An incremental refresh: symbols of changed and deleted files go, those parsed anew come, edges are relinked or dropped; rows by fate."""
    return refresh.refresh(view(spark, folder, "f", "repo_id", "path", "content_hash"), _texts(spark, folder), view(spark, folder, "s", "name", "qualified_name", "symbol_type", "file_id", "start_line"), view(spark, folder, "d", "from_symbol_id", "to_symbol_id", "to_qualified_name", "dependency_type"))


_MORE = (
    pa05_stores_and_composables, pa06_react, pa07_next_pages, pa08_node, pa09_laravel_routes, pa09_laravel_classes, pa10_godot, pa11_orm, pa12_jobs, pa13_tests, pa14_packages, pa15_api_calls, pa04_call_contexts,
    ig08_frameworks, ig01_encodings, ig02_size_policies, ig09_import_export_maps, ig07_merged_parse, in05_refreshed,
)
QUERIES = {
    f.__name__: f
    for f in (*_MORE, pa01_symbols, pa02_imports, pa03_exports, pa04_calls, pa05_components, pa09_routes, ig07_symbols_per_language, in01_snapshot_diff, in06_event_windows, in07_debounced_changes)
}

ORACLES = {
    "ig01_encodings": """SELECT file_id, starts_with(content, chr(65279)) AS has_mark, CASE WHEN lf = 0 THEN 'none' WHEN crlf = lf THEN 'crlf' WHEN crlf = 0 THEN 'lf' ELSE 'mixed' END AS line_ends,
sha256(regexp_replace(CASE WHEN starts_with(content, chr(65279)) THEN substr(content, 2) ELSE content END, '\\r\\n?', chr(10), 'g')) AS hash
FROM (SELECT *, len(content) - len(replace(content, chr(10), '')) AS lf, (len(content) - len(replace(content, chr(13) || chr(10), ''))) // 2 AS crlf FROM source_texts WHERE content IS NOT NULL)""",
    "ig02_size_policies": """WITH o AS (SELECT repo_id, file_size_policy AS p FROM build_options QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
SELECT file_id, CASE WHEN strlen(content) < coalesce(p.min_file_size, 1) THEN 'skip' WHEN strlen(content) > coalesce(p.max_file_size, 20971520) THEN 'reject' WHEN strlen(content) > p.chunking_threshold AND ceil(strlen(content) / p.chunking_threshold) > coalesce(p.max_chunks_per_file, 100) THEN 'truncate'
  WHEN strlen(content) > p.chunking_threshold THEN 'chunk' ELSE 'whole' END AS action, coalesce(strlen(content) > p.warn_threshold, false) AS warned FROM source_texts JOIN o USING (repo_id) WHERE content IS NOT NULL""",
    "in06_event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "in07_debounced_changes": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
h AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS first_at, count(*) AS events FROM h GROUP BY user_id, session""",
    "in01_snapshot_diff": """WITH b AS (SELECT concat_ws(':', repo_id, path) AS path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, repo_id DESC NULLS LAST, path DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn FROM files) WHERE rn = 1),
n AS (SELECT concat_ws(':', repo_id, path) AS path, sha256(content) AS content_hash FROM source_texts)
SELECT CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN b.content_hash IS DISTINCT FROM n.content_hash THEN 'changed' ELSE 'same' END AS state, count(*) AS files
FROM b FULL OUTER JOIN n ON n.path = b.path GROUP BY 1""",
}
