"""Relational operators over the code graph: lookups, joins, aggregates, windows, pages, sets.

Each takes a Graph and its parameters and declares a plan; nothing runs before
an action. Lookups become filters of the scan, semi- and anti-joins take the
place of IN and EXISTS, rankings within a group are aggregates of structs, so
that a hot group needs no sort, and limits stand on an order that is total.

Defined cases: nulls match nothing in joins and filters, and make a group of
their own in groupings; empty tables give no rows (totals give zeros).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.sources.graph import Graph

FRONTEND, BACKEND = ("javascript", "typescript", "vue"), ("php", "csharp")


def count_of(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def share(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, null where the whole is nothing."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2)


def has(column: str | Column, text: str) -> Column:
    """Substring test without regard to case."""
    c = F.col(column) if isinstance(column, str) else column
    return F.contains(F.lower(c), F.lit(text.lower()))


def first_of(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Of each group the row that is first in an order, by one aggregate; nulls of keys make a group too."""
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in keep])
    return df.groupBy(*keys).agg(F.min(packed).alias("first_")).select(*keys, *[F.col(f"first_.{c}").alias(c) for c in keep])


def most_called(g: Graph) -> DataFrame:
    """The symbol that most rows call: hot_id."""
    known = g.s("name").select(F.col("id").alias("k"))
    calls = g.d("to_symbol_id", "dependency_type").where("dependency_type = 'calls'").join(known, F.col("to_symbol_id") == F.col("k"), "left_semi")
    return calls.groupBy(F.col("to_symbol_id").alias("hot_id")).count().orderBy(F.desc("count"), "hot_id").limit(1).select("hot_id")


# scans and writes


def symbols_of_repository(g: Graph, repo_id: int) -> DataFrame:
    files = g.f("repo_id").where(F.col("repo_id") == repo_id).select(F.col("id").alias("f_id"), "repo_id")
    return g.s("name", "symbol_type", "file_id").join(files, F.col("file_id") == F.col("f_id")).select("repo_id", "id", "name", "symbol_type")


def described_after(g: Graph, after: int, size: int) -> DataFrame:
    """The next symbols with a description by id."""
    return g.s("name", "description").where((F.col("id") > after) & F.col("description").isNotNull()).orderBy("id").limit(size)


def upserted(g: Graph, *columns: str) -> DataFrame:
    """Files after all their rows are merged by id, the latest row winning."""
    return g.f(*columns)


def skip_rate(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows offered, rows stored when repeats of a key are left out, and the share left out."""
    n, kept = F.count(F.lit(1)), F.count_distinct(key)
    return rows.agg(n.alias("offered"), kept.alias("stored"), share(n - kept, n).alias("skipped_pct"))


def _gone(g: Graph, repo_id: int) -> DataFrame:
    files = g.f("repo_id").where(F.col("repo_id") == repo_id).select(F.col("id").alias("f_id"))
    return g.s("file_id").join(files, F.col("file_id") == F.col("f_id"), "left_semi").select(F.col("id").alias("gone_id"))


def without_repository(g: Graph, repo_id: int) -> DataFrame:
    """Edges that are left when a repository goes with its files, symbols and all edges at these."""
    gone = _gone(g, repo_id)
    d = g.d("from_symbol_id", "to_symbol_id")
    kept = d.join(gone, F.col("from_symbol_id") == F.col("gone_id"), "left_anti")
    return kept.join(gone, F.col("to_symbol_id") == F.col("gone_id"), "left_anti")


def unlinked_from_repository(g: Graph, repo_id: int) -> DataFrame:
    """All edges, those into a repository that goes without their target."""
    gone = _gone(g, repo_id)
    d = g.d("to_symbol_id").join(gone, F.col("to_symbol_id") == F.col("gone_id"), "left")
    return d.select("id", F.when(F.col("gone_id").isNull(), F.col("to_symbol_id")).alias("to_symbol_id"))


def exported_edges(g: Graph) -> DataFrame:
    """Rows of a graph database: symbols in files and typed edges: rel, start_id, end_id."""
    inside = g.s("file_id").where("file_id is not null").select(F.lit("IN_FILE").alias("rel"), F.col("id").alias("start_id"), F.col("file_id").alias("end_id"))
    typed = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("from_symbol_id is not null and to_symbol_id is not null")
    return inside.unionByName(typed.select(F.upper("dependency_type").alias("rel"), F.col("from_symbol_id").alias("start_id"), F.col("to_symbol_id").alias("end_id")).distinct())


def exported_nodes(g: Graph) -> DataFrame:
    """Nodes of a graph database: label, node_id and name (a file's is its path)."""
    files = g.f("path").select(F.lit("File").alias("label"), F.col("id").alias("node_id"), F.col("path").alias("name"))
    return files.unionByName(g.s("name").select(F.lit("Symbol").alias("label"), F.col("id").alias("node_id"), "name"))


def repositories_with_files(g: Graph) -> DataFrame:
    files = g.f("repo_id").groupBy(F.col("repo_id").alias("f_repo")).agg(count_of().alias("n"))
    return g.r("name", "language_primary").join(files, F.col("id") == F.col("f_repo"), "left").select("id", "name", "language_primary", F.coalesce("n", F.lit(0)).alias("files"))


# projections and filters


def symbol_by_id(g: Graph, symbol_id: int) -> DataFrame:
    return g.s("name", "qualified_name", "file_id").where(F.col("id") == symbol_id)


def symbols_by_ids(g: Graph, ids: DataFrame, *columns: str) -> DataFrame:
    """Symbols whose ids stand in the first column of a frame."""
    keys = ids.select(F.col(ids.columns[0]).alias("k")).distinct()
    return g.s(*columns).join(keys, F.col("id") == F.col("k"), "left_semi")


def callers_of_most_called(g: Graph) -> DataFrame:
    edges = g.d("from_symbol_id", "to_symbol_id").join(most_called(g), F.col("to_symbol_id") == F.col("hot_id"), "left_semi")
    return symbols_by_ids(g, edges.select("from_symbol_id"), "name", "symbol_type")


def file_by_path(g: Graph, exact: str, suffix: str, part: str) -> DataFrame:
    """The file whose path is equal, else ends so, else holds the part (LIKE patterns), with the step that found it."""
    path = F.col("path")
    step = F.when(path == exact, 1).when(path.like(suffix), 2).when(path.like(part), 3)
    return g.f("path").withColumn("priority", step).where("priority is not null").orderBy("priority", "path", "id").limit(1)


def names_with(g: Graph, text: str) -> DataFrame:
    """Symbols whose name holds a text, in which no character has a meaning."""
    return g.s("name").where(has("name", text))


def symbols_of_type(g: Graph, *types: str) -> DataFrame:
    return g.s("name", "symbol_type").where(F.col("symbol_type").isin(*types)).select("id", "name")


def files_of_language(g: Graph, language: str) -> DataFrame:
    return g.f("path", "language").where(F.lower("language") == language.lower()).select("id", "path")


def edges_of_types(g: Graph, include: list[str], exclude: list[str]) -> DataFrame:
    kind = F.col("dependency_type")
    wanted = kind.isin(*include) if include else F.lit(True)
    return g.d("dependency_type").where(wanted & ~kind.isin(*exclude) if exclude else wanted)


def names_like(g: Graph, *patterns: str) -> DataFrame:
    """Symbols whose name matches one of some regular expressions."""
    ok = F.lit(False)
    for p in patterns:
        ok = ok | F.col("name").rlike(p)
    return g.s("name").where(ok)


def _around(g: Graph, inner: list[str], outer: list[str]) -> DataFrame:
    """Pairs of symbols of one file of which the outer one's lines hold the inner one's."""
    i = g.prefixed("s", "i_", "file_id", "symbol_type", "start_line", "end_line").where(F.col("i_symbol_type").isin(*inner))
    o = g.prefixed("s", "o_", "file_id", "symbol_type", "start_line", "end_line").where(F.col("o_symbol_type").isin(*outer))
    on = (F.col("i_file_id") == F.col("o_file_id")) & (F.col("i_start_line") >= F.col("o_start_line")) & (F.col("i_end_line") <= F.col("o_end_line"))
    return i.join(o, on)


def containment(g: Graph, inner: list[str], outer: list[str]) -> DataFrame:
    return _around(g, inner, outer).select(F.col("o_id").alias("outer_id"), F.col("i_id").alias("inner_id"))


def modified_since_indexed(g: Graph) -> DataFrame:
    r = g.prefixed("r", "r_", "last_indexed")
    return g.f("path", "repo_id", "last_modified").join(r, (F.col("repo_id") == F.col("r_id")) & (F.col("last_modified") > F.col("r_last_indexed"))).select("id", "path")


def stacks_of_at_least(g: Graph, n: int) -> DataFrame:
    return g.r("name", "framework_stack").where(F.size("framework_stack") >= n).select("id", "name")


def with_framework_symbol(g: Graph, symbol_type: str) -> DataFrame:
    """Symbols of a type with the symbol of their framework that has their name."""
    x = g.prefixed("x", "x_", "name", "framework", "qualified_name")
    s = g.s("name", "framework", "symbol_type").where(F.col("symbol_type") == symbol_type)
    return s.join(x, (F.col("name") == F.col("x_name")) & (F.col("framework") == F.col("x_framework")), "left").select("id", "name", F.col("x_qualified_name").alias("framework_name"))


def json_rows(g: Graph) -> DataFrame:
    blank = F.lit("")
    row = F.struct("id", F.coalesce("name", blank).alias("name"), F.coalesce("symbol_type", blank).alias("type"))
    return g.s("name", "symbol_type").select("id", F.to_json(row).alias("response"))


def nested_rows(g: Graph, *types: str) -> DataFrame:
    """Edges of some types with both ends as structs that hold their file: id, from_symbol, to_symbol."""
    def end(p: str) -> Column:
        inner = F.struct(F.col(f"{p}f_id").alias("id"), F.col(f"{p}f_path").alias("path"))
        return F.when(F.col(f"{p}id").isNotNull(), F.struct(F.col(f"{p}id").alias("id"), F.col(f"{p}name").alias("name"), inner.alias("file")))

    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where(F.col("dependency_type").isin(*types))
    both = d.join(g.placed("a_"), F.col("from_symbol_id") == F.col("a_id"), "left").join(g.placed("b_"), F.col("to_symbol_id") == F.col("b_id"), "left")
    return both.select("id", end("a_").alias("from_symbol"), end("b_").alias("to_symbol"))


def nested_json(g: Graph, *types: str) -> DataFrame:
    """nested_rows() with each end as JSON, nulls kept."""
    keep = {"ignoreNullFields": "false"}
    return nested_rows(g, *types).select("id", F.to_json("from_symbol", keep).alias("from_symbol"), F.to_json("to_symbol", keep).alias("to_symbol"))


def routes(g: Graph, method: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct endpoints of a method whose path holds a text."""
    out = g.a("http_method", "endpoint_path").select(F.upper("http_method").alias("method"), "endpoint_path")
    if method:
        out = out.where(F.col("method") == method.upper())
    if text:
        out = out.where(has("endpoint_path", text))
    out = out.distinct()
    return out if limit is None else out.orderBy("method", "endpoint_path").limit(limit)


def components(g: Graph) -> DataFrame:
    s = g.placed("", ("name", "symbol_type", "entity_type")).where("f_id is not null")
    return s.where("symbol_type = 'component' or entity_type = 'component'").select("id", "name", F.col("f_path").alias("path"))


def entities_named(g: Graph, entity_type: str, text: str) -> DataFrame:
    return g.s("name", "entity_type").where((F.col("entity_type") == entity_type) & has("name", text)).select("id", "name")


def nodes_with_scenes(g: Graph) -> DataFrame:
    scenes = g.prefixed("s", "p_", "symbol_type").where("p_symbol_type = 'godot_scene'")
    nodes = g.s("name", "symbol_type", "parent_symbol_id").where("symbol_type = 'godot_node'")
    return nodes.join(scenes, F.col("parent_symbol_id") == F.col("p_id"), "left").select(F.col("id").alias("node_id"), "name", F.col("p_id").alias("scene_id"))


def roots_with_children(g: Graph, symbol_type: str) -> DataFrame:
    children = g.s("parent_symbol_id").where("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").alias("c_id")).agg(count_of().alias("n"))
    roots = g.s("name", "parent_symbol_id", "symbol_type").where((F.col("symbol_type") == symbol_type) & F.col("parent_symbol_id").isNull())
    return roots.join(children, F.col("id") == F.col("c_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("children"))


# joins


def symbols_with_files(g: Graph) -> DataFrame:
    return g.placed().where("f_id is not null").select("id", "name", F.col("f_path").alias("path"))


def edges_with_ends(g: Graph) -> DataFrame:
    """Every edge with names and paths of both ends, as far as they are known."""
    d = g.d("from_symbol_id", "to_symbol_id")
    both = d.join(g.placed("a_"), F.col("from_symbol_id") == F.col("a_id"), "left").join(g.placed("b_"), F.col("to_symbol_id") == F.col("b_id"), "left")
    return both.select("id", F.col("a_name").alias("from_name"), F.col("a_f_path").alias("from_path"), F.col("b_name").alias("to_name"), F.col("b_f_path").alias("to_path"))


def distinct_callers(g: Graph) -> DataFrame:
    """Who refers to the most called symbol, and how."""
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("from_symbol_id <> to_symbol_id")
    at = d.join(most_called(g), F.col("to_symbol_id") == F.col("hot_id"), "left_semi").select("from_symbol_id", "dependency_type").distinct()
    return at.join(g.prefixed("s", "s_", "name"), F.col("from_symbol_id") == F.col("s_id"), "left").select("from_symbol_id", "dependency_type", F.col("s_name").alias("name"))


def file_edges_of_type(g: Graph, kind: str) -> DataFrame:
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where(F.col("dependency_type") == kind)
    both = d.join(g.placed("a_"), F.col("from_symbol_id") == F.col("a_id")).join(g.placed("b_"), F.col("to_symbol_id") == F.col("b_id"))
    return both.where("a_f_id is not null and b_f_id is not null").select("id", F.col("a_f_path").alias("from_path"), F.col("b_f_path").alias("to_path"))


def calls_with_endpoint(g: Graph) -> DataFrame:
    a = g.a("caller_symbol_id", "endpoint_symbol_id")
    both = a.join(g.prefixed("s", "e_", "name"), F.col("endpoint_symbol_id") == F.col("e_id")).join(g.placed("c_"), F.col("caller_symbol_id") == F.col("c_id"))
    return both.select("id", F.col("c_name").alias("caller"), F.col("e_name").alias("endpoint"), F.col("c_f_path").alias("path"))


def calls_per_symbol(g: Graph, kind: str = "calls") -> DataFrame:
    """Rows of a type into every symbol, zeros included."""
    n = g.d("to_symbol_id", "dependency_type").where(F.col("dependency_type") == kind).groupBy("to_symbol_id").agg(count_of().alias("n"))
    return g.s("name").join(n, F.col("id") == F.col("to_symbol_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("calls"))


def never_called(g: Graph, *types: str) -> DataFrame:
    called = g.d("to_symbol_id", "dependency_type").where("dependency_type = 'calls'")
    return g.s("name", "symbol_type").where(F.col("symbol_type").isin(*types)).join(called.select("to_symbol_id"), F.col("id") == F.col("to_symbol_id"), "left_anti").select("id", "name")


def unknown_targets(g: Graph) -> DataFrame:
    """Unresolved edges, imports aside, whose name no symbol has."""
    known = g.s("qualified_name").where("qualified_name is not null").select("qualified_name")
    d = g.d("to_symbol_id", "dependency_type", "to_qualified_name").where("to_symbol_id is null and dependency_type <> 'imports'")
    return d.join(known, F.col("to_qualified_name") == F.col("qualified_name"), "left_anti").select("id")


def symbols_of_primary_language(g: Graph, language: str) -> DataFrame:
    repos = g.r("language_primary").where(F.col("language_primary") == language).select(F.col("id").alias("r_id"))
    files = g.f("repo_id").join(repos, F.col("repo_id") == F.col("r_id"), "left_semi").select(F.col("id").alias("f_id"))
    return g.s("name", "file_id").join(files, F.col("file_id") == F.col("f_id"), "left_semi").select("id", "name")


def files_without_text(g: Graph) -> DataFrame:
    texts = g.table("source_texts").select(F.col("repo_id").alias("t_repo"), F.col("path").alias("t_path"))
    return g.f("repo_id", "path").join(texts, (F.col("repo_id") == F.col("t_repo")) & (F.col("path") == F.col("t_path")), "left_anti").select("id")


def two_hop_degree(g: Graph, *types: str) -> DataFrame:
    """Distinct symbols two edges away from each symbol; an edge's targets join as one row per middle symbol."""
    e = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("from_symbol_id is not null and to_symbol_id is not null")
    if types:
        e = e.where(F.col("dependency_type").isin(*types))
    e = e.select(F.col("from_symbol_id").alias("a"), F.col("to_symbol_id").alias("b")).distinct()
    return e.alias("x").join(e.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("id"), F.col("y.b").alias("far")).distinct().groupBy("id").agg(count_of().alias("two_hops"))


def container_paths(g: Graph) -> DataFrame:
    methods = g.s("symbol_type").where("symbol_type = 'method'").select(F.col("id").alias("m_id"))
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("dependency_type = 'contains'").join(methods, F.col("to_symbol_id") == F.col("m_id"), "left_semi")
    return d.join(g.placed("c_", ()), F.col("from_symbol_id") == F.col("c_id")).where("c_f_id is not null").select(F.col("to_symbol_id").alias("method_id"), F.col("c_id").alias("container_id"), F.col("c_f_path").alias("path"))


def service_calls(g: Graph, entity_type: str = "service") -> DataFrame:
    """Callers of methods whose parent is of an entity type."""
    services = g.prefixed("s", "p_", "entity_type").where(F.col("p_entity_type") == entity_type)
    methods = g.prefixed("s", "m_", "symbol_type", "parent_symbol_id").where("m_symbol_type = 'method'").join(services, F.col("m_parent_symbol_id") == F.col("p_id"))
    calls = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("dependency_type = 'calls'")
    return calls.join(methods, F.col("to_symbol_id") == F.col("m_id")).select(F.col("from_symbol_id").alias("caller_id"), F.col("p_id").alias("service_id")).distinct()


def interface_pairs(g: Graph) -> DataFrame:
    """Methods of interfaces and those of the same name in classes that implement them."""
    im = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("dependency_type = 'implements'").select(F.col("from_symbol_id").alias("class_id"), F.col("to_symbol_id").alias("interface_id")).distinct()
    a, b = g.prefixed("s", "a_", "name", "parent_symbol_id"), g.prefixed("s", "b_", "name", "parent_symbol_id")
    joined = im.join(a, F.col("a_parent_symbol_id") == F.col("interface_id")).join(b, (F.col("b_parent_symbol_id") == F.col("class_id")) & (F.col("b_name") == F.col("a_name")))
    return joined.select("interface_id", "class_id", F.col("a_id").alias("interface_method"), F.col("b_id").alias("class_method"))


def first_container(g: Graph) -> DataFrame:
    """Of each method the class or interface around it with the smallest id."""
    pairs = _around(g, ["method"], ["class", "interface"]).where("i_id <> o_id")
    return pairs.groupBy(F.col("i_id").alias("child_id")).agg(F.min("o_id").alias("parent_id"))


def innermost_class(g: Graph) -> DataFrame:
    pairs = _around(g, ["method", "property"], ["class"]).where("i_id <> o_id").select(F.col("i_id").alias("inner_id"), F.col("o_id").alias("outer_id"), (F.col("o_end_line") - F.col("o_start_line")).alias("span"))
    return first_of(pairs, ["inner_id"], [F.col("span")], ["outer_id"])


def symbols_per_file(g: Graph) -> DataFrame:
    per = g.s("file_id", "symbol_type").groupBy("file_id").agg(count_of().alias("n"), F.count_distinct("symbol_type").alias("k"))
    zero = F.lit(0)
    return g.f("path").join(per, F.col("id") == F.col("file_id"), "left").select("id", F.coalesce("n", zero).alias("symbols"), F.coalesce("k", zero).alias("kinds"))


def share_of_languages(g: Graph) -> DataFrame:
    files = g.f("language").groupBy("language").agg(count_of().alias("files"))
    total = files.agg(F.sum("files").alias("total"))
    return files.join(F.broadcast(total)).select("language", "files", share(F.col("files"), F.col("total")).alias("pct"))


def entity_lookup(g: Graph) -> DataFrame:
    """Every id that is an endpoint, a component or a framework's symbol, with the first of these that it is."""
    sources = [g.a("endpoint_symbol_id").where("endpoint_symbol_id is not null").select(F.col("endpoint_symbol_id").alias("id")), g.s("symbol_type").where("symbol_type = 'component'").select("id"), g.x("name").select("id")]
    out = None
    for rank, (kind, df) in enumerate(zip(("endpoint", "component", "framework"), sources, strict=True)):
        part = df.select("id", F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind")).alias("k"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.min("k").alias("k")).select("id", F.col("k.kind").alias("kind"))


def latest_edges_of(g: Graph, n: int) -> DataFrame:
    """Of every file its n greatest outgoing edges by line, the rows that a lateral join would give."""
    s = g.prefixed("s", "s_", "file_id").where("s_file_id is not null")
    d = g.d("from_symbol_id", "line_number").where("line_number is not null").join(s, F.col("from_symbol_id") == F.col("s_id")).select("s_file_id", "line_number", "id")
    order = Window.partitionBy("s_file_id").orderBy(F.desc("line_number"), F.asc("id"))
    return d.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(F.col("s_file_id").alias("file_id"), "id", "line_number", "place")


# aggregates


def totals(g: Graph, **counts: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame; frames are counted side by side."""
    rows = None
    for name, df in counts.items():
        part = df.select(F.lit(name).alias("name"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.count_if(F.col("name") == n).alias(n) for n in counts])


def ends_per_type(g: Graph) -> DataFrame:
    return g.d("from_symbol_id", "to_symbol_id", "dependency_type").groupBy("dependency_type").agg(F.count_distinct("from_symbol_id").alias("callers"), F.count_distinct("to_symbol_id").alias("callees"))


def distinct_tuples(g: Graph, *columns: str) -> DataFrame:
    return g.d(*columns).select(*columns).distinct().agg(count_of().alias("tuples"))


def file_flags_per_repository(g: Graph) -> DataFrame:
    return g.f("repo_id", "is_test", "is_generated").groupBy("repo_id").agg(count_of(F.col("is_test")).alias("tests"), count_of(F.col("is_generated")).alias("generated"), count_of().alias("files"))


def frequent_names(g: Graph, more_than: int) -> DataFrame:
    return g.s("name").groupBy("name").agg(count_of().alias("n")).where(F.col("n") > more_than)


def files_by_ending(g: Graph, endings: dict[str, str]) -> DataFrame:
    kind = F.lit("other")
    for ending, name in reversed(endings.items()):
        kind = F.when(F.col("path").endswith(ending), name).otherwise(kind)
    return g.f("path", "size").groupBy(kind.alias("kind")).agg(count_of().alias("files"), F.sum("size").alias("bytes"))


def first_id_per_pair(g: Graph) -> DataFrame:
    return g.d("from_symbol_id", "to_symbol_id").where("to_symbol_id is not null").groupBy("from_symbol_id", "to_symbol_id").agg(F.min("id").alias("id"))


def described_share(g: Graph) -> DataFrame:
    return g.s("symbol_type", "description").groupBy("symbol_type").agg(count_of().alias("n"), share(F.count("description"), count_of()).alias("described_pct"))


def line_statistics(g: Graph) -> DataFrame:
    n = F.col("end_line") - F.col("start_line")
    return g.s("symbol_type", "start_line", "end_line").groupBy("symbol_type").agg(F.round(F.avg(n), 4).alias("mean_lines"), F.min(n).alias("least"), F.max(n).alias("most"))


def languages_per_repository(g: Graph) -> DataFrame:
    k = g.f("repo_id", "language").where("language is not null").select("repo_id", F.lower("language").alias("lang"))
    return k.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("languages"))


def parameter_groups(g: Graph) -> DataFrame:
    d = g.d("from_symbol_id", "to_symbol_id", "parameter_context", "line_number").where("parameter_context is not null and to_symbol_id is not null")
    return d.groupBy("to_symbol_id", "parameter_context").agg(count_of().alias("calls"), F.count_distinct("from_symbol_id").alias("callers"), F.min("line_number").alias("first_line"))


def parameter_insights(g: Graph) -> DataFrame:
    d = g.d("to_symbol_id", "parameter_context").where("to_symbol_id is not null")
    return d.groupBy("to_symbol_id").agg(F.count_distinct("parameter_context").alias("patterns"), count_of(F.contains("parameter_context", F.lit("null"))).alias("null_patterns")).where("patterns > 1")


def call_health(g: Graph, tolerated: float = 0.1) -> DataFrame:
    """Calls, calls without an endpoint, and whether these are more than a share of all."""
    n = g.a("endpoint_symbol_id").agg(count_of().alias("calls"), count_of(F.col("endpoint_symbol_id").isNull()).alias("orphans"))
    return n.withColumn("status", F.when(F.col("orphans") > F.col("calls") * tolerated, "degraded").otherwise("healthy"))


def frameworks_per_repository(g: Graph) -> DataFrame:
    s = g.placed("", ("framework",), ("repo_id",)).where("framework is not null and f_id is not null")
    return s.select(F.col("f_repo_id").alias("repo_id"), "framework").distinct()


def methods_per_repository(g: Graph) -> DataFrame:
    m = F.upper("http_method")
    return g.a("repo_id", "http_method").groupBy("repo_id").agg(count_of(m == "GET").alias("get_calls"), count_of(m == "POST").alias("post_calls"), count_of(~m.isin("GET", "POST")).alias("other_calls"))


def type_lists_per_repository(g: Graph) -> DataFrame:
    k = g.placed("", ("symbol_type",), ("repo_id",)).where("f_id is not null").groupBy(F.col("f_repo_id").alias("repo_id"), "symbol_type").agg(count_of().alias("n"))
    parts = F.array_sort(F.collect_list(F.concat(F.coalesce("symbol_type", F.lit("")), F.lit(":"), F.col("n").cast("string"))))
    return k.groupBy("repo_id").agg(F.array_join(parts, ", ").alias("parts"))


def first_edge_per_pair(g: Graph) -> DataFrame:
    d = g.d("from_symbol_id", "to_symbol_id", "line_number").where("to_symbol_id is not null")
    return first_of(d, ["from_symbol_id", "to_symbol_id"], [F.col("id")], ["id", "line_number"])


def most_complete(g: Graph) -> DataFrame:
    """Of symbols with one name and file the one that says most: signature, export, description, qualified name."""
    flag = lambda c: F.when(c, 0).otherwise(1)
    s = g.s("name", "file_id", "signature", "is_exported", "description", "qualified_name")
    order = [flag(F.col("signature").isNotNull()), flag(F.col("is_exported")), flag(F.col("description").isNotNull()), flag(F.col("qualified_name").isNotNull())]
    return first_of(s, ["name", "file_id"], order, ["id"])


def specific_then_short(g: Graph) -> DataFrame:
    """Of symbols with one name the one with an entity type, then the shortest path."""
    s = g.placed("", ("name", "entity_type")).where("f_id is not null")
    # a null length comes last
    order = [F.when(F.col("entity_type").isNotNull(), 0).otherwise(1), F.coalesce(F.length("f_path"), F.lit(2**31 - 1)), F.col("id")]
    return first_of(s, ["name"], order, ["id", "entity_type"])


def large_files(g: Graph, more_than: int, limit: int) -> DataFrame:
    k = g.s("file_id", "end_line").groupBy("file_id").agg(count_of().alias("symbols"), F.max("end_line").alias("last_line"))
    return k.where(F.col("symbols") > more_than).orderBy(F.desc("last_line"), "file_id").limit(limit)


def primary_language(g: Graph) -> DataFrame:
    k = g.f("repo_id", "language").where("language is not null").groupBy("repo_id", F.lower("language").alias("lang")).agg(count_of().alias("n"))
    return first_of(k, ["repo_id"], [-F.col("n"), F.col("lang")], ["lang", "n"])


# windows


def keep_latest(g: Graph) -> DataFrame:
    """The edge with the greatest id of each source, name, type and line."""
    return g.d("from_symbol_id", "to_qualified_name", "dependency_type", "line_number").groupBy("from_symbol_id", "to_qualified_name", "dependency_type", "line_number").agg(F.max("id").alias("id")).select("id")


def samples_per_type(g: Graph, n: int) -> DataFrame:
    order = Window.partitionBy("symbol_type").orderBy("id")
    return g.s("symbol_type", "name").withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("symbol_type", "id", "name")


def siblings(g: Graph) -> DataFrame:
    """Children with the number of children of their parent; the counts are joined back, so no parent is one task's window."""
    s = g.s("parent_symbol_id").where("parent_symbol_id is not null")
    n = s.groupBy(F.col("parent_symbol_id").alias("p")).agg(count_of().alias("siblings"))
    return s.join(n, F.col("parent_symbol_id") == F.col("p")).select("id", "parent_symbol_id", "siblings")


def share_within_type(g: Graph) -> DataFrame:
    k = g.s("symbol_type", "entity_type").groupBy("symbol_type", "entity_type").agg(count_of().alias("n"))
    return k.select("symbol_type", "entity_type", "n", share(F.col("n"), F.sum("n").over(Window.partitionBy("symbol_type"))).alias("pct"))


# order and pages


def longest_symbols(g: Graph, limit: int) -> DataFrame:
    n = (F.col("end_line") - F.col("start_line")).alias("lines")
    return g.s("name", "start_line", "end_line").select("id", "name", n).where("lines is not null").orderBy(F.desc("lines"), "id").limit(limit)


def first_by_rank(g: Graph, *types: str) -> DataFrame:
    """One symbol, of the first of some types that has any."""
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("symbol_type"))
    return g.s("name", "symbol_type").where(F.col("symbol_type").isin(*types)).orderBy(rank, "id").limit(1)


def page_after(g: Graph, after: int, size: int) -> DataFrame:
    """A page of symbols by id after a cursor, with whether another follows."""
    rows = g.s("name").where(F.col("id") > after).orderBy("id").limit(size + 1)
    order = Window.orderBy("id")
    return rows.withColumns({"n": F.row_number().over(order), "all": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))}).where(F.col("n") <= size).select("id", "name", (F.col("all") > size).alias("has_more"))


def page_at(g: Graph, offset: int, size: int) -> DataFrame:
    return g.s("name").orderBy("id").offset(max(0, offset)).limit(max(1, min(size, 5_000)))


def page_with_total(g: Graph, size: int) -> DataFrame:
    total = g.s("name").agg(count_of().alias("total"))
    return page_at(g, 0, size).join(F.broadcast(total))


def callers_page(g: Graph, after: int, size: int) -> DataFrame:
    d = g.d("from_symbol_id", "to_symbol_id").where(F.col("from_symbol_id") > after).join(most_called(g), F.col("to_symbol_id") == F.col("hot_id"), "left_semi")
    return d.groupBy("from_symbol_id").agg(count_of().alias("calls")).orderBy("from_symbol_id").limit(size)


def truncated_by_rank(g: Graph, limit: int) -> DataFrame:
    rank = F.when(F.col("is_exported"), 3).when(F.col("visibility") == "private", 1).otherwise(2).alias("pr")
    return g.s("is_exported", "visibility").select("id", rank).orderBy("pr", "id").limit(limit)


def types_in_order(g: Graph, order: list[str]) -> DataFrame:
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("symbol_type")), F.lit(0)), F.lit(len(order) + 1))
    return g.s("symbol_type").groupBy("symbol_type").agg(count_of().alias("n")).select("symbol_type", "n", place.alias("place")).orderBy("place", "symbol_type")


def most_referred(g: Graph, least: int, limit: int) -> DataFrame:
    n = g.d("to_symbol_id").where("to_symbol_id is not null").groupBy("to_symbol_id").agg(count_of().alias("n"))
    return n.where(F.col("n") >= least).orderBy(F.desc("n"), "to_symbol_id").limit(limit)


def samples_with_totals(g: Graph, n: int) -> DataFrame:
    s = g.s("entity_type").where("entity_type is not null")
    total = s.groupBy(F.col("entity_type").alias("t")).agg(count_of().alias("total"))
    order = Window.partitionBy("entity_type").orderBy("id")
    first = s.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    return first.join(total, F.col("entity_type") == F.col("t")).select("entity_type", "id", "total")


def pruned_queue(queue: DataFrame, most: int) -> DataFrame:
    """What a bounded queue keeps of (node, depth): the nearest nodes, ties by id."""
    return queue.orderBy("depth", "node").limit(most)


# sets


def labelled_metrics(g: Graph) -> DataFrame:
    rows = totals(g, files=g.f("path"), symbols=g.s("name"), edges=g.d("line_number"), api_calls=g.a("line_number"))
    return rows.select(F.explode(F.create_map(*[x for n in rows.columns for x in (F.lit(n), F.col(n))])).alias("metric", "value"))


def all_edges(g: Graph) -> DataFrame:
    """Edges and API calls in one shape: src, dst, kind."""
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), F.col("dependency_type").alias("kind"))
    return d.unionByName(g.a("caller_symbol_id", "endpoint_symbol_id").select(F.col("caller_symbol_id").alias("src"), F.col("endpoint_symbol_id").alias("dst"), F.lit("api_call").alias("kind")))


def new_relationships(g: Graph) -> DataFrame:
    """Pairs that API calls link and no edge does."""
    calls = g.a("caller_symbol_id", "endpoint_symbol_id").where("endpoint_symbol_id is not null").select(F.col("caller_symbol_id").alias("src"), F.col("endpoint_symbol_id").alias("dst")).distinct()
    d = g.d("from_symbol_id", "to_symbol_id")
    return calls.join(d, (F.col("src") == F.col("from_symbol_id")) & (F.col("dst") == F.col("to_symbol_id")), "left_anti")


def parents_with_edges(g: Graph) -> DataFrame:
    """Ids that are parents of symbols and also contain something by an edge."""
    parents = g.s("parent_symbol_id").where("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("id")).distinct()
    holders = g.d("from_symbol_id", "dependency_type").where("dependency_type = 'contains'").select("from_symbol_id")
    return parents.join(holders, F.col("id") == F.col("from_symbol_id"), "left_semi")


def linked_ids(g: Graph) -> DataFrame:
    """Union of all ids that stand at an end of an edge or a call."""
    ends = all_edges(g).select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.where("id is not null").distinct()


# lookups of impact and framework data


def tests_touched(g: Graph) -> DataFrame:
    """Test files with a symbol that refers to the most called symbol."""
    d = g.d("from_symbol_id", "to_symbol_id").join(most_called(g), F.col("to_symbol_id") == F.col("hot_id"), "left_semi").select("from_symbol_id").distinct()
    s = g.placed("", ()).where(F.contains("f_path", F.lit("test")) | F.contains("f_path", F.lit("spec")))
    return s.join(d, F.col("id") == F.col("from_symbol_id"), "left_semi").select(F.col("f_id").alias("file_id"), F.col("f_path").alias("path")).distinct()


def impact_sets(g: Graph, ids: DataFrame) -> DataFrame:
    """Routes, jobs and tests that symbols (id) touch: kind and symbol_id."""
    keys = ids.select(F.col("id").alias("k")).distinct()
    routes_ = g.a("endpoint_symbol_id").join(keys, F.col("endpoint_symbol_id") == F.col("k"), "left_semi").select(F.lit("route").alias("kind"), F.col("endpoint_symbol_id").alias("symbol_id"))
    s = g.placed("", ("name",)).join(keys, F.col("id") == F.col("k"), "left_semi")
    jobs = s.where(has("f_path", "/jobs/") | F.col("name").endswith("Job")).select(F.lit("job").alias("kind"), F.col("id").alias("symbol_id"))
    tests = s.where(has("f_path", "test") | has("f_path", "spec")).select(F.lit("test").alias("kind"), F.col("id").alias("symbol_id"))
    return routes_.unionByName(jobs).unionByName(tests).distinct()


def implementations(g: Graph) -> DataFrame:
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("dependency_type = 'implements' and to_symbol_id is not null")
    return d.select(F.col("to_symbol_id").alias("interface_id"), F.col("from_symbol_id").alias("class_id")).distinct()


def relatives(g: Graph, symbol_id: int) -> DataFrame:
    """Callers, callees, implementations and parents of one symbol: relation and other_id."""
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where((F.col("from_symbol_id") == symbol_id) | (F.col("to_symbol_id") == symbol_id))
    to, kind = F.col("to_symbol_id") == symbol_id, F.col("dependency_type")
    relation = (
        F.when(to & (kind == "calls"), "caller").when(to & kind.isin("implements", "inherits"), "implementation").when(~to & (kind == "calls"), "callee").when(~to & kind.isin("implements", "inherits"), "parent")
    )
    other = F.when(to, F.col("from_symbol_id")).otherwise(F.col("to_symbol_id"))
    return d.select(relation.alias("relation"), other.alias("other_id")).where("relation is not null and other_id is not null").distinct()


def self_calls(g: Graph) -> DataFrame:
    return g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("from_symbol_id = to_symbol_id and dependency_type = 'calls'").select(F.col("from_symbol_id").alias("id")).distinct()


def unused_functions(g: Graph) -> DataFrame:
    called = g.d("to_symbol_id", "dependency_type").where("dependency_type = 'calls'").select("to_symbol_id")
    s = g.s("name", "symbol_type", "is_exported").where("symbol_type = 'function' and not coalesce(is_exported, false)")
    return s.join(called, F.col("id") == F.col("to_symbol_id"), "left_anti").select("id", "name")


def complexity(g: Graph) -> DataFrame:
    """1 + distinct callees + half of the distinct callers + 2 for each parent."""
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where(F.col("dependency_type").isin("calls", "inherits", "implements"))
    call = F.col("dependency_type") == "calls"
    out = d.groupBy(F.col("from_symbol_id").alias("o")).agg(F.count_distinct(F.when(call, F.col("to_symbol_id"))).alias("callees"), F.count_distinct(F.when(~call, F.col("to_symbol_id"))).alias("parents"))
    into = d.where(call).groupBy(F.col("to_symbol_id").alias("i")).agg(F.count_distinct("from_symbol_id").alias("callers"))
    zero = F.lit(0)
    value = 1 + F.coalesce("callees", zero) + F.floor(F.coalesce("callers", zero) / 2) + 2 * F.coalesce("parents", zero)
    return g.s("name").join(out, F.col("id") == F.col("o"), "left").join(into, F.col("id") == F.col("i"), "left").select("id", value.cast("long").alias("complexity"))


def _between_files(g: Graph, symbols: tuple[str, ...] = (), files: tuple[str, ...] = ("path",), kind: str | None = None, *more: str) -> DataFrame:
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type", *more)
    if kind:
        d = d.where(F.col("dependency_type") == kind)
    return d.join(g.placed("a_", symbols, files), F.col("from_symbol_id") == F.col("a_id")).join(g.placed("b_", symbols, files), F.col("to_symbol_id") == F.col("b_id"))


def file_importers(g: Graph) -> DataFrame:
    return _between_files(g, kind="imports").where("a_f_id <> b_f_id").select(F.col("b_f_id").alias("file_id"), F.col("a_f_id").alias("importer_id")).distinct()


def file_edges(g: Graph) -> DataFrame:
    """Edges between symbols rolled up to their files."""
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type", "line_number")
    both = d.join(g.prefixed("s", "a_", "file_id"), F.col("from_symbol_id") == F.col("a_id")).join(g.prefixed("s", "b_", "file_id"), F.col("to_symbol_id") == F.col("b_id"))
    return both.where("a_file_id <> b_file_id").groupBy(F.col("a_file_id").alias("from_file"), F.col("b_file_id").alias("to_file"), "dependency_type").agg(F.min("line_number").alias("line_number"), count_of().alias("edges"))


def impact_classes(g: Graph) -> DataFrame:
    kind = F.col("dependency_type")
    value = F.when(kind.isin("api_call", "shares_schema", "frontend_backend"), "cross_stack").when(kind == "implements", "interface_contract").when(kind == "inherits", "implementation").when(F.col("calling_object").isNotNull(), "delegation").otherwise("direct")
    return g.d("dependency_type", "calling_object").select("id", value.alias("impact"))


def cross_stack_impact(g: Graph) -> DataFrame:
    """Per endpoint the distinct callers on the one side and callees on the other, each counted before they meet."""
    front = g.a("caller_symbol_id", "endpoint_symbol_id").where("endpoint_symbol_id is not null").groupBy(F.col("endpoint_symbol_id").alias("backend_id")).agg(F.count_distinct("caller_symbol_id").alias("frontend_symbols"))
    back = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("dependency_type = 'calls'").groupBy("from_symbol_id").agg(F.count_distinct("to_symbol_id").alias("n"))
    return front.join(back, F.col("backend_id") == F.col("from_symbol_id"), "left").select("backend_id", "frontend_symbols", F.coalesce("n", F.lit(0)).alias("backend_symbols"))


def dependencies_of_types(g: Graph, *types: str) -> DataFrame:
    """Distinct edges of some types with name and path of the target."""
    c = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where(F.col("dependency_type").isin(*types) & F.expr("to_symbol_id is not null and from_symbol_id <> to_symbol_id")).select("from_symbol_id", "to_symbol_id", "dependency_type").distinct()
    return c.join(g.placed("s_"), F.col("to_symbol_id") == F.col("s_id")).select("from_symbol_id", "to_symbol_id", "dependency_type", F.col("s_name").alias("name"), F.col("s_f_path").alias("path"))


def database_operations(g: Graph, verbs: dict[tuple[str, ...], str]) -> DataFrame:
    """Functions and methods whose name starts like one that stores or reads, by language."""
    is_db = F.lit(False)
    for languages, pattern in verbs.items():
        is_db = is_db | (F.coalesce(F.lower("f_language").isin(*languages), F.lit(False)) & F.coalesce(F.col("name").rlike(pattern), F.lit(False)))
    return g.placed("", ("name", "symbol_type"), ("language",)).where(F.col("symbol_type").isin("method", "function")).select("id", is_db.alias("is_database"))


def roles(g: Graph) -> DataFrame:
    """What a symbol is in a traversal: executor, container, entity or data."""
    kind = F.col("symbol_type")
    holder = kind.isin("class", "component", "godot_scene")
    role = F.when(kind.isin("function", "method"), "executor").when(holder & (F.col("entity_type") == "model"), "entity").when(holder | kind.isin("namespace", "godot_node"), "container").otherwise("data")
    return g.s("symbol_type", "entity_type").select("id", role.alias("role"))


def parent_containers(g: Graph) -> DataFrame:
    """What contains a symbol, else the component that calls it, the smallest id of either: id, parent_id, p (1 or 2)."""
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("to_symbol_id is not null and from_symbol_id is not null")
    inside = d.where("dependency_type = 'contains'").select(F.col("to_symbol_id").alias("id"), F.lit(1).alias("p"), F.col("from_symbol_id").alias("parent_id"))
    parts = g.s("symbol_type").where("symbol_type = 'component'").select(F.col("id").alias("c_id"))
    called = d.where("dependency_type = 'calls'").join(parts, F.col("from_symbol_id") == F.col("c_id"), "left_semi").select(F.col("to_symbol_id").alias("id"), F.lit(2).alias("p"), F.col("from_symbol_id").alias("parent_id"))
    return inside.unionByName(called).groupBy("id").agg(F.min(F.struct("p", "parent_id")).alias("k")).select("id", "k.parent_id", "k.p")


def symbols_outside_tests(g: Graph) -> DataFrame:
    no = F.lit(False)
    test = F.coalesce("f_is_test", no) | F.coalesce(F.contains("f_path", F.lit("test")), no) | F.coalesce(F.col("name").rlike("^(test|it|describe)[A-Z_]"), no)
    return g.placed("", ("name",), ("path", "is_test")).where(~test).select("id")


def inherited_entities(g: Graph) -> DataFrame:
    p = g.prefixed("s", "p_", "entity_type")
    return g.s("entity_type", "parent_symbol_id").join(p, F.col("parent_symbol_id") == F.col("p_id"), "left").select("id", F.coalesce("entity_type", "p_entity_type").alias("entity"))


def routes_of_methods(g: Graph) -> DataFrame:
    a = g.a("endpoint_symbol_id", "http_method", "endpoint_path").select("endpoint_symbol_id", F.upper("http_method").alias("method"), "endpoint_path").distinct()
    return g.s("symbol_type").where("symbol_type = 'method'").join(a, F.col("id") == F.col("endpoint_symbol_id")).select("id", "method", "endpoint_path")


def name_parts(g: Graph) -> DataFrame:
    """First part of a dotted qualified name, and the name without type arguments."""
    head = F.when(F.contains("qualified_name", F.lit(".")), F.substring_index("qualified_name", ".", 1))
    return g.s("name", "qualified_name").select("id", head.alias("head"), F.regexp_replace("name", "<.*>", "").alias("plain"))


def language_compatible(g: Graph) -> DataFrame:
    """Edges between files of one language, or of languages that share their symbols."""
    a, b = F.lower("a_f_language"), F.lower("b_f_language")
    return _between_files(g, files=("language",)).where((a == b) | (a.isin(*FRONTEND) & b.isin(*FRONTEND))).select("id")


def store_targets(g: Graph, suffix: str = "Store") -> DataFrame:
    stores = g.s("name", "symbol_type").where("symbol_type = 'class'").select(F.col("id").alias("store_id"), "name")
    d = g.d("resolved_class").where(F.col("resolved_class").endswith(suffix))
    return d.join(stores, F.col("resolved_class") == F.col("name")).select("id", "store_id").distinct()


def framework_targets(g: Graph) -> DataFrame:
    x = g.prefixed("x", "x_", "framework", "qualified_name")
    return g.d("to_symbol_id").join(x, F.col("to_symbol_id") == F.col("x_id")).select("id", F.col("x_framework").alias("framework"), F.col("x_qualified_name").alias("qualified_name"))


def route_controllers(g: Graph) -> DataFrame:
    classes = g.prefixed("s", "p_", "symbol_type").where("p_symbol_type = 'class'")
    s = g.prefixed("s", "s_", "parent_symbol_id").join(classes, F.col("s_parent_symbol_id") == F.col("p_id"), "left")
    return g.a("endpoint_symbol_id").join(s, F.col("endpoint_symbol_id") == F.col("s_id")).select("id", F.col("s_id").alias("handler_id"), F.col("p_id").alias("controller_id"))


def component_parents(g: Graph) -> DataFrame:
    c = g.s("parent_symbol_id", "symbol_type").where("symbol_type = 'component'")
    return c.join(g.prefixed("s", "p_", "name"), F.col("parent_symbol_id") == F.col("p_id"), "left").select("id", F.col("parent_symbol_id").alias("parent_id"), F.col("p_name").alias("parent_name"))


def scene_scripts(g: Graph) -> DataFrame:
    n = g.s("symbol_type").where(F.col("symbol_type").isin("godot_scene", "godot_node")).select(F.col("id").alias("n_id"))
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("dependency_type = 'references'")
    return d.join(n, F.col("from_symbol_id") == F.col("n_id")).select(F.col("n_id").alias("id"), F.col("to_symbol_id").alias("script_id"))


def framework_search(g: Graph, text: str, frameworks: dict[str, str], limit: int) -> DataFrame:
    """Symbols of some languages whose name holds a text, framework by framework in order."""
    language = F.lower("f_language")
    rank = F.array_position(F.array(*map(F.lit, frameworks)), language)
    framework = F.create_map(*[F.lit(x) for pair in frameworks.items() for x in pair])[language]
    hits = g.placed("", ("name",), ("language",)).where(language.isin(*frameworks) & has("name", text))
    return hits.select("id", "name", framework.alias("framework"), rank.alias("rank")).orderBy("rank", "name", "id").limit(limit).drop("rank")


def entity_heuristics(g: Graph) -> DataFrame:
    kind = F.when(has("f_path", "/models/") | (F.col("base_class") == "Model"), "model").when(F.col("name").endswith("Controller"), "controller").when(has("f_path", "/jobs/") | F.col("name").endswith("Job") | F.col("name").endswith("Worker"), "job")
    return g.placed("", ("name", "symbol_type", "base_class")).where("symbol_type = 'class' and f_id is not null").select("id", kind.alias("kind"))


# cross-stack and incremental


def _side(column: str = "f_language") -> Column:
    return F.when(F.lower(column).isin(*BACKEND), "backend").otherwise("frontend")


def shared_contracts(g: Graph) -> DataFrame:
    """Type names that both sides declare, with their numbers; one grouping, no product of the sides."""
    k = g.placed("", ("name", "symbol_type"), ("language",)).where("symbol_type in ('class', 'interface') and f_id is not null and name is not null")
    back = _side() == "backend"
    n = k.groupBy("name").agg(count_of(~back).alias("frontend_types"), count_of(back).alias("backend_types"))
    return n.where("frontend_types > 0 and backend_types > 0")


def contract_drift(g: Graph) -> DataFrame:
    """Fields of class names that both sides declare: in both or in one of them; one grouping."""
    t = g.placed("t_", ("name", "symbol_type"), ("language",)).where("t_symbol_type = 'class' and t_f_id is not null and t_name is not null").select("t_id", "t_name", _side("t_f_language").alias("side"))
    both = t.groupBy(F.col("t_name").alias("b_name")).agg(F.count_distinct("side").alias("n")).where("n = 2").select("b_name")
    c = g.s("name", "symbol_type", "parent_symbol_id").where("symbol_type = 'property' and name is not null")
    fields = c.join(t, F.col("parent_symbol_id") == F.col("t_id")).join(both, F.col("t_name") == F.col("b_name"), "left_semi")
    seen = fields.groupBy(F.col("t_name").alias("name_"), F.col("name").alias("field")).agg(F.bool_or(F.col("side") == "frontend").alias("f"), F.bool_or(F.col("side") == "backend").alias("b"))
    return seen.select(F.col("name_").alias("name"), "field", F.when(~F.col("f"), "backend_only").when(~F.col("b"), "frontend_only").otherwise("same").alias("state"))


def best_callers(g: Graph) -> DataFrame:
    """Of each API call the symbol of the caller's file that suits best: frontend, callable, smallest id.

    The best symbol of a file does not depend on the call, so it is found once per file.
    """
    s = g.placed("", ("symbol_type",), ("language",)).where("file_id is not null")
    order = [F.when(F.coalesce(F.lower("f_language").isin(*FRONTEND), F.lit(False)), 0).otherwise(1), F.when(F.col("symbol_type").isin("function", "method"), 0).otherwise(1)]
    best = first_of(s, ["file_id"], order, ["id"]).select(F.col("file_id").alias("b_file"), F.col("id").alias("symbol_id"))
    caller = g.prefixed("s", "c_", "file_id").join(best, F.col("c_file_id") == F.col("b_file"))
    return g.a("caller_symbol_id").join(caller, F.col("caller_symbol_id") == F.col("c_id")).select("id", "symbol_id")


def feature_clusters(g: Graph) -> DataFrame:
    word = F.regexp_extract("name", "^([A-Z][a-z]+)", 1)
    s = g.s("name", "symbol_type").where("symbol_type in ('class', 'component')")
    return s.groupBy(word.alias("word")).agg(count_of().alias("symbols")).where("word <> '' and symbols > 1")


def with_all_frameworks(g: Graph, *frameworks: str) -> DataFrame:
    return g.r("name", "framework_stack").where(F.size(F.array_except(F.array(*map(F.lit, frameworks)), "framework_stack")) == 0).select("id", "name")


def change_states(g: Graph) -> DataFrame:
    """Files of the index against the texts of a snapshot: new, deleted, changed or same."""
    snap = g.table("source_texts").select(F.col("file_id").alias("p_id"))
    r = g.prefixed("r", "r_", "last_indexed")
    files = g.f("repo_id", "last_modified").join(r, F.col("repo_id") == F.col("r_id"), "left")
    state = F.when(F.col("id").isNull(), "new").when(F.col("p_id").isNull(), "deleted").when(F.col("last_modified") > F.col("r_last_indexed"), "changed").otherwise("same")
    return files.join(snap, F.col("id") == F.col("p_id"), "full").select(F.coalesce("id", "p_id").alias("file_id"), state.alias("state"))


def deleted_files(g: Graph) -> DataFrame:
    texts = g.table("source_texts").select("file_id")
    return g.f("path", "is_generated").where("not coalesce(is_generated, false)").join(texts, F.col("id") == F.col("file_id"), "left_anti").select("id", "path")


def orphan_texts(g: Graph) -> DataFrame:
    return g.table("source_texts").select("file_id").join(g.s("file_id").select(F.col("file_id").alias("k")), F.col("file_id") == F.col("k"), "left_anti")


def tagged_rows(g: Graph) -> DataFrame:
    return g.a("created_at").select(F.lit("api_call").alias("kind"), "id", "created_at").unionByName(g.b("created_at").select(F.lit("error").alias("kind"), "id", "created_at"))


def size_labels(g: Graph) -> DataFrame:
    """Sizes as text in whole bytes, KB or MB."""
    n = F.col("size")
    whole = lambda unit: F.floor(n / unit).cast("string")
    text = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(whole(1024), F.lit(" KB"))).otherwise(F.concat(whole(1 << 20), F.lit(" MB")))
    return g.f("size").where("size is not null").select("id", text.alias("label"))


def overriding(g: Graph) -> DataFrame:
    return g.d("from_symbol_id", "dependency_type").where("dependency_type in ('implements', 'inherits')").select(F.col("from_symbol_id").alias("id")).distinct()


def exported(g: Graph) -> DataFrame:
    return g.s("is_exported").where("is_exported").select("id")


def latest_repository(g: Graph) -> DataFrame:
    return g.r("name", "last_indexed").orderBy(F.desc_nulls_last("last_indexed"), "id").limit(1).select("id", "name")


def resolved_by_name(g: Graph) -> DataFrame:
    """Unresolved edges with the smallest id that has their qualified name."""
    n = g.s("qualified_name").where("qualified_name is not null").groupBy("qualified_name").agg(F.min("id").alias("target"))
    d = g.d("to_symbol_id", "to_qualified_name").where("to_symbol_id is null")
    return d.join(n, F.col("to_qualified_name") == F.col("qualified_name"), "left").select("id", F.col("target").alias("to_symbol_id"))


def orphan_edges(g: Graph) -> DataFrame:
    """Edges to delete: no target and no name, or, imports aside, a name that no symbol has."""
    known = g.s("qualified_name").where("qualified_name is not null").select("qualified_name").distinct()
    d = g.d("to_symbol_id", "to_qualified_name", "dependency_type").where("to_symbol_id is null").join(known, F.col("to_qualified_name") == F.col("qualified_name"), "left")
    return d.where("to_qualified_name is null or (dependency_type <> 'imports' and qualified_name is null)").select("id")


def storable_edges(g: Graph) -> DataFrame:
    """Edges whose two ends exist, with their qualified name or that of the target."""
    t = g.prefixed("s", "t_", "qualified_name")
    known = g.s("name").select(F.col("id").alias("k"))
    d = g.d("from_symbol_id", "to_symbol_id", "to_qualified_name").join(known, F.col("from_symbol_id") == F.col("k"), "left_semi")
    return d.join(t, F.col("to_symbol_id") == F.col("t_id")).select("id", "from_symbol_id", "to_symbol_id", F.coalesce("to_qualified_name", "t_qualified_name").alias("to_qualified_name"))


def contexts_with(g: Graph, text: str) -> DataFrame:
    d = g.d("qualified_context", "resolved_class").where(has("qualified_context", text) | has("resolved_class", text))
    return d.groupBy("qualified_context", "resolved_class").agg(count_of().alias("n"))


def signatures_with(g: Graph, text: str) -> DataFrame:
    return g.d("to_symbol_id", "method_signature").where(has("method_signature", text)).select("to_symbol_id", "method_signature").distinct()


def namespaces_with(g: Graph, text: str) -> DataFrame:
    d = g.d("from_symbol_id", "namespace_context").where(has("namespace_context", text))
    return d.join(g.prefixed("s", "s_", "name"), F.col("from_symbol_id") == F.col("s_id")).select("namespace_context", F.col("s_name").alias("name")).distinct()


# audits


def unresolved_by_type(g: Graph) -> DataFrame:
    open_ = count_of(F.col("to_symbol_id").isNull())
    return g.d("to_symbol_id", "dependency_type").groupBy("dependency_type").agg(count_of().alias("edges"), open_.alias("unresolved"), share(open_, count_of()).alias("pct"))


def name_collisions(g: Graph) -> DataFrame:
    return g.placed("", ("name",), ("repo_id",)).where("f_id is not null").groupBy(F.col("f_repo_id").alias("repo_id")).agg(count_of().alias("symbols"), (count_of() - F.count_distinct("name")).alias("collisions"))


def files_without_symbols(g: Graph) -> DataFrame:
    used = g.s("file_id").select("file_id").distinct()
    return g.f("repo_id").join(used, F.col("id") == F.col("file_id"), "left_anti").groupBy("repo_id").agg(count_of().alias("files"))


def lines_out_of_order(g: Graph) -> DataFrame:
    return g.s("start_line", "end_line").where("end_line < start_line")


def edges_across_languages(g: Graph) -> DataFrame:
    a, b = F.lower("a_f_language"), F.lower("b_f_language")
    return _between_files(g, files=("language",)).where(a != b).groupBy(a.alias("from_language"), b.alias("to_language")).agg(count_of().alias("edges"))


def edges_per_month(g: Graph) -> DataFrame:
    return g.d("created_at", "dependency_type").groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), "dependency_type").agg(count_of().alias("edges"))


def description_gaps(g: Graph) -> DataFrame:
    c = F.col("description")
    return g.s("symbol_type", "description").groupBy("symbol_type").agg(count_of(c.isNull()).alias("missing"), count_of(F.trim(c) == "").alias("blank"))


def errors_per_repository(g: Graph) -> DataFrame:
    return g.b("repo_id", "file_path").groupBy("repo_id").agg(count_of().alias("errors"), F.count_distinct("file_path").alias("files"))


def nodes_per_scene(g: Graph) -> DataFrame:
    n = g.s("symbol_type", "parent_symbol_id").where("symbol_type = 'godot_node'").groupBy(F.col("parent_symbol_id").alias("scene_id")).agg(count_of().alias("nodes"))
    scenes = g.s("symbol_type").where("symbol_type = 'godot_scene'").select("id")
    return n.join(scenes, F.col("scene_id") == F.col("id"), "left_semi")


def signals_by_name(g: Graph) -> DataFrame:
    d = g.d("from_symbol_id", "to_symbol_id", "dependency_type").where("dependency_type = 'signal_connection'")
    both = d.join(g.prefixed("s", "a_", "name"), F.col("from_symbol_id") == F.col("a_id")).join(g.prefixed("s", "b_", "name"), F.col("to_symbol_id") == F.col("b_id"))
    return both.groupBy(F.col("a_name").alias("source"), F.col("b_name").alias("target")).agg(count_of().alias("edges"))


def cube_of_types(g: Graph) -> DataFrame:
    return g.placed("", ("symbol_type",), ("repo_id",)).where("f_id is not null").select(F.col("f_repo_id").alias("repo_id"), "symbol_type").cube("repo_id", "symbol_type").agg(count_of().alias("n"))
