"""Who calls a symbol and how one symbol leads to another, across the stack.

Edges here are the rows of the dependencies together with the API calls, in one
shape (src, dst, kind, line, ref): an API call is an edge from its caller to its
endpoint. A traversal over both is the one of the graph module.

Defined cases: an unknown symbol gives no rows; symbols without a file have a
null path; a caller without a name is "unknown"; ties rank by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.operators import graph, importance
from symloom.session import as_table, cut

#: Direct callers beyond which transitive ones are not looked for (fixed value).
TRANSITIVE_UP_TO = 20
#: Types that a flow may follow (fixed values).
FLOW_TYPES = ("calls", "imports", "api_call", "shares_schema", "frontend_backend")


def stack_edges(dependencies: DataFrame, calls: DataFrame) -> DataFrame:
    """Both kinds of edges: src, dst, kind, line, parameter_context, qualified_context, method, endpoint."""
    none = F.lit(None).cast("string")
    d = dependencies.select(
        F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), F.col("dependency_type").alias("kind"), F.col("line_number").alias("line"), "parameter_context", "qualified_context", none.alias("method"), none.alias("endpoint")
    )
    a = calls.select(
        F.col("caller_symbol_id").alias("src"), F.col("endpoint_symbol_id").alias("dst"), F.lit("api_call").alias("kind"), F.col("line_number").alias("line"), none.alias("parameter_context"), none.alias("qualified_context"), F.col("http_method").alias("method"), F.col("endpoint_path").alias("endpoint")
    )
    return d.unionByName(a).where("src is not null and dst is not null")


def class_of_path(path: Column) -> Column:
    """Name of the file without the ending of a source language."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.(cs|js|ts|php|vue)$", "")


def qualified(name: Column, path: Column) -> Column:
    return F.when(name.isNull(), "unknown").when(path.isNull(), name).otherwise(F.concat(class_of_path(path), F.lit("."), name))


def who_calls(
    symbol_id: int, edges: DataFrame, symbols: DataFrame, depth: int = 1, kind: str | None = None, cross_stack: bool = False
) -> DataFrame:
    """Direct, cross-stack and transitive callers of a symbol, most important first.

    edges: stack_edges(). symbols: id, name, symbol_type, qualified_name, path.
    Transitive callers come only where a depth above 1 is asked for, neither a
    kind nor the other side of the stack, and there are at most
    ``TRANSITIVE_UP_TO`` direct ones; a relation that is there already is not
    repeated. Returns caller_id, depth, caller, callee, kind, line,
    parameter_context, is_cross_stack, score and place.
    """
    edges = as_table(edges)
    into = edges.where(F.col("dst") == symbol_id)
    if not cross_stack:
        into = into.where("method is null")
    if kind:
        into = into.where(F.col("kind") == kind)
    direct = cut(into.groupBy("src", "dst", "kind", "line").agg(F.min("parameter_context").alias("parameter_context"), F.bool_or(F.col("method").isNotNull()).alias("is_cross_stack")).withColumn("depth", F.lit(1)))
    found = direct
    if depth > 1 and not kind and not cross_stack and direct.count() <= TRANSITIVE_UP_TO:
        links = edges.where("method is null and kind = 'calls' and src <> dst").select("src", "dst").distinct()
        seed = edges.sparkSession.createDataFrame([(symbol_id,)], "seed long")
        far = graph.reach(links, seed, depth, reverse=True).where("depth > 1").select(F.col("node").alias("n"), F.col("depth").alias("d"))
        nearer = graph.reach(links, seed, depth - 1, reverse=True).select(F.col("node").alias("m"))
        steps = edges.where("method is null and kind = 'calls'").join(far, F.col("src") == F.col("n")).join(nearer, F.col("dst") == F.col("m"), "left_semi")
        # of a transitive caller one relation to the symbols nearer by
        one = steps.groupBy("src", "d").agg(F.min(F.struct("dst", "kind", "line", "parameter_context")).alias("k"))
        found = found.unionByName(one.select("src", "k.dst", "k.kind", "k.line", "k.parameter_context", F.lit(False).alias("is_cross_stack"), F.col("d").alias("depth")))
    a = symbols.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "name", "symbol_type", "qualified_name", "path")])
    b = symbols.select(F.col("id").alias("b_id"), F.col("name").alias("b_name"), F.col("path").alias("b_path"), F.col("qualified_name").alias("b_qualified"))
    named = cut(found.join(a, F.col("src") == F.col("a_id"), "left").join(b, F.col("dst") == F.col("b_id"), "left"))
    ranked = named.where("a_id is not null").groupBy(F.col("a_id").alias("id")).agg(*[F.first(f"a_{c}").alias(c) for c in ("name", "symbol_type", "qualified_name", "path")], F.min("depth").alias("depth"))
    pairs = edges.where("method is null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    scores = importance.importance(ranked, pairs, few=True).select(F.col("id").alias("s_id"), F.round("score", 4).alias("score"))
    return named.join(scores, F.col("a_id") == F.col("s_id"), "left").select(
        F.col("src").alias("caller_id"),
        "depth",
        qualified(F.col("a_name"), F.col("a_path")).alias("caller"),
        F.coalesce("b_qualified", qualified(F.col("b_name"), F.col("b_path"))).alias("callee"),
        "kind",
        "line",
        "parameter_context",
        "is_cross_stack",
        "score",
    )


def parameter_analysis(symbol_id: int, edges: DataFrame) -> DataFrame:
    """How a symbol is called: each parameter context with its calls and lines; a context with null in it is marked."""
    c = F.col("parameter_context")
    return (
        edges.where((F.col("dst") == symbol_id) & c.isNotNull())
        .groupBy("parameter_context")
        .agg(F.count(F.lit(1)).alias("calls"), F.array_join(F.array_sort(F.collect_set("line")).cast("array<string>"), ",").alias("lines"))
        .withColumn("has_null", F.contains(c, F.lit("null")))
    )


def trace_flow(start: int, goal: int, edges: DataFrame, all_paths: bool = False, depth: int = 10) -> DataFrame:
    """How a symbol leads to another over the types of flows: path number, position, node.

    The shortest path takes edges both ways; all paths follow them forwards and
    have at most `depth` steps.
    """
    links = cut(edges.where(F.col("kind").isin(*FLOW_TYPES) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    if not all_paths:
        return graph.shortest_path(links, start, goal).select(F.lit(1).alias("path"), "position", "node")
    seed = links.sparkSession.createDataFrame([(start,)], "seed long")
    # only nodes from which the goal can be reached are worth a path
    back = graph.reach(links, seed.select(F.lit(goal).cast("long").alias("seed")), depth, reverse=True).select(F.col("node").alias("g")).unionByName(seed.select(F.lit(goal).cast("long").alias("g")))
    useful = links.join(back, F.col("dst") == F.col("g"), "left_semi")
    found = graph.paths(useful, seed, depth, end=F.col("node") == goal).select("path")
    text = F.array_join(F.col("path").cast("array<string>"), ">")
    return found.withColumn("n", F.row_number().over(Window.orderBy(F.size("path"), text))).select(F.col("n").alias("path"), F.posexplode("path").alias("position", "node"))
