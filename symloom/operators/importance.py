"""Importance of symbols: centrality proxies, a semantic weight and their composite.

The proxies are local: betweenness is the root of callers times callees, degree
counts rows with callers weighing more, the share of the callers' own callers
stands for the eigenvector, and the nodes within two hops for closeness. Each is
capped at 1. Symbols to rank may be few: then only the edges around them are
touched.

Defined cases: rows with a null end count on the other end's degree only; self
edges and repeated rows count as rows; a symbol without edges has zeros; a null
name is an empty one; a null depth adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the composite (fixed values).
WEIGHTS = {"betweenness": 0.3, "degree": 0.2, "eigenvector": 0.15, "closeness": 0.1, "semantic": 0.25}
#: Nodes within two hops at which closeness is full (fixed value).
NEAR = 30
#: Semantic weight of each symbol type, and of all others (fixed values).
TYPE_WEIGHTS = {"method": 0.6, "function": 0.6, "class": 0.7, "interface": 0.5, "variable": 0.3, "property": 0.3}
OTHER_TYPE = 0.5
#: Words of storing, of processing, of reporting, and starts of answering names (fixed values).
STORING = "create|insert|update|save|persist|delete|remove|destroy|upsert"
PROCESSING = "process|calculate|validate|transform|handle|execute|perform"
REPORTING = "log|logger|debug|trace|info|warn|error"
ANSWERING = "response|json|getMessage|getDetails|getResourceName|print|console"
#: What a storing name is multiplied by, and what each step of depth takes off it (fixed values).
DATABASE, DEPTH_PENALTY = 2.5, 0.02


def weighted(dependencies: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs with the number of their rows; the partial sums come before the shuffle."""
    return (
        dependencies.select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"))
        .where("src is not null or dst is not null")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _language(path: Column, qualified: Column, name: Column) -> Column:
    """Language by the file's extension, else by the look of a qualified name that is not the name."""
    by_path = F.when(path.endswith(".php"), "php").when(path.endswith(".cs"), "csharp").when(path.endswith(".ts"), "typescript").when(path.endswith(".js"), "javascript").when(path.endswith(".gd"), "gdscript")
    by_name = (
        F.when(F.contains(qualified, F.lit("\\")), "php")
        .when(qualified.rlike(r"^[A-Z][a-zA-Z0-9]*(\.[A-Z][a-zA-Z0-9]*)+") & ~F.contains(qualified, F.lit("::")), "csharp")
        .when(qualified.rlike(r"^[a-z]+(\.[a-z]+)+\.[A-Z]"), "java")
        .when(F.contains(qualified, F.lit("@/")) | F.contains(qualified, F.lit("../")), "typescript")
    )
    return F.coalesce(by_path, F.when(qualified != name, by_name), F.lit("unknown"))


def is_database_operation(name: Column, path: Column, qualified: Column) -> Column:
    """Whether a symbol stores or removes data, by its language's habits."""
    low, file = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    full = F.coalesce(F.nullif(qualified, F.lit("")), name, F.lit(""))
    language = _language(file, full, F.coalesce(name, F.lit("")))

    def has(column: Column, *words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(column, F.lit(w))
        return out

    php = full.rlike(r"(?i)::(create|insert|update|save|delete|destroy|upsert)\b") | full.rlike(r"(?i)\\models\\") | has(file, "/models/") | file.rlike(r"\b(eloquent|repository)\b") | has(low, "repository")
    csharp = low.rlike(r"\b(savechanges|add|update|remove|delete|insert|executesql|execute)\b") | file.rlike(r"\b(repository|dbcontext|database|entity)\b") | has(low, "repository", "db")
    script = has(low, "repository", "prisma", "orm") | file.rlike(r"\b(model|schema|entity|collection)\b")
    godot = low.rlike(r"(save|load)_(resource|scene|config|data|game)") | low.rlike(r"resource_?saver|config_?file")
    other = has(low, "repository", "db", "database", "persist")
    by_language = F.when(language == "php", php).when(language == "csharp", csharp).when(language.isin("typescript", "javascript"), script).when(language == "gdscript", godot).otherwise(other)
    return low.rlike(rf"\b({STORING})\b") & by_language


def semantic_weight(symbol_type: Column, name: Column, path: Column, depth: Column | None = None) -> Column:
    """Weight of type, name and place, between 0 and 1."""
    low, file = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(path, F.lit(""))
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair]), symbol_type), F.lit(OTHER_TYPE))
    score = (
        base
        + F.when(low.rlike(rf"\b({STORING})\b"), 0.4).otherwise(0.0)
        + F.when(low.rlike(rf"\b({PROCESSING})\b"), 0.3).otherwise(0.0)
        + F.when(F.contains(file, F.lit("/Service")) | F.contains(file, F.lit("/Controller")), 0.2).otherwise(0.0)
        - F.when(low.rlike(rf"\b({REPORTING})\b"), 0.5).otherwise(0.0)
        - F.when(low.rlike(rf"(?i)^({ANSWERING})\b"), 0.3).otherwise(0.0)
    )
    if depth is not None:
        score = score + F.coalesce(F.greatest(F.lit(0.0), (1 - depth / 5) * 0.2), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def importance(symbols: DataFrame, pairs: DataFrame, few: bool = False) -> DataFrame:
    """Proxies, semantic weight and score per symbol.

    symbols: id, name, symbol_type, path, qualified_name and, if known, depth.
    pairs: weighted(), as a table. few says that the symbols are a small part of
    all; then the pairs are reduced to those around them before anything else.
    """
    into, out_of = pairs.where("dst is not null"), pairs.where("src is not null")
    sources, second_in, second_out = into, into, out_of.where("dst is not null")
    if few:
        ids = symbols.select(F.col("id").alias("k")).distinct()
        sources = into = into.join(ids, F.col("dst") == F.col("k"), "left_semi")
        out_of = out_of.join(ids, F.col("src") == F.col("k"), "left_semi")
        callers = into.select(F.col("src").alias("k")).distinct()
        second_in = second_in.join(callers, F.col("dst") == F.col("k"), "left_semi")
        callees = out_of.select(F.col("dst").alias("k")).distinct()
        second_out = second_out.join(callees, F.col("src") == F.col("k"), "left_semi")
    # one row per node and direction: rows and distinct other ends
    arriving = into.groupBy(F.col("dst").alias("i_id")).agg(F.sum("n").alias("in_rows"), F.count("src").alias("callers"))
    leaving = out_of.groupBy(F.col("src").alias("o_id")).agg(F.sum("n").alias("out_rows"), F.count("dst").alias("callees"))
    own = second_in.groupBy(F.col("dst").alias("c_id")).agg(F.sum("n").alias("c_rows"))
    second = sources.join(own, F.col("src") == F.col("c_id")).groupBy(F.col("dst").alias("e_id")).agg(F.sum(F.col("n") * F.col("c_rows")).alias("second"))
    # closeness is capped at NEAR nodes, so NEAR neighbours of a node settle it however many there are
    order = Window.partitionBy("src").orderBy("dst")

    def nearest(df: DataFrame) -> DataFrame:
        return df.where("dst is not null").select("src", "dst").withColumn("at", F.row_number().over(order)).where(F.col("at") <= NEAR).drop("at")

    first = nearest(out_of)
    two = first.unionByName(first.alias("a").join(nearest(second_out).alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst"))
    near = two.groupBy(F.col("src").alias("n_id")).agg(F.count_distinct("dst").alias("near"))
    one, zero = F.lit(1.0), F.lit(0)
    depth = F.col("depth") if "depth" in symbols.columns else None
    kept = [c for c in ("depth",) if c in symbols.columns]
    joined = symbols
    for part, key in ((arriving, "i_id"), (leaving, "o_id"), (second, "e_id"), (near, "n_id")):
        joined = joined.join(part, F.col("id") == F.col(key), "left")
    parts = joined.select(
        "id",
        *kept,
        F.least(F.sqrt((F.coalesce("callers", zero) * F.coalesce("callees", zero)).cast("double")) / 10, one).alias("betweenness"),
        F.least((F.coalesce("in_rows", zero) * 1.5 + F.coalesce("out_rows", zero)) / 20, one).alias("degree"),
        F.least(F.coalesce("second", zero) / 50, one).alias("eigenvector"),
        F.least(F.coalesce("near", zero) / NEAR, one).alias("closeness"),
        semantic_weight(F.col("symbol_type"), F.col("name"), F.col("path"), depth).alias("semantic"),
        is_database_operation(F.col("name"), F.col("path"), F.col("qualified_name")).alias("is_database"),
    )
    plain = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    penalty = F.coalesce(depth, zero) * DEPTH_PENALTY if depth is not None else F.lit(0.0)
    score = F.when(F.col("is_database"), F.greatest(plain * DATABASE - penalty, F.lit(0.0))).otherwise(plain)
    return parts.withColumn("score", F.least(score, one)).drop(*kept)


def ranked(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Scores in falling order; ties by id."""
    out = scored.orderBy(F.desc("score"), F.asc("id"))
    return out if limit is None else out.limit(limit)
