"""Feature discovery: from an entry symbol outwards, by strategies in the order of their priority.

The dependency traversal goes level by level with a role-aware edge table: what
a symbol leads to depends on its role (executor, container, entity, data), on
the direction it was reached in and on the depth. The other strategies are
joins of what is known with the graph. The engine runs all of them in turns, at
most ``ITERATIONS`` times or until nothing new comes; the relevance that a
symbol is found with first stays.

Defined cases: symbols without a row in the symbols table are not discovered;
repeated edges count once; an unknown entry gives itself alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.session import as_table, cut, cut_counting

#: Rounds of the engine (fixed value).
ITERATIONS = 3
#: Entities with a place of their own in an architecture (fixed values).
ENTITIES = (
    "model", "service", "controller", "component", "request", "job", "middleware", "notification", "command", "provider", "node", "ui_component", "resource", "manager", "handler", "coordinator",
    "engine", "pool", "repository", "factory", "builder", "validator", "adapter",
)
#: Entities whose references are always followed, whose files are valid, and that parents are taken of (fixed values).
REFERRED, VALIDATED, PARENTS = ("request", "model", "middleware", "job"), ("store", "service", "controller", "component", "request", "composable"), ("controller", "store", "service", "component")
#: Entities and depths at which a traversal does not go on (fixed values).
DEEP, FORWARD_DEPTH, MODEL_DEPTH, BACKWARD_DEPTH = ("model", "controller", "service", "request"), 2, 3, 4
#: Depth up to which plain references are followed (fixed value).
REFERENCE_DEPTH = 2
#: Relevance of what the strategies find (fixed values).
BRIDGE, DIRECT, NEAR, ENDPOINT, BACKEND, SCENE, CALLER = 0.9, 0.95, 0.9, 0.85, 0.8, 0.95, 0.9


def role(symbol_type: Column, entity_type: Column) -> Column:
    """What a symbol is in a traversal."""
    entity = F.coalesce(entity_type, F.lit(""))
    return (
        F.when(symbol_type.isin("method", "function") | (entity == "composable"), "executor")
        .when(entity.isin(*ENTITIES), F.when(symbol_type == "class", "container").otherwise("entity"))
        .when(symbol_type == "class", "container")
        .when(entity == "store", "entity")
        .when(symbol_type == "file", "container")
        .otherwise("data")
    )


def direction(symbol_type: Column, entity_type: Column, parent_entity: Column) -> Column:
    """Where a traversal from a symbol goes: forward, backward or both."""
    entity, kind = F.coalesce(entity_type, F.lit("")), role(symbol_type, entity_type)
    plain = (
        F.when(entity.isin("controller", "method") & (symbol_type == "method"), "forward")
        .when((entity == "model") | ((entity == "service") & (symbol_type == "class")), "backward")
        .when((entity == "component") & (symbol_type != "method"), "forward")
        .when(kind == "data", "forward")
        .otherwise("both")
    )
    return F.when((symbol_type == "method") & (F.coalesce(parent_entity, F.lit("")) == "service"), "both").otherwise(plain)


def role_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that a traversal may take: src, dst, way (forward or backward), most (depth up to which, null for any).

    symbols: id, symbol_type, entity_type. edges: src, dst, kind.
    """
    s = symbols.select("id", "symbol_type", "entity_type", role(F.col("symbol_type"), F.col("entity_type")).alias("role"))
    a = s.select(F.col("id").alias("a"), F.col("symbol_type").alias("a_type"), F.col("entity_type").alias("a_entity"), F.col("role").alias("a_role"))
    b = s.select(F.col("id").alias("b"), F.col("symbol_type").alias("b_type"), F.col("entity_type").alias("b_entity"), F.col("role").alias("b_role"))
    e = edges.where("src <> dst").distinct().join(a, F.col("src") == F.col("a")).join(b, F.col("dst") == F.col("b"))
    kind, referred = F.col("kind"), F.coalesce(F.col("b_entity").isin(*REFERRED), F.lit(False))
    calls, refers = kind.isin("calls", "api_call"), kind == "references"
    executor, entity = F.col("a_role") == "executor", F.col("a_role") == "entity"
    always = (
        (executor & (calls | (kind == "contains") | (refers & F.coalesce(F.col("b_entity").isin(*ENTITIES), F.lit(False)))))
        | (entity & (calls | (refers & referred)))
        | ((F.col("a_role") == "container") & (kind == "contains"))
    )
    near = refers & ~referred & (executor | (entity & (F.coalesce("a_entity", F.lit("")) != "component")))
    forward = e.withColumn("most", F.when(always, F.lit(None).cast("int")).when(near, F.lit(REFERENCE_DEPTH))).where(always | near)
    traced = F.coalesce(F.col("b_entity").isin("composable", "model"), F.lit(False)) | ((F.col("b_role") == "executor") & (F.col("b_type") == "function"))
    backward = e.where(calls | (kind == "contains") | (refers & traced))
    return forward.select("src", "dst", F.lit("forward").alias("way"), "most").unionByName(
        backward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("backward").alias("way"), F.lit(None).cast("int").alias("most"))
    ).distinct()


def parents_of(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """What contains a symbol, else the component that calls it: child, parent, parent_entity, parent_file."""
    p = symbols.select(F.col("id").alias("parent"), F.col("entity_type").alias("parent_entity"), F.col("file_id").alias("parent_file"))
    joined = edges.where("kind in ('contains', 'calls') and src <> dst").join(p, F.col("src") == F.col("parent"))
    rank = F.when(F.col("kind") == "contains", 1).when(F.col("parent_entity") == "component", 2)
    best = joined.withColumn("rank", rank).where("rank is not null").groupBy(F.col("dst").alias("child")).agg(F.min(F.struct("rank", "parent", "parent_entity", "parent_file")).alias("k"))
    return best.select("child", "k.parent", "k.parent_entity", "k.parent_file")


def traverse(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Symbols reached from seeds (seed) by role and direction: node, depth, relevance.

    A container is expanded to what it contains. Beyond the first step a symbol
    counts if its entity has a place in the architecture or its file holds one
    that was found; methods and deep entities end a way at their depth. The
    parent of an executor that is a store, service, controller or component is
    found with it. Of two ways to a symbol on one level the wider direction
    stays.
    """
    symbols = as_table(symbols)
    edges = as_table(edges.select("src", "dst", "kind").distinct())
    table = cut(role_edges(symbols, edges))
    parents = cut(parents_of(symbols, edges))
    kind, entity = F.col("symbol_type"), F.col("entity_type")
    s = symbols.select("id", "symbol_type", "entity_type", "file_id")
    start = seeds.select(F.col("seed").cast("long").alias("node")).distinct().join(s, F.col("node") == F.col("id")).join(parents, F.col("node") == F.col("child"), "left")
    frontier, left = cut_counting(start.select("node", direction(kind, entity, F.col("parent_entity")).alias("going"), F.lit(0).alias("depth"), F.lit(1.0).alias("relevance"), "file_id", F.coalesce("entity_type", F.lit("")).alias("entity")))
    seen = frontier.select("node", "depth", "relevance", "file_id", "entity")
    for d in range(1, depth + 1):
        if not left:
            break
        step = (
            frontier.select("node", "going").join(table, F.col("node") == F.col("src"))
            .where(((F.col("going") == "both") | (F.col("going") == F.col("way"))) & (F.col("most").isNull() | (F.col("most") >= d - 1)))
            .groupBy(F.col("dst").alias("next"))
            .agg(F.min(F.when(F.col("way") == "backward", 0).otherwise(1)).alias("forwards"))
            .join(seen.select(F.col("node").alias("known")), F.col("next") == F.col("known"), "left_anti")
            .join(s, F.col("next") == F.col("id"))
            .join(parents, F.col("next") == F.col("child"), "left")
        )
        way = F.when(F.col("forwards") == 1, "forward").otherwise("backward")
        most = F.when(way == "backward", BACKWARD_DEPTH).when(entity == "model", MODEL_DEPTH).otherwise(FORWARD_DEPTH)
        ends = (kind == "method") | F.coalesce(entity.isin(*DEEP), F.lit(False))
        if d >= 2:
            files = seen.where(F.col("entity").isin(*[x for x in VALIDATED if x != "model"])).select(F.col("file_id").alias("v_file")).distinct()
            step = step.join(files, F.col("file_id") == F.col("v_file"), "left").where(
                F.coalesce(entity.isin(*VALIDATED), F.lit(False)) | F.col("file_id").isNull() | ((kind == "class") & F.coalesce(entity == "model", F.lit(False))) | F.col("v_file").isNotNull()
            )
        executor = role(kind, entity) == "executor"
        going = F.when(executor & F.coalesce(F.col("parent_entity").isin("controller", "store"), F.lit(False)) & (way == "backward") & F.lit(d <= 1), "backward").when(executor, "forward").otherwise("forward")
        relevance = F.round(F.lit(1 - d / (depth + 1)), 6)
        new, left = cut_counting(step.where(~(ends & (F.lit(d) >= most))).select(F.col("next").alias("node"), going.alias("going"), F.lit(d).alias("depth"), relevance.alias("relevance"), "file_id", F.coalesce("entity_type", F.lit("")).alias("entity"), F.when(executor, F.col("parent")).alias("parent"), "parent_entity", "parent_file"))
        seen = seen.unionByName(new.select("node", "depth", "relevance", "file_id", "entity"))
        if d < depth:
            above = new.where(F.col("parent_entity").isin(*PARENTS) & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.first("parent_file").alias("file_id"), F.min("parent_entity").alias("entity"))
            fresh = cut(above.join(seen.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti").select("node", F.lit(d + 1).alias("depth"), F.round(F.lit(1 - (d + 1) / (depth + 1)), 6).alias("relevance"), "file_id", "entity"))
            seen = seen.unionByName(fresh)
        seen = cut(seen)
        frontier = new.select("node", "going")
    return seen.select("node", "depth", "relevance")


#: A strategy: what is known (node) and the round, to what it finds (node, relevance).
Strategy = Callable[[DataFrame, int], DataFrame]


def _ends(known: DataFrame, edges: DataFrame, kinds: tuple[str, ...], back: bool = False) -> DataFrame:
    """Other ends of edges of some kinds at known nodes: node, other."""
    here, there = ("dst", "src") if back else ("src", "dst")
    e = edges.where(F.col("kind").isin(*kinds))
    return e.join(known.select("node"), F.col(here) == F.col("node")).select("node", F.col(there).alias("other")).distinct()


def _of_entity(found: DataFrame, symbols: DataFrame, *entities: str) -> DataFrame:
    """Rows (other) whose symbol is of some entity types: node."""
    s = symbols.where(F.col("entity_type").isin(*entities)).select("id")
    return found.join(s, F.col("other") == F.col("id"), "left_semi").select(F.col("other").alias("node")).distinct()


def _at(df: DataFrame, relevance: float) -> DataFrame:
    return df.select("node", F.lit(relevance).alias("relevance"))


def cross_stack(symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> Strategy:
    """The other side of API calls, both ways, with the stores, components and composables around frontend callers."""
    def run(known: DataFrame, turn: int) -> DataFrame:
        api = calls.where("src is not null and dst is not null").select("src", "dst", F.lit("api").alias("kind"))
        forward = _ends(known, api, ("api",)).select(F.col("other").alias("node"))
        back = _ends(known, api, ("api",), back=True).select(F.col("other").alias("node")).distinct()
        around = _of_entity(_ends(back, edges, ("contains",), back=True), symbols, "store", "component", "composable").unionByName(_of_entity(_ends(back, edges, ("calls",), back=True), symbols, "component"))
        users = _ends(back, edges, ("calls",), back=True).select(F.col("other").alias("node")).distinct()
        owners = _of_entity(_ends(users, edges, ("contains",), back=True), symbols, "component", "composable").unionByName(_of_entity(_ends(users, edges, ("calls",), back=True), symbols, "component"))
        return _at(forward.unionByName(back).unionByName(around).unionByName(users).unionByName(owners), BRIDGE)

    return run


def props(symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> Strategy:
    """From components to the stores, composables and components they use, to who uses them, and on to the backend."""
    def run(known: DataFrame, turn: int) -> DataFrame:
        here = _of_entity(known.select(F.col("node").alias("other")), symbols, "component")
        used = _ends(here, edges, ("calls", "imports", "references"))
        direct = _of_entity(used, symbols, "composable", "component").unionByName(_stores(used, symbols, edges))
        users = _of_entity(_ends(here, edges, ("imports", "references", "calls"), back=True), symbols, "component")
        stores = _stores(_ends(users, edges, ("calls",)), symbols, edges)
        return _at(direct, DIRECT).unionByName(_at(users.unionByName(stores), NEAR)).unionByName(_backend(stores, edges, calls))

    return run


def composables(symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> Strategy:
    """From composables and what they contain to the stores they call, the components around them, and the backend."""
    def run(known: DataFrame, turn: int) -> DataFrame:
        here = _of_entity(known.select(F.col("node").alias("other")), symbols, "composable")
        nested = here.unionByName(_ends(here, edges, ("contains",)).select(F.col("other").alias("node"))).distinct()
        stores = _stores(_ends(nested, edges, ("calls",)), symbols, edges)
        parts = _of_entity(_ends(here, edges, ("calls", "imports", "references"), back=True), symbols, "component").unionByName(_of_entity(_ends(nested, edges, ("references", "imports")), symbols, "component"))
        return _at(parts, DIRECT).unionByName(_at(stores, NEAR)).unionByName(_backend(stores, edges, calls))

    return run


def _stores(found: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods of stores among found symbols (other), with their stores: node."""
    stores = symbols.where("entity_type = 'store'").select(F.col("id").alias("s"))
    held = edges.where("kind = 'contains'").join(stores, F.col("src") == F.col("s"), "left_semi").select("src", "dst").distinct()
    hit = found.join(held, F.col("other") == F.col("dst"))
    return hit.select(F.col("other").alias("node")).unionByName(hit.select(F.col("src").alias("node"))).unionByName(_of_entity(found, symbols, "store")).distinct()


def _backend(stores: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Endpoints that store methods call, and what these call: node, relevance."""
    api = calls.where("src is not null and dst is not null").select("src", "dst", F.lit("api").alias("kind"))
    ends = _ends(stores, api, ("api",)).select(F.col("other").alias("node")).distinct()
    return _at(ends, ENDPOINT).unionByName(_at(_ends(ends, edges, ("calls", "references")).select(F.col("other").alias("node")), BACKEND))


def signals(symbols: DataFrame, edges: DataFrame, depth: int) -> Strategy:
    """Methods connected with known ones by signals, both ways."""
    def run(known: DataFrame, turn: int) -> DataFrame:
        executors = symbols.where(F.col("symbol_type").isin("method", "function")).select("id")
        here = known.join(executors, F.col("node") == F.col("id"), "left_semi").select("node")
        found = _ends(here, edges, ("signal_connection",)).unionByName(_ends(here, edges, ("signal_connection",), back=True))
        return _at(found.select(F.col("other").alias("node")), 1 - (turn + 1) / (depth + 1))

    return run


def scenes(symbols: DataFrame, edges: DataFrame, depth: int) -> Strategy:
    """Scenes whose nodes use known scripts, with the scenes above and below them."""
    def run(known: DataFrame, turn: int) -> DataFrame:
        nodes = symbols.where(F.col("symbol_type").isin("godot_node", "godot_scene")).select(F.col("id").alias("n"), F.coalesce(F.when(F.col("symbol_type") == "godot_scene", F.col("id")), "parent_symbol_id").alias("scene"))
        using = _ends(known, edges, ("references", "contains"), back=True).join(nodes, F.col("other") == F.col("n")).where("scene is not null").select(F.col("scene").alias("node")).distinct()
        of_scene = symbols.where("symbol_type = 'godot_scene'").select(F.col("id").alias("s"))
        near = _ends(using, edges, ("contains", "references")).unionByName(_ends(using, edges, ("contains", "references"), back=True)).join(of_scene, F.col("other") == F.col("s"), "left_semi")
        relevance = 1 - (turn + 1) / (depth + 1)
        return _at(using, relevance).unionByName(_at(near.select(F.col("other").alias("node")), relevance * SCENE))

    return run


def autoloads(symbols: DataFrame, edges: DataFrame, depth: int) -> Strategy:
    """Globally loaded scripts that known symbols are or refer to, with their callers."""
    def run(known: DataFrame, turn: int) -> DataFrame:
        relevance = 1 - (turn + 1) / (depth + 1)
        own = _of_entity(known.select(F.col("node").alias("other")), symbols, "autoload")
        referred = _of_entity(_ends(known, edges, ("references", "calls")), symbols, "autoload")
        callers = _ends(own, edges, ("calls", "references"), back=True).select(F.col("other").alias("node"))
        return _at(own.unionByName(referred), relevance).unionByName(_at(callers, relevance * CALLER))

    return run


def strategies(symbols: DataFrame, edges: DataFrame, calls: DataFrame, depth: int) -> list[tuple[int, str, Strategy]]:
    """All strategies with their priorities; a lower one comes first."""
    def dependencies(known: DataFrame, turn: int) -> DataFrame:
        return traverse(symbols, edges, known.select(F.col("node").alias("seed")), depth).where("depth > 0").select("node", "relevance")

    return [
        (3, "props", props(symbols, edges, calls)), (3, "composables", composables(symbols, edges, calls)), (5, "cross-stack", cross_stack(symbols, edges, calls)), (7, "signals", signals(symbols, edges, depth)),
        (8, "scenes", scenes(symbols, edges, depth)), (9, "autoloads", autoloads(symbols, edges, depth)), (10, "dependencies", dependencies),
    ]


def discover(symbols: DataFrame, edges: DataFrame, calls: DataFrame, seeds: DataFrame, depth: int = 3, iterations: int = ITERATIONS) -> DataFrame:
    """Symbols of a feature: node, relevance, strategy and the round that found them.

    symbols: id, symbol_type, entity_type, file_id, parent_symbol_id. edges:
    src, dst, kind. calls: src, dst (callers and endpoints). Within a round
    strategies run in the order of priority on what was known at its start; of
    two that find a symbol the one before stays.
    """
    symbols = as_table(symbols)
    edges = as_table(edges.where("src is not null and dst is not null").select("src", "dst", "kind").distinct())
    calls = as_table(calls.select("src", "dst").distinct())
    exists = symbols.select(F.col("id").alias("k"))
    plan = sorted(strategies(symbols, edges, calls, depth), key=lambda s: s[0])
    known = cut(seeds.where("seed is not null").select(F.col("seed").cast("long").alias("node"), F.lit(1.0).alias("relevance"), F.lit("entry").alias("strategy"), F.lit(0).alias("turn")).distinct())
    for turn in range(iterations):
        found = None
        for place, (_, name, strategy) in enumerate(plan):
            part = strategy(known.select("node"), turn).select("node", F.struct(F.lit(place).alias("place"), (-F.col("relevance")).alias("minus"), F.lit(name).alias("name")).alias("k"))
            found = part if found is None else found.unionByName(part)
        best = found.groupBy("node").agg(F.min("k").alias("best"))
        fresh = best.join(exists, F.col("node") == F.col("k"), "left_semi").join(known.select(F.col("node").alias("old")), F.col("node") == F.col("old"), "left_anti")
        new, count = cut_counting(fresh.select("node", F.round(-F.col("best.minus"), 6).alias("relevance"), F.col("best.name").alias("strategy"), F.lit(turn + 1).alias("turn")))
        if not count:
            break
        known = cut(known.unionByName(new))
    return known


#: Categories of a manifest, in its order (fixed values).
CATEGORIES = (
    "controllers", "services", "repositories", "models", "requests", "resources", "jobs", "middleware", "notifications", "commands", "providers", "events", "listeners", "policies", "traits", "stores", "components",
    "composables", "types", "nodes", "scenes", "managers", "handlers", "functions", "others",
)


def category(symbol_type: Column, entity_type: Column) -> Column:
    """Category of a manifest for a symbol: its entity type in the plural, else by its symbol type."""
    entity = F.coalesce(entity_type, F.lit(""))
    plural = F.when(entity == "policy", "policies").when(entity == "repository", "repositories").when(entity == "middleware", "middleware").otherwise(F.concat(entity, F.lit("s")))
    by_type = (
        F.when(symbol_type.isin("interface", "type", "type_alias", "enum"), "types").when(symbol_type == "trait", "traits").when(symbol_type == "godot_scene", "scenes").when(symbol_type == "godot_node", "nodes")
        .when(symbol_type == "component", "components").when(symbol_type.isin("function", "method"), "functions").otherwise("others")
    )
    return F.when(plural.isin(*CATEGORIES), plural).otherwise(by_type)


def manifest(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Discovered symbols by category with their number and mean relevance, in the order of the categories."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return (
        found.join(symbols, F.col("node") == F.col("id"))
        .groupBy(category(F.col("symbol_type"), F.col("entity_type")).alias("category"))
        .agg(F.count(F.lit(1)).alias("symbols"), F.round(F.avg("relevance"), 6).alias("mean_relevance"))
        .withColumn("place", place)
    )
