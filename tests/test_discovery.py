from symloom.operators import discovery as D

SYMBOLS = "id long, symbol_type string, entity_type string, file_id long, parent_symbol_id long"
EDGES = "src long, dst long, kind string"


def frames(spark, symbols, edges, calls=()):
    return (
        spark.createDataFrame([(*s, None) if len(s) == 4 else s for s in symbols], SYMBOLS),
        spark.createDataFrame(list(edges), EDGES),
        spark.createDataFrame(list(calls), "src long, dst long"),
        spark.createDataFrame([(1,)], "seed long"),
    )


def test_roles_and_directions(spark):
    rows = [(1, "method", "controller", 1), (2, "class", "model", 1), (3, "function", None, 1), (4, "class", None, 1), (5, "variable", "store", 1), (6, "interface", None, 1), (7, "variable", "composable", 1), (8, "variable", "component", 1)]
    s, *_ = frames(spark, rows, [])
    none = D.F.lit(None).cast("string")
    got = {r.id: (r.r, r.d) for r in s.select("id", D.role(D.F.col("symbol_type"), D.F.col("entity_type")).alias("r"), D.direction(D.F.col("symbol_type"), D.F.col("entity_type"), none).alias("d")).collect()}
    assert got == {
        1: ("executor", "forward"), 2: ("container", "backward"), 3: ("executor", "both"), 4: ("container", "both"), 5: ("entity", "both"), 6: ("data", "forward"), 7: ("executor", "both"), 8: ("entity", "forward"),
    }


def test_traversal(spark):
    symbols = [(1, "function", None, 1), (2, "function", None, 1), (3, "function", None, 2), (4, "function", None, 3), (5, "class", "store", 4), (6, "variable", None, 1), (7, "function", "service", 9), (8, "function", None, 9)]
    edges = [(1, 2, "calls"), (2, 3, "calls"), (3, 4, "calls"), (5, 1, "contains"), (1, 6, "imports"), (2, 7, "calls"), (7, 8, "calls"), (1, 1, "calls"), (1, 2, "calls"), (1, 99, "calls")]
    s, e, _, seed = frames(spark, symbols, edges)
    got = {r.node: (r.depth, r.relevance) for r in D.traverse(s, e, seed, 3).collect()}
    # 3 and 4 lie in files that nothing speaks for; 7 is a service, which ends ways at its depth
    assert got == {1: (0, 1.0), 2: (1, 0.75), 5: (1, 0.75)}
    assert D.traverse(s, e, seed.where("false"), 3).collect() == []
    assert [r.node for r in D.traverse(s, e.where("false"), seed, 3).collect()] == [1]


def test_engine_keeps_the_first_relevance_and_stops(spark):
    symbols = [(1, "function", "component", 1), (2, "function", "composable", 2), (3, "variable", "store", 3), (4, "method", "method", 3), (5, "method", "controller", 4), (6, "class", "model", 5), (7, "function", "component", 6), (8, "class", None, 7)]
    edges = [(1, 2, "imports"), (2, 4, "calls"), (3, 4, "contains"), (5, 6, "references"), (7, 1, "imports")]
    s, e, c, seed = frames(spark, symbols, edges, [(4, 5)])
    got = {r.node: (r.strategy, r.turn, r.relevance) for r in D.discover(s, e, c, seed).collect()}
    assert got[1] == ("entry", 0, 1.0) and got[2] == ("props", 1, 0.95) and got[7] == ("props", 1, 0.9)
    assert got[4] == ("composables", 2, 0.9) and got[3] == ("composables", 2, 0.9) and got[5] == ("composables", 2, 0.85) and got[6] == ("composables", 2, 0.8)
    assert 8 not in got
    m = {r.category: r.symbols for r in D.manifest(D.discover(s, e, c, seed), s).collect()}
    assert m == {"components": 2, "composables": 1, "stores": 1, "functions": 1, "controllers": 1, "models": 1}
    assert [r.node for r in D.discover(s, e.where("false"), c.where("false"), seed).collect()] == [1]


def test_signals_scenes_and_autoloads(spark):
    symbols = [(1, "method", None, 1, None), (2, "method", None, 1, None), (3, "godot_scene", None, 2, None), (4, "godot_node", None, 2, 3), (5, "godot_scene", None, 3, None), (6, "class", "autoload", 4, None), (7, "method", None, 5, None)]
    edges = [(1, 2, "signal_connection"), (4, 1, "references"), (3, 5, "contains"), (1, 6, "references"), (7, 6, "calls")]
    s, e, _, _ = frames(spark, symbols, edges)
    known = spark.createDataFrame([(1,)], "node long")
    rows = lambda strategy, k=known: {(r.node, round(r.relevance, 6)) for r in strategy(k, 0).collect()}
    assert rows(D.signals(s, e, 3)) == {(2, 0.75)}
    assert rows(D.scenes(s, e, 3)) == {(3, 0.75), (5, 0.7125)}
    assert rows(D.autoloads(s, e, 3)) == {(6, 0.75)}
    assert rows(D.autoloads(s, e, 3), spark.createDataFrame([(6,)], "node long")) == {(6, 0.75), (7, 0.675), (1, 0.675)}
