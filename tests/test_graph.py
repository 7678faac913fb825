from symloom.operators import graph

EDGES = [(1, 2), (2, 3), (3, 1), (2, 4), (0, 1), (5, 5)]


def links(spark, pairs=EDGES):
    rows = [(i, a, b, "calls") for i, (a, b) in enumerate(pairs)]
    d = spark.createDataFrame(rows, "id long, from_symbol_id long, to_symbol_id long, dependency_type string")
    return graph.edges(d, "calls")


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed long")


def test_cycle_paths_stop(spark):
    back = links(spark).select(graph.F.col("dst").alias("src"), graph.F.col("src").alias("dst"))
    got = sorted(tuple(r.path) for r in graph.paths(back, seed(spark, 1), 10).collect())
    assert got == [(1, 0), (1, 3), (1, 3, 2)]


def test_reach_counts_nodes_once(spark):
    diamond = links(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert sorted((r.node, r.depth) for r in graph.reach(diamond, seed(spark, 1), 5).collect()) == [(2, 1), (3, 1), (4, 2)]
    assert len(graph.paths(diamond, seed(spark, 1), 5).where("node = 4").collect()) == 2


def test_reach_without_depth_goes_to_the_end(spark):
    chain = links(spark, [(i, i + 1) for i in range(30)] + [(30, 0)])
    got = sorted((r.depth, r.node) for r in graph.reach(chain, seed(spark, 0), None).collect())
    assert got == [(i, i) for i in range(1, 31)]
    assert graph.reach(chain, seed(spark, 0)).count() == graph.DEPTH
    assert graph.reach(chain, seed(spark, 0), 99).count() == graph.MAX_DEPTH


def test_shortest_path_with_id_zero(spark):
    got = [r.node for r in graph.shortest_path(links(spark), 0, 4).orderBy("position").collect()]
    assert got == [0, 1, 2, 4]
    assert graph.shortest_path(links(spark), 0, 77).count() == 0


def test_cycle_core_and_self_edges(spark):
    core = {(r.src, r.dst) for r in graph.on_cycles(links(spark)).collect()}
    assert core == {(1, 2), (2, 3), (3, 1)}
    assert (5, 5) not in {(r.src, r.dst) for r in links(spark).collect()}


def test_edges_between_cycles_are_on_none(spark):
    two = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (9, 6), (6, 7), (7, 9), (7, 5)]
    got = sorted((r.src, r.dst) for r in graph.on_cycles(links(spark, two)).collect())
    assert got == [(1, 2), (2, 1), (4, 5), (5, 4), (6, 7), (7, 9), (9, 6)]


def test_empty(spark):
    none = links(spark, [])
    assert graph.reach(none, seed(spark, 1), 3).collect() == []
    assert graph.on_cycles(none).collect() == []


def test_cycles_equal_reachability(spark):
    import random

    rng = random.Random(4)
    for n, m in ((12, 18), (30, 45)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        after = {v: {b for a, b in pairs if a == v} for v in range(n)}

        def reached(v, after=after):
            seen, todo = set(), [v]
            while todo:
                for b in after[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            return seen

        want = {(a, b) for a, b in pairs if a != b and a in reached(b)}
        assert {(r.src, r.dst) for r in graph.on_cycles(links(spark, pairs)).collect()} == want


def test_long_shortest_path(spark):
    chain = links(spark, [(i, i + 1) for i in range(26)] + [(3, 50), (50, 5)])
    assert [r.node for r in graph.shortest_path(chain, 0, 26).orderBy("position").collect()] == list(range(27))
    assert graph.shortest_path(chain, 0, 26, 20).count() == 0
    assert [r.node for r in graph.shortest_path(chain, 4, 4).collect()] == [4]
