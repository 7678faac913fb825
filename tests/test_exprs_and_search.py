from pyspark.sql import functions as F

from symloom.functions import exprs as X
from symloom.operators import crossstack, deadcode, resolve, search
from symloom.streaming import refresh


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


def test_paths_and_urls(spark):
    p = F.col("p")
    assert one(spark, X.is_test_path(p), p="src/a.test.ts") and not one(spark, X.is_test_path(p), p="src/latest.ts")
    assert one(spark, X.in_skipped_directory(p), p="a/node_modules/b.js") and not one(spark, X.in_skipped_directory(p), p="a/b/dist")
    assert one(spark, X.language_of_path(p), p="A.CS") == "csharp"
    u = F.col("u")
    assert one(spark, X.normal_url(u), u="/Users/{id}/?x=1") == one(spark, X.normal_url(u), u="users/:userId") == "users/{param}"
    assert one(spark, X.feature_name(F.col("n")), n="getUserService") == "User"
    assert one(spark, X.ignored(p, ["# c", "*.min.js", "!keep"]), p="a/x.min.js")


def test_lexical_and_fulltext(spark):
    rows = [(1, "findUser", None, "looks up"), (2, "user", "user()", None), (3, None, None, None), (4, "UserService", "class UserService", "finds users")]
    s = spark.createDataFrame(rows, "id long, name string, signature string, description string")
    assert [r.id for r in search.lexical(s, "user").collect()][0] == 4
    assert search.lexical(s, "  ").collect() == [] and search.fulltext(s, "!!").collect() == []
    assert {r.id for r in search.fulltext(s, "user find").collect()} == {1}


def test_vector_and_hybrid(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.similarity) for r in search.vector(v, [1.0, 0.0]).collect()] == [(1, 1.0)]
    ranked = spark.createDataFrame([(7, 0), (8, 1)], "id long, position int")
    assert [r.id for r in search.hybrid({"lexical": ranked, "vector": ranked}, 5).collect()] == [7, 8]


def test_cover_density(spark):
    from itertools import product

    texts = ["a x b", "a b", "b a a b", "x y", "a x x x b x a", "c a b c", "a c x b a b c", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, name string").withColumns({"signature": search.F.lit(None).cast("string"), "description": search.F.lit("")})
    for query in (["a", "b"], ["a", "b", "c"], ["a"]):
        want = {}
        for i, t in enumerate(texts):
            w = t.split()
            spans = [(p, q) for p, q in product(range(len(w)), repeat=2) if p <= q and set(query) <= set(w[p : q + 1])]
            least = [(p, q) for p, q in spans if not any((p, q) != (c, d) and p <= c and d <= q for c, d in spans)]
            if least:
                want[i] = round(sum(0.1 / (1 + sum(x not in query for x in w[p : q + 1])) for p, q in least), 6)
        assert {r.id: r.rank for r in search.fulltext(df, " ".join(query)).collect()} == want


def test_neighbours_equal_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(40)] + [(40, None), (41, [1.0]), (42, [0.0] * 4), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id, r.similarity) for r in search.neighbours(v.where("vec_id % 5 = 0"), v, 0.1, 4).collect()}
    want = set()
    for q, a in rows[:40:5]:
        near = []
        for i, b in rows[:40]:
            s = round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6)
            if s >= 0.1:
                near.append((-s, i))
        want |= {(q, i, -s) for s, i in sorted(near)[:4]}
    assert got == want
    assert search.neighbours(v.where("false"), v).collect() == []


def test_dead_code_and_routes(spark):
    schema = "id long, file_id long, name string, symbol_type string, entity_type string, signature string, is_exported boolean"
    rows = [
        (1, 9, "a", "function", None, None, False), (2, 9, "b", "function", None, None, True), (3, 9, "main", "function", None, None, False), (4, 9, "run", "function", None, None, False), (5, 9, "go", "method", None, "private void go()", False),
        (6, 9, "x", "property", None, None, False), (7, 9, "Kit", "class", None, None, None), (8, 9, None, "method", None, None, None), (9, 9, "Face", "interface", None, None, False), (10, 9, "act", "method", None, None, False), (11, 8, "t", "function", None, None, False), (12, None, "no", "function", None, None, False),
    ]
    s = spark.createDataFrame(rows, schema)
    f = spark.createDataFrame([(9, 1, "src/a.ts"), (8, 1, "src/a.test.ts")], "id long, repo_id long, path string")
    d = spark.createDataFrame([(3, 1, "calls"), (7, 9, "implements"), (None, None, "calls")], "from_symbol_id long, to_symbol_id long, dependency_type string")
    got = {r.id: (r.category, r.confidence) for r in deadcode.findings(s, d, f, include_exports=True).collect()}
    assert got == {2: ("unused_export", "low"), 4: ("dead_function", "low"), 5: ("interface_bloat", "high"), 7: ("dead_class", "low"), 9: ("dead_function", "medium"), 10: ("interface_bloat", "high"), 8: ("dead_public_method", "high")}
    assert {r.id for r in deadcode.findings(s, d, f, threshold="high").collect()} == {5, 8, 10}
    assert deadcode.findings(s.where("false"), d, f).collect() == []
    calls = spark.createDataFrame([(1, 1, 5, 8, "get", "/A/{x}"), (2, 1, 6, None, "GET", "a/:id/")], "id long, repo_id long, caller_symbol_id long, endpoint_symbol_id long, http_method string, endpoint_path string")
    assert [(r.id, r.handler_id) for r in crossstack.matched(calls).collect()] == [(2, 8)]


def test_snapshots(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "path string, content_hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None), ("w", "1")], "path string, content_hash string")
    assert {r.path: r.state for r in refresh.changes(a, b).collect()} == {"x": "same", "y": "changed", "z": "same", "w": "new"}
    out = refresh.refreshed(a, b.where("path = 'y'"), a.where("path = 'x'"), "path").collect()
    assert sorted((r.path, r.content_hash) for r in out) == [("y", "2"), ("z", None)]


def test_stream_windows(spark, tmp_path):
    import datetime

    rows = [(datetime.datetime(2024, 1, 1, 0, m), "view", 1.0) for m in (1, 2, 59)] + [(datetime.datetime(2024, 1, 1, 2, 0), "view", 2.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = refresh.event_counts(stream).writeStream.outputMode("update").format("memory").queryName("windows_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.events for r in spark.sql("select events from windows_test").collect()) == [1, 3]
