from symloom.operators import flow, resolve
from symloom.streaming import refresh

S = "id long, name string, symbol_type string, file_id long, start_line int, parent_symbol_id long"
D = "id long, from_symbol_id long, to_symbol_id long, to_symbol string, dependency_type string, line_number int, calling_object string, resolved_class string, qualified_context string"


def test_edges_out_of_names(spark):
    symbols = [
        (1, "main", "function", 1, 1, None), (2, "Kit", "class", 2, 1, None), (3, "save", "method", 2, 3, 2), (4, "Box", "class", 3, 1, None), (5, "save", "method", 3, 3, 4), (6, "IKit", "interface", 4, 1, None), (7, "solo", "function", 5, 1, None),
        (8, "solo", "method", 6, 1, None), (9, None, "function", 1, 9, None), (10, "Colour", "enum", 5, 10, None), (11, "RED", "constant", 5, 11, 10),
    ]
    files = [(1, "a.ts"), (2, "kit.ts"), (3, "box.js"), (4, "face.ts"), (5, "solo.vue"), (6, "solo.php")]
    call = lambda i, to, obj=None, cls=None, ctx=None, kind="calls": (i, 1, None, to, kind, i, obj, cls, ctx)
    deps = [
        call(1, "Kit.save"), call(2, "save", ctx="Box.other"), call(3, "save"), call(4, "save", obj="x"), call(5, "save", obj="x", cls="Kit"), call(6, "solo<T>"), call(7, "this.save"), call(8, "System.save"), call(9, "Colour.RED"), call(10, None), call(11, "save", ctx="Nothing"),
        call(12, "save", kind="references"), call(13, "main", kind="imports"), call(14, "main"), call(15, "IKit.save"), (16, 2, 6, "IKit", "implements", 1, None, None, None), call(17, "save", kind="contains"), call(2, "save", ctx="Box.other"),
    ]
    built = resolve.build_edges(spark.createDataFrame(deps, D), spark.createDataFrame(symbols, S), spark.createDataFrame(files, "id long, path string"))
    got = {(r.line_number, r.to_id): r.strategy for r in built.where("from_id = 1").collect()}
    assert got == {(1, 3): "qualified", (2, 5): "context", (5, 3): "context", (6, 7): "name", (9, 11): "qualified", (11, 3): "first", (12, 3): "name", (12, 5): "name", (14, 1): "name", (15, 3): "interface"}
    none = spark.createDataFrame([], D)
    assert resolve.build_edges(none, spark.createDataFrame(symbols, S), spark.createDataFrame(files, "id long, path string")).collect() == []


def test_virtual_symbols(spark):
    imports = spark.createDataFrame([(1, "vue"), (2, "vue/server"), (3, "@a/b/c"), (4, "./x"), (5, "@/y"), (None, "vue")], "file_id long, source string")
    got = {r.name: (r.id < 0, r.importers) for r in resolve.virtual_symbols(imports).collect()}
    assert got == {"vue": (True, 2), "@a/b": (True, 1)}


def stack(spark):
    d = spark.createDataFrame([(1, 2, "calls", 5, "(a)", None), (2, 3, "calls", 6, "(null)", None), (4, 3, "inherits", 7, None, None), (1, 2, "calls", 5, "(a)", None), (None, 3, "calls", 1, None, None)], "from_symbol_id long, to_symbol_id long, dependency_type string, line_number int, parameter_context string, qualified_context string")
    a = spark.createDataFrame([(5, 3, "GET", "/x", 9), (6, 1, "POST", "/y", 2)], "caller_symbol_id long, endpoint_symbol_id long, http_method string, endpoint_path string, line_number int")
    s = spark.createDataFrame([(i, f"n{i}" if i != 4 else None, "method", None, f"app/K{i}.php" if i != 5 else None) for i in range(1, 7)], "id long, name string, symbol_type string, qualified_name string, path string")
    return flow.stack_edges(d, a), s


def test_who_calls(spark):
    edges, s = stack(spark)
    rows = lambda **k: {(r.caller_id, r.depth, r.caller, r.kind, r.is_cross_stack) for r in flow.who_calls(3, edges, s, **k).collect()}
    assert rows() == {(2, 1, "K2.n2", "calls", False), (4, 1, "unknown", "inherits", False)}
    assert rows(depth=3) == rows() | {(1, 2, "K1.n1", "calls", False)}
    assert rows(cross_stack=True) == rows() | {(5, 1, "n5", "api_call", True)}
    assert rows(kind="calls") == {(2, 1, "K2.n2", "calls", False)}
    assert flow.who_calls(77, edges, s, depth=2).collect() == []
    assert [tuple(r) for r in flow.parameter_analysis(3, edges).collect()] == [("(null)", 1, "6", True)]


def test_trace_flow(spark):
    edges, _ = stack(spark)
    path = lambda rows: [r.node for r in sorted(rows, key=lambda r: (r.path, r.position))]
    assert path(flow.trace_flow(6, 3, edges).collect()) == [6, 1, 2, 3]
    assert path(flow.trace_flow(6, 3, edges, all_paths=True).collect()) == [6, 1, 2, 3]
    assert flow.trace_flow(3, 6, edges, all_paths=True).collect() == [] and flow.trace_flow(1, 4, edges).collect() == []


def test_refresh(spark):
    import hashlib

    text = "function keep() {}\nfunction fresh() {}\n"
    files = spark.createDataFrame([(1, 1, "a.js", "old"), (2, 1, "b.js", hashlib.sha256(b"function same() {}").hexdigest()), (3, 1, "c.js", "x")], "id long, repo_id long, path string, content_hash string")
    texts = spark.createDataFrame([(1, 1, "a.js", "javascript", text), (2, 1, "b.js", "javascript", "function same() {}")], "file_id long, repo_id long, path string, language string, content string")
    symbols = spark.createDataFrame([(10, "keep", "keep", "function", 1, 1), (11, "gone", "gone", "function", 1, 2), (12, "same", "gone", "function", 2, 1), (13, "lost", "lost", "function", 3, 1)], "id long, name string, qualified_name string, symbol_type string, file_id long, start_line int")
    d = spark.createDataFrame([(1, 12, 11, "gone", "calls"), (2, 12, 10, "keep", "calls"), (3, 11, 12, "same", "calls"), (4, 12, 11, "nowhere", "imports"), (5, 12, 11, "nowhere", "calls")], "id long, from_symbol_id long, to_symbol_id long, to_qualified_name string, dependency_type string")
    got = {(r.kind, r.fate): r.rows for r in refresh.refresh(files, texts, symbols, d).collect()}
    assert got == {("symbol", "kept"): 2, ("symbol", "reparsed"): 1, ("symbol", "removed"): 1, ("symbol", "added"): 1, ("edge", "kept"): 1, ("edge", "removed"): 1, ("edge", "relinked"): 1, ("edge", "unlinked"): 1, ("edge", "orphaned"): 1}
    whole = {(r.kind, r.fate): r.rows for r in refresh.refresh(files, texts, symbols, d, complete=True).collect()}
    assert whole["symbol", "removed"] == 2
