"""Edges of names that many symbols bear: what they cost, and rows of one edge told in several ways."""

import random

import duckdb
import pytest

from symloom.operators import resolve
from symloom.plans import flow_queries

S = "id long, name string, symbol_type string, file_id long, start_line int, parent_symbol_id long"
D = "id long, from_symbol_id long, to_symbol_id long, to_symbol string, dependency_type string, line_number int, calling_object string, resolved_class string, qualified_context string"
F = "id long, path string"
HOT = 600


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A folder where HOT symbols of one name are referred to HOT times, a third of them from the same file."""
    folder = str(tmp_path_factory.mktemp("hot"))
    symbols = [(i, "Item", "method", i % 3, i, None, 0) for i in range(HOT)]
    kinds = ("references", "contains", "calls")
    d = [(i, i, None, "Item", kinds[i % 3] if i % 2 else "imports", i, None, None, None, 0) for i in range(HOT)]
    for name, rows, schema in (("symbols", symbols, S), ("dependencies", d, D), ("files", [(i, f"{i}.ts", 0) for i in range(3)], F)):
        spark.createDataFrame(rows, f"{schema}, updated_at long").write.parquet(f"{folder}/{name}.parquet")
    return folder


def shuffled(spark) -> int:
    """Rows that all stages so far wrote for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_counts_of_a_hot_name_shuffle_no_product(spark, hot):
    before = shuffled(spark)
    got = {(r.kind, r.strategy): r.edges for r in flow_queries.rs04_resolution_strategies(spark, hot).collect()}
    # of every six: three imports, one each of the others; contained ones lie in the file they ask from
    assert got == {("imports", "name"): HOT // 2 * (HOT - 1), ("references", "name"): HOT // 6 * (HOT - 1), ("contains", "name"): HOT // 6 * (HOT // 3 - 1)}
    assert shuffled(spark) - before < 30 * HOT


def tables(spark, seed: int):
    """Symbols and dependencies with names, qualified ones and lines that often coincide."""
    r = random.Random(seed)
    pick = r.choice
    names = ["A", "B", "I", "save", "load", "x", "Node", None, "a.b", ""]
    kinds = ["class", "interface", "method", "enum", "constant", "property", "function"]
    symbols = [(i, pick(names), pick(kinds), pick([1, 2, 3, None]), pick([1, 2, 3, None]), pick([None, *range(60)])) for i in range(60)]
    asked = ["A", "save", "A.save", "I.load", "B.x", "I.save", "x.save", "System.save", "save<T>", "Node", "Node.x", None, ".x", "A.", "a.b", ""]
    d = [
        (i, pick([0, 1, 2, 3, 70, None]), pick([None, *range(60)]), pick(asked), pick(["calls", "references", "contains", "implements", None]), pick([1, 2, None]), pick([None, None, "o"]), pick([None, None, "A", "field_call__a"]), pick([None, "B.q"]))
        for i in range(500)
    ]
    return spark.createDataFrame(d, D), spark.createDataFrame(symbols, S), spark.createDataFrame([(1, "a.ts"), (2, "b.ts"), (3, None)], F)


@pytest.mark.parametrize("seed", [1, 4])
def test_counts_are_those_of_the_edges(spark, seed):
    all_ = tables(spark, seed)
    rows = resolve.build_edges(*all_).collect()
    counts = {(r.kind, r.strategy): r.edges for r in resolve.edge_counts(*all_).collect()}
    want = {}
    for r in rows:
        want[r.kind, r.strategy] = want.get((r.kind, r.strategy), 0) + 1
    assert rows and counts == want


def test_edges_of_a_hot_name_shuffle_no_product(spark, hot):
    before = shuffled(spark)
    edges = flow_queries.rs01_built_edges(spark, hot)
    got = {r.kind: r.n for r in edges.groupBy("kind").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {"imports": HOT // 2 * (HOT - 1), "references": HOT // 6 * (HOT - 1), "contains": HOT // 6 * (HOT // 3 - 1)}
    assert shuffled(spark) - before < 30 * HOT
    assert edges.distinct().count() == sum(got.values())


@pytest.mark.parametrize("seed", [2, 3])
def test_edges_told_in_several_ways_are_those_of_the_twin(spark, seed):
    d, s, f = tables(spark, seed)
    built = resolve.build_edges(d, s, f).select("from_id", "to_id", "kind", "line_number")
    con = duckdb.connect()
    for name, df, schema in (("dependencies", d, D), ("symbols", s, S), ("files", f, F)):
        kinds = ", ".join(f"{c} {'VARCHAR' if kind == 'string' else 'BIGINT'}" for c, kind in (part.split() for part in schema.split(", ")))
        con.execute(f"CREATE TABLE {name} ({kinds}, updated_at BIGINT DEFAULT 0)")
        con.executemany(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ({', '.join('?' * len(df.columns))})", [list(r) for r in df.collect()])
    want = con.execute(flow_queries.ORACLES["rs01_built_edges"]).fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert want and order(built.collect()) == order(want)
