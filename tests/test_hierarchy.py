import random

import pytest

from symloom.operators import hierarchy as H
from symloom.operators.hierarchy import descendants, hierarchy

SCHEMA = "id long, parent long, name string, extra int"


def brute(links: dict) -> dict:
    out = {}
    for node in links:
        seen, x = [], node
        while x not in seen:
            seen.append(x)
            parent = links[x]
            if parent is None or parent not in links:
                out[node] = (x, len(seen) - 1, False)
                break
            x = parent
        else:
            out[node] = (min(seen[seen.index(x) :]), None, True)
    return out


@pytest.mark.parametrize("spacing", [3, 1_000_000])
def test_random_forests_with_circles(spark, spacing):
    rng = random.Random(spacing)
    links = {i: (rng.choice([None, 999_999]) if rng.random() < 0.05 else rng.randrange(max(0, i - 6), i + 3)) for i in range(300)}
    links |= {1000 + i: 1000 + i - 1 for i in range(1, 70)} | {1000: None}
    links |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2002, 2004: 2003, 3000: 3000}
    rows = [(i, p, f"n{i}", 1) for i, p in links.items()]
    got = {r.node_id: r for r in hierarchy(spark.createDataFrame(rows, SCHEMA), "id", "parent", "name", spacing).collect()}
    want = brute(links)
    assert set(got) == set(want)
    for node, (root, depth, cyclic) in want.items():
        r = got[node]
        assert (r.root_id, r.depth, r.is_cyclic) == (root, depth, cyclic)
        if not cyclic:
            path, x = [node], node
            while x != root:
                x = links[x]
                path.append(x)
            assert r.path_ids == path[::-1]
            assert r.path_names == [f"n{i}" for i in path[::-1]]
        else:
            assert r.path_ids is None


def test_depth_without_names_and_descendants(spark):
    rows = [(1, None, "a", 0), (2, 1, "b", 0), (3, 2, None, 0), (4, 2, "d", 0), (4, 2, "d", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.node_id, r.depth) for r in hierarchy(df, "id", "parent").collect()) == [(1, 0), (2, 1), (3, 2), (4, 2)]
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in descendants(hierarchy(df, "id", "parent", "name")).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)}


def test_nulls_and_empty_table(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA), "id", "parent", "name").collect() == []
    df = spark.createDataFrame([(None, 1, "x", 0), (0, None, "z", 0), (-5, 0, None, 0)], SCHEMA)
    assert sorted((r.node_id, r.root_id, r.depth) for r in hierarchy(df, "id", "parent").collect()) == [(-5, 0, 1), (0, 0, 0)]


def test_descendants_below_circles(spark):
    rows = [(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (4, 2, "d"), (5, 4, "e"), (6, 5, "f"), (7, None, "g"), (8, 7, "h"), (9, 9, "i"), (10, 9, "j")]
    links = spark.createDataFrame(rows, "id long, parent long, name string")
    tree = H.hierarchy(links, "id", "parent", "name")
    members = H.circle_members(links, tree, "id", "parent")
    assert {(r.id, r.circle, r.on_circle) for r in members.collect()} == {(1, 1, True), (2, 1, True), (3, 1, True), (4, 1, False), (5, 1, False), (6, 1, False), (9, 9, True), (10, 9, False)}
    got = {(r.ancestor_id, r.descendant_id, r.distance) for r in H.descendants(tree, members).collect()}
    assert got == {(2, 4, 1), (2, 5, 2), (2, 6, 3), (4, 5, 1), (4, 6, 2), (5, 6, 1), (7, 8, 1), (9, 10, 1)}
